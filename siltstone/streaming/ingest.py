"""Upload loop as a file stream: new files are ingested batch by batch, each exactly once.

An extension beside the batch calls. Sinks are idempotent by key (insert-if-absent
and batch folders overwritten under the same batch id), so a restarted batch leaves no twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions import files
from siltstone.operators import documents
from siltstone.sources.readers import full_text


def watch_folder(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New files below a folder as a stream of (path, length, content)."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)


def ingest_documents(stream: DataFrame, out: str, checkpoint: str, tenant: str = documents.DEFAULT_TENANT) -> StreamingQuery:
    """Write metadata and chunks of each batch below ``out``; runs until all present files are done."""

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = df.where(~files.is_media("path")).select(F.sha2(F.col("path"), 256).alias("file_id"), files.file_name("path").alias("file_name"), full_text("content", files.extension("path")).alias("text"), F.lit(tenant).alias("tenant_id"))
        documents.metadata(rows).write.mode("overwrite").parquet(f"{out}/files/batch={batch_id}")
        documents.chunks(rows).write.mode("overwrite").partitionBy("collection").parquet(f"{out}/chunks/batch={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time_col: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of each key in tumbling windows; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
