"""Documents and media files as metadata rows, chunks and embedding nodes.

Input rows are files (file_id, file_name, text, tenant_id ...); every step is a projection, so a
pipeline is one scan. Null and blank texts become the line "PDF document: <name>" and give
one chunk; extra columns pass the projections by.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import files, texts

DEFAULT_TENANT = "tenant_default"


def content(text: Column | str, name: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    n = F.col(name) if isinstance(name, str) else name
    return F.when(texts.is_blank(t), F.concat(F.lit("PDF document: "), n)).otherwise(t)


def metadata(docs: DataFrame) -> DataFrame:
    """One row for each file: names, topic (from the summary), previews and sizes."""
    name = F.col("file_name")
    full = docs.withColumn("content", content("text", "file_name")).withColumn("summary", texts.first_sentences("content", "file_name"))
    return full.select(
        F.coalesce("file_id", F.sha2(name, 256)).alias("file_id"),
        name.alias("original_name"),
        F.coalesce("tenant_id", F.lit(DEFAULT_TENANT)).alias("tenant_id"),
        texts.topic("summary").alias("collection_hint"),
        texts.preview("summary").alias("summary_preview"),
        "summary",
        files.extension("file_name").alias("extension"),
        files.modality("file_name").alias("modality"),
        F.char_length("content").cast("bigint").alias("size_chars"),
    )


def chunks(docs: DataFrame, size: int = texts.CHUNK, overlap: int = texts.OVERLAP) -> DataFrame:
    """One row for each chunk of each file with its topic; write with ``partitionBy("collection")``."""
    full = docs.withColumn("content", content("text", "file_name")).withColumn("summary", texts.first_sentences("content", "file_name")).withColumn("collection", texts.topic("summary"))
    return full.select("file_id", F.coalesce("tenant_id", F.lit(DEFAULT_TENANT)).alias("tenant_id"), "collection", F.posexplode(texts.character_chunks("content", size, overlap)).alias("chunk_index", "chunk")).select("file_id", "tenant_id", "collection", "chunk_index", F.col("chunk").alias("text"), F.char_length("chunk").alias("chunk_size"))


def nodes(docs: DataFrame, encoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Embedding nodes {file_id}:file and {file_id}:chunk:{i}; without an encoder the embedding is null."""
    embed = (lambda c: encoder(c)) if encoder else (lambda c: F.lit(None).cast("array<float>"))
    base = docs.withColumn("content", content("text", "file_name")).withColumn("summary", texts.first_sentences("content", "file_name")).withColumn("collection", texts.topic("summary"))
    meta = lambda kind, index: F.struct(F.col("file_id"), F.lit(kind).alias("node_type"), files.modality("file_name").alias("modality"), F.col("collection"), F.col("file_name").alias("path"), index.alias("chunk_index"))
    whole = base.select(F.concat("file_id", F.lit(":file")).alias("node_id"), F.col("summary").alias("text"), meta("file", F.lit(None).cast("int")).alias("metadata"))
    parts = base.select("*", F.posexplode(texts.character_chunks("content")).alias("i", "chunk")).select(F.concat("file_id", F.lit(":chunk:"), F.col("i").cast("string")).alias("node_id"), F.col("chunk").alias("text"), meta("chunk", F.col("i")).alias("metadata"))
    return whole.unionByName(parts).withColumn("embedding", embed(F.col("text")))


def media_fallback(media: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Metadata of media without an encoder: a summary that names kind and file, collection media_assets."""
    kind = files.media_type(name_col)
    return media.select(F.col(name_col).alias("original_name"), kind.alias("modality"), F.concat(texts.title_case(kind), F.lit(" file "), F.col(name_col)).alias("summary"), F.lit("media_assets").alias("collection_hint"), F.expr("cast(null as array<float>)").alias("embedding"))


def stored_names(rows: DataFrame, folder_col: str, name_col: str, order_col: str, taken_col: str | None = None) -> DataFrame:
    """rows + stored_name: names that occur again in a folder get _1, _2 ... in order, after ``taken_col`` that are there already.

    A folder that holds a third of all files is no window: only equal names meet.
    """
    w = Window.partitionBy(folder_col, name_col).orderBy(order_col)
    before = F.coalesce(taken_col, F.lit(0)) if taken_col else F.lit(0)
    return rows.withColumn("stored_name", files.collision_name(name_col, F.row_number().over(w) - 1 + before))


def sanitized_row(row: DataFrame) -> DataFrame:
    """Every column as a metadata value."""
    return row.select(*[sanitized(F.col(f"`{f.name}`"), f.dataType.simpleString()).alias(f.name) for f in row.schema.fields])


def sanitized(value: Column, kind: str) -> Column:
    """Metadata values: texts, numbers and flags as they are, everything else as JSON text."""
    return value if kind in ("string", "int", "bigint", "smallint", "tinyint", "float", "double", "boolean") else F.to_json(value)
