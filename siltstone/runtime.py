"""Session helpers shared by every operator."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in so many rows; at most as many keys can be.
HOT_PARTS = 1024
#: Bytes of input for each task of a shuffle whose width follows the data.
TASK_BYTES = 64 << 20


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder.

    The folder named by ``spark.checkpoint.dir`` wins. Where the session names none, a private
    one is made if everything runs in this one process; on a cluster that is an error, as
    executors can't read each other's disks.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not is_one_process(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="siltstone-ckpt-"))


def is_one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *partitions: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder by partition columns and read from there, so that filters on them skip files."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def width_for(df: DataFrame, times: float = 1.0) -> int:
    """Tasks for a shuffle of ``times`` the bytes of ``df``: the session's number, more where a task's share would exceed TASK_BYTES."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0
    return max(shuffle_width(df.sparkSession), min(1_000_000, math.ceil(known * times / TASK_BYTES)))


def hot_keys(counts: DataFrame, keys: list[str], count: str = "n", parts: int = HOT_PARTS) -> DataFrame:
    """(keys, _salts) of the keys of ``counts`` that hold more than 1 in ``parts`` of all rows; fewer than ``parts`` rows, whatever the data."""
    total = counts.agg(F.sum(count).alias("_total"))
    top = counts.orderBy(F.desc(count)).limit(parts).join(F.broadcast(total))
    salts = F.ceil(F.col(count) * parts / F.col("_total")).cast("int")
    return top.where(F.col(count) * parts > F.col("_total")).select(*keys, salts.alias("_salts"))


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how: str = "inner", counts: DataFrame | None = None, count: str = "n") -> DataFrame:
    """``big`` joined with ``small`` on ``keys``, one of which may hold a third of the rows of ``big``.

    Rows of a hot key are spread by a hash of the ``spread`` columns over salts in proportion to
    its count, and the rows of ``small`` of that key are repeated for each of them; all
    other keys meet once. ``counts`` (keys, n) saves counting ``big``. ``how`` is inner,
    left, left_semi or left_anti; null keys match nothing.
    """
    seen = counts if counts is not None else big.groupBy(*keys).agg(F.count("*").alias("n"))
    found = hot_keys(seen.where(F.col(keys[0]).isNotNull()), keys, count)
    rows = found.toArrow()  # fewer than HOT_PARTS rows
    if not rows.num_rows:
        return big.join(small, keys, how)
    hot = F.broadcast(big.sparkSession.createDataFrame(rows, found.schema))
    salts = F.coalesce("_salts", F.lit(1))
    left = big.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_salts")
    right = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
