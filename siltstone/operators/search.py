"""Nearest-neighbour, metadata and storage search, and the chain of fallbacks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.functions import files, texts

# Bounds of the number of results.
LEAST, MOST, DEFAULT = 1, 50, 10
QUERY_BLOCK, QUERY_SLICE = 16_384, 64
SEARCHED = ("summary_preview", "descriptive_text", "original_name", "storage_uri", "collection_hint")


def clamp_limit(limit: int | str | None) -> int:
    """A limit within 1 and 50; 10 for anything that is no number."""
    try:
        return max(LEAST, min(MOST, int(limit)))
    except (TypeError, ValueError):
        return DEFAULT


def squared_distance(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance in double precision, null for vectors of different length."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    pairs = F.zip_with(x, y, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double")))
    return F.when(F.size(x) == F.size(y), F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v))


def nearest(nodes: DataFrame, query: list[float], k: int, id_col: str = "node_id", vec_col: str = "embedding") -> DataFrame:
    """The k nodes nearest to a query vector with distance and similarity; a top-k per task, merged."""
    q = F.array(*[F.lit(float(v)) for v in query])
    rows = nodes.withColumn("distance", squared_distance(vec_col, q)).where(F.col("distance").isNotNull())
    return rows.orderBy("distance", id_col).limit(k).withColumn("similarity", texts.similarity("distance"))


def _query_blocks(queries: DataFrame, id_col: str, vec_col: str, most: int) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and vectors of the queries in blocks of one length; the driver holds one block of each length."""
    held: dict[int, tuple[list, list]] = {}
    for key, vector in queries.where(F.size(vec_col) > 0).where(~F.exists(vec_col, lambda v: v.isNull())).select(id_col, vec_col).toLocalIterator():
        ids, vectors = held.setdefault(len(vector), ([], []))
        ids.append(key)
        vectors.append(np.array(vector, np.float64))
        if len(ids) == most:
            yield ids, np.stack(vectors)
            del held[len(vector)]
    for ids, vectors in held.values():
        yield ids, np.stack(vectors)


def nearest_each(nodes: DataFrame, queries: DataFrame, k: int, id_col: str = "node_id", vec_col: str = "embedding", keep: tuple[str, ...] = (), block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, *keep, distance, similarity): the k nodes nearest to every query, whose ids are unique.

    Every block of queries meets all nodes. A task keeps the k nearest of each query, ties by
    id, and these are merged. Distances are summed as in ``squared_distance``; vectors that are
    null, hold a null or have another length than the query's take no part.
    """
    spark, id_type = nodes.sparkSession, queries.schema[id_col].dataType
    fields = [f"query_id {id_type.simpleString()}", *[f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in (id_col, *keep)], "distance double"]
    names, order = ["query_id", id_col, *keep, "distance"], [("_q", "ascending"), ("distance", "ascending"), (id_col, "ascending")]
    out = spark.createDataFrame([], ", ".join(fields))
    for ids, vectors in _query_blocks(queries, id_col, vec_col, block):
        shared, dim = spark.sparkContext.broadcast((ids, vectors)), vectors.shape[1]

        def run(batches, shared=shared, dim=dim):
            ids, vectors = shared.value
            ids = pa.array(ids, to_arrow_type(id_type))
            best: dict[int, pa.Table] = {}
            for batch in batches:
                x = np.ascontiguousarray(np.asarray(batch.column(len(keep) + 1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim).T)
                if not x.shape[1]:
                    continue
                for at in range(0, len(vectors), QUERY_SLICE):
                    part = vectors[at : at + QUERY_SLICE]
                    d = np.zeros((len(part), x.shape[1]))
                    for j in range(dim):
                        step = x[j] - part[:, j, None]
                        d += step * step
                    last = min(k, d.shape[1]) - 1
                    q, row = np.nonzero(~(d > np.partition(d, last, axis=1)[:, last, None]))
                    taken = [batch.column(i).take(pa.array(row)) for i in range(len(keep) + 1)]
                    found = pa.table([pa.array(q + at), *taken, pa.array(d[q, row])], names=["_q", id_col, *keep, "distance"])
                    found = pa.concat_tables([best[at], found]) if at in best else found
                    found = found.take(pc.sort_indices(found, sort_keys=order))
                    q = found.column("_q").to_numpy()
                    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
                    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
                    best[at] = found.filter(pa.array(rank < k))
            for found in best.values():
                found = found.combine_chunks()
                named = pa.table([pc.take(ids, found.column("_q")), *[found.column(c) for c in names[1:]]], names=names)
                yield from named.combine_chunks().to_batches()

        usable = nodes.where(F.size(vec_col) == dim).where(~F.exists(vec_col, lambda v: v.isNull())).select(id_col, *keep, vec_col)
        out = out.unionByName(usable.mapInArrow(run, out.schema))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col))
    return out.withColumn("_place", place).where(F.col("_place") <= k).drop("_place").withColumn("similarity", texts.similarity("distance"))


def wants_media(query: str) -> bool:
    return any(w in query.lower() for w in files.MEDIA_WORDS)


def media_filter(hits: DataFrame, query: str, *keys: str) -> DataFrame:
    """For queries that ask for media, only media hits if there are any (for each of ``keys``); hits are a top-k, so few."""
    if not wants_media(query):
        return hits
    media = F.coalesce(F.col("modality").isin("video", "audio", "image"), F.lit(False))
    return hits.withColumn("_any", F.max(media).over(Window.partitionBy(*keys))).where(media | ~F.col("_any")).drop("_any")


def metadata_search(meta: DataFrame, query: str, limit: int, id_col: str = "file_id", columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Files one of whose fields holds the query, whatever its case; the first by id."""
    hit = F.lit(False)
    for c in columns:
        if c in meta.columns:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(query.lower()))
    return meta.where(hit if query else F.lit(False)).orderBy(id_col).limit(limit)


def storage_search(paths: DataFrame, query: str, limit: int, path_col: str = "path") -> DataFrame:
    """Stored files whose path or name holds the query."""
    text = F.lower(F.concat(F.col(path_col), F.lit(" "), files.file_name(path_col)))
    return paths.where(F.contains(text, F.lit(query.lower())) if query else F.lit(False)).orderBy(path_col).limit(limit)


def first_filled(*results: tuple[str, DataFrame]) -> DataFrame:
    """The rows of the first result that has any, labelled with its source. Results are limited, so the window is small."""
    parts = [df.withColumn("source", F.lit(name)).withColumn("_rank", F.lit(i)) for i, (name, df) in enumerate(results)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    return union.withColumn("_first", F.min("_rank").over(Window.partitionBy())).where("_rank = _first").drop("_rank", "_first")


def with_download_path(hits: DataFrame, root: str, path_col: str = "path") -> DataFrame:
    p = files.relative_path(path_col, root)
    return hits.withColumn("download_path", p).withColumn(path_col, F.coalesce(p, F.col(path_col)))


def display_rows(hits: DataFrame, path_col: str = "path", id_col: str = "node_id") -> DataFrame:
    """What a result list shows: the last path segment and whether it is a chunk."""
    return hits.withColumn("name", files.file_name(path_col)).withColumn("is_chunk", F.contains(F.col(id_col), F.lit(":chunk:")))


def flattened(nodes: DataFrame) -> DataFrame:
    """Nodes with the fields of their metadata as columns."""
    have = set(nodes.columns)
    return nodes.select(*[c for c in nodes.columns if c != "metadata"], *[F.col(f"metadata.{f}").alias(f if f not in have else f"meta_{f}") for f in nodes.schema["metadata"].dataType.names])


def mean_pool(vectors: DataFrame, key: str, vec_col: str) -> DataFrame:
    """(key, embedding): the mean of each group's vectors at unit length; a zero mean stays zero.

    One partial average for each position, so that no number becomes a row; null vectors and
    positions that a shorter vector lacks don't count.
    """
    dim = vectors.agg(F.max(F.size(vec_col))).first()[0] or 0
    means = vectors.groupBy(key).agg(*[F.avg(F.get(vec_col, F.lit(i)).cast("double")).alias(f"_m{i}") for i in range(dim)])
    mean = F.array_compact(F.array(*[F.col(f"_m{i}") for i in range(dim)]).cast("array<double>"))
    rows = means.select(key, mean.alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("_n", norm).select(key, F.transform("mean", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(x)).alias("embedding"))


def joined_captions(captions: DataFrame, key: str, order: str, text_col: str) -> DataFrame:
    """(key, caption): each group's distinct captions in order, joined by bars; a group is one file's sampled frames."""
    lists = captions.where(F.col(text_col).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, text_col))).alias("l"))
    return lists.select(key, F.array_join(F.array_distinct(F.transform("l", lambda s: s[text_col])), " | ").alias("caption"))
