"""Most similar vectors for every vector: inverted file, product quantisation, exact reranking.

Plan, for N rows:

1. ``unit_vectors`` normalises the usable vectors (Arrow batches) and drops the rest; they
   are packed to 16 bits a number and written once.
2. ``vector_groups`` keeps each id once (its latest row) and folds copies of any norm into
   one group, so that a vector held by a third of all rows is searched once. A group
   carries its smallest ids only (``k`` + 2 of them), found with a pre-shuffle group limit.
3. ``train`` fits coarse centroids and residual codebooks on a bounded sample of distinct
   vectors.
4. Every group goes to the list of its nearest centroid, and as a query to the lists of
   its nearest centroids (``probes``). One list is one Arrow group: residual codes are
   scanned with asymmetric distance tables, the best are reranked with the stored vectors.
   A list that outgrew ``SUBLISTED`` rows, as centroids are bounded, is scanned by sublists
   of its own, found in the list, so that a query's cost doesn't follow the collection.
5. The answers of the lists are merged per group and unfolded to ids.

Null, short, long, zero or non-finite vectors have no row in the result and are nobody's
neighbour. Ties go to the smaller id. A collection with fewer than k + 1 ids gives shorter
lists, an empty one no rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.blocks import binary_column, fixed_rows, kmeans, list_column, nearest, usable_matrix
from siltstone.runtime import cut_lineage, shuffle_width, skew_join

#: Bounds of the training sample (rows) and of the centroids that the driver fits and sends out.
SAMPLE_ROWS, SAMPLE_PER_LIST, MOST_LISTS = 32_768, 32, 8_192
#: Rows from which a list has sublists of its own, and rows of a list that one task takes.
SUBLISTED, CELL_ROWS = 16_384, 65_536
#: Lists searched for each query, and how many doublings of the lists add one more.
LEAST_PROBES, FREE_DOUBLINGS = 4, 3


@dataclass(frozen=True)
class Index:
    dim: int
    centroids: np.ndarray  # lists x dim
    codebooks: np.ndarray  # parts x 256 x (dim / parts)
    split: np.ndarray  # sublists of each list
    base: np.ndarray  # first sublist of each list


def probes(lists: int) -> int:
    """Lists searched for each query: 4 up to 128 lists, one more for each doubling."""
    return max(LEAST_PROBES, math.ceil(math.log2(max(1, lists))) - FREE_DOUBLINGS)


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, version_col: str | None, dim: int, packed: bool = False) -> DataFrame:
    """(id, version, vec, vhash): usable vectors at unit length as float32 bytes, or ``packed`` to 16 bits a number.

    ``vhash`` is a hash of the unit vector at 16 bits a number, so that copies of another
    norm meet; vectors of one hash have a cosine above 1 - 1e-7.
    """

    def run(batches):
        import xxhash

        for batch in batches:
            at, x = usable_matrix(batch.column(1), dim)
            if len(at):
                take = pa.array(at)
                coarse = (np.rint(x * 32767) + 0.0).astype(np.int16).view(np.uint8).reshape(len(x), -1)
                digest = np.array([xxhash.xxh3_64_intdigest(row) for row in map(bytes, coarse)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), binary_column(_pack(x) if packed else x), pa.array(digest)], names=["id", "version", "vec", "vhash"])

    version = F.col(version_col).cast("timestamp") if version_col else F.lit(None).cast("timestamp")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("e"), version.alias("version"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("e") == dim)).select("id", "e", "version")
    return rows.mapInArrow(run, "id bigint, version timestamp, vec binary, vhash bigint")


def current_ids(units: DataFrame) -> DataFrame:
    """(id, vhash) of the latest row of each id; vectors are not moved."""
    return units.groupBy("id").agg(F.max(F.struct(F.coalesce("version", F.lit("0001-01-01").cast("timestamp")), "vhash")).alias("m")).select("id", F.col("m.vhash").alias("vhash"))


def group_members(current: DataFrame, keep: int) -> DataFrame:
    """(vhash, members): the ``keep`` smallest ids of each distinct vector."""
    w = Window.partitionBy("vhash").orderBy("id")
    return current.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).groupBy("vhash").agg(F.sort_array(F.collect_list("id")).alias("members"))


def distinct_vectors(units: DataFrame) -> DataFrame:
    """(vhash, vec): of the vectors of one hash that of the smallest id."""
    return units.groupBy("vhash").agg(F.min_by("vec", F.struct("id", "version")).alias("vec"))


def vector_groups(units: DataFrame, members: DataFrame) -> DataFrame:
    """(gid, vhash, vec, members): one row for each distinct vector of a current id."""
    return distinct_vectors(units).join(members, "vhash").select(F.col("members")[0].alias("gid"), "vhash", "vec", "members")


def bounded_sample(units: DataFrame, total: int, rows: int) -> list[bytes]:
    """At most ``rows`` distinct vectors, those whose hash comes first; copies and repeated ids count once before any row is sent."""
    order = F.xxhash64("vhash", F.lit(11))
    some = units.where(F.pmod(order, F.lit(1 << 40)) < math.ceil(min(1.0, 2 * rows / max(total, 1)) * (1 << 40)))
    picked = distinct_vectors(some).orderBy(order, "vhash").limit(rows)
    return picked.select("vec").toArrow().column("vec")


def train(sample: np.ndarray, total: int, list_rows: int, parts: int) -> Index:
    """Centroids for lists of about ``list_rows`` rows and residual codebooks; lists that one task can't take are split."""
    dim = sample.shape[1]
    lists = int(np.clip(round(total / list_rows), 1, MOST_LISTS))
    centroids = kmeans(sample, lists)
    at = nearest(sample, centroids)
    share = np.bincount(at, minlength=len(centroids)) / max(1, len(sample))
    split = np.maximum(1, np.ceil(share * total / CELL_ROWS)).astype(np.int64)
    rest = (sample - centroids[at])[:16_384]
    width = dim // parts
    books = np.zeros((parts, 256, width), np.float32)
    for m in range(parts):
        c = kmeans(rest[:, m * width : (m + 1) * width], 256, rounds=8, seed=m)
        books[m, : len(c)] = c
        books[m, len(c) :] = c[0]
    return Index(dim, centroids, books, split, np.cumsum(split) - split)


def _pack(x: np.ndarray) -> np.ndarray:
    """Unit vectors in 16 bits a number with a scale for each; the error of a dot product is about 4e-6."""
    scale = np.abs(x).max(1) / 32767
    out = np.empty((len(x), 4 + 2 * x.shape[1]), np.uint8)
    out[:, :4] = scale.astype(np.float32)[:, None].view(np.uint8)
    out[:, 4:] = np.rint(x / scale[:, None]).astype(np.int16).view(np.uint8)
    return out


def _unpack(raw: np.ndarray) -> np.ndarray:
    scale = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    return np.ascontiguousarray(raw[:, 4:]).view(np.int16).astype(np.float32) * scale


def route(groups: DataFrame, index: Index, nprobe: int) -> DataFrame:
    """Home rows (with members) and visiting queries of each list."""
    schema = "cell bigint, home boolean, gid bigint, vec binary, members array<bigint>"
    nprobe = min(nprobe, len(index.centroids))

    def run(batches):
        half = 0.5 * (index.centroids**2).sum(1)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            gid = batch.column(0).to_numpy()
            packed = fixed_rows(batch.column(1), np.uint8, 4 + 2 * index.dim)
            score = _unpack(packed) @ index.centroids.T - half
            top = np.argpartition(-score, nprobe - 1, axis=1)[:, :nprobe]
            first = np.take_along_axis(score, top, 1).argmax(1)
            home = top[np.arange(n), first]
            sub = gid % index.split[home]
            cell = index.base[home] + sub
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.ones(n, bool)), batch.column(0), batch.column(1), batch.column(2).cast(pa.list_(pa.int64()))], names=["cell", "home", "gid", "vec", "members"])
            who = np.repeat(np.arange(n), nprobe)
            lists = top.ravel()
            times = index.split[lists]
            who, lists = np.repeat(who, times), np.repeat(lists, times)
            cells = index.base[lists] + np.arange(len(lists)) - np.repeat(np.cumsum(times) - times, times)
            away = cells != cell[who]
            who, cells = who[away], cells[away]
            for i in range(0, len(who), 16_384):
                w = who[i : i + 16_384]
                yield pa.RecordBatch.from_arrays([pa.array(cells[i : i + 16_384]), pa.array(np.zeros(len(w), bool)), pa.array(gid[w]), binary_column(packed[w]), pa.nulls(len(w), pa.list_(pa.int64()))], names=["cell", "home", "gid", "vec", "members"])

    return groups.select("gid", "vec", "members").mapInArrow(run, schema)


def residual_codes(stored: np.ndarray, centroid: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """parts x rows: the code word of each part of each residual."""
    rest, width = stored - centroid, codebooks.shape[2]
    return np.stack([nearest(rest[:, m * width : (m + 1) * width], codebooks[m]) for m in range(len(codebooks))]).astype(np.intp)


def scan_list(queries: np.ndarray, codes: np.ndarray, codebooks: np.ndarray, want: int, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (query, stored) of one list, by asymmetric distance tables over residual codes.

    A query's table holds its dot products with all code words; a stored vector's score is
    the sum of ``parts`` table entries. About ``want`` best-scored rows are returned for
    each query (never fewer than ``want`` / 3 where the list has them).
    """
    n, (parts, _, width) = codes.shape[1], codebooks.shape
    if n <= want:
        return np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
    probe = np.linspace(0, n - 1, min(n, 1024)).astype(np.intp)
    rank = max(2, round(want * len(probe) / n))
    found_q, found_x = [], []
    acc = np.empty((n, block), np.float32)
    part = np.empty((n, block), np.float32)
    for start in range(0, len(queries), block):
        q = queries[start : start + block]
        b = len(q)
        if b != block:
            acc, part = np.empty((n, b), np.float32), np.empty((n, b), np.float32)
        for m in range(parts):
            table = codebooks[m] @ q[:, m * width : (m + 1) * width].T
            if m:
                np.take(table, codes[m], axis=0, out=part, mode="clip")
                acc += part
            else:
                np.take(table, codes[m], axis=0, out=acc, mode="clip")
        some = np.ascontiguousarray(acc[probe].T)
        cut = np.partition(some, len(probe) - rank, axis=1)[:, len(probe) - rank]
        xi, qi = np.divmod(np.flatnonzero(acc >= cut), b)
        few = np.flatnonzero(np.bincount(qi, minlength=b) < want // 3)
        if len(few):
            keep = ~np.isin(qi, few)
            best = np.argpartition(-acc[:, few], want - 1, axis=0)[:want]
            xi, qi = np.concatenate([xi[keep], best.ravel()]), np.concatenate([qi[keep], np.tile(few, want)])
        found_q.append(qi + start)
        found_x.append(xi)
    return np.concatenate(found_q), np.concatenate(found_x)


def scan_sublists(queries: np.ndarray, codes: np.ndarray, codebooks: np.ndarray, sub: np.ndarray, home: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``scan_list``, in the nearest sublists of each query only; ``sub`` are their centroids, ``home`` that of each row."""
    visit = min(len(sub), probes(len(sub)))
    top = np.argpartition(0.5 * (sub * sub).sum(1) - queries @ sub.T, visit - 1, axis=1)[:, :visit]
    found_q, found_x = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(len(sub)):
        who, rows = np.flatnonzero((top == i).any(1)), np.flatnonzero(home == i)
        if len(who) and len(rows):
            q, x = scan_list(queries[who], codes[:, rows], codebooks, want)
            found_q.append(who[q])
            found_x.append(rows[x])
    return np.concatenate(found_q), np.concatenate(found_x)


def best_of(qi: np.ndarray, xi: np.ndarray, queries: np.ndarray, stored: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best stored vectors of each query after exact comparison; a query is not its own answer.

    Query, distance in millionths and rank of the id make one 63-bit number for each pair, so
    one sort orders all pairs with ties by id.
    """
    if len(queries) > 1 << 21 or len(ids) > 1 << 21:
        raise ValueError("a block of a list holds more than 2^21 rows")
    away = own[qi] != ids[xi]
    qi, xi = qi[away], xi[away]
    sim = np.empty(len(qi), np.float32)
    for i in range(0, len(qi), 16_384):
        sim[i : i + 16_384] = np.einsum("ij,ij->i", queries[qi[i : i + 16_384]], stored[xi[i : i + 16_384]])
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    apart = np.clip(np.rint((1.0 - sim.astype(np.float64)) * 1_000_000), 0, (1 << 21) - 1).astype(np.int64)
    key = (qi.astype(np.int64) << 42) | (apart << 21) | rank[xi]
    key.sort()
    qi = key >> 42
    counts = np.bincount(qi, minlength=len(queries))
    at = np.arange(len(qi)) - np.repeat(np.cumsum(counts) - counts, counts)
    key = key[at < k]
    return key >> 42, by_id[key & ((1 << 21) - 1)], 1.0 - ((key >> 21) & ((1 << 21) - 1)) / 1_000_000


def search(routed: DataFrame, index: Index, k: int, want: int) -> DataFrame:
    """(gid, members, near): for each visit of a query to a list, its k nearest ids there as (minus similarity, id)."""
    owner = np.repeat(np.arange(len(index.split)), index.split)
    schema = "gid bigint, members array<bigint>, near array<struct<d:double,id:bigint>>"

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        home = table.column("home").to_numpy()
        here, away = np.flatnonzero(home), np.flatnonzero(~home)
        out = pa.schema([("gid", pa.int64()), ("members", pa.list_(pa.int64())), ("near", pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())])))])
        gids, vec = table.column("gid").to_numpy(), table.column("vec")
        queries = _unpack(fixed_rows(vec.take(pa.array(np.r_[here, away])), np.uint8, 4 + 2 * index.dim))
        stored = queries[: len(here)]
        own, ids = np.concatenate([gids[here], gids[away]]), gids[here]
        if not len(stored):
            return out.empty_table()
        codes = residual_codes(stored, index.centroids[owner[int(table.column("cell")[0].as_py())]], index.codebooks)
        members = table.column("members").take(pa.array(here)).combine_chunks()
        if isinstance(members, pa.ChunkedArray):
            members = pa.concat_arrays(members.chunks)
        offsets, flat = members.offsets.to_numpy(), members.values.to_numpy()
        sub = None
        if len(stored) > SUBLISTED:
            some = np.random.default_rng(5).permutation(len(stored))[: SAMPLE_ROWS]
            sub = kmeans(stored[some], round(4 * len(stored) / SUBLISTED))
            home = nearest(stored, sub)
        q_all, d_all, n_all = [], [], []
        for s in range(0, len(queries), 4096):
            part = queries[s : s + 4096]
            qi, xi = scan_list(part, codes, index.codebooks, want) if sub is None else scan_sublists(part, codes, index.codebooks, sub, home, want)
            qi, xi, sim = best_of(qi, xi, part, stored, own[s : s + 4096], ids, k)
            held = np.minimum(np.diff(offsets)[xi], k)
            reps = np.repeat(np.arange(len(xi)), held)
            within = np.arange(len(reps)) - np.repeat(np.cumsum(held) - held, held)
            q_all.append(qi[reps] + s)
            d_all.append(-sim[reps])
            n_all.append(flat[offsets[xi[reps]] + within])
        q, d, n = np.concatenate(q_all), np.concatenate(d_all), np.concatenate(n_all)
        counts = np.bincount(q, minlength=len(queries))
        at = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
        keep = at < k
        near = list_column(pa.StructArray.from_arrays([pa.array(d[keep]), pa.array(n[keep])], names=["d", "id"]), np.minimum(counts, k))
        groups = pa.concat_arrays([members.cast(pa.list_(pa.int64())), pa.nulls(len(away), pa.list_(pa.int64()))])
        return pa.Table.from_arrays([pa.array(own), groups, near], schema=out)

    # By number, so that lists of few bytes but many comparisons are not packed into few tasks.
    return routed.repartition(max(shuffle_width(routed.sparkSession), len(owner)), "cell").groupBy("cell").applyInArrow(run, schema)


def knn_graph(df: DataFrame, id_col: str, vec_col: str, version_col: str | None = None, dim: int = 64, k: int = 5, list_rows: int = 4096, nprobe: int | None = None, parts: int = 16, want: int = 160) -> DataFrame:
    """(id, near): the k most similar other ids of every usable id, as an ascending array of (d = minus cosine, id).

    ``nprobe`` lists (by default ``probes`` of their number) of about ``list_rows`` vectors are
    searched for each query; both are the dials between cost and recall. Recall against brute
    force is measured in tests/llm and the README.
    """
    units = cut_lineage(unit_vectors(df, id_col, vec_col, version_col, dim, packed=True))
    total = units.count()
    lists = int(np.clip(round(total / list_rows), 1, MOST_LISTS))
    sample = _unpack(fixed_rows(bounded_sample(units, total, max(SAMPLE_ROWS, SAMPLE_PER_LIST * lists)), np.uint8, 4 + 2 * dim))
    if not len(sample):
        return units.select("id", F.expr("cast(null as array<struct<d:double,id:bigint>>)").alias("near")).where("false")
    index = train(sample, total, list_rows, parts)
    current = cut_lineage(current_ids(units))
    members = group_members(current, k + 2)
    found = search(route(vector_groups(units, members), index, nprobe or probes(len(index.centroids))), index, k, want)
    merged = found.groupBy("gid").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"), F.flatten(F.collect_list("members")).alias("members"))
    copies = F.transform(F.filter("members", lambda m: m != F.col("id")), lambda m: F.struct(F.lit(-1.0).alias("d"), m.alias("id")))
    listed = merged.withColumn("id", F.explode("members")).select("id", F.slice(F.concat(copies, "near"), 1, k).alias("near"))
    # Groups with more copies than are listed: the rest have the k smallest ids of the group as neighbours.
    full = members.where(F.size("members") == k + 2)
    rest = skew_join(current, full, ["vhash"], ["id"], counts=current.groupBy("vhash").agg(F.count("*").alias("n")))
    rest = rest.where(F.col("id") > F.col("members")[k + 1]).select("id", F.transform(F.slice("members", 1, k), lambda m: F.struct(F.lit(-1.0).alias("d"), m.alias("id"))).alias("near"))
    return listed.unionByName(rest)


def neighbour_pairs(graph: DataFrame, least: float) -> DataFrame:
    """(node_lo, node_hi): distinct pairs with cosine >= least where one is among the neighbours of the other."""
    near = graph.select("id", F.explode("near").alias("n")).where(F.col("n.d") <= -least)
    return near.select(F.least("id", "n.id").alias("node_lo"), F.greatest("id", "n.id").alias("node_hi")).distinct()
