"""Grouping records into similarity clusters: density clustering in overlapping partitions.

Two records belong together when a chain of similar records joins them (every record with
a similar one is a core point). Both kinds of record follow the same steps:

1. Exact copies fold into one point, so a value held by a third of all rows is one point.
2. Points are spread over partitions that overlap. Vectors are reduced to their principal
   axes and go to the cell of their nearest centre, and to every cell whose border with it
   is within the margin. Paths go to the cells of their rarest 3-character substrings.
3. Each partition clusters its points by exact similarity of the full records and names
   each local cluster by its smallest id.
4. A point that lies in several partitions carries the name of its local cluster in each;
   the names it shares are merged by distributed connected components.
5. A partition of more points than one task holds has several blocks. Each holds a part of
   the points that must be compared with all (vectors: those at home in the cell; paths:
   stored ones), and all points of the partition pass by. Points of one cluster never meet again.
6. Within a partition few pairs are compared. Vectors at home are spread over small cells
   again. Cells of paths are split by the next substrings that a pair must share, ordered by
   their frequency within the cell.

Margin of the vector cells: a pair at the similarity limit, apart in any direction alike,
differs along one border's normal by about chord / sqrt(d). When a border runs between the
two, the nearer one is at most half of that away, so the margin is ``sigmas`` times half of it.
Centres closer than ``SPACING`` margins can't be told apart and count as one. Paths need no
margin: sets with Jaccard similarity >= t share one of their rarest substrings (prefix
filter), for any fixed order of the substrings.

Nulls and unusable records belong to no group. Ids are counted once, with their latest row.
Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.blocks import Forest, binary_column, fixed_rows, kmeans, nearest, runs, slices
from siltstone.llm.similar_vectors import current_ids, distinct_vectors, unit_vectors
from siltstone.runtime import cut_lineage, shuffle_width, skew_join, width_for

#: Bounds of the sample that places the centres, and of their number.
SAMPLE_ROWS, MOST_SAMPLE, MOST_CELLS = 16_384, 1 << 20, 8_192
#: Margins between two centres, pilot points of a dense partition, buckets of counted substrings.
SPACING, PILOTS, BUCKETS = 3.0, 256, 1 << 16
#: Cells of vectors up to which they keep their size, and pairs of paths from which a cell is split by further substrings, up to which cells are compared together.
FEW_CELLS, SPLIT_PAIRS, FEW_PAIRS = 32, 8_000_000, 2048


# --- components -----------------------------------------------------------------------


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of the component of each id in edges (u, v).

    Alternating large-star and small-star steps; each keeps at most one edge for every old
    edge, hubs are reduced to their minimum before the join and salted in it. Rounds grow with
    the logarithm of the longest chain and end when the edges stay the same. Lineage is cut
    each round in the shared checkpoint folder.
    """
    e = cut_lineage(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = skew_join(both, least.select("u", "m"), ["u"], ["v"], counts=least.select("u", "n")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        e = cut_lineage(small)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def merge_stars(stars: DataFrame) -> DataFrame:
    """(gid, cluster) from (gid, lab): local clusters that share a point become one."""
    stars = cut_lineage(stars.distinct())
    least = stars.groupBy("gid").agg(F.min("lab").alias("least"), F.collect_set("lab").alias("labs"))
    links = least.where(F.size("labs") > 1).select(F.col("least").alias("v"), F.explode("labs").alias("u")).where("u != v")
    roots = connected(links)
    point = least.select("gid", F.col("least").alias("id"))
    return point.join(roots, "id", "left").select("gid", F.coalesce("root", "id").alias("cluster"))


def _star_batch(forest: Forest) -> pa.RecordBatch:
    ids, roots = forest.stars()
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], names=["gid", "lab"])


def join_block(forest: Forest, a_ids: np.ndarray, b_ids: np.ndarray, similar: np.ndarray) -> None:
    """Join the pairs marked in a block; each row needs only one link to its first partner and each column one to a linked row."""
    hit_rows = np.flatnonzero(similar.any(1))
    if not len(hit_rows):
        return
    block = similar[hit_rows]
    labels = np.arange(len(hit_rows))
    columns = np.flatnonzero(block.any(0))
    owner = block[:, columns].argmax(0)
    for c, r in zip(columns.tolist(), owner.tolist()):
        forest.join(int(b_ids[c]), int(a_ids[hit_rows[r]]))
    # rows that share a column with its owner
    r, c = np.nonzero(block[:, columns]) if block.sum() < 4_000_000 else (None, None)
    if r is not None:
        links = np.unique(labels[r] * np.int64(len(labels)) + owner[c])
        for x in links.tolist():
            i, j = divmod(x, len(labels))
            if i != j:
                forest.join(int(a_ids[hit_rows[i]]), int(a_ids[hit_rows[j]]))
        return
    for i in range(len(hit_rows)):
        for j in np.unique(owner[block[i, columns]]).tolist():
            if i != j:
                forest.join(int(a_ids[hit_rows[i]]), int(a_ids[hit_rows[j]]))


def one_tree(forest: Forest, ids: np.ndarray) -> bool:
    """Whether all ids are joined already, so that no further comparison among them can change a cluster."""
    root = forest.find(int(ids[0]))
    return all(forest.find(i) == root for i in ids.tolist())


# --- partitions in blocks -------------------------------------------------------------


def scrambled(ids: np.ndarray, salt: int = 0) -> np.ndarray:
    """Whole numbers below 2^40 that look random, from ids."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(salt + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(24)).astype(np.int64)


def block_copies(gid: np.ndarray, rows: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, block) of every copy of points in partitions of ``rows`` rows and ``blocks`` blocks: each in its block, pilots in all of them."""
    one = np.arange(len(gid))
    mine = scrambled(gid) % blocks
    pilot = np.flatnonzero((blocks > 1) & (scrambled(gid, 1) % np.maximum(1, rows // PILOTS) == 0))
    if not len(pilot):
        return one, mine
    times = blocks[pilot]
    who = np.repeat(pilot, times)
    every = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
    away = every != mine[who]
    return np.concatenate([one, who[away]]), np.concatenate([mine, every[away]])


def block_duties(gid: np.ndarray, stored: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, block, stored) of points in partitions of ``blocks`` blocks: a stored point is stored in one block, and every
    point is compared with what each block stores, so no pair of a partition is missed."""
    at = np.repeat(np.arange(len(gid)), blocks)
    block = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return at, block, stored[at] & (block == (scrambled(gid) % blocks)[at])


def major_tree(forest: Forest, ids: np.ndarray) -> tuple[np.ndarray, int] | None:
    """(mask, root) of the ids of the tree that holds more than half of them; none if there is no such tree."""
    roots = np.fromiter((forest.find(i) for i in ids.tolist()), np.int64, len(ids))
    root = int(np.partition(roots, len(roots) // 2)[len(roots) // 2])
    mask = roots == root
    return (mask, root) if 2 * int(mask.sum()) > len(ids) else None


# --- vectors --------------------------------------------------------------------------


@dataclass
class Cells:
    """Centres of cells over reduced vectors; a cell of more home rows than a task holds has several blocks."""

    axes: np.ndarray  # dim x dims
    centres: np.ndarray  # cells x dims
    margin: float
    rows: np.ndarray  # expected home rows of each cell
    blocks: np.ndarray


def spaced(centres: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """The heaviest centres that keep the distance ``least`` from each other."""
    kept: list[int] = []
    for i in np.argsort(-weight, kind="stable").tolist():
        if not kept or ((centres[kept] - centres[i]) ** 2).sum(1).min() >= least * least:
            kept.append(i)
    return centres[kept]


def _cells_of(reduced: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, cell, home) of each point in its home cell and in those whose border with it is within the margin."""
    square = (centres * centres).sum(1)
    apart = np.sqrt(np.maximum(square[:, None] - 2 * centres @ centres.T + square, 1e-12))
    out = []
    step = max(1, 4_000_000 // len(centres))
    for i in range(0, len(reduced), step):
        far = square - 2 * reduced[i : i + step] @ centres.T
        home = far.argmin(1)
        one = np.arange(len(far))
        # Distance to the border: (|x - c|^2 - |x - home|^2) / (2 |c - home|).
        who, cell = np.nonzero(far - far[one, home][:, None] <= 2 * margin * apart[home])
        out.append((who + i, cell, cell == home[who]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))


def _centres(reduced: np.ndarray, cells: int, margin: float) -> np.ndarray:
    c = kmeans(reduced, cells)
    return spaced(c, np.bincount(nearest(reduced, c), minlength=len(c)), SPACING * margin)


def place_cells(sample: np.ndarray, total: int, cell_rows: int, dims: int, chord: float, sigmas: float, block_rows: int) -> Cells:
    middle = sample - sample.mean(0)
    values, vectors = np.linalg.eigh(middle.T @ middle / max(1, len(sample)))
    values = np.maximum(values, 0)
    spread = float(values.sum() ** 2 / max((values**2).sum(), 1e-12))
    margin = sigmas * chord / (2 * math.sqrt(max(spread, 1.0)))
    axes = np.ascontiguousarray(vectors[:, ::-1][:, :dims]).astype(np.float32)
    reduced = sample @ axes
    centres = _centres(reduced, int(np.clip(round(total / cell_rows), 1, MOST_CELLS)), margin)
    rows = np.ceil(np.bincount(nearest(reduced, centres), minlength=len(centres)) / max(1, len(sample)) * total).astype(np.int64)
    return Cells(axes, centres, margin, rows, np.maximum(1, np.ceil(rows / block_rows)).astype(np.int64))


def spread_vectors(cells: Cells, dim: int) -> Callable:
    """Arrow batches (gid, vec) to rows of the blocks of the cells they lie in, at home in one block."""
    base = np.cumsum(cells.blocks) - cells.blocks

    def run(batches):
        for batch in batches:
            gid = batch.column(0).to_numpy()
            if not len(gid):
                continue
            who, cell, home = _cells_of(fixed_rows(batch.column(1), np.float32, dim) @ cells.axes, cells.centres, cells.margin)
            at, block, home = block_duties(gid[who], home, cells.blocks[cell])
            who, slot = who[at], (base[cell[at]] + block).astype(np.int32)
            for i in range(0, len(who), 8192):
                take = pa.array(who[i : i + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(slot[i : i + 8192]), pa.array(~home[i : i + 8192]), batch.column(0).take(take), batch.column(1).take(take)], names=["slot", "away", "gid", "vec"])

    return run


def join_rows(forest: Forest, ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, other: np.ndarray, cosine: float) -> None:
    """Join the rows of x and of other at ``cosine`` or above, in blocks that a processor's cache holds."""
    for i in range(0, len(x), 512):
        for j in range(0, len(other), 4096):
            similar = x[i : i + 512] @ other[j : j + 4096].T >= cosine
            if similar.any():
                join_block(forest, ids[i : i + 512], other_ids[j : j + 4096], similar)


def join_similar(forest: Forest, ids: np.ndarray, x: np.ndarray, home: np.ndarray, cosine: float, axes: np.ndarray, margin: float, leaf_rows: int, depth: int = 0) -> None:
    """Join all points at ``cosine`` or above of which one is at home; many points are first spread over cells of their own."""
    if len(ids) > 4 * leaf_rows and depth < 4:
        reduced = x @ axes
        some = np.random.default_rng(depth).permutation(len(x))[:SAMPLE_ROWS]
        centres = _centres(reduced[some], len(ids) // leaf_rows, margin)
        if len(centres) > 1:
            who, cell, own = _cells_of(reduced, centres, margin)
            # Cells help where they hold less than half of the pairs in all.
            sizes = np.bincount(cell, minlength=len(centres)).astype(float)
            if (sizes * np.bincount(cell[own], minlength=len(centres))).sum() < 0.5 * len(ids) * home.sum():
                order = np.argsort(cell, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                    at = who[part]
                    join_similar(forest, ids[at], x[at], own[part], cosine, axes, margin, leaf_rows, depth + 1)
                return
    order = np.argsort(~home, kind="stable")
    ids, x, least = ids[order], x[order], int(home.sum())
    for i in range(0, least, 512):
        if i and i & (i - 1) == 0 and (top := major_tree(forest, ids[i:])):
            # Points of one tree never meet again.
            inside, out, own = top[0], ~top[0], np.arange(len(ids) - i) < least - i
            if not out.any():
                return
            ids, x = ids[i:], x[i:]
            join_rows(forest, ids[own & inside], x[own & inside], ids[out], x[out], cosine)
            join_rows(forest, ids[own & out], x[own & out], ids, x, cosine)
            return
        join_rows(forest, ids[i : min(i + 512, least)], x[i : min(i + 512, least)], ids[i:], x[i:], cosine)


class Home:
    """The points at home in a block, joined among themselves, to be compared with the points of its margin as these come in."""

    def __init__(self, forest: Forest, ids: np.ndarray, x: np.ndarray, cosine: float, axes: np.ndarray, margin: float, leaf_rows: int) -> None:
        self.forest, self.ids, self.x, self.cosine, self.axes, self.margin = forest, ids, x, cosine, axes, margin
        self.all = self.own = ()
        if not len(ids):
            return
        join_similar(forest, ids, x, np.ones(len(ids), bool), cosine, axes, margin, leaf_rows)
        reduced = x @ axes
        some = np.random.default_rng(0).permutation(len(x))[:SAMPLE_ROWS]
        self.centres = _centres(reduced[some], len(ids) // leaf_rows, margin) if len(ids) > 4 * leaf_rows else reduced[:1]
        who, cell, own = _cells_of(reduced, self.centres, margin)
        self.all = [self.targets(part, leaf_rows) for part in self._by_cell(who, cell)]
        self.own = [self.targets(part, leaf_rows) for part in self._by_cell(who[own], cell[own])]

    def _by_cell(self, who: np.ndarray, cell: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(cell, kind="stable")
        return np.split(who[order], np.cumsum(np.bincount(cell, minlength=len(self.centres)))[:-1])

    def targets(self, at: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(compared first, compared with those that did not join the root, root): most points of a cell may be in one tree."""
        if len(at) > 2 * leaf_rows and (top := major_tree(self.forest, self.ids[at])):
            inside = at[top[0]]
            return np.concatenate([at[~top[0]], inside[:PILOTS]]), inside[PILOTS:], top[1]
        return at, at[:0], 0

    def meet(self, ids: np.ndarray, y: np.ndarray, targets: tuple[np.ndarray, np.ndarray, int]) -> None:
        first, rest, root = targets
        join_rows(self.forest, ids, y, self.ids[first], self.x[first], self.cosine)
        if len(rest):
            root = self.forest.find(root)
            left = np.array([self.forest.find(i) != root for i in ids.tolist()], bool)
            join_rows(self.forest, ids[left], y[left], self.ids[rest], self.x[rest], self.cosine)

    def compare(self, ids: np.ndarray, y: np.ndarray) -> None:
        """Of two similar points one lies within the margin of the other's cell: points meet all of the cell
        that is nearest to them, and of cells in reach those whose nearest it is."""
        if not len(self.ids):
            return
        who, cell, own = _cells_of(y @ self.axes, self.centres, self.margin)
        for near, targets in ((own, self.all), (~own, self.own)):
            for part, t in zip(self._by_cell(who[near], cell[near]), targets):
                if len(part) and len(t[0]):
                    self.meet(ids[part], y[part], t)


def vector_stars(points: DataFrame, cells: Cells, cosine: float, dim: int, leaf_rows: int) -> DataFrame:
    """(gid, lab) of the local clusters of the blocks of cells of points (gid, vec).

    When a border runs between two similar points one of them lies within the margin of the
    other's cell, so a cell compares only the points at home there with all its points.
    """
    axes, margin = cells.axes, cells.margin

    def pull(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        if not held:
            return np.empty(0, np.int64), np.empty((0, dim), np.float32)
        table = pa.Table.from_batches(held)
        held.clear()
        return table.column("gid").to_numpy(), fixed_rows(table.column("vec"), np.float32, dim)

    def cluster(batches):
        slot, home, held, waiting = None, None, [], 0
        for part in slices(batches, ("slot", "away")):
            at, away = part.column("slot")[0].as_py(), part.column("away")[0].as_py()
            if at != slot:
                if slot is not None:
                    yield _star_batch(finish(home, held))
                slot, home, waiting = at, None, 0
            if away and home is None:
                home = Home(Forest(), *pull(held), cosine, axes, margin, leaf_rows)
            held.append(part)
            waiting += part.num_rows
            if home is not None and waiting >= 32_768:
                home.compare(*pull(held))
                waiting = 0
        if slot is not None:
            yield _star_batch(finish(home, held))

    def finish(home: Home | None, held: list[pa.RecordBatch]) -> Forest:
        if home is None:
            return Home(Forest(), *pull(held), cosine, axes, margin, leaf_rows).forest
        if held:
            home.compare(*pull(held))
        return home.forest

    rows = points.select("gid", "vec").mapInArrow(spread_vectors(cells, dim), "slot int, away boolean, gid bigint, vec binary")
    # A task for each block: the home points are held, those of the margin pass by.
    return rows.repartitionById(int(cells.blocks.sum()), "slot").sortWithinPartitions("slot", "away").mapInArrow(cluster, "gid bigint, lab bigint")


def cluster_vectors(df: DataFrame, id_col: str, vec_col: str, version_col: str | None = None, dim: int = 64, cosine: float = 0.866, cell_rows: int = 8192, leaf_rows: int = 2048, dims: int = 48, sigmas: float = 3.5, block_rows: int = 262_144) -> tuple[DataFrame, DataFrame]:
    """((id, cluster) of every usable id, (id, vec) unit vectors): groups of ids joined by chains at cosine >= ``cosine``.

    Cells of about ``cell_rows`` home rows are sent to tasks, which spread them over cells of
    ``leaf_rows`` of their own: the fewer cells are sent out, the fewer copies lie in margins.
    So beyond ``FEW_CELLS`` cells they grow up to ``block_rows`` home rows before there are more.
    """
    units = cut_lineage(unit_vectors(df, id_col, vec_col, version_col, dim))
    current = cut_lineage(current_ids(units))
    owner = cut_lineage(current.groupBy("vhash").agg(F.min("id").alias("gid"), F.count("*").alias("n")))
    points = cut_lineage(distinct_vectors(units).join(owner, "vhash").select("gid", "vec"))
    total = points.count()
    if not total:
        return current.select("id", F.col("id").alias("cluster")), units
    order = F.xxhash64("gid", F.lit(11))
    cell_rows = min(max(cell_rows, total // FEW_CELLS), max(cell_rows, block_rows))
    wanted = int(np.clip(256 * total // cell_rows, SAMPLE_ROWS, MOST_SAMPLE))
    some = points.where(F.pmod(order, F.lit(1 << 40)) < math.ceil(min(1.0, 2 * wanted / total) * (1 << 40))).orderBy(order, "gid").limit(wanted)
    sample = fixed_rows(some.select("vec").toArrow().column("vec"), np.float32, dim)
    cells = place_cells(sample, total, cell_rows, dims, math.sqrt(2 - 2 * cosine), sigmas, block_rows)
    clusters = merge_stars(vector_stars(points, cells, cosine, dim, leaf_rows))
    named = skew_join(current, owner.select("vhash", "gid"), ["vhash"], ["id"], counts=owner.select("vhash", "n"))
    return skew_join(named, clusters, ["gid"], ["id"], "left", counts=owner.select("gid", "n")).select("id", F.coalesce("cluster", "gid").alias("cluster")), units


# --- paths ----------------------------------------------------------------------------


def grams_of(text: str) -> np.ndarray:
    """The distinct 3-character substrings as sorted 63-bit numbers."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])


def _bucket(grams: np.ndarray) -> np.ndarray:
    return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def gram_frequencies(points: DataFrame) -> np.ndarray:
    """In how many points a substring of each of 65,536 hash buckets occurs; the table's size does not depend on the data."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts += np.bincount(_bucket(grams_of(text)), minlength=BUCKETS) if len(text) > 4096 else 0
                if len(text) <= 4096:
                    np.add.at(counts, _bucket(grams_of(text)), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    rows = points.select("path").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def _unshared(n: np.ndarray, share: float) -> np.ndarray:
    """How many of n substrings a path may have for itself if it shares at least ``share`` of them."""
    return n - np.ceil(share * n - 1e-9).astype(np.int64)


def path_cells(frequency: np.ndarray, least: float, cell_rows: int) -> Callable:
    """Arrow batches (gid, path) to rows of the cells of each path's rarest substrings.

    A set x that resembles a set at least as large shares one of its first
    |x| - ceil(2t/(1+t)|x|) + 1 substrings (stored) with the first |y| - ceil(t|y|) + 1 of the
    other (probes), in the order of ``frequency``. Of a cell of more than ``cell_rows`` points
    each block stores a part and probes it with all.
    """
    blocks = np.maximum(1, np.ceil(frequency / cell_rows)).astype(np.int64)

    def run(batches):
        for batch in batches:
            gid = batch.column(0).to_numpy()
            who, cells, stored, buckets = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                g = grams_of(text)
                b = _bucket(g)
                first = np.lexsort((g, frequency[b]))[: int(_unshared(len(g), least)) + 1]
                who.append(np.full(len(first), i))
                cells.append(g[first])
                stored.append(np.arange(len(first)) <= _unshared(len(g), 2 * least / (1 + least)))
                buckets.append(b[first])
            if not who:
                continue
            who, cells, stored, buckets = np.concatenate(who), np.concatenate(cells), np.concatenate(stored), np.concatenate(buckets)
            at, block, stored = block_duties(gid[who], stored, blocks[buckets])
            who, cells, block = who[at], cells[at], block.astype(np.int32)
            for i in range(0, len(who), 16_384):
                take = pa.array(who[i : i + 16_384])
                yield pa.RecordBatch.from_arrays([pa.array(cells[i : i + 16_384]), pa.array(block[i : i + 16_384]), pa.array(stored[i : i + 16_384]), batch.column(0).take(take), batch.column(1).take(take)], names=["cell", "block", "stored", "gid", "path"])

    return run


@dataclass
class PathSet:
    """Substring sets of paths as reduced vectors: hashed counts of the distinct substrings, whose
    products are never below the size of the intersection, and bit maps, exact up to a set's own clashes."""

    texts: list[str]
    sizes: np.ndarray
    counts: np.ndarray
    bits: np.ndarray
    clashes: np.ndarray
    grams: np.ndarray  # the substrings of all paths, one path after the other
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[str], hashed: int) -> PathSet:
        parts = [cls._some(texts[i : i + 16_384], hashed) for i in range(0, len(texts), 16_384)]
        sizes, counts, bits, grams = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts))
        return cls(texts, sizes.astype(np.float32), counts, bits, sizes - np.bitwise_count(bits).sum(1).astype(np.float32), grams, np.r_[0, np.cumsum(sizes)])

    @staticmethod
    def _some(texts: list[str], hashed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(texts)
        c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.repeat(np.arange(n), np.fromiter(map(len, texts), np.int64, n))
        inside = np.flatnonzero(rows[:-2] == rows[2:])
        # Characters by their number in these texts, so that path and substring fit one sortable number.
        seen = np.bincount(c) > 0
        chars, rank = np.flatnonzero(seen), np.cumsum(seen)[c] - 1
        m = len(chars)
        key = ((rows[inside] * m + rank[inside]) * m + rank[inside + 1]) * m + rank[inside + 2]
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]]
        key, third = np.divmod(key, m)
        key, second = np.divmod(key, m)
        rows, first = np.divmod(key, m)
        grams = (chars[first] << 42) | (chars[second] << 21) | chars[third]
        mixed = ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64)
        counts = np.bincount(rows * hashed + (mixed * hashed >> 40), minlength=n * hashed).reshape(n, hashed)
        bits = np.zeros((n, 1024), np.uint8)
        bits[rows, (mixed >> 20) & 1023] = 1
        return np.bincount(rows, minlength=n), counts.astype(np.uint16 if counts.max() < 65_536 else np.float32), np.packbits(bits, axis=1).view(np.uint64), grams

    def resembles(self, i: int, j: int, least: float) -> bool:
        x, y = (self.grams[self.starts[k] : self.starts[k + 1]] for k in (i, j))
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= least * (self.sizes[i] + self.sizes[j] - both) - 1e-9

    def likely(self, x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs (x, y) that may resemble each other by their bit maps."""
        part = least / (1 + least)
        most = np.bitwise_count(self.bits[x] & self.bits[y]).sum(1) + np.minimum(self.clashes[x], self.clashes[y])
        ok = most >= part * (self.sizes[x] + self.sizes[y]) - 1e-3
        return x[ok], y[ok]

    def reduced(self, at: np.ndarray, least: float, stored: bool) -> np.ndarray:
        """Counts with two more places, so that a stored one's product with a probe's is the shared substrings less those that a similar pair shares."""
        size = least / (1 + least) * self.sizes[at][:, None]
        one = np.ones_like(size)
        return np.concatenate([self.counts[at].astype(np.float32), *((-size, one) if stored else (one, -size))], axis=1)

    def candidates(self, at: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the paths ``at`` and ``other`` that may resemble each other; x, y: their reduced vectors."""
        p, q = np.divmod(np.flatnonzero(x @ y.T >= -1e-3), len(other))
        return self.likely(at[p], other[q], least)


class PathJoin:
    """Joins the paths of a cell of which one is stored and that resemble each other.

    A cell of many pairs is split again. Let the cell's substring be the first that a pair shares:
    the substrings before it are unshared, which leaves few of the others that may be. In any order
    of these, then, the pair's next shared one is among the first of both, as many as may be unshared
    and one more. The order is by frequency within the cell, so that what goes along with the
    cell's own substring comes last.
    """

    def __init__(self, forest: Forest, ids: np.ndarray, paths: PathSet, least: float) -> None:
        self.forest, self.ids, self.paths, self.least = forest, ids, paths, least

    def run(self, stored: np.ndarray, cell: int, frequency: np.ndarray) -> None:
        n = len(self.ids)
        at = np.flatnonzero(stored)
        if len(at) * n <= SPLIT_PAIRS:
            self.block(at, np.arange(n))
            return
        grams, starts = self.paths.grams, self.paths.starts
        rows = np.repeat(np.arange(n), np.diff(starts))
        often, mine = frequency[_bucket(grams)], frequency[_bucket(np.array([cell]))][0]
        after = (often > mine) | ((often == mine) & (grams > cell))
        sizes = self.paths.sizes.astype(np.int64)
        behind = np.bincount(rows[after], minlength=n)
        before = sizes - behind - 1
        codes = np.unique(grams[after], return_inverse=True)[1].astype(np.int64)
        end = np.cumsum(behind)
        probe = _unshared(sizes, self.least) - before
        store = np.where(stored, _unshared(sizes, 2 * self.least / (1 + self.least)) - before, -1)
        for i in range(0, n, 65_536):
            some = np.flatnonzero(stored | ((np.arange(n) >= i) & (np.arange(n) < i + 65_536)))
            asks = (some >= i) & (some < i + 65_536)
            self.split(codes, some, end[some] - behind[some], end[some], np.where(asks, probe[some], -1), store[some], 1)

    def split(self, codes: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray, probe: np.ndarray, store: np.ndarray, depth: int) -> None:
        """Join rows with ``store`` >= 0 to rows with ``probe`` >= 0: how many of a row's substrings codes[start:end] may be unshared."""
        s, q = np.flatnonzero(store >= 0), np.flatnonzero(probe >= 0)
        if len(s) * len(q) <= SPLIT_PAIRS or depth > 4:
            self.block(rows[s], rows[q])
            return
        self.block(rows[s[:: max(32, len(s) // 64)]], rows[q])
        if top := major_tree(self.forest, self.ids[rows]):
            # Paths of one tree never meet again.
            out = ~top[0]
            for a, b in ((out, top[0] | out), (top[0], out)):
                some = (a & (store >= 0)) | (b & (probe >= 0))
                if (a & (store >= 0)).any() and (b & (probe >= 0)).any():
                    self.parts(codes, rows[some], start[some], end[some], np.where(b, probe, -1)[some], np.where(a, store, -1)[some], depth)
            return
        self.parts(codes, rows, start, end, probe, store, depth)

    def parts(self, codes: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray, probe: np.ndarray, store: np.ndarray, depth: int) -> None:
        n, left = len(rows), end - start
        # Sets so small that nothing more need be shared.
        few = left <= np.maximum(probe, store)
        if few.any():
            self.block(rows[few & (store >= 0)], rows[probe >= 0])
            self.block(rows[store >= 0], rows[few & (probe >= 0)])
            rows, start, end, probe, store, left = (v[~few] for v in (rows, start, end, probe, store, left))
            n = len(rows)
            if not n:
                return
        who = np.repeat(np.arange(n), left)
        mine = codes[np.arange(len(who)) - np.repeat(np.cumsum(left) - left - start, left)]
        often = np.bincount(mine)
        order = np.argsort(often, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = who * len(order) + rank[mine]
        key.sort()
        new = order[key % len(order)]
        first, last = np.cumsum(left) - left, np.cumsum(left)
        at = np.arange(len(who)) - first[who]
        some = np.flatnonzero(at <= np.maximum(probe, store)[who])
        some = some[np.argsort(new[some], kind="stable")]
        r, p = who[some], at[some]
        asks, keeps = probe[r] - p, store[r] - p
        cuts = np.r_[0, np.flatnonzero(np.diff(new[some])) + 1, len(some)]
        held, asked = (np.add.reduceat((v >= 0).astype(np.int64), cuts[:-1]) for v in (keeps, asks))
        size = held * asked
        self.small([(k, rows[r[cuts[k] : cuts[k + 1]]], keeps[cuts[k] : cuts[k + 1]], asks[cuts[k] : cuts[k + 1]]) for k in np.flatnonzero((size > 0) & (size <= FEW_PAIRS)).tolist()])
        for k in np.flatnonzero(size > FEW_PAIRS).tolist():
            a = slice(cuts[k], cuts[k + 1])
            self.split(new, rows[r[a]], some[a] + 1, last[r[a]], asks[a], keeps[a], depth + 1)

    def small(self, cells: list) -> None:
        """All pairs of cells of few pairs, together."""
        x, y, pairs = [], [], 0
        for k, (_, rows, keeps, asks) in enumerate(cells):
            s, q = rows[keeps >= 0], rows[asks >= 0]
            x.append(np.repeat(s, len(q)))
            y.append(np.tile(q, len(s)))
            pairs += len(s) * len(q)
            if pairs > 100_000 or k == len(cells) - 1:
                self.pairs(*self.paths.likely(np.concatenate(x), np.concatenate(y), self.least))
                x, y, pairs = [], [], 0

    def block(self, at: np.ndarray, other: np.ndarray) -> None:
        if not len(at) or not len(other):
            return
        for i in range(0, len(at), 256):
            a = at[i : i + 256]
            if i and i & (i - 1) == 0 and one_tree(self.forest, self.ids[np.concatenate([at[i:], other])]):
                break
            x = self.paths.reduced(a, self.least, True)
            for j in range(0, len(other), 2048):
                b = other[j : j + 2048]
                self.pairs(*self.paths.candidates(a, x, b, self.paths.reduced(b, self.least, False), self.least))

    def pairs(self, x: np.ndarray, y: np.ndarray) -> None:
        """Join the pairs that do resemble each other; in a dense cell most of them are joined before their turn."""
        ids, find = self.ids, self.forest.find
        step = 4096
        while len(x):
            for p, q in zip(x[:step].tolist(), y[:step].tolist()):
                if p != q and find(int(ids[p])) != find(int(ids[q])) and self.paths.resembles(p, q, self.least):
                    self.forest.join(int(ids[p]), int(ids[q]))
            x, y = x[step:], y[step:]
            if len(x):
                seen, back = np.unique(np.concatenate([x, y]), return_inverse=True)
                root = np.fromiter((find(i) for i in ids[seen].tolist()), np.int64, len(seen))[back]
                apart = root[: len(x)] != root[len(x) :]
                x, y = x[apart], y[apart]


def path_stars(points: DataFrame, frequency: np.ndarray, least: float, cell_rows: int, hashed: int, tasks: int) -> DataFrame:
    """(gid, lab) of the local clusters of the cells, or blocks of cells, of points (gid, path)."""

    def cluster(batches):
        for table in runs(batches, ("cell", "block")):
            stored = table.column("stored").to_numpy()
            if table.num_rows < 2 or not stored.any():
                continue
            forest, ids = Forest(), table.column("gid").to_numpy()
            paths = PathSet.of(table.column("path").to_pylist(), hashed)
            PathJoin(forest, ids, paths, least).run(stored, table.column("cell")[0].as_py(), frequency)
            yield _star_batch(forest)

    rows = points.select("gid", "path").mapInArrow(path_cells(frequency, least, cell_rows), "cell bigint, block int, stored boolean, gid bigint, path string")
    return rows.repartition(tasks, "cell", "block").sortWithinPartitions("cell", "block").mapInArrow(cluster, "gid bigint, lab bigint")


def cluster_paths(df: DataFrame, id_col: str, path_col: str, version_col: str | None = None, least: float = 0.5, cell_rows: int = 262_144, hashed: int = 256) -> tuple[DataFrame, DataFrame]:
    """((id, cluster), (id, path)): groups of ids joined by chains of lower-cased paths whose 3-character substrings have Jaccard similarity >= ``least``."""
    version = F.coalesce(F.col(version_col).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")) if version_col else F.lit("0001-01-01").cast("timestamp")
    rows = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(F.struct(version.alias("v"), F.lower(path_col).alias("path"))).alias("m")).select("id", F.col("m.path").alias("path"))
    rows = cut_lineage(rows.where(F.char_length("path") >= 4))
    points = cut_lineage(rows.groupBy("path").agg(F.min("id").alias("gid"), F.count("*").alias("n")))
    frequency = gram_frequencies(points)
    # A path goes to about half as many cells as it has characters; the width follows the table's bytes.
    clusters = merge_stars(path_stars(points, frequency, least, cell_rows, hashed, max(2 * shuffle_width(df.sparkSession), width_for(df.select(path_col), 32))))
    named = skew_join(rows, points.select("path", "gid"), ["path"], ["id"], counts=points.select("path", "n"))
    return skew_join(named.select("id", "gid"), clusters, ["gid"], ["id"], "left", counts=points.select("gid", "n")).select("id", F.coalesce("cluster", "gid").alias("cluster")), rows


# --- description ----------------------------------------------------------------------


def sizeable(members: DataFrame, least: int = 3) -> DataFrame:
    """The members (id, cluster, size) of clusters of at least ``least`` ids."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    return skew_join(members, sizes.where(F.col("size") >= least), ["cluster"], ["id"], counts=sizes, count="size")


def hashed_paths(rows: DataFrame, hashed: int = 64) -> DataFrame:
    """(id, vec): unit vectors of hashed substring counts, for typical members of path clusters."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            v = np.zeros((len(texts), hashed), np.float32)
            for i, t in enumerate(texts):
                v[i] = np.bincount(_bucket(grams_of(t)) % hashed, minlength=hashed)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), binary_column(v)], names=["id", "vec"])

    return rows.select("id", "path").mapInArrow(run, "id bigint, vec binary")


def describe(members: DataFrame, vectors: DataFrame, dim: int = 64, medoids: int = 3) -> DataFrame:
    """(cluster, size, typical): size and the members with the largest summed cosine to all others.

    For unit vectors this sum is the product with the cluster's vector sum, so the medoids need
    one partial-aggregated sum for each cluster and no pairs.
    """

    def unpack(batches):
        for batch in batches:
            x = fixed_rows(batch.column("vec"), np.float32, dim).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), batch.column("size"), *[pa.array(np.ascontiguousarray(x[:, i])) for i in range(dim)]], names=["id", "cluster", "size", *[f"x{i}" for i in range(dim)]])

    shape = "id bigint, cluster bigint, size bigint, " + ", ".join(f"x{i} double" for i in range(dim))
    rows = members.join(vectors.groupBy("id").agg(F.min("vec").alias("vec")), "id").select("id", "cluster", "size", "vec").mapInArrow(unpack, shape)
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(dim)])
    score = sum((F.col(f"x{i}") * F.col(f"s{i}") for i in range(1, dim)), F.col("x0") * F.col("s0"))
    scored = skew_join(rows, sums.drop("n"), ["cluster"], ["id"], counts=sums.select("cluster", "n")).select("cluster", "size", "id", F.round(score, 6).alias("score"))
    w = Window.partitionBy("cluster").orderBy(F.desc("score"), "id")
    top = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= medoids)
    return top.groupBy("cluster").agg(F.max("size").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("typical"))
