"""Clusters against brute-force components."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.llm import clusters as C


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def grams(p):
    return {p[i : i + 3] for i in range(len(p) - 2)}


def test_connected(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(3000, 4000), rng.randrange(3000, 4000)) for _ in range(700)]
    got = {r["id"]: r["root"] for r in C.connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert got == {i: r for i, r in want.items() if i in got} and {x for a, b in edges if a != b for x in (a, b)} == set(got)


def test_join_block_is_complete():
    rng = np.random.default_rng(4)
    for density in (0.002, 0.05, 0.9):
        s = rng.random((60, 80)) < density
        f = C.Forest()
        C.join_block(f, np.arange(60), np.arange(100, 180), s)
        want = components([*range(60), *range(100, 180)], [(int(a), 100 + int(b)) for a, b in zip(*np.nonzero(s))])
        assert all(f.find(i) == r for i, r in want.items())


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist(), "a", 0) for i, v in zip(ids if ids is not None else range(len(x)), x)], "node_no bigint, e array<float>, gid string, lab int")


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = np.repeat(rng.normal(size=(12, 64)), 60, axis=0) * 0.8 + 0.7 * rng.normal(size=(720, 64))
    near = base[rng.integers(720, size=900)] + 0.25 * rng.normal(size=(900, 64))
    chain = near[rng.integers(900, size=300)] + 0.25 * rng.normal(size=(300, 64))
    x = np.concatenate([base, near, chain]).astype(np.float32)
    members, _ = C.cluster_vectors(vectors(spark, x), "node_no", "e", cell_rows=400, leaf_rows=50)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.866, 1))
    assert {r["id"]: r["cluster"] for r in members.collect()} == components(range(len(x)), zip(a.tolist(), b.tolist()))


def test_cells_hold_every_link():
    """Of two similar points one lies in the other's home cell."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 64))
    x = centres[rng.integers(40, size=4000)] + 0.35 * rng.normal(size=(4000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    cells = C.place_cells(x, len(x), 200, 48, 0.5177, 3.5, 32_768)
    assert len(cells.centres) > 10
    who, cell, home = C._cells_of(x @ cells.axes, cells.centres, cells.margin)
    assert home.sum() == len(x) and len(who) < 8 * len(x)
    own = np.empty(len(x), int)
    own[who[home]] = cell[home]
    inside = set(zip(who.tolist(), cell.tolist()))
    a, b = np.nonzero(np.triu(x @ x.T >= 0.866, 1))
    found = [(i, own[j]) in inside or (j, own[i]) in inside for i, j in zip(a.tolist(), b.tolist())]
    assert len(found) > 1000 and np.mean(found) >= 0.999


def test_centres_of_one_dense_region_count_once():
    rng = np.random.default_rng(11)
    x = np.concatenate([np.eye(64)[0] + 0.01 * rng.normal(size=(900, 64)), rng.normal(size=(100, 64))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = C.place_cells(x, 100_000, 1000, 48, 0.5177, 3.5, 20_000)
    assert sorted(cells.blocks)[-1] >= 5 and (cells.rows.sum() < 100_000 * 60)
    near = ((x[:900] @ cells.axes)[:, None] - cells.centres) ** 2
    assert len(np.unique(near.sum(2).argmin(1))) == 1


def test_partitions_in_blocks_lose_nothing(spark):
    """A dense region of many blocks, small groups at its edge, and chains across blocks."""
    rng = np.random.default_rng(12)
    dense = np.eye(64)[0] + 0.04 * rng.normal(size=(700, 64))
    edge = np.eye(64)[0] + 0.12 * rng.normal(size=(200, 64))
    apart = np.concatenate([c + 0.05 * rng.normal(size=(40, 64)) for c in rng.normal(size=(6, 64)) * 0.3 + np.eye(64)[1]])
    x = np.concatenate([dense, edge, apart]).astype(np.float32)
    members, _ = C.cluster_vectors(vectors(spark, x), "node_no", "e", cell_rows=400, leaf_rows=100, block_rows=90)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.866, 1))
    assert {r["id"]: r["cluster"] for r in members.collect()} == components(range(len(x)), zip(a.tolist(), b.tolist()))


def test_block_copies():
    gid = np.arange(20_000)
    who, block = C.block_copies(gid, np.full(20_000, 20_000), np.full(20_000, 10))
    sizes = np.bincount(block)
    assert len(sizes) == 10 and sizes.max() < 2000 + 2 * C.PILOTS + 200
    assert (np.bincount(who) >= 1).all() and 0 < (np.bincount(who) == 10).sum() < 3 * C.PILOTS
    who, block = C.block_copies(gid, np.full(20_000, 20_000), np.ones(20_000, int))
    assert len(who) == 20_000 and not block.any()


def test_local_cells_equal_all_pairs():
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(60, 64))
    x = centres[rng.integers(60, size=3000)] + 0.3 * rng.normal(size=(3000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    cells = C.place_cells(x, 3000, 3000, 48, 0.5177, 3.5, 32_768)
    a, b = C.Forest(), C.Forest()
    C.join_similar(a, np.arange(3000), x, np.ones(3000, bool), 0.866, cells.axes, cells.margin, 100)
    C.join_similar(b, np.arange(3000), x, np.ones(3000, bool), 0.866, cells.axes, cells.margin, 3000)
    assert [a.find(i) for i in range(3000)] == [b.find(i) for i in range(3000)]


def test_copies_and_dirt(spark):
    rng = np.random.default_rng(7)
    hot = rng.normal(size=64)
    rows = [(i, (hot * 2).tolist()) for i in range(300)] + [(1000 + i, rng.normal(size=64).tolist()) for i in range(20)] + [(2000, None), (2001, []), (2002, [0.0] * 64), (5, (hot * 2).tolist())]
    df = spark.createDataFrame(rows, "n bigint, e array<float>")
    members, vec = C.cluster_vectors(df, "n", "e")
    found = C.sizeable(members)
    assert found.count() == 300 and {r["cluster"] for r in found.collect()} == {0}
    group = C.describe(found, vec).first()
    assert group["size"] == 300 and group["typical"] == [0, 1, 2]
    empty, _ = C.cluster_vectors(df.where("false"), "n", "e")
    assert empty.count() == 0


def some_paths(n, seed):
    rng = random.Random(seed)
    syllables = ["ra", "ko", "mil", "stu", "pren", "za", "lo", "gri", "ten", "vo"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5)))
    tops = ["finance/budget", "sales/orders", "media/images"]
    out = []
    for _ in range(n):
        p = rng.choice(tops) + "/" + "/".join(word() for _ in range(4))
        out.append(p)
        for _ in range(rng.choice([0, 0, 1, 4])):
            q = list(rng.choice(out[-5:]))
            for _ in range(rng.randrange(1, 7)):
                q[rng.randrange(len(q))] = rng.choice("abcxyz/")
            out.append("".join(q)[: rng.randrange(20, 80)])
    return out


def test_paths_against_brute_force(spark):
    paths = some_paths(300, 8)
    rows = [(i, p.upper() if i % 9 == 0 else p, "clash") for i, p in enumerate(paths)]
    members, _ = C.cluster_paths(spark.createDataFrame(rows, "plan_no bigint, path string, gid string"), "plan_no", "path", cell_rows=40)
    sets = [grams(p.lower()) for p in paths]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])]
    assert {r["id"]: r["cluster"] for r in members.collect()} == components(range(len(paths)), links)


def test_a_root_that_all_paths_share(spark):
    """Half of each path's substrings are hot; a third of the paths make one dense group."""
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    root = "/company/archive/"
    paths = [root + "reports/" + word(4) for _ in range(250)] + [root + word(rng.randrange(10, 24)) for _ in range(250)] + [root[:9] + word(14) for _ in range(60)]
    paths = list(dict.fromkeys(paths))
    members, _ = C.cluster_paths(spark.createDataFrame(list(enumerate(paths)), "plan_no bigint, path string"), "plan_no", "path", cell_rows=60)
    sets = [grams(p) for p in paths]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])]
    assert {r["id"]: r["cluster"] for r in members.collect()} == components(range(len(paths)), links)


def test_short_null_and_hot_paths(spark):
    rows = [(1, None), (2, ""), (3, "abc"), (4, "ABCD"), (5, "abcd"), (6, "abcd"), (7, "абвг"), (8, "abcd"), (8, "abcd")] + [(100 + i, "same/path/for/all") for i in range(200)]
    members, paths = C.cluster_paths(spark.createDataFrame(rows, "n bigint, p string"), "n", "p")
    found = C.sizeable(members).groupBy("cluster").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in found.collect()} == {(4, 4), (100, 200)}
    groups = {r["cluster"]: r for r in C.describe(C.sizeable(members), C.hashed_paths(paths)).collect()}
    assert groups[4]["typical"] == [4, 5, 6]


def test_medoids(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=64) + 0.1 * rng.normal(size=(9, 64))
    members, vec = C.cluster_vectors(vectors(spark, x.astype(np.float32)), "node_no", "e")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert C.describe(C.sizeable(members), vec).first()["typical"][0] == int((u @ u.T).sum(1).argmax())


def test_groups_by_size(spark):
    sizes = defaultdict(int)
    m = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "id bigint, cluster bigint")
    for r in C.sizeable(m).collect():
        sizes[r["cluster"]] += 1
    assert sizes == {1: 3}


def test_large_path_cells_are_split(monkeypatch):
    """Cells of many pairs compare few of them and join what all pairs do."""
    paths = list(dict.fromkeys(p.lower() for p in some_paths(500, 21) if len(p) >= 4)) + ["aaaa", "aaab", "abab", "ababa"]
    frequency = np.zeros(C.BUCKETS, np.int64)
    for p in paths:
        np.add.at(frequency, C._bucket(C.grams_of(p)), 1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(paths))), pa.array(paths)], names=["gid", "path"])
    links = [(i, j) for i in range(len(paths)) for j in range(i) if 2 * len(grams(paths[i]) & grams(paths[j])) >= len(grams(paths[i]) | grams(paths[j]))]
    compared = []
    candidates, likely = C.PathSet.candidates, C.PathSet.likely
    monkeypatch.setattr(C.PathSet, "candidates", lambda self, at, x, other, y, least: (compared.append(len(at) * len(other)), candidates(self, at, x, other, y, least))[1])
    monkeypatch.setattr(C.PathSet, "likely", lambda self, x, y, least: (compared.append(len(x)), likely(self, x, y, least))[1])
    monkeypatch.setattr(C, "FEW_PAIRS", 50)
    pairs = {}
    for split, block_rows in ((10**9, 10**6), (1000, 10**6), (1000, 100)):
        monkeypatch.setattr(C, "SPLIT_PAIRS", split)
        compared.clear()
        table = pa.Table.from_batches(C.path_cells(frequency, 0.5, block_rows)([batch])).to_pylist()
        cells = defaultdict(list)
        for r in table:
            cells[r["cell"], r["block"]].append(r)
        forest = C.Forest()
        for (cell, _), rows in cells.items():
            stored = np.array([r["stored"] for r in rows])
            if len(rows) > 1 and stored.any():
                C.PathJoin(forest, np.array([r["gid"] for r in rows]), C.PathSet.of([r["path"] for r in rows], 256), 0.5).run(stored, cell, frequency)
        assert {i: forest.find(i) for i in range(len(paths))} == components(range(len(paths)), links)
        pairs[split, block_rows] = sum(compared)
    assert pairs[1000, 10**6] < 0.7 * pairs[10**9, 10**6]


def test_margin_passes_by_the_points_at_home():
    """A block joins all similar pairs of which one is at home and no pair of its margin, in a dense region too."""
    rng = np.random.default_rng(22)
    centres = rng.normal(size=(50, 64))
    x = np.concatenate([centres[rng.integers(50, size=1500)] + 0.3 * rng.normal(size=(1500, 64)), 5 * np.eye(64)[0] + 0.2 * rng.normal(size=(1500, 64))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)[rng.permutation(3000)]
    cells = C.place_cells(x, 3000, 3000, 48, 0.5177, 3.5, 32_768)
    ids = np.arange(3000)
    home = C.Home(C.Forest(), ids[:1200], x[:1200], 0.866, cells.axes, cells.margin, 60)
    for i in range(1200, 3000, 700):
        home.compare(ids[i : i + 700], x[i : i + 700])
    a, b = np.nonzero(np.triu(x @ x.T >= 0.866, 1))
    assert len(home.centres) > 1
    assert {i: home.forest.find(i) for i in range(3000)} == components(range(3000), [(i, j) for i, j in zip(a.tolist(), b.tolist()) if i < 1200])


def test_vector_cells_grow_before_they_multiply(monkeypatch, spark):
    """Many small cells would copy each point to more and more of them."""
    asked = []
    place = C.place_cells
    monkeypatch.setattr(C, "place_cells", lambda sample, total, cell_rows, *rest: (asked.append(total / cell_rows), place(sample, total, cell_rows, *rest))[1])
    x = np.random.default_rng(23).normal(size=(2000, 64)).astype(np.float32)
    C.cluster_vectors(vectors(spark, x), "node_no", "e", cell_rows=10, leaf_rows=50)
    assert asked and max(asked) <= C.FEW_CELLS + 1


def test_each_block_meets_all_points():
    gid = np.arange(500)
    stored = gid % 3 == 0
    at, block, keeps = C.block_duties(gid, stored, np.full(500, 4))
    assert len(at) == 2000 and len(set(zip(at.tolist(), block.tolist()))) == 2000
    assert (np.bincount(at[keeps], minlength=500) == stored).all() and len(np.unique(block[keeps])) == 4
