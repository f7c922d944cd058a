"""The neighbour graph against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import similar_vectors as V

SCHEMA = "node_no bigint, embedding array<float>, written_at timestamp, id string, cell int, vec string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, t, "clash", 1, "clash") for i, e, t in rows], SCHEMA)


def graph(spark, rows, **kw):
    out = V.knn_graph(frame(spark, rows), "node_no", "embedding", "written_at", dim=8, parts=4, **kw)
    return {r["id"]: [(n["id"], round(-n["d"], 4)) for n in r["near"]] for r in out.collect()}


def brute(ids, x, k=5):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {i: [int(ids[j]) for j in np.lexsort((ids, -s[r]))[:k]] for r, i in enumerate(ids)}, s


def test_recall_and_similarity(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(12, size=3000)] + 0.3 * rng.normal(size=(3000, 8))).astype(np.float32)
    ids = np.arange(3000) * 7
    got = graph(spark, [(int(i), v.tolist(), None) for i, v in zip(ids, x)], list_rows=200, nprobe=4)
    want, s = brute(ids, x.astype(float))
    hits = sum(len({n for n, _ in got[int(i)]} & set(want[i])) for i in ids)
    assert len(got) == 3000 and hits / 15000 >= 0.9
    at = {int(i): r for r, i in enumerate(ids)}
    assert all(abs(sim - s[at[int(i)], at[n]]) < 1e-3 for i in ids[:200] for n, sim in got[int(i)])


def test_scan_equals_tables_sum():
    rng = np.random.default_rng(1)
    stored, q = rng.normal(size=(500, 8)).astype(np.float32), rng.normal(size=(40, 8)).astype(np.float32)
    index = V.train(stored, 500, 10_000, 4)
    qi, xi = V.scan_list(q, V.residual_codes(stored, index.centroids[0], index.codebooks), index.codebooks, 30)
    assert np.bincount(qi, minlength=40).min() >= 10
    exact = (q @ stored.T).argmax(1)
    assert np.mean([exact[i] in xi[qi == i] for i in range(40)]) > 0.9


def test_dirty_vectors_and_repeats(spark):
    e = lambda *v: [float(x) for x in v] + [0.0] * (8 - len(v))
    rows = [(1, e(1), None), (2, e(2), None), (3, e(1, 0.1), None), (4, None, None), (5, [], None), (6, [1.0], None), (7, e(0), None), (8, e(float("nan")), None), (9, e(float("inf")), None), (1, e(1), None), (None, e(1), None), (10, [None] * 8, None)]
    got = graph(spark, rows)
    assert set(got) == {1, 2, 3}
    assert got[1] == [(2, 1.0), (3, 0.995)] and got[3] == [(1, 0.995), (2, 0.995)]


def test_latest_row_counts(spark):
    from datetime import datetime

    a, b = [1.0] + [0.0] * 7, [0.0] * 7 + [1.0]
    got = graph(spark, [(1, a, datetime(2024, 1, 1)), (1, b, datetime(2024, 2, 1)), (2, a, None), (3, b, None)])
    assert got[1][0] == (3, 1.0) and len(got) == 3


def test_a_third_are_copies(spark):
    rng = np.random.default_rng(2)
    hot, rest = rng.normal(size=8), rng.normal(size=(400, 8))
    rows = [(i, (hot * (1 + i % 3)).tolist(), None) for i in range(200)] + [(1000 + i, v.tolist(), None) for i, v in enumerate(rest)]
    got = graph(spark, rows, list_rows=64, nprobe=6)
    assert len(got) == 600
    assert got[0] == [(i, 1.0) for i in (1, 2, 3, 4, 5)] and got[150] == [(i, 1.0) for i in (0, 1, 2, 3, 4)] and got[3] == [(i, 1.0) for i in (0, 1, 2, 4, 5)]
    near = [k for k, v in got.items() if k >= 1000 and v[0][0] == 0]
    assert all(got[k][:5] == [(i, got[k][0][1]) for i in range(5)] for k in near)


def test_split_lists_lose_nothing(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    units = V.unit_vectors(frame(spark, [(i, v.tolist(), None) for i, v in enumerate(x)]), "node_no", "embedding", None, 8, packed=True)
    sample = V._unpack(V.fixed_rows(V.bounded_sample(units, 300, 1000), np.uint8, 20))
    index = V.train(sample, 300, 300, 4)
    index = V.Index(8, index.centroids, index.codebooks, np.array([3]), np.array([0]))
    groups = V.vector_groups(units, V.group_members(V.current_ids(units), 7))
    found = V.search(V.route(groups, index, 1), index, 5, 300)
    got = found.groupBy("gid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, 5).alias("near"))
    want, _ = brute(np.arange(300), x.astype(float))
    assert {r["gid"]: [n["id"] for n in r["near"]] for r in got.collect()} == want


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, n):
    got = graph(spark, [(i, [1.0 + i] + [1.0] * 7, None) for i in range(n)])
    assert len(got) == n and all(len(v) == n - 1 for v in got.values())


def test_pairs(spark):
    g = spark.createDataFrame([(2, [(-1.0, 1)]), (1, [(-1.0, 2), (-0.5, 3)])], "id bigint, near array<struct<d:double,id:bigint>>")
    assert [tuple(r) for r in V.neighbour_pairs(g, 0.99).collect()] == [(1, 2)]


def test_samples_are_bounded(spark):
    rng = np.random.default_rng(4)
    rest = rng.normal(size=(1500, 8))
    rows = [(7, v.tolist(), None) for v in rest[:500]] + [(9, [1.0] * 8, None)] * 500 + [(1000 + i, v.tolist(), None) for i, v in enumerate(rest[500:])]
    units = V.unit_vectors(frame(spark, rows), "node_no", "embedding", None, 8)
    assert len(V.bounded_sample(units, 2000, 100)) == 100 and len(V.bounded_sample(units, 2000, 5000)) == 1501


def test_probes_follow_the_lists():
    assert [V.probes(n) for n in (1, 9, 88, 128, 256, 880, 8192)] == [4, 4, 4, 4, 5, 7, 10]


def test_large_lists_have_sublists(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 8))
    x = (centres[rng.integers(30, size=2500)] + 0.2 * rng.normal(size=(2500, 8))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = V.train(x, 2500, 10_000, 4)
    codes = V.residual_codes(x, index.centroids[0], index.codebooks)
    sub = V.kmeans(x, 20)
    qi, xi = V.scan_sublists(x[:400], codes, index.codebooks, sub, V.nearest(x, sub), 60)
    q, n, sim = V.best_of(qi, xi, x[:400], x, np.arange(400), np.arange(2500), 5)
    want, _ = brute(np.arange(2500), x.astype(float))
    assert sum(int(b) in want[int(a)] for a, b in zip(q, n)) >= 0.9 * 2000
    assert len(qi) < 400 * 2500 / 4
