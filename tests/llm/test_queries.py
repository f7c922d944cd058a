"""The registered queries that no SQL checks, against plain Python on the small tables."""

import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from siltstone.llm import encoding, languages, mixing, queries, splitting
from siltstone.llm.blocks import usable_matrix

REST = set(queries.queries()) - set(queries.oracle_sql())
needs_tokens = pytest.mark.skipif(not os.path.isdir(encoding.TOKENIZERS), reason="no tokenizer files")


def rows(spark, data, name):
    return queries.queries()[name](spark, data).collect()


@pytest.fixture(scope="module")
def texts(data):
    return {r["doc_id"]: r for r in pq.read_table(f"{data}/documents.parquet").to_pylist()}


def test_all_are_covered():
    assert REST == {"p1_neighbours", "p4_groups", "p5_pieces", "p5_chunk_counts", "p6_ids", "p7_found", "p7_mix", "p7_shares", "p8_found", "p8_segments"}


def test_neighbours(spark, data):
    t = pq.read_table(f"{data}/graph_nodes.parquet", columns=["node_no", "embedding"]).combine_chunks()
    at, x = usable_matrix(t.column("embedding").combine_chunks(), 64)
    ids = t.column("node_no").to_numpy()[at]
    ids, first = np.unique(ids, return_index=True)
    x = x[first]
    s = x @ x.T
    np.fill_diagonal(s, -9)
    got = defaultdict(dict)
    for r in rows(spark, data, "p1_neighbours"):
        got[r["node_no"]][r["neighbour_no"]] = r["similarity"]
    assert set(got) == set(ids.tolist()) and all(len(v) == 5 for v in got.values())
    place = {int(i): k for k, i in enumerate(ids)}
    fifth = np.sort(s, axis=1)[:, -5]
    assert all(abs(s[place[a], place[b]] - v) < 1e-4 for a, near in got.items() for b, v in near.items())
    assert np.mean([s[place[a], place[b]] >= fifth[place[a]] - 1e-5 for a, near in got.items() for b in near]) >= 0.95


def test_groups(spark, data):
    members = defaultdict(set)
    for r in rows(spark, data, "p4_found"):
        members[r["member_kind"], r["cluster_no"]].add(r["member_no"])
    groups = {(r["member_kind"], r["cluster_no"]): r for r in rows(spark, data, "p4_groups")}
    assert set(groups) == set(members)
    assert all(groups[k]["size"] == len(m) and set(groups[k]["typical"]) <= m and len(set(groups[k]["typical"])) == 3 for k, m in members.items())


def test_pieces_and_counts(spark, data, texts):
    pieces = defaultdict(list)
    for r in rows(spark, data, "p5_pieces"):
        pieces[r["doc_id"]].append(r)
    whole = {}
    for d, found in pieces.items():
        found.sort(key=lambda r: r["piece_no"])
        assert all(r["n_chars"] == len(r["piece"]) <= 1000 and r["overlap"] <= 200 for r in found)
        whole[d] = "".join(r["piece"][r["overlap"] :] for r in found)
    assert whole == {d: r["text"] for d, r in texts.items() if r["text"]}
    counts = {r["file_id"]: r["chunk_count"] for r in rows(spark, data, "p5_chunk_counts")}
    assert counts == {r["file_id"]: len(splitting.spans(r["text"] or "")) for r in texts.values()}


@needs_tokens
def test_ids(spark, data, texts):
    tok = encoding.tokenizer()
    assert {r["doc_id"]: list(r["ids"]) for r in rows(spark, data, "p6_ids")} == {d: tok.encode_ordinary(r["text"] or "") for d, r in texts.items()}


@needs_tokens
def test_mix(spark, data, texts):
    tok = encoding.tokenizer()
    size = {d: len(tok.encode_ordinary(r["text"] or "")) for d, r in texts.items()}
    plain = lambda s: "_".join(s.strip().lower().replace("-", " ").split()) if s else None
    targets = {plain(r["source"]): r for r in pq.read_table(f"{data}/source_targets.parquet").to_pylist()}
    have = Counter()
    for d, r in texts.items():
        if plain(r["source"]) in targets:
            have[plain(r["source"])] += size[d]
    total = sum(have.values())
    short = {s for s, t in targets.items() if have[s] * t["max_repeats"] < t["target_share"] * total}
    assert {r["source"] for r in rows(spark, data, "p7_found")} == short
    used, times = Counter(), Counter()
    mix = rows(spark, data, "p7_mix")
    for r in mix:
        assert plain(texts[r["doc_id"]]["source"]) == r["source"] and r["tokens"] == size[r["doc_id"]]
        used[r["source"]] += r["tokens"]
        times[r["source"], r["doc_id"]] += 1
    assert all(n <= targets[s]["max_repeats"] for (s, _), n in times.items())
    longest = max(size.values())
    for s, t in targets.items():
        want = t["target_share"] * total
        assert used[s] == have[s] * t["max_repeats"] if s in short else want <= used[s] <= want + longest
    report = {r["source"]: r for r in rows(spark, data, "p7_shares")}
    assert {s: r["used_tokens"] for s, r in report.items()} == {s: used[s] for s in targets}
    assert all(r["actual_share"] == pytest.approx(used[s] / sum(used.values()), abs=1e-6) for s, r in report.items())
    assert len({(r["source"], r["slot"]) for r in mix}) == len({r["slot"] for r in mix}), "a slot has one source"


def test_languages(spark, data, texts):
    """Right labels agree with the language that was found; segments cover what they name, in order."""
    found = defaultdict(set)
    for r in rows(spark, data, "p8_found"):
        found[r["doc_id"]].add(r["seg_lang"])
    code = lambda v: (v or "").replace("_", "-").split("-")[0].strip().lower()
    assert all(langs <= set(languages.LANGUAGES) for langs in found.values())
    assert all(len(langs) > 1 or code(texts[d]["lang"]) not in langs for d, langs in found.items())
    parts = defaultdict(list)
    for r in rows(spark, data, "p8_segments"):
        parts[r["doc_id"]].append(r)
    for d, held in parts.items():
        held.sort(key=lambda r: r["segment_no"])
        ends = [r["start"] + r["n_chars"] for r in held]
        assert ends[-1] <= len(texts[d]["text"]) and all(e <= r["start"] for e, r in zip(ends, held[1:]))
        assert all(0 <= r["confidence"] <= 1 for r in held)
        assert all(a["seg_lang"] != b["seg_lang"] for a, b in zip(held, held[1:]))
        assert found[d] <= {r["seg_lang"] for r in held}
