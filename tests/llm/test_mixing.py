"""Mixes: shares, caps, order and report."""

import os

import pytest
from pyspark.sql import functions as F

from siltstone.llm import encoding, mixing

pytestmark = pytest.mark.skipif(not os.path.isdir(encoding.TOKENIZERS), reason="no tokenizer files")


def corpus(spark):
    rows = [(i, " word" * 100, ["A", " a", "A-", "a"][i % 4] if i % 4 != 2 else "a") for i in range(300)]
    rows += [(1000 + i, " word" * 50, "small one" if i % 2 else "Small-One") for i in range(40)]
    rows += [(2000 + i, " word" * 10, "tiny") for i in range(10)] + [(3000, None, "a"), (3001, "", "a"), (3002, "x y", None), (3003, "x y", "unlisted")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, slot int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_caps_and_shortfall(spark):
    t = targets(spark, [("a", 0.5, 2), ("small_one", 0.3, 8), ("tiny", 0.1, 3), ("nobody", 0.1, 5)])
    mix = mixing.mix_sources(corpus(spark), t, block_tokens=300)
    total = 300 * 100 + 40 * 50 + 10 * 10
    by = {q.source: q for q in mix.quotas}
    assert (by["a"].available, by["small_one"].available, by["tiny"].available, by["nobody"].available) == (30_000, 2_000, 100, 0)
    assert {s for s, q in by.items() if q.short} == {"tiny", "nobody"}
    report = {r["source"]: r for r in mixing.share_report(mix).collect()}
    assert abs(report["a"]["used_tokens"] - 0.5 * total) <= 100 and abs(report["small_one"]["used_tokens"] - 0.3 * total) <= 50
    assert report["tiny"]["used_tokens"] == 300 and report["nobody"]["used_tokens"] == 0
    rows = mix.rows.collect()
    assert {r["source"] for r in rows} == {"a", "small_one", "tiny"} and all(r["tokens"] > 0 for r in rows)
    assert max(mix.rows.groupBy("doc_id").count().collect(), key=lambda r: r["count"])["count"] <= 8
    assert mix.rows.groupBy("source", "doc_id", "repeat_no").count().where("count > 1").count() == 0


def test_every_stretch_holds_the_shares(spark):
    t = targets(spark, [("a", 0.6, 1), ("small_one", 0.4, 10)])
    rows = mixing.mix_sources(corpus(spark), t, block_tokens=200).rows.orderBy("slot").collect()
    quarter = len(rows) // 4
    for k in range(3):
        part = rows[k * quarter : (k + 1) * quarter]
        share = sum(r["tokens"] for r in part if r["source"] == "a") / sum(r["tokens"] for r in part)
        assert abs(share - 0.6) < 0.12


def test_deterministic_and_empty(spark):
    t = targets(spark, [("a", 1.0, 1)])
    key = lambda m: sorted(map(tuple, m.rows.collect()))
    assert key(mixing.mix_sources(corpus(spark), t)) == key(mixing.mix_sources(corpus(spark).repartition(7), t))
    assert mixing.mix_sources(corpus(spark).where("false"), t).rows.count() == 0
    assert mixing.mix_sources(corpus(spark), t.where("false")).rows.count() == 0
    assert mixing.share_report(mixing.mix_sources(corpus(spark).where("false"), t)).first()["actual_share"] == 0.0


def test_source_names(spark):
    rows = [(" Upload-Form",), ("upload form",), ("UPLOAD_FORM ",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "s string").select(mixing.source_name("s")).collect()] == ["upload_form"] * 3 + [None]


def test_slots_are_unique_per_block(spark):
    m = mixing.mix_sources(corpus(spark), targets(spark, [("a", 0.9, 1), ("tiny", 0.1, 20)]), block_tokens=100)
    blocks = m.rows.select("source", "slot").distinct().groupBy("slot").agg(F.count("*").alias("n"))
    assert blocks.where("n > 1").count() == 0


def test_report_reads_the_mix(spark):
    mix = mixing.mix_sources(corpus(spark), targets(spark, [("a", 0.7, 1), ("small_one", 0.3, 8)]), block_tokens=300)
    short = lambda m: {r["source"] for r in mixing.share_report(m).where("short").collect()}
    assert short(mixing.written(mix)) == set()
    assert short(mixing.Mix(mix.sized, mix.quotas, mix.rows.where("source <> 'a' or slot % 2 = 0"))) == {"a"}


def test_slots_are_bounded_by_blocks(spark):
    mix = mixing.mix_sources(corpus(spark), targets(spark, [("a", 0.999999, 1), ("tiny", 0.000001, 1)]), block_tokens=300)
    blocks = mix.rows.select("slot").distinct().count()
    assert mix.rows.agg(F.max("slot")).first()[0] < 2 * blocks


def test_every_block_has_a_slot(spark):
    """A source of one block in a large corpus, one of some, and one of most."""
    blocks = {"large": 99_961, "some": 37, "tiny": 1}
    found = {r["source"]: r for r in mixing.slot_ranks(spark, blocks).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("k").alias("d"), F.max("k").alias("last"), F.max("slot").alias("slot")).collect()}
    assert all(found[s]["n"] == found[s]["d"] == found[s]["last"] + 1 and found[s]["n"] >= n for s, n in blocks.items())
    assert max(r["slot"] for r in found.values()) < 1 << 17


def test_mirrored_digits(spark):
    got = [r[0] for r in spark.range(64).select(mixing.mirrored(F.col("id"), 6)).collect()]
    assert got == [int(f"{i:06b}"[::-1], 2) for i in range(64)]
