"""Pieces: limits, overlaps, boundaries and the round trip."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import splitting as S

RUN = re.compile("[^ \t\n\r。！？]+")


def check(text, limit=100, overlap=20):
    parts = S.spans(text, limit, overlap)
    done = 0
    for k, (a, b, _) in enumerate(parts):
        assert 0 < b - a <= limit and a <= done < b
        if k:
            assert done - a <= overlap
        done = b
    assert done == len(text)
    joined, done = "", 0
    for a, b, _ in parts:
        joined += text[max(a, done) : b]
        done = b
    assert joined == text
    forced = any(level == 5 for _, _, level in parts)
    assert forced == any(len(m) > limit for m in RUN.findall(text))
    return parts


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["word ", "a", "b" * 37, "b" * 99, "b" * 100, "b" * 101, "b" * 230, ". ", "\n\n", "\r\n", "。", "！", "\n# T\n", " ", "日本", "? ", "\t"]), max_size=60).map("".join))
def test_any_text(text):
    if text:
        check(text)


def test_levels():
    para = ("Some words here. " * 4).strip()
    text = "\n\n".join([para] * 6)
    levels = [S.LEVELS[lv] for _, _, lv in check(text, 150, 20)]
    assert levels[:-1] == ["paragraph"] * (len(levels) - 1)
    assert [S.LEVELS[lv] for _, _, lv in check("x" * 250)] == ["character", "character", "character", "end"][-len(S.spans("x" * 250, 100, 20)) :]
    section = "Intro " * 12 + "\n\n# Title\n" + "Body " * 12
    a, b, lv = S.spans(section, 100, 20)[0]
    assert S.LEVELS[lv] == "section" and section[b:].startswith("# Title")
    words = " ".join(["wort"] * 60)
    assert all(words[b - 1] == " " or words[b : b + 1] in ("", " ") for _, b, _ in check(words))


def test_exact_overlap_in_plain_text():
    text = "A sentence of some words. " * 200
    parts = S.spans(text)
    assert all(parts[i][1] - parts[i + 1][0] == 200 for i in range(len(parts) - 1))


def test_operator(spark):
    rows = [("f1", 1, "x" * 1500, "clash"), ("f2", 2, "word " * 400, "clash"), ("f3", 3, None, "c"), ("f4", 4, "", "c"), ("f5", 5, "short", "c"), ("f2", 2, "word " * 400, "clash")]
    df = spark.createDataFrame(rows, "file_id string, doc_id bigint, text string, piece string")
    got = S.split_texts(df, ["file_id", "doc_id"], "text")
    assert {r["file_id"] for r in got.collect()} == {"f1", "f2", "f5"}
    assert all(len(r["piece"]) == r["n_chars"] <= 1000 for r in got.collect())
    cuts = {r["file_id"]: r["cut"] for r in got.groupBy("file_id").agg(S.cut_kind().alias("cut")).collect()}
    assert cuts == {"f1": "forced", "f2": "natural", "f5": "natural"}
    assert S.split_texts(df.where("false"), ["doc_id"], "text", with_text=False).count() == 0


def test_very_long_text():
    assert len(S.spans("y" * 300_000)) == 374 or len(S.spans("y" * 300_000)) == 375
    check("Satz eins. " * 30_000, 1000, 200)
