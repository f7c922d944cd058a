"""Corpus ids equal those of the tokenizer on whole texts."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import encoding as E

pytestmark = pytest.mark.skipif(not os.path.isdir(E.TOKENIZERS), reason="no tokenizer files")

PARTS = ["the quick ", "don't", "'s", "'", "!!'s", "  ", "\n\n", "\t", "123", "4567 89", "ünïcode", "日本語のテキスト。", "...", "?!", "🙂🔥", "́", "a" * 50, "_", " ", "​", "I'll", "x=1;", "ß", "\r\n", "١٢٣"]


def by_chunks(text, target, most):
    tok = E.tokenizer()
    ends, opens = E.chunk_ends(text, target, most)
    start, chunks = 0, []
    for end in ends:
        chunks.append(tok.encode_ordinary(text[start:end]))
        start = end
    return E.repair(chunks, opens, tok)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=60).map("".join))
def test_small_chunks_and_repairs(text):
    want = E.tokenizer().encode_ordinary(text)
    assert by_chunks(text, 8, 12) == want
    assert by_chunks(text, 40, 5000) == want


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=300))
def test_any_characters(text):
    if text.encode("utf-8", "ignore").decode() == text:
        assert by_chunks(text, 8, 12) == E.tokenizer().encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 30_000, "日" * 9_000, " " * 9_000, "ab" * 9_000, "'" * 9_000, "é" * 6_000 + " x", "🙂" * 6_000])
def test_runs_without_word_starts(text):
    assert by_chunks(text, 160, 4096) == E.tokenizer().encode_ordinary(text)


def test_operator(spark):
    tok = E.tokenizer()
    texts = [None, "", " ", "Hello world, it's me. " * 300, "日本語" * 3000, "x", "Hello world, it's me. " * 300, "<|endoftext|>", "a\x00b"] + ["the same boiler plate for a third of all texts " * 8] * 120
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(3, "another text of the same id", "clash")], "doc_id bigint, text string, chunk string").repartition(3)
    got = sorted((r["doc_id"], list(r["ids"])) for r in E.encode_corpus(df, "doc_id", "text").collect())
    assert got == sorted([(i, tok.encode_ordinary(t or "")) for i, t in enumerate(texts)] + [(3, tok.encode_ordinary("another text of the same id"))])
    assert E.encode_corpus(df.where("false"), "doc_id", "text").count() == 0


def test_counts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id bigint, t string")
    assert {tuple(r) for r in E.count_tokens(df, ["id"], "t").collect()} == {(1, 2), (2, 0), (3, 0)}


def test_repeats_share_chunks():
    text = "".join(f"Sentence number {i} says something else. " for i in range(400))
    cut = lambda t: [t[a:b] for a, b in zip([0, *E.chunk_ends(t, 160, 4096)[0]], E.chunk_ends(t, 160, 4096)[0])]
    a, b = cut(text), cut("An inserted start. " + text)
    assert len(set(a) & set(b)) > 0.9 * len(a)
