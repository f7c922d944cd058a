"""Splitting oversized texts at natural boundaries.

A separator hierarchy (section, paragraph, line, sentence, word, character) decides where a
text is cut; pieces are packed greedily up to the limit and overlap their predecessor.

* Texts of at most ``limit`` characters are one piece; null and empty texts have none.
* Each piece ends at the furthest boundary of the highest level that lies in its window
  beyond ``least_fill`` of the limit; word boundaries are accepted anywhere in the window.
* The next piece starts ``overlap`` characters before that end. Where this would leave no
  boundary within reach (a run of more than limit - overlap characters follows), it starts
  later, so that the cut stays natural; the overlap that was used is reported.
* Only a run of more than ``limit`` characters without a separator is cut between characters.

Lengths are counted in code points. The joined pieces minus their overlaps give the text.
Repeated rows are split each on its own. Work is per text; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("section", "paragraph", "line", "sentence", "word", "character", "end")
SECTION = re.compile(r"(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)\s*(?=#{1,6} |={1,6} |\d{1,3}[.)] )")
PARAGRAPH = re.compile(r"(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)[ \t\r\n]*")
LINE = re.compile(r"[ \t]*(?:\r\n?|\n)")
SENTENCE = re.compile(r"[.!?…]+[\"'»”’)\]]*[ \t\r\n]+|[。！？]+[」』”]?")
GAP = re.compile(r"[ \t\n\r。！？]")


def _last_gap(text: str, low: int, high: int) -> int:
    """The last position in (low, high] that follows or precedes a separator, else -1."""
    best = max(text.rfind(c, low, high) for c in " \t\n\r。！？")
    if best >= 0:
        return best + 1
    return high if high < len(text) and GAP.match(text, high) else -1


def spans(text: str, limit: int = 1000, overlap: int = 200, least_fill: float = 0.25) -> list[tuple[int, int, int]]:
    """(start, end, level) of each piece; the level tells what ended it."""
    n = len(text)
    if not n:
        return []
    if n <= limit:
        return [(0, n, 6)]
    marks = [[m.end() for m in rule.finditer(text)] for rule in (SECTION, PARAGRAPH, LINE, SENTENCE)]
    out, start, done = [], 0, 0
    while n - start > limit:
        high, level, cut = start + limit, 5, -1
        floor = max(done, start + int(limit * least_fill))
        for k, at in enumerate(marks):
            i = bisect_right(at, high) - 1
            if i >= 0 and at[i] > floor:
                level, cut = k, at[i]
                break
        if cut < 0 and (cut := _last_gap(text, done, high)) > done:
            level = 4
        if cut <= done:
            gap = GAP.search(text, max(high, done + 1))
            stop = gap.start() if gap else n
            if stop - done <= limit:
                # A shorter overlap reaches the separator behind the run.
                start, cut, level = stop - limit, stop, 4
                if stop == n:
                    break
            else:
                cut, level = high, 5
        out.append((start, cut, level))
        done = cut
        start = max(cut - overlap, start + 1)
    out.append((start, n, 6))
    return out


def split_texts(df: DataFrame, keys: list[str], text_col: str, limit: int = 1000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """keys + (piece_no, start, n_chars, overlap, cut_level[, piece]) for every piece of every text."""
    fields = [df.schema[k] for k in keys]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", piece_no int, start int, n_chars int, overlap int, cut_level string" + (", piece string" if with_text else "")

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            step = max(1, min(len(texts), 256))
            for base in range(0, len(texts), step):
                who, no, at, size, over, level, piece = [], [], [], [], [], [], []
                for i, text in enumerate(texts[base : base + step], base):
                    last = 0
                    for k, (a, b, lv) in enumerate(spans(text, limit, overlap)):
                        who.append(i)
                        no.append(k)
                        at.append(a)
                        size.append(b - a)
                        over.append(last - a if k else 0)
                        level.append(LEVELS[lv])
                        if with_text:
                            piece.append(text[a:b])
                        last = b
                if who:
                    take = pa.array(who)
                    columns = [batch.column(i).take(take) for i in range(len(keys))] + [pa.array(x, pa.int32()) for x in (no, at, size, over)] + [pa.array(level)]
                    names = [*keys, "piece_no", "start", "n_chars", "overlap", "cut_level"]
                    yield pa.RecordBatch.from_arrays(columns + ([pa.array(piece, pa.string())] if with_text else []), names=names + (["piece"] if with_text else []))

    return df.where(F.length(text_col) > 0).select(*keys, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, shape)


def cut_kind() -> Column:
    """'forced' where any piece had to end between two characters of a run, else 'natural'."""
    return F.when(F.max((F.col("cut_level") == "character").cast("int")) == 1, "forced").otherwise("natural")
