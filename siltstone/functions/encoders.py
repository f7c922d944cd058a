"""Encoders that turn texts into unit vectors.

An encoder is any function from a text column to an ``array<float>`` column; trained models are
injected that way. ``hashing_encoder`` needs no model: hashed words and character trigrams,
counted with signs and scaled to length 1, the same on every machine. Null and empty
texts give null, so such nodes are skipped by upserts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"\w+")


def word_vector(word: str, dim: int) -> np.ndarray:
    """The signed counts that one occurrence of a word adds: of itself and of its trigrams."""
    marks = [word, *[f"#{word[i : i + 3]}" for i in range(max(1, len(word) - 2))]]
    h = np.fromiter((xxhash.xxh3_64_intdigest(m) for m in marks), np.uint64, len(marks))
    return np.bincount((h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), minlength=dim)


def encode_batch(texts: list[str | None], dim: int = 64) -> list[list[float] | None]:
    """The vectors of a batch of texts; each distinct word is hashed once."""
    found = [WORD.findall((t or "").lower()) for t in texts]
    known: dict[str, int] = {}
    codes = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in found]
    table = np.stack([word_vector(w, dim) for w in known]) if known else np.zeros((0, dim))
    out: list[list[float] | None] = []
    for c in codes:
        at, times = np.unique(c, return_counts=True)
        v = times @ table[at]
        n = np.linalg.norm(v)
        out.append((v / n).astype(np.float32).tolist() if n else None)
    return out


def plain_encode(text: str | None, dim: int = 64) -> list[float] | None:
    return encode_batch([text], dim)[0]


def hashing_encoder(dim: int = 64) -> Callable[[Column], Column]:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(encode_batch(texts.tolist(), dim), dtype=object)

    return lambda c: encode(c)
