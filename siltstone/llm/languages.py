"""Languages of texts and of their segments, by nearest centroids of n-gram vectors.

Training takes at most ``ROWS_PER_LANGUAGE`` distinct labelled texts of each language (a hash
of the text picks them; a text that several rows repeat counts once, under its most frequent
label). Labels may be wrong: texts whose nearest language is not their label are left
out, and the centroids are made again. Each language then gets up to ``CENTROIDS`` clustered
centroids of normalised TF-IDF vectors of hashed letter trigrams (and single letters of
non-Latin scripts).

Every text is read whole. It is cut into sentences (long ones at blanks); words that hold
digits, joiners of codes and addresses (as _ / = &) or over 40 Latin letters are left out. A segment's vector is compared with all
centroids by cosine; segments far from all are rejected, short or undecided ones take the
language of their text that suits them best. A language counts for a text from ``LEAST_SHARE``
of the letters on. Texts that are null, blank or without prose get no language.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.blocks import kmeans

#: The languages told apart.
LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "pl", "ru", "ja")
ROWS_PER_LANGUAGE, CENTROIDS, LEAST_SHARE = 250, 3, 0.15
BITS = 15
SPACE, FEATURE_SLICE = 32, 100_000
JOINERS = np.isin(np.arange(128), [ord(c) for c in "_/=&+@\\\\#~"])
_tables: dict = {}


def label_code(c: Column | str) -> Column:
    """The code of a label: the part before - or _, lower-cased."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(F.regexp_extract(c, "^\\s*([^-_]*)", 1)))


def _character_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the basic plane: kind (0 other, 1 letter or mark, 2 digit), simple lower case, sentence end (1 needs a blank behind it, 2 not)."""
    if not _tables:
        kind, lower, stop = np.zeros(0x10000, np.uint8), np.arange(0x10000, dtype=np.uint32), np.zeros(0x10000, np.uint8)
        for c in range(0x10000):
            k = unicodedata.category(chr(c))[0]
            kind[c] = 1 if k in "LM" else 2 if k == "N" else 0
            low = chr(c).lower()
            if len(low) == 1 and ord(low) < 0x10000:
                lower[c] = ord(low)
        for c in ".!?;…":
            stop[ord(c)] = 1
        for c in "\n\r\f。！？\"“”„«»「」":
            stop[ord(c)] = 2
        _tables["t"] = kind, lower, stop
    return _tables["t"]


@dataclass
class Segments:
    doc: np.ndarray  # text of each segment
    start: np.ndarray  # first character within the joined block
    end: np.ndarray
    letters: np.ndarray
    owner: np.ndarray  # segment of each feature
    feature: np.ndarray
    times: np.ndarray


def segment(texts: list[str], whole: bool = False, longest: int = 200) -> Segments:
    """Segments and hashed features of a block of texts (``whole``: one segment for each text)."""
    kinds, lower, stops = _character_tables()
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.minimum(raw, 0xFFFF)
    doc = np.repeat(np.arange(len(texts)), lengths)
    kind = kinds[points]
    kind[raw >= 0x20000] = 1  # ideographs beyond the basic plane; its other characters there are no letters here
    n = len(points)
    if whole:
        seg = doc
    else:
        stop = stops[points]
        blank = np.append((points[1:] == 32) | (points[1:] == 9) | (points[1:] == 10) | (points[1:] == 13), True)
        begins = np.zeros(n, np.int64)
        begins[1:] = ((stop == 2) | ((stop == 1) & blank))[:-1]
        begins[np.cumsum(lengths)[:-1]] = 1
        seg = np.cumsum(begins)
        first = np.flatnonzero(np.r_[True, begins[1:] > 0])
        part = (np.arange(n) - first[seg]) // longest
        breaks = np.flatnonzero((kind == 0) | (points >= 0x3000))
        key = seg[breaks] * (part.max() + 1) + part[breaks]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]] & (part[breaks] > 0))
        begins[breaks[new]] = 1
        begins[0] = 0
        seg = np.cumsum(begins)
    count = int(seg[-1]) + 1 if n else 0
    # words: runs of letters, digits and joiners of codes, paths and addresses; those that hold
    # a digit or joiner or are overlong are no prose
    joiner = JOINERS[np.minimum(points, 127)] & (points < 127)
    word = ((kind > 0) | joiner) & (points < 0x3000)
    edge = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    close = np.flatnonzero(word & ~np.r_[word[1:], False])
    if len(edge):
        marked = (kind == 2) | joiner
        marks = np.cumsum(marked)
        held = marks[close] - marks[edge] + marked[edge]
        junk = (held > 0) | ((close - edge >= 40) & (points[edge] < 0x370))
        flags = np.zeros(n + 1, np.int32)
        np.add.at(flags, edge[junk], 1)
        np.add.at(flags, close[junk] + 1, -1)
        good = (kind == 1) & (np.cumsum(flags[:-1]) == 0)
    else:
        good = kind == 1
    c = np.where(good, np.where(raw > 0xFFFF, raw, lower[points]), SPACE).astype(np.uint32)
    at = np.flatnonzero(good)
    before = np.r_[np.uint32(SPACE), c[:-1]][at]
    after = np.r_[c[1:], np.uint32(SPACE)][at]
    middle = c[at]
    h = before * np.uint32(0x9E3779B1) ^ middle * np.uint32(0x85EBCA77) ^ after * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)
    foreign = middle >= 0x250
    single = (middle[foreign] * np.uint32(0x165667B1)) ^ np.uint32(0x5BD1E995)
    single = (single ^ (single >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    keys = np.concatenate([seg[at] << BITS | (h >> np.uint32(32 - BITS)).astype(np.int64), seg[at[foreign]] << BITS | (single >> np.uint32(32 - BITS)).astype(np.int64)])
    keys.sort()
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    times = np.diff(np.r_[new, len(keys)]).astype(np.float32)
    keys = keys[new]
    starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    return Segments(doc[starts], starts, np.r_[starts[1:], n], np.bincount(seg[at], minlength=count), keys >> BITS, keys & ((1 << BITS) - 1), times)


@dataclass
class Model:
    idf: np.ndarray
    weights: np.ndarray  # buckets x centroids, idf times unit centroid
    language: np.ndarray  # of each centroid
    least: float  # cosine under which a segment has no language


def cosines(s: Segments, model: Model) -> np.ndarray:
    """Cosine of each segment with its nearest centroid of each language."""
    out = np.zeros((len(s.doc), len(LANGUAGES)), np.float32)
    if not len(s.owner):
        return out
    heads = np.flatnonzero(np.r_[True, s.owner[1:] != s.owner[:-1]])
    norm = np.maximum(np.sqrt(np.add.reduceat((s.times * model.idf[s.feature]) ** 2, heads)), 1e-9)
    best = np.zeros((len(heads), len(LANGUAGES)), np.float32)
    # Slices of whole segments bound the gathered weights, whatever the block's size.
    cuts = np.unique(np.r_[0, np.searchsorted(heads, np.arange(FEATURE_SLICE, len(s.owner), FEATURE_SLICE)), len(heads)])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        low, high = heads[a], heads[b] if b < len(heads) else len(s.owner)
        gathered = model.weights[s.feature[low:high]]
        gathered *= s.times[low:high, None]
        dots = np.add.reduceat(gathered, heads[a:b] - low, axis=0) / norm[a:b, None]
        for i in range(len(LANGUAGES)):
            own = np.flatnonzero(model.language == i)
            if len(own):
                best[a:b, i] = dots[:, own].max(1)
    out[s.owner[heads]] = best
    return out


def _centroid_model(idf: np.ndarray, centroids: list[np.ndarray], language: list[int], least: float) -> Model:
    c = np.stack(centroids)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return Model(idf, np.ascontiguousarray((c * idf).T.astype(np.float32)), np.array(language), least)


def _joined(parts: list[Segments]) -> Segments:
    """Blocks with one segment for each text as one block."""
    offsets = np.cumsum([0, *[len(p.doc) for p in parts]])
    owner = np.concatenate([p.owner + o for p, o in zip(parts, offsets)] or [np.empty(0, np.int64)])
    rest = [np.concatenate([getattr(p, k) for p in parts] or [np.empty(0, np.int64)]) for k in ("start", "end", "letters", "feature", "times")]
    return Segments(np.arange(offsets[-1]), rest[0], rest[1], rest[2], owner, rest[3], rest[4])


def fit(texts: list[str], labels: list[int], seed: int = 3) -> Model:
    """Centroids of the labelled texts, cleaned of wrong labels."""
    size, labels_ = 1 << BITS, np.array(labels)
    s = _joined([segment(part, whole=True) for _, part in _blocks(texts)])
    df = np.bincount(s.feature, minlength=size)
    idf = (np.log((1 + len(texts)) / (1 + df)) + 1).astype(np.float32)
    value = s.times * idf[s.feature]
    norm = np.sqrt(np.bincount(s.owner, value**2, minlength=len(texts)))
    value = value / np.maximum(norm[s.owner], 1e-9)
    keep = np.ones(len(texts), bool)
    present = [i for i in range(len(LANGUAGES)) if (labels_ == i).any()]
    for _ in range(4):
        means, names = [], []
        for i in present:
            own = keep & (labels_ == i)
            if own.any():
                rows = own[s.owner]
                means.append(np.bincount(s.feature[rows], value[rows], minlength=size))
                names.append(i)
        rough = _centroid_model(idf, means, names, 0.0)
        guess = cosines(s, rough)
        keep = (guess.argmax(1) == labels_) & (guess.max(1) > 0)
    centroids, names = [], []
    for i in present:
        own = np.flatnonzero(keep & (labels_ == i))
        if not len(own):
            continue
        dense = np.zeros((len(own), size), np.float32)
        place = np.full(len(texts), -1)
        place[own] = np.arange(len(own))
        rows = place[s.owner] >= 0
        dense[place[s.owner[rows]], s.feature[rows]] = value[rows]
        for c in kmeans(dense, min(CENTROIDS, max(1, len(own) // 8)), rounds=6, seed=seed):
            centroids.append(c)
            names.append(i)
    model = _centroid_model(idf, centroids, names, 0.0)
    near = []
    for _, part in _blocks([texts[i] for i in np.flatnonzero(keep)]):
        parts = segment(part)
        near.append(cosines(parts, model).max(1)[parts.letters >= 40])
    near = np.concatenate(near) if near else np.empty(0)
    model.least = float(np.quantile(near, 0.002) * 0.8) if len(near) else 0.1
    return model


def train(df: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model from a bounded, hash-picked sample of distinct labelled texts."""
    order = {c: i for i, c in enumerate(LANGUAGES)}
    known = F.create_map(*[F.lit(x) for c, i in order.items() for x in (c, i)])
    labelled = df.select(F.col(text_col).alias("t"), label_code(label_col).alias("code")).where(F.col("code").isin(*LANGUAGES) & (F.char_length(F.trim("t")) > 40))
    labelled = labelled.select(F.xxhash64("t").alias("h"), "t", known[F.col("code")].alias("label"))
    # Number and label of the most frequent label in one whole number, so that the maximum is hashed.
    votes = labelled.groupBy("h", "label").agg(F.count("*").alias("n")).groupBy("h").agg(F.max(F.col("n") * 16 + F.col("label")).alias("vote"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("h", F.lit(5)), "h"))
    picked = votes.select("h", (F.col("vote") % 16).cast("int").alias("label")).withColumn("place", place).where(F.col("place") <= rows).select("h", "label").collect()
    if not picked:
        return None
    labels = {r["h"]: r["label"] for r in picked}
    chosen = df.sparkSession.createDataFrame([(h,) for h in labels], "h bigint")
    texts = labelled.select("h", "t").join(F.broadcast(chosen), "h").groupBy("h").agg(F.any_value("t").alias("t")).toArrow()
    found = sorted(zip(texts.column("h").to_pylist(), texts.column("t").to_pylist()))
    return fit([t for _, t in found], [labels[h] for h, _ in found])


def decide(texts: list[str], model: Model) -> tuple[Segments, np.ndarray, np.ndarray]:
    """Segments, the language of each (-1: none) and its cosine."""
    s = segment(texts)
    score = cosines(s, model)
    best = score.argmax(1)
    top = score[np.arange(len(best)), best]
    second = np.partition(score, -2, axis=1)[:, -2]
    language = np.full(len(best), -1)
    sure = (s.letters >= 20) & (top >= model.least) & (top - second >= 0.05)
    language[sure] = best[sure]
    known = np.zeros((len(texts), len(LANGUAGES)), np.float32)
    np.add.at(known, (s.doc[sure], best[sure]), s.letters[sure])
    # Undecided segments: the language of their text that suits them best.
    open_ = np.flatnonzero(~sure & (s.letters > 0) & (top >= 0.6 * model.least))
    has = known[s.doc[open_]] > 0
    inside = np.where(has, score[open_], -1.0)
    some = has.any(1)
    language[open_[some]] = inside[some].argmax(1)
    # Texts without any sure segment are judged as a whole.
    lone = np.flatnonzero((known.sum(1) == 0) & (np.bincount(s.doc, s.letters, minlength=len(texts)) >= 8))
    if len(lone):
        w = segment([texts[i] for i in lone], whole=True)
        total = cosines(w, model)
        fine = total.max(1) >= model.least
        pick = np.full(len(texts), -1)
        pick[lone[fine]] = total[fine].argmax(1)
        mine = (pick[s.doc] >= 0) & (s.letters > 0)
        language[mine] = pick[s.doc[mine]]
    # A short, weakly decided segment between two of one language belongs to them.
    held = np.flatnonzero(language >= 0)
    if len(held) > 2:
        a, b, c = held[:-2], held[1:-1], held[2:]
        lone = (s.doc[a] == s.doc[b]) & (s.doc[b] == s.doc[c]) & (language[a] == language[c]) & (language[b] != language[a]) & (s.letters[b] < 40) & (top[b] - score[b, language[a]] < 0.1)
        language[b[lone]] = language[a[lone]]
    return s, language, score[np.arange(len(best)), np.maximum(language, 0)]


def _blocks(texts: list[str], most: int = 250_000):
    at = 0
    while at < len(texts):
        start, size = at, 0
        while at < len(texts) and (size == 0 or size + len(texts[at]) < most):
            size += len(texts[at])
            at += 1
        yield start, texts[start:at]


def text_languages(df: DataFrame, model: Model, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """id + keep + (lang, share, confidence, mixed): each language with at least LEAST_SHARE of a text's letters."""
    shape = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in [id_col, *keep]) + ", seg_lang string, share double, confidence double, mixed boolean"

    def run(batches):
        for batch in batches:
            for base, texts in _blocks(batch.column(len(keep) + 1).to_pylist()):
                s, language, near = decide(texts, model)
                named = language >= 0
                letters = np.zeros((len(texts), len(LANGUAGES)))
                weight = np.zeros_like(letters)
                np.add.at(letters, (s.doc[named], language[named]), s.letters[named])
                np.add.at(weight, (s.doc[named], language[named]), s.letters[named] * near[named])
                total = letters.sum(1, keepdims=True)
                share = letters / np.maximum(total, 1)
                doc, lang = np.nonzero((share >= LEAST_SHARE) & (letters > 0))
                mixed = np.bincount(doc, minlength=len(texts))[doc] > 1
                take = pa.array(doc + base)
                sure = weight[doc, lang] / letters[doc, lang]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(len(keep) + 1)], pa.array([LANGUAGES[i] for i in lang], pa.string()), pa.array(share[doc, lang]), pa.array(sure), pa.array(mixed)], names=[id_col, *keep, "seg_lang", "share", "confidence", "mixed"])

    return df.where(F.length(text_col) > 0).select(id_col, *keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, shape)


def text_segments(df: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """id + (segment_no, start, n_chars, seg_lang, confidence): stretches of one language, in characters."""
    shape = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, segment_no int, start int, n_chars int, seg_lang string, confidence double"

    def run(batches):
        for batch in batches:
            for base, texts in _blocks(batch.column(1).to_pylist()):
                s, language, near = decide(texts, model)
                held = np.flatnonzero(language >= 0)
                if not len(held):
                    continue
                doc, lang = s.doc[held], language[held]
                new = np.r_[True, (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])]
                first = np.flatnonzero(new)
                last = np.r_[first[1:], len(held)] - 1
                origin = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
                start = s.start[held[first]] - origin[doc[first]]
                stop = np.minimum(s.end[held[last]], origin[doc[first] + 1] - 1) - origin[doc[first]]
                letters = np.maximum(s.letters[held], 1)
                sure = np.add.reduceat(near[held] * letters, first) / np.add.reduceat(letters, first)
                fresh = np.r_[True, doc[first][1:] != doc[first][:-1]]
                run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(first)), 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[first] + base)), pa.array((np.arange(len(first)) - run_start).astype(np.int32)), pa.array(start.astype(np.int32)), pa.array((stop - start).astype(np.int32)), pa.array([LANGUAGES[i] for i in lang[first]], pa.string()), pa.array(sure.astype(float))], names=[id_col, "segment_no", "start", "n_chars", "seg_lang", "confidence"])

    return df.where(F.length(text_col) > 0).select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, shape)


def wrong_labels(found: DataFrame, label_col: str) -> DataFrame:
    """The rows of mixed texts, and of texts whose label is missing or is not their language."""
    right = F.coalesce(label_code(label_col) == F.col("seg_lang"), F.lit(False))
    return found.where(F.col("mixed") | ~right)
