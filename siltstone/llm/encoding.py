"""Encoding of the whole corpus with a public byte-level BPE tokenizer, by content-defined chunks.

1. A rolling hash over the last eight bytes cuts each text into chunks of about ``target``
   bytes, wherever the same words stand. A cut moves on to the next spot where the
   tokenizer's pattern always starts a new word; where there is none nearby the cut is
   *open*.
2. One shuffle brings each distinct chunk and all its uses together; it is encoded once. A
   chunk that one batch uses more than once is hot: it is encoded once for every
   ``SALT_TASKS`` tasks, whose uses alone meet, so that its uses spread as the corpus grows.
3. A second shuffle puts the ids of each text in order. Joins at open cuts are repaired: the
   chunks on both sides are re-encoded together, widened until the ids on the outer edges
   agree with what was there.

Ids equal those of the tokenizer over the whole text without special tokens. Null and empty
texts give an empty list. Rows that repeat a doc_id are encoded each on its own. Very long
texts are only ever handled chunk by chunk, except for runs that hold no word boundary.
"""

from __future__ import annotations

import base64
import os
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import width_for

#: Folder of the public vocabulary files; never copied.
TOKENIZERS = os.environ.get("SILTSTONE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the word pattern of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Uses in one batch from which a chunk is hot, and tasks that share the encoding of a hot chunk.
HOT_USES, SALT_TASKS = 2, 64

_loaded: dict = {}


def tokenizer(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    """The tokenizer of a rank file, loaded once in each Python worker."""
    path = os.path.join(folder, name)
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _classes() -> np.ndarray:
    """Of each character of the basic plane: 0 space, 1 letter, 2 number, 3 other, 4 apostrophe, 5 uncertain."""
    if "classes" not in _loaded:
        kinds = np.full(0x10000, 3, np.uint8)
        for c in range(0x10000):
            k = unicodedata.category(chr(c))[0]
            if k in "LN":
                kinds[c] = 1 if k == "L" else 2
            elif k in "ZC":
                kinds[c] = 5
        kinds[[9, 10, 11, 12, 13, 32]] = 0
        kinds[ord("'")] = 4
        _loaded["classes"] = kinds
    return _loaded["classes"]


def word_starts(points: np.ndarray) -> np.ndarray:
    """Positions i > 0 where the pattern always starts a new match, whatever stands around.

    A letter or number run always ends before another class; other symbols (not an
    apostrophe) end before letters, numbers and white space. Unassigned, control and
    supplementary characters are left out, as Unicode versions may differ on them.
    """
    kinds = np.where(points < 0x10000, _classes()[np.minimum(points, 0xFFFF)], 5)
    a, b = kinds[:-1], kinds[1:]
    known = (a != 5) & (b != 5) & (a != 0)
    return np.flatnonzero(known & (((a <= 2) & (a != b)) | ((a == 3) & (b <= 2)))) + 1


_GEAR = np.random.default_rng(20).integers(1, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def chunk_ends(text: str, target: int, most: int) -> tuple[list[int], list[bool]]:
    """Ends of the chunks of a text (in code points) and whether each end is open."""
    n = len(text)
    if n <= target:
        return [n], [False]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    g = _GEAR[points & 255] ^ (points >> 8) * np.uint32(0x9E3779B1)
    h = g.copy()
    for k in range(1, 8):
        h[k:] += g[:-k] << np.uint32(k)
    hits = np.flatnonzero(h[7:] >> np.uint32(8) < np.uint32((1 << 24) // max(1, target // 2))) + 8
    safe = word_starts(points)
    at = np.searchsorted(safe, hits)
    moved = safe[at[at < len(safe)]]
    cuts = np.unique(moved)
    ends, opens, last = [], [], 0
    least = target // 2
    for c in [*cuts[cuts < n].tolist(), n]:
        if c - last < least and c < n:
            continue
        while c - last > most:
            i = int(np.searchsorted(safe, last + most, side="right")) - 1
            if i >= 0 and safe[i] > last:
                ends.append(int(safe[i]))
                opens.append(False)
            else:
                ends.append(last + most)
                opens.append(True)
            last = ends[-1]
        ends.append(c)
        opens.append(False)
        last = c
    return ends, opens


def encode_corpus(df: DataFrame, id_col: str, text_col: str, target: int = 320, most: int = 4096, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, ids): the token ids of every row of df."""
    # The first shuffle moves about as many bytes as the texts have, the second fewer.
    width = width_for(df.select(id_col, text_col), 2)
    piece = pa.schema([("hash", pa.int64()), ("check", pa.int64()), ("use", pa.bool_()), ("uid", pa.int64()), ("id", pa.int64()), ("pos", pa.int32()), ("open", pa.bool_()), ("chunk", pa.binary())])

    def chunk(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        salt = np.int64(1 + TaskContext.get().partitionId() // SALT_TASKS)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                size, chunks, uids, ids, pos, opened = 0, [], [], [], [], []
                while at < len(texts) and size < 4_000_000:
                    text, start = texts[at], 0
                    ends, opens = chunk_ends(text, target, most)
                    for k, (end, is_open) in enumerate(zip(ends, opens)):
                        chunks.append(text[start:end].encode("utf-8", "surrogatepass"))
                        pos.append(k)
                        opened.append(is_open)
                        start = end
                    uids += [uid] * len(ends)
                    ids += [docs[at]] + [None] * (len(ends) - 1)
                    size += len(text)
                    uid += 1
                    at += 1
                codes: dict[bytes, int] = {}
                which = np.fromiter((codes.setdefault(c, len(codes)) for c in chunks), np.int64, len(chunks))
                distinct = list(codes)
                m = len(distinct)
                digest = np.frombuffer(b"".join(map(_digest, distinct)), np.int64).reshape(m, 2)
                digest, check = digest[:, 0].copy(), digest[:, 1].copy()
                # Multiplied, so that salts change all digits of what rows are spread by.
                with np.errstate(over="ignore"):
                    check[np.bincount(which, minlength=m) >= HOT_USES] ^= salt * np.int64(0x1E3779B97F4A7C15)
                yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(check), pa.array(np.zeros(m, bool)), *[pa.nulls(m, piece.field(i).type) for i in range(3, 7)], pa.array(distinct, pa.binary())], schema=piece)
                yield pa.RecordBatch.from_arrays([pa.array(digest[which]), pa.array(check[which]), pa.array(np.ones(len(which), bool)), pa.array(uids, pa.int64()), pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(opened, pa.bool_()), pa.nulls(len(which), pa.binary())], schema=piece)

    def encode(batches):
        tok = tokenizer(folder, name)
        held_key, held = None, b""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            use = batch.column(2).to_numpy(zero_copy_only=False)
            chunks = batch.column(7)
            out: list[bytes] = []
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if use[i]:
                    out.append(held)
                elif key != held_key:
                    held_key, held = key, _encode(tok, chunks[i].as_py())
            keep = pa.array(np.flatnonzero(use))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(keep) for i in (3, 4, 5, 6)], pa.array(out, pa.binary())], names=["uid", "id", "pos", "open", "ids"])

    def assemble(batches):
        tok = tokenizer(folder, name)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            uids = batch.column(0).to_numpy()
            first = int(np.searchsorted(uids, uids[-1]))
            if first:
                yield _documents(pa.Table.from_batches([*held, batch.slice(0, first)]), tok)
                held = []
            held.append(batch.slice(first))
        if held:
            yield _documents(pa.Table.from_batches(held), tok)

    filled = df.where(F.length(text_col) > 0).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t"))
    blank = df.where(F.coalesce(F.length(text_col), F.lit(0)) == 0).select(F.col(id_col).cast("bigint").alias("doc_id"), F.expr("cast(array() as array<int>)").alias("ids"))
    pieces = filled.mapInArrow(chunk, "hash bigint, check bigint, use boolean, uid bigint, id bigint, pos int, open boolean, chunk binary")
    coded = pieces.repartition(width, "hash", "check").sortWithinPartitions("hash", "check", "use").mapInArrow(encode, "uid bigint, id bigint, pos int, open boolean, ids binary")
    done = coded.repartition(width, "uid").sortWithinPartitions("uid", "pos").mapInArrow(assemble, "doc_id bigint, ids array<int>")
    return done.unionByName(blank)


def _digest(chunk: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(chunk)


def _encode(tok, chunk: bytes) -> bytes:
    return np.array(tok.encode_ordinary(chunk.decode("utf-8", "surrogatepass")), np.uint16).tobytes()


def _documents(table: pa.Table, tok) -> pa.RecordBatch:
    """One row for each text of rows sorted by (uid, pos)."""
    table = table.combine_chunks()
    uids = table.column("uid").to_numpy()
    opens = table.column("open").to_numpy(zero_copy_only=False)
    column = table.column("ids").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 2
    data = np.frombuffer(column.buffers()[2], np.uint16)
    starts = np.flatnonzero(np.r_[True, uids[1:] != uids[:-1]])
    stops = np.r_[starts[1:], len(uids)]
    if not opens.any():
        values = data[offsets[0] : offsets[-1]]
        lengths = offsets[stops] - offsets[starts]
    else:
        parts = []
        for a, b in zip(starts.tolist(), stops.tolist()):
            ids = data[offsets[a] : offsets[b]]
            if opens[a:b].any():
                ids = repair([data[offsets[i] : offsets[i + 1]].tolist() for i in range(a, b)], opens[a:b].tolist(), tok)
            parts.append(np.asarray(ids, np.uint16))
        values = np.concatenate(parts)
        lengths = np.array([len(p) for p in parts])
    ends = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))
    return pa.RecordBatch.from_arrays([table.column("id").combine_chunks().take(pa.array(starts)), lists], names=["doc_id", "ids"])


def _bytes_of(tok, ids: list[int]) -> bytes:
    return b"".join(tok.decode_tokens_bytes(ids))


def repair(chunks: list[list[int]], opens: list[bool], tok) -> list[int]:
    """The ids of a text whose chunks were cut at open ends.

    All chunks of one open stretch are joined; the last word start before the stretch and the
    first one after it bound what has to be re-encoded, and everything outside agrees.
    """
    out: list[int] = []
    i = 0
    while i < len(chunks):
        j = i
        while j < len(chunks) and opens[j]:
            j += 1
        if j == i:
            out += chunks[i]
            i += 1
            continue
        stretch = chunks[i : min(j, len(chunks) - 1) + 1]
        out += _rejoin(stretch, tok)
        i += len(stretch)
    return out


def _rejoin(stretch: list[list[int]], tok) -> list[int]:
    """Re-encode around each open join, on ever more ids of both sides, until both outer edges agree."""
    left = stretch[0]
    for right in stretch[1:]:
        reach = 16
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            whole = a == 0 and b == len(right)
            raw = _bytes_of(tok, left[a:] + right[:b])
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                text = None
            if text is not None:
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                starts = np.r_[0, np.cumsum([len(x) for x in tok.decode_tokens_bytes(left[a:] + right[:b])])]
                sizes = np.r_[0, np.cumsum(np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4))))]
                firm = np.intersect1d(sizes[word_starts(points)] if len(points) > 1 else [], starts)
                join = len(_bytes_of(tok, left[a:]))
                before, after = firm[firm < join], firm[firm > join]
                p = int(before[-1]) if len(before) else (0 if a == 0 else -1)
                q = int(after[0]) if len(after) else (len(raw) if b == len(right) else -1)
                if p >= 0 and q >= 0:
                    mid = tok.encode_ordinary(raw[p:q].decode("utf-8"))
                    x, y = int(np.searchsorted(starts, p)), int(np.searchsorted(starts, q))
                    left = left[:a] + (left[a:] + right[:b])[:x] + mid + (left[a:] + right[:b])[y:] + right[b:]
                    break
            if whole:
                left = tok.encode_ordinary(raw.decode("utf-8", "surrogatepass"))
                break
            reach *= 4
    return left


def count_tokens(df: DataFrame, keys: list[str], text_col: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """keys + (tokens): sizes of all texts in tokens; null and empty texts have 0."""
    shape = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", tokens bigint"

    def run(batches):
        tok = tokenizer(folder, name)
        for batch in batches:
            sizes = [len(tok.encode_ordinary(t)) if t else 0 for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], pa.array(sizes, pa.int64())], names=[*keys, "tokens"])

    return df.select(*keys, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, shape)
