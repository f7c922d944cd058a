"""Arrow and numpy plumbing shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def binary_column(matrix: np.ndarray) -> pa.Array:
    """Rows of a contiguous matrix as an Arrow binary column, without a copy per row."""
    matrix = np.ascontiguousarray(matrix)
    n, width = matrix.shape[0], matrix.shape[1] * matrix.itemsize if matrix.ndim == 2 else matrix.itemsize
    offsets = (np.arange(n + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(matrix.tobytes())])


def _plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return column


def fixed_rows(column: pa.Array | pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """The inverse of binary_column for rows of one width (no nulls)."""
    column = _plain(column)
    n = len(column)
    if not n:
        return np.empty((0, width), dtype)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), dtype).reshape(n, width)


def list_column(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def usable_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors of a list column, and these vectors at unit length.

    Usable: not null, exactly ``dim`` numbers, all finite, not all zero.
    """
    column = _plain(column)
    n = len(column)
    if not n:
        return np.empty(0, np.int64), np.empty((0, dim), np.float32)
    offsets = column.offsets.to_numpy()
    good = np.flatnonzero((np.diff(offsets) == dim) & column.is_valid().to_numpy(zero_copy_only=False))
    values = column.values.to_numpy(zero_copy_only=False)
    x = values[offsets[good][:, None] + np.arange(dim)].astype(np.float64)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    good, x = good[ok], x[ok]
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return good, x.astype(np.float32)


def slices(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches cut where a key column changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        differs = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        cuts = [0, *(np.flatnonzero(differs) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def runs(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Consecutive rows of one key from batches sorted by the key columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for part in slices(batches, keys):
        key = tuple(part.column(k)[0].as_py() for k in keys)
        if held and key != last:
            yield pa.Table.from_batches(held)
            held = []
        last = key
        held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids of the rows of x; empty centroids restart at random rows."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        a = nearest(x, c)
        order = np.argsort(a, kind="stable")
        counts = np.bincount(a, minlength=k)
        filled = counts > 0
        starts = (np.cumsum(counts) - counts)[filled]
        c = x[rng.integers(len(x), size=k)].astype(np.float32)
        c[filled] = np.add.reduceat(x[order], starts, axis=0) / counts[filled][:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, block: int = 8192) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([(x[i : i + block] @ c.T - half).argmax(1) for i in range(0, len(x), block)] or [np.empty(0, np.int64)])


class Forest:
    """Union-find over arbitrary 64-bit ids; the smallest id names its tree."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent.setdefault(a, a)
        self.parent.setdefault(b, b)
        if a < b:
            self.parent[b] = a
        elif b < a:
            self.parent[a] = b

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        ids = np.fromiter(self.parent, np.int64, len(self.parent))
        return ids, np.fromiter((self.find(int(i)) for i in ids), np.int64, len(ids))
