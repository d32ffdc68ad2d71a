"""Numpy arrays in rows: many values travel as one compressed blob for each group and slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import U


def packed(a: np.ndarray) -> bytes:
    """a, byte planes apart and compressed."""
    if not len(a):
        return bytes(8)
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T
    return len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(b: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    return np.frombuffer(np.frombuffer(pa.decompress(b[8:], n * size, codec="zstd"), np.uint8).reshape(size, n).T.tobytes(), kind)


def joined(table: pa.Table, name: str, kind) -> np.ndarray:
    """All values of a column of blobs."""
    return np.concatenate([unpacked(b.as_py(), kind) for b in table.column(name)] or [np.zeros(0, kind)])


def rows(first: str, names, out: list[tuple], **others: pa.DataType) -> pa.RecordBatch:
    """A batch of a number, first, and blobs; others: columns that are no blobs."""
    kinds = pa.schema([(first, pa.int32()), *((x, others.get(x, pa.binary())) for x in names)])
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], schema=kinds)


def bits(flags: np.ndarray) -> bytes:
    return packed(np.packbits(flags, bitorder="little"))


def flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unpacked(blob, np.uint8), count=n, bitorder="little").astype(bool) if n else np.zeros(0, bool)


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    """The slice of the range of 64-bit hashes in which each of h lies."""
    return ((h >> U(32)) * U(slices)) >> U(32)


def in_slices(table: pa.Table, names: tuple[str, ...]) -> list[tuple]:
    """Rows of answers to one group, in the order of their slices."""
    table = table.take(np.argsort(table.column("slice").to_numpy(), kind="stable"))
    return list(zip(*(table.column(x).to_pylist() for x in names)))
