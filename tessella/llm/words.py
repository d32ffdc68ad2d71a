"""Words of many texts at once, hashed in numpy from an Arrow column's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from xxhash import xxh3_128_intdigest, xxh64_intdigest

U = np.uint64
#: Odd 64-bit constants (fixed values).
FIRST, SECOND = U(0xC2B2AE3D27D4EB4F), U(0xFF51AFD7ED558CCD)
#: Bytes of text handled at once; a longer text is handled alone.
BYTES = 1 << 20
#: Bytes beyond which a word is hashed alone.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def parts(column: pa.Array):
    """(first, last, bytes, offsets) of consecutive texts of a string column of about BYTES each; null texts are empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if column.null_count:  # a null may have bytes behind it
        kept = column.fill_null("")
        yield from parts(kept)
        return
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BYTES, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def masks() -> np.ndarray:
    """Masks of the first 0 to 8 bytes of a little-endian number."""
    return np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def hashed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each string of data. Eight bytes at a time are mixed in, so that no algebra of positions makes strings collide."""
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    mask, n = masks(), lengths.astype(U)
    take = lambda at, left: np.ascontiguousarray(eight[at]).view(U).ravel() & mask[np.minimum(left, 8)]
    x = take(starts, lengths)
    h, g = mix(x ^ (n * FIRST)), mix(x * SECOND + n)
    rest = np.flatnonzero(lengths > 8)
    for i in rest[lengths[rest] > LONG].tolist():
        both = xxh3_128_intdigest(data[starts[i] : starts[i] + lengths[i]])
        h[i], g[i] = both & ((1 << 64) - 1), both >> 64
    rest, at = rest[lengths[rest] <= LONG], 8
    while len(rest):
        x = take(starts[rest] + at, lengths[rest] - at)
        h[rest], g[rest] = mix(h[rest] ^ x), mix(g[rest] + x * SECOND)
        at += 8
        rest = rest[lengths[rest] > at]
    return h, g


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The XXH64 of each string of data, with seed 0: those under 32 bytes all at once, longer ones alone."""
    one, two, three, four, five = (U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rotated = lambda x, by: (x << U(by)) | (x >> U(64 - by))
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    h, short = lengths.astype(U) + five, lengths < 32
    for at in (0, 8, 16):
        i = np.flatnonzero(short & (lengths >= at + 8))
        x = np.ascontiguousarray(eight[starts[i] + at]).view(U).ravel()
        h[i] = rotated(h[i] ^ (rotated(x * two, 31) * one), 27) * one + four
    left = lengths & 7
    x = np.ascontiguousarray(eight[starts + lengths - left]).view(U).ravel()
    i = np.flatnonzero(left >= 4)
    h[i] = rotated(h[i] ^ ((x[i] & U(0xFFFFFFFF)) * one), 23) * two + three
    x[i] >>= U(32)
    left = left & 3
    for k in range(3):
        i = np.flatnonzero(left > k)
        h[i] = rotated(h[i] ^ ((x[i] >> U(8 * k) & U(255)) * five), 11) * one
    h = (h ^ (h >> U(33))) * two
    h = (h ^ (h >> U(29))) * three
    h ^= h >> U(32)
    for i in np.flatnonzero(~short).tolist():
        h[i] = xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    return h


def space_places(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, in lower case if asked for, the start and length of each word between ASCII white space, in order, and how many words each text has."""
    n = len(data)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = np.ones(n + 1, bool)
    inside[:n] = (data != 32) & ((data < 9) | (data > 13))
    inside[n] = False
    before = np.concatenate([[False], inside[:-1]])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return data, starts, ends - starts, np.diff(np.searchsorted(starts, offsets))


def space_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word between ASCII white space, in order, and how many words each text has."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, U), np.zeros(len(offsets) - 1, np.int64)
    data, starts, lengths, per_text = space_places(data, offsets, lower)
    return *hashed(data, starts, lengths), per_text


def windows(h: np.ndarray, g: np.ndarray, per_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """h1, h2 (64 bits each, of either hash of the words), the text's number and the place of the first word, for each window of size words within a text."""
    m = len(h) - size + 1
    none = np.zeros(0, U)
    if m <= 0:
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(per_text)), per_text)
    end = np.cumsum(per_text)
    index = np.arange(m)
    whole = index + size <= end[text[:m]]
    # an odd factor for each place, without relation between places
    factors = mix(np.arange(1, 2 * size + 1, dtype=U) * FIRST) | U(1)
    a, b = np.zeros(m, U), np.zeros(m, U)
    for k in range(size):
        a += h[k : k + m] * factors[k]
        b += g[k : k + m] * factors[size + k]
    at = index - (end - per_text)[text[:m]]
    return mix(a)[whole], mix(b)[whole], text[:m][whole], at[whole]
