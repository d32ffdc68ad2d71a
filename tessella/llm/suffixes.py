"""Removal of every byte inside a string of 200 bytes that starts at more than one place.

Texts are dealt to groups once (shelves.py). Sorting every suffix of a corpus would move many times its size, so only suffixes that can have a partner are
sorted. Each window of 200 bytes selects the k-gram of least hash within it, its anchor; windows with the same bytes select the same anchor. Consecutive
windows that select the same place are a segment. Each group sends its distinct segments once, as anchor and 128-bit hash, to slices of the anchors' hash range, and is
told of each whether it occurs more than once, and whether its anchor has other segments too. Segments that occur whole more than once are repeated. An anchor that all
its places share with just one segment needs nothing else, and an anchor with one place has no repeated window. Only where an anchor has several
different segments are one text of each sent to the anchor's shard. There the suffixes are sorted by the difference-cover
algorithm: the triples at places not divisible by three are sorted and named, the string of names is sorted by recursion, the remaining suffixes are sorted
by their first byte and the rank of the next suffix, and both are merged. The recursion ends where names stand for 200 bytes. Neighbours
in the order are then compared over their first 200 bytes.

The segments of an anchor with more than HOT different ones, such as those at both ends of a passage that very many documents share, would
meet in one shard. Their windows are sent as hashes of 128 bits instead, once a group, spread over all slices, and counted there. So strings are the
same by their bytes in shards, and elsewhere if their 128-bit hashes (XXH3) are.

Defined cases: a null text is empty; texts under 200 bytes keep all; texts of any length are read whole, in pieces; documents that repeat as a whole lose all their
windows' bytes; a null doc_id stays null; repeated rows count as places of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xxhash import xxh3_128_digest

from .blobs import bits, flags, in_slices, joined, packed, rows, slice_of, unpacked
from .common import stored
from .shelves import in_order, shelved
from .words import BYTES, FIRST, U, mix

LENGTH, GRAM = 200, 48
#: Different segments of an anchor up to which they are sorted together.
HOT = 256
#: Bytes of text for each slice of anchors, and for each shard that sorts; sorting takes some 200 times what is sorted in a worker's memory.
SLICE, SHARD = 64 << 20, 4 << 20
#: An odd 64-bit constant: the base of byte sums (fixed value).
BASE = U(0x9E3779B97F4A7C15)
#: Bits of a place within a piece of text, in the keys that anchors are picked by.
PLACE = 22


def pieces(column: pa.Array, length: int):
    """(text, data, offsets, base) of consecutive texts of about BYTES, where data[offsets[i]:offsets[i + 1]] is text + i from its byte base on.

    A longer text comes alone, in pieces that overlap by length - 1 bytes."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + BYTES, "right")) - 1
        if last > first:
            yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], 0
            first = last
            continue
        whole = data[offsets[first] : offsets[first + 1]]
        for base in range(0, len(whole) - length + 1, BYTES - length + 1):
            piece = whole[base : base + BYTES]
            yield first, piece, np.array([0, len(piece)]), base
        first += 1


@lru_cache(maxsize=1)
def tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte; the first n powers of BASE, and of its inverse modulo 2**64."""
    inverse = U(pow(int(BASE), -1, 1 << 64))
    powers = [np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)]), dtype=U) for b in (BASE, inverse)]
    return mix(np.arange(1, 257, dtype=U) * FIRST), *powers


def prefix_sums(data: np.ndarray) -> np.ndarray:
    value, power, _ = tables(BYTES + (1 << 20))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(value[data] * power[: len(data)], out=sums[1:])
    return sums


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the 128-bit hashes of strings of data."""
    view = memoryview(np.ascontiguousarray(data))
    both = np.frombuffer(b"".join([xxh3_128_digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), U).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """text, start (within data), n (windows), anchor hash, both halves of the segment's hash of all segments; text counts from 0.

    Anchors are picked by sums of powers, quick but not collision-free; this only makes more segments meet. As least hashes they are small, and are mixed to fill the range."""
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none, none, none, *([none.astype(U)] * 3)
    sums, grams = prefix_sums(data), len(data) - gram + 1
    inverse = tables(BYTES + (1 << 20))[2]
    h = mix((sums[gram:] - sums[:grams]) * inverse[:grams])
    key = (h >> U(PLACE) << U(PLACE)) | np.arange(grams, dtype=U)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        key, width = np.minimum(key[: len(key) - width], key[width:]), 2 * width
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    at = (key & U((1 << PLACE) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + length <= offsets[1:][text]
    new = inside & np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[:-1]])
    start = np.flatnonzero(new)
    # a segment ends where another begins or a text's last window is passed
    stop = np.flatnonzero(np.concatenate([new[1:] | ~inside[1:], [True]]) & inside) + 1
    return text[start], start, stop - start, mix(h[at[start]]), *digests(data, start, stop + length - 1)


def order_of(s: np.ndarray, need: int) -> np.ndarray:
    """The order of the suffixes of s (values from 1 on) by their first need values at least, by the difference-cover algorithm."""
    n = len(s)
    s = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one, two, zero = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    cover = np.concatenate([one, two])
    most = int(s.max()) + 1
    pair = s[cover] * most + s[cover + 1]
    if most**3 >= 1 << 62:
        pair = np.unique(pair, return_inverse=True)[1]
    distinct, name = np.unique(pair * most + s[cover + 2], return_inverse=True)
    rank = np.zeros(n + 3, np.int64)
    if len(distinct) == len(cover) or need <= 3:
        rank[cover] = name + 1
        sampled = cover[np.argsort(name, kind="stable")]
    else:
        # names of places 1, 4, 7, ..., an end mark, and names of places 2, 5, 8, ...
        joined = np.concatenate([name[: len(one)] + 2, [1], name[len(one) :] + 2])
        order = order_of(joined, -(-need // 3))
        order = order[order != len(one)]
        sampled = cover[np.where(order > len(one), order - 1, order)]
    rank[sampled] = np.arange(1, len(sampled) + 1)
    base = n + 4
    rest = zero[np.argsort(s[zero] * base + rank[zero + 1], kind="stable")]
    # how many of the sampled suffixes are less than each of the rest
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    less = np.searchsorted(s[ones] * base + rank[ones + 1], s[rest] * base + rank[rest + 1])
    wide = np.concatenate([s[twos] * most + s[twos + 1], s[rest] * most + s[rest + 1]])
    if most * most * base >= 1 << 62:
        wide = np.unique(wide, return_inverse=True)[1]
    wide = wide * base + np.concatenate([rank[twos + 2], rank[rest + 2]])
    less += np.searchsorted(wide[: len(twos)], wide[len(twos) :])
    return np.insert(sampled, np.maximum.accumulate(less), rest) if len(rest) else sampled


def repeated_windows(data: np.ndarray, eligible: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place of data whether it is eligible and its next length bytes are those of another eligible place."""
    order = order_of(data.astype(np.int64) + 1, length)
    order = order[eligible[order]]
    out = np.zeros(len(data), bool)
    if len(order) < 2:
        return out
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    a, b, k = order[:-1], order[1:], np.arange(len(order) - 1)
    steps = [*range(0, length - 8, 8), length - 8] if length >= 8 else []
    for o in steps:
        same = np.ascontiguousarray(eight[a[k] + o]).view(U).ravel() == np.ascontiguousarray(eight[b[k] + o]).view(U).ravel()
        k = k[same]
    if not steps:
        k = k[[bytes(data[x : x + length]) == bytes(data[y : y + length]) for x, y in zip(a[k], b[k])]]
    out[a[k]] = out[b[k]] = True
    return out


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of each maximal run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: What is said of a segment, added up: it occurs more than once; it is asked for; it is one of more than HOT at its anchor.
DONE, ASK, MANY = 1, 2, 4
SENT = tuple(f"x{i}" for i in range(6))


def read(table: pa.Table, length: int, gram: int):
    """A group's rows in order; text, start, n, anchor and hash of its segments; the order of these by anchor and hash, where another begins in it."""
    table = in_order(table)
    none = np.zeros(0, np.int64)
    out = [(none, none, none, *([none.astype(U)] * 3))]
    for first, data, offsets, base in pieces(table.column("text").combine_chunks(), length):
        text, start, n, *hashes = segments(data, offsets, length, gram)
        out.append((first + text, start - offsets[text] + base, n, *hashes))
    text, start, n, anchor, w1, w2 = map(np.concatenate, zip(*out))
    order = np.lexsort((w2, w1, anchor))
    differs = lambda x: x[order][1:] != x[order][:-1]
    new = np.flatnonzero(np.concatenate([[True], differs(anchor) | differs(w1) | differs(w2)])) if len(text) else none
    return table, text, start, n, anchor, w1, w2, order, new


def decided(own: DataFrame, slices: int, length: int, gram: int, hot: int) -> DataFrame:
    """label, slice, n, said: for each group what is said of its distinct segments, in order."""

    def send(table: pa.Table) -> pa.Table:
        label, out = table.column("label")[0].as_py(), []
        _, _, _, _, anchor, w1, w2, order, new = read(table, length, gram)
        first, many = order[new], np.diff(np.append(new, len(order))) > 1
        to = slice_of(anchor[first], slices)
        for s in np.unique(to).tolist():
            a, b = np.searchsorted(to, (s, s + 1))
            x = first[a:b]
            out.append((s, label, packed(anchor[x]), packed(w1[x]), packed(w2[x]), packed(many[a:b].astype(np.uint8))))
        return pa.Table.from_batches([rows("slice", ("label", "anchor", "w1", "w2", "many"), out, label=pa.int32())])

    def decide(table: pa.Table) -> pa.Table:
        per = [int.from_bytes(x.as_py()[:8], "little") for x in table.column("anchor")]
        anchor, w1, w2, many = (joined(table, x, t) for x, t in (("anchor", U), ("w1", U), ("w2", U), ("many", np.uint8)))
        order = np.lexsort((np.repeat(table.column("label").to_numpy(), per), w2, w1, anchor))
        differs = lambda x: x[order][1:] != x[order][:-1]
        new_anchor = np.concatenate([[True], differs(anchor)])
        new = new_anchor | np.concatenate([[True], differs(w1) | differs(w2)])
        group, segment = np.cumsum(new_anchor) - 1, np.cumsum(new) - 1
        copies = np.bincount(segment, many[order].astype(np.int64) + 1)[segment] > 1
        different = np.bincount(group[new])[group]
        said = np.empty(len(order), np.uint8)
        said[order] = DONE * copies + ASK * (new & (different > 1)) + MANY * (different > hot)
        cut = np.split(said, np.cumsum(per)[:-1])
        s = table.column("slice")[0].as_py()
        return pa.Table.from_batches([rows("slice", ("label", "n", "said"), [(s, r, n, packed(x)) for r, n, x in zip(table.column("label").to_pylist(), per, cut)], label=pa.int32(), n=pa.int32())])

    sent = own.groupBy("label").applyInArrow(send, "slice int, label int, anchor binary, w1 binary, w2 binary, many binary")
    return sent.groupBy("slice").applyInArrow(decide, "slice int, label int, n int, said binary")


def sort_suffixes(own: DataFrame, said: DataFrame, slices: int, shards: int, length: int, gram: int) -> DataFrame:
    """label, slice, n, SENT: answers to each group. Of slice -1: texts, places and numbers of windows that are repeated (of segments that are), and texts, places
    and numbers among the distinct ones of windows that are counted; of slice -2: of repeated windows from a shard; others: bits of those that are counted, in order."""
    one = pa.schema([("place", pa.int64()), ("label", pa.int32()), *((x, pa.binary()) for x in SENT)])
    two = pa.schema([("label", pa.int32()), ("slice", pa.int32()), ("n", pa.int32()), *((x, pa.binary()) for x in SENT)])
    row = lambda *head_and_blobs, blobs: (*head_and_blobs, *blobs, *([None] * (len(SENT) - len(blobs))))

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(answers):
            return one.empty_table()
        label = table.column("label")[0].as_py()
        table, text, start, n, anchor, _, _, order, new = read(table, length, gram)
        codes = np.concatenate([unpacked(x, np.uint8) for _, x in in_slices(answers, ("n", "said"))])
        of = np.empty(len(order), np.uint8)
        of[order] = np.repeat(codes, np.diff(np.append(new, len(order))))
        done = np.flatnonzero(of & DONE)
        done = done[np.lexsort((start[done], text[done]))]
        asked = order[new][codes & ASK > 0]
        texts, out = table.column("text"), []
        part = lambda i: texts[text[i]].as_buffer()[start[i] : start[i] + n[i] + length - 1].to_pybytes()
        few = asked[of[asked] & MANY == 0]
        to = (anchor[few] % U(shards)).astype(np.int64)
        few, to = few[np.argsort(to, kind="stable")], np.sort(to)
        for s in np.unique(to).tolist():
            x = few[slice(*np.searchsorted(to, (s, s + 1)))]
            body = np.frombuffer(b"".join([part(i) for i in x.tolist()]), np.uint8)
            out.append(row(s, label, blobs=(packed(text[x].astype(np.uint32)), packed(start[x].astype(np.int32)), packed(n[x].astype(np.int32)), packed(body))))
        counted = asked[of[asked] & MANY > 0]
        hashes, none = [(np.zeros(0, U), np.zeros(0, U))], np.zeros(0, np.int64)
        for i in counted.tolist():
            begin = np.arange(n[i])
            hashes.append(digests(np.frombuffer(part(i), np.uint8), begin, begin + length))
        h1, h2 = map(np.concatenate, zip(*hashes))
        rank = np.lexsort((h2, h1))
        fresh = np.concatenate([[True], (h1[rank][1:] != h1[rank][:-1]) | (h2[rank][1:] != h2[rank][:-1])]) if len(rank) else np.zeros(0, bool)
        which = np.empty(len(rank), np.uint32)
        which[rank] = np.cumsum(fresh) - 1
        x, many = rank[fresh], np.bincount(which) > 1
        to = slice_of(h1[x], slices)
        for s in np.unique(to).tolist():
            a, b = np.searchsorted(to, (s, s + 1))
            out.append(row(shards + s, label, blobs=(packed(h1[x[a:b]]), packed(h2[x[a:b]]), packed(many[a:b].astype(np.uint8)))))
        at = np.concatenate([none, *(start[i] + np.arange(n[i]) for i in counted.tolist())])
        out.append(row(-1 - label, label, blobs=(packed(text[done].astype(np.uint32)), packed(start[done].astype(np.int32)), packed(n[done].astype(np.int32)), packed(np.repeat(text[counted], n[counted]).astype(np.uint32)), packed(at.astype(np.int32)), packed(which))))
        return pa.table([pa.array(c, k.type) for c, k in zip(zip(*out), one)], schema=one)

    def answer(table: pa.Table) -> pa.Table:
        place, labels = table.column("place")[0].as_py(), table.column("label").to_pylist()
        if place < 0:
            out = [row(labels[0], -1, None, blobs=tuple(table.column(x)[0].as_py() for x in SENT))]
        elif place >= shards:
            per = [int.from_bytes(x.as_py()[:8], "little") for x in table.column("x0")]
            h1, h2, many = (joined(table, x, t) for x, t in zip(SENT, (U, U, np.uint8)))
            order = np.lexsort((h2, h1))
            new = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
            which = np.cumsum(new) - 1
            more = np.empty(len(order), bool)
            more[order] = (np.bincount(which, many[order].astype(np.int64) + 1) > 1)[which]
            out = [row(r, place - shards, n, blobs=(bits(x),)) for r, n, x in zip(labels, per, np.split(more, np.cumsum(per)[:-1]))]
        else:
            per = [int.from_bytes(x.as_py()[:8], "little") for x in table.column("x0")]
            text, start, n, data = (joined(table, x, t) for x, t in zip(SENT, (np.uint32, np.int32, np.int32, np.uint8)))
            label = np.repeat(labels, per)
            size = n.astype(np.int64) + length - 1
            first = np.cumsum(size) - size
            segment = np.repeat(np.arange(len(n)), size)
            inner = np.arange(len(data)) - first[segment]
            a, b = ranges(repeated_windows(data, inner < n[segment], length))
            # eligible places of neighbouring segments are apart by length - 1 bytes, so that a run lies in one segment
            g, out = segment[a], []
            for r in np.unique(label[g]).tolist():
                x = np.flatnonzero(label[g] == r)
                out.append(row(r, -2, None, blobs=(packed(text[g[x]]), packed((start[g[x]] + inner[a[x]]).astype(np.int32)), packed((b - a)[x].astype(np.int32)))))
        return pa.table([pa.array(c, k.type) for c, k in zip(zip(*out) if out else [[]] * len(two), two)], schema=two)

    binary = "".join(f", {x} binary" for x in SENT)
    asked = own.groupBy("label").cogroup(said.groupBy("label")).applyInArrow(ask, f"place long, label int{binary}")
    return asked.groupBy("place").applyInArrow(answer, f"label int, slice int, n int{binary}")


def cut_out(text: bytes, at, n, length: int = LENGTH) -> tuple[bytes, int, int]:
    """What is left of text without the bytes of n windows from each at on; how many bytes are removed, in how many runs."""
    if not len(at):
        return text, 0, 0
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n + length - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    a, _ = ranges(gone)
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), len(a)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for every row of docs(doc_id, text)."""
    own, _, size = shelved(docs, F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices, shards = max(partitions, size // SLICE), max(partitions, size // SHARD)
    said = stored(decided(own, slices, length, gram, hot), "segments")
    found = stored(sort_suffixes(own, said, slices, shards, length, gram), "suffixes")
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    three = (np.uint32, np.int32, np.int32)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, gone, counted = in_order(table), [], []
        for slice_, n, *x in in_slices(answers, ("slice", "n", *SENT)) if len(answers) else ():
            if slice_ >= 0:
                counted.append(flags(x[0], n))
                continue
            gone.append([unpacked(b, t) for b, t in zip(x, three)])
            if slice_ == -1:
                text, at, which = (unpacked(b, t) for b, t in zip(x[3:], (np.uint32, np.int32, np.uint32)))
        if counted:
            more = np.concatenate(counted)[which]
            gone.append([text[more], at[more], np.ones(int(more.sum()), np.int32)])
        text, at, n = map(np.concatenate, zip(*gone)) if gone else (np.zeros(0, t) for t in three)
        order, out = np.argsort(text, kind="stable"), []
        text, at, n = text[order], at[order], n[order]
        edge = np.searchsorted(text, np.arange(len(table) + 1))
        for i, t in enumerate(table.column("text")):
            t, (a, b) = t.as_py(), edge[i : i + 2]
            kept, removed, spans = cut_out(t, at[a:b], n[a:b], length)
            out.append((len(t), removed, spans, kept))
        return pa.table([table.column("doc_id"), *(pa.array(x, k.type) for x, k in zip(zip(*out), list(kinds)[1:]))], schema=kinds)

    return own.groupBy("label").cogroup(found.groupBy("label")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
