"""Removal of word windows that a document with a smaller id has too.

Texts are dealt to groups once (shelves.py). First pass: each group counts its windows in a count-min sketch of two rows and sends the cells
that it touched, sorted and compressed, to slices of the windows' hash range; a slice merges the partial sketches and answers each group with a bit for
each cell, whether it counts two or more. A cell holds no less than the count of any of its windows, so a window found twice or more is never
missed. The sketch has CELLS cells in a row for each window whatever the input, since no task and no driver ever holds more than a slice. Second
pass: of the windows whose cells all count two or more each group sends every distinct one once, as a 128-bit hash with the smallest id it has there; slices
group them exactly and answer with a bit, whether another group has a smaller one. So copies of one window make an entry for each group, not for each
document, and nothing is ever paired. Windows are the same if their 128-bit hashes are.

Defined cases: null or short texts have no windows and keep all words; documents with the same id don't remove each other's words; a
null doc_id counts as larger than any; repeated rows all get their row; an empty table gives no rows; other columns are ignored; texts and words of
any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import bits, flags, in_slices, joined, packed, rows, slice_of, unpacked
from .common import stored
from .shelves import in_order, shelved
from .words import U, parts, space_words, windows

WINDOW = 13
#: Cells in a row of the sketch for each window; windows of a slice, on average.
CELLS, SLICE = 4, 4 << 20
LOW = U((1 << 32) - 1)


def read(table: pa.Table, size: int):
    """A group's rows in order; h1, h2, the row's place in the group and the first word's place of each of its windows."""
    table, out = in_order(table), [(np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32))]
    for first, _, data, offsets in parts(table.column("text").combine_chunks()):
        a, b, text, at = windows(*space_words(data, offsets), size)
        out.append((a, b, text + first, at.astype(np.int32)))
    return table, *map(np.concatenate, zip(*out))


def touched(h1: np.ndarray, h: np.ndarray, slices: int, cells: int):
    """The order of the windows by slice and cell; where another cell begins in it; the slice and the cell of each of these."""
    key = slice_of(h1, slices) << U(32) | (h & LOW & U(cells - 1))
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return order, new, key[new] >> U(32), (key[new] & LOW).astype(np.uint32)


COUNTED, SEEN = ("label", "c0", "m0", "c1", "m1"), ("label", "n0", "b0", "n1", "b1")
ASKED, TOLD = ("h1", "h2", "id", "none"), ("text", "at", "which", "over")


def estimated(own: DataFrame, size: int, slices: int, cells: int) -> DataFrame:
    """For each group and slice a bit for each cell that the group touched there, in order, in either row: whether it counts two or more."""

    def count(table: pa.Table) -> pa.Table:
        label, out = table.column("label")[0].as_py(), []
        _, h1, h2, _, _ = read(table, size)
        cut = []
        for h in (h1, h2):
            order, new, to, cell = touched(h1, h, slices, cells)
            cut.append((to, cell, np.diff(np.append(new, len(order))) > 1))
        for s in np.unique(cut[0][0]).tolist():
            one = [label]
            for to, cell, many in cut:
                a, b = np.searchsorted(to, (s, s + 1))
                one += [packed(np.diff(cell[a:b], prepend=np.uint32(0))), bits(many[a:b])]
            out.append((s, *one))
        return pa.Table.from_batches([rows("slice", COUNTED, out, label=pa.int32())])

    def merge(table: pa.Table) -> pa.Table:
        s, sent = table.column("slice")[0].as_py(), list(zip(*(table.column(x).to_pylist() for x in COUNTED)))
        answers = []
        for c, m in ((1, 2), (3, 4)):
            counted, at = np.zeros(cells, np.uint8), []
            for r in sent:
                x = np.cumsum(unpacked(r[c], np.uint32), dtype=np.uint32)
                at.append(x)
                counted[x] = np.minimum(counted[x] + 1 + flags(r[m], len(x)), 2)
            answers.append([(len(x), bits(counted[x] == 2)) for x in at])
        return pa.Table.from_batches([rows("slice", SEEN, [(s, r[0], *a, *b) for r, a, b in zip(sent, *answers)], label=pa.int32(), n0=pa.int32(), n1=pa.int32())])

    kinds = "slice int, label int, c0 binary, m0 binary, c1 binary, m1 binary"
    return own.groupBy("label").applyInArrow(count, kinds).groupBy("slice").applyInArrow(merge, "slice int, label int, n0 int, b0 binary, n1 int, b1 binary")


def exactly(own: DataFrame, seen: DataFrame, size: int, slices: int, cells: int) -> DataFrame:
    """label, slice, n, bits, and TOLD: for each group, in a row of slice -1, its windows that are estimated repeated (the text's place, the first
    word's, the number of the distinct window, whether the group has a smaller id there); in others, for its distinct windows in order, whether another group has."""
    one = pa.schema([("place", pa.int64()), ("label", pa.int32()), *((x, pa.binary()) for x in (*ASKED, *TOLD))])
    two = pa.schema([("label", pa.int32()), ("slice", pa.int32()), ("n", pa.int32()), ("bits", pa.binary()), *((x, pa.binary()) for x in TOLD)])

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(answers):
            return one.empty_table()
        label = table.column("label")[0].as_py()
        table, h1, h2, text, at = read(table, size)
        told, keep = in_slices(answers, SEEN), np.ones(len(h1), bool)
        for h, n, b in ((h1, 1, 2), (h2, 3, 4)):
            order, new, _, _ = touched(h1, h, slices, cells)
            more = np.concatenate([flags(r[b], r[n]) for r in told])
            keep[order] &= np.repeat(more, np.diff(np.append(new, len(order))))
        h1, h2, text, at = h1[keep], h2[keep], text[keep], at[keep]
        ids = table.column("doc_id").combine_chunks()
        none, ids = (ids.is_null().to_numpy(zero_copy_only=False)[text], ids.fill_null(0).to_numpy()[text])
        order = np.lexsort((ids, none, h2, h1))
        a, b = h1[order], h2[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        which, first = np.cumsum(new) - 1, order[new]
        over = (ids[order] != ids[first][which]) | (none[order] != none[first][which])
        back = np.lexsort((at[order], text[order]))
        out = [(-1 - label, label, *([None] * 4), packed(text[order][back].astype(np.uint32)), packed(at[order][back]), packed(which[back].astype(np.uint32)), bits(over[back]))]
        to = slice_of(h1[first], slices)
        for s in np.unique(to).tolist():
            x = first[slice(*np.searchsorted(to, (s, s + 1)))]
            out.append((s, label, packed(h1[x]), packed(h2[x]), packed(ids[x]), packed(none[x].astype(np.uint8)), *([None] * 4)))
        return pa.table([pa.array(x, k.type) for x, k in zip(zip(*out), one)], schema=one)

    def answer(table: pa.Table) -> pa.Table:
        place = table.column("place")[0].as_py()
        if place < 0:
            return pa.table([table.column("label"), pa.array([-1], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), *(table.column(x) for x in TOLD)], schema=two)
        per = [int.from_bytes(x.as_py()[:8], "little") for x in table.column("h1")]
        h1, h2, ids, none = (joined(table, x, t) for x, t in zip(ASKED, (U, U, np.int64, np.uint8)))
        order = np.lexsort((ids, none, h2, h1))
        a, b = h1[order], h2[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        least = order[new][np.cumsum(new) - 1]
        more = np.empty(len(order), bool)
        more[order] = (ids[order] != ids[least]) | (none[order] != none[least])
        cut = np.split(more, np.cumsum(per)[:-1])
        none = pa.nulls(len(per), pa.binary())
        return pa.table([table.column("label"), pa.array([place] * len(per), pa.int32()), pa.array(per, pa.int32()), pa.array(map(bits, cut), pa.binary()), none, none, none, none], schema=two)

    binary = lambda names: "".join(f", {x} binary" for x in names)
    asked = own.groupBy("label").cogroup(seen.groupBy("label")).applyInArrow(ask, f"place long, label int{binary((*ASKED, *TOLD))}")
    return asked.groupBy("place").applyInArrow(answer, f"label int, slice int, n int, bits binary{binary(TOLD)}")


def kept_words(words: list[bytes], places, size: int = WINDOW) -> tuple[list[bytes], int]:
    """The words outside the windows at places, and how many are inside."""
    if places is None or not len(places):
        return words, 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + size, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def dedup(docs: DataFrame, size: int = WINDOW, cells: float = CELLS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words, joined by spaces) for every row of docs(doc_id, text). cells: of a row of the sketch for each window."""
    own, _, n_bytes = shelved(docs, F.coalesce("text", F.lit("")))
    n = n_bytes // 6  # a word and a space
    slices = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // SLICE)
    per_slice = 1 << max(4, int(cells * n / slices).bit_length())
    seen = stored(estimated(own, size, slices, per_slice), "estimated")
    told = stored(exactly(own, seen, size, slices, per_slice), "repeated-windows")
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.large_binary())])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, gone = in_order(table), {}
        if len(answers):
            head, *rest = in_slices(answers, ("n", "bits", *TOLD))
            text, at, which = (unpacked(x, t) for x, t in zip(head[2:5], (np.uint32, np.int32, np.uint32)))
            more = np.concatenate([np.zeros(0, bool), *(flags(b, n) for n, b, *_ in rest)])
            x = np.flatnonzero(more[which] | flags(head[5], len(which)))
            text, at = text[x], at[x]
            cuts = np.flatnonzero(np.diff(text)) + 1
            gone = dict(zip(text[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts))) if len(x) else {}
        out = []
        for i, t in enumerate(table.column("text")):
            words = t.as_buffer().to_pybytes().split()
            kept, n = kept_words(words, gone.get(i), size)
            out.append((len(words), n, b" ".join(kept)))
        return pa.table([table.column("doc_id"), *(pa.array(x, k.type) for x, k in zip(zip(*out), list(kinds)[1:]))], schema=kinds).cast(kinds.set(3, pa.field("kept", pa.binary())))

    return own.groupBy("label").cogroup(told.groupBy("label")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.decode("kept", "UTF-8"))
