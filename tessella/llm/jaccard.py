"""Texts that share nearly all their n-grams: a similarity join on sets of word n-grams.

Two texts are linked if their sets have a Jaccard similarity of at least ALIKE. Texts with the same set are one class and need no joining. N-grams
have one order, those that are frequent in all texts last, and a set's prefix is its first 1 + n/10: linked sets have an n-gram in both
prefixes. Classes that meet at an n-gram go through filters before any set is looked at: sizes (length filter), the places of the n-gram in both (positional
filter), how many n-grams the prefixes share, and, for what comes after, the n-grams that each has in each of BINS ranges of hashes (suffix filter).
What passes is verified once a pair on whole sets, which are made from the texts of these classes alone.

Components are what the result needs, so no group makes all its pairs: first each class asks one of those that it meets, and what that links needs no further comparing.
N-grams at which different components still meet go on. Classes that meet at n-grams with the same first class are a family; families are cut into blocks of bounded size, and
workers filter and verify two blocks at a time, and send an edge for each class that is linked, never pairs.

Defined cases: a text of fewer words is one n-gram; null and blank texts have an empty set, linked with nothing; long texts are read whole; a null
doc_id is never a component's id unless it has no other; repeated rows all get their row; an empty table gives no rows; other columns are ignored. N-grams are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, stored
from .shingles import connected, in_common, joined, shingler
from .simhash import components
from .words import parts, space_places, xxh64

SHINGLE = 3
#: The least similarity is ALIKE[0] / ALIKE[1].
ALIKE = (90, 100)
#: N-grams counted at once in a task; how many frequent ones have their own place in the order, which is what workers are sent (16 bytes each).
COUNTED, MOST = 1 << 20, 1 << 20
#: Ranges of the suffix filter.
BINS = 32
#: Classes, and n-grams of all of them, of a block, on average.
ROWS, GRAMS = 512, 1 << 20


def shingled(column: pa.Array, size: int = SHINGLE):
    """What shingler() gives for each text of a string column, in order. Words of about a megabyte of texts are hashed at once, because a call for each took most of the time."""
    shingles = shingler(size)
    for first, last, data, offsets in parts(column):
        data, starts, lengths, per_text = space_places(data, offsets, lower=True)
        h, begin = joined(xxh64(data, starts, lengths), size), 0
        for i, m in enumerate(per_text.tolist()):
            if 0 < m < size:
                yield shingles(column[first + i].as_py())
            else:
                s = np.sort(h[begin : begin + max(0, m - size + 1)])
                yield s[np.concatenate([s[:1] == s[:1], s[1:] != s[:-1]])]
            begin += m


def in_order(h: np.ndarray, first: int, late: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first so many of h, which is sorted: those that aren't in late, which is too, then those that are by their rank. Mostly these lie in the first places of h, so only they are looked up."""
    for some in (h[: 4 * first], h):
        at = np.minimum(np.searchsorted(late, some), len(late) - 1)
        is_late = late[at] == some if len(late) else np.zeros(len(some), bool)
        rare = some[~is_late][:first]
        if len(rare) == first:
            return rare
    return np.concatenate([rare, h[is_late][np.argsort(rank[at[is_late]])]])[:first]


def frequent(docs: DataFrame, size: int = SHINGLE, most: int = MOST, at_once: int = COUNTED) -> np.ndarray:
    """N-grams of docs(text) that are frequent, the most frequent last. Tasks count all texts and send what they find twice or more at once, so that rare n-grams aren't shuffled."""

    def run(batches):
        held, n = [], 0

        def counts():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[c > 1].view(np.int64)), pa.array(c[c > 1], pa.int64())], names=["h", "n"])

        for b in batches:
            for h in shingled(b.column(0), size):
                held.append(h)
                n += len(h)
                if n >= at_once:
                    yield counts()
                    held, n = [], 0
        if n:
            yield counts()

    top = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most).select("h").toArrow()
    return top.column("h").to_numpy()[::-1].view(np.uint64)


def sets(docs: DataFrame, late: np.ndarray, size: int = SHINGLE, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """doc_id, v (a hash of the text), key (names the set), n (its size), prefix (its first n-grams in order), bins (how many it has in each range) for docs(doc_id, text)."""
    by_hash = np.argsort(late)
    late, rank = late[by_hash], by_hash + 1
    kinds = pa.schema([("doc_id", pa.int64()), ("v", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("bins", pa.binary())])

    def run(batches):
        from xxhash import xxh3_128_digest

        for b in batches:
            out = []
            for h in shingled(b.column(2), size):
                n = len(h)
                bins = np.bincount((h >> np.uint64(59)).astype(np.int64), minlength=BINS)
                prefix = in_order(h, n - -(-alike[0] * n // alike[1]) + 1, late, rank) if n else h
                out.append((xxh3_128_digest(h.tobytes()), n, prefix.view(np.int64), np.minimum(bins, 65535).astype(np.uint16).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), *(pa.array(x, k.type) for x, k in zip(zip(*out) if out else [[]] * 4, list(kinds)[2:]))], schema=kinds)

    return docs.select("doc_id", F.xxhash64("text").alias("v"), "text").mapInArrow(run, "doc_id long, v long, key binary, n int, prefix array<long>, bins binary")


def can_meet(n: Column, at: Column, m: Column, to: Column, alike: tuple[int, int] = ALIKE) -> Column:
    """Whether different sets of n and m n-grams that have one in common, at these places, can be linked: by their sizes, and by what can come before and after it.
    Of different sets of one size each has an n-gram of its own."""
    a, b = alike
    n, m, at, to = (x.cast("long") for x in (n, m, at, to))
    common = F.least(F.least(at, to) + F.least(n - at, m - to), F.when(n == m, n - 1).otherwise(F.least(n, m)))
    return (b * F.least(n, m) >= a * F.greatest(n, m)) & ((a + b) * common >= a * (n + m))


def whole_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """id, s: the sorted hashes of the n-grams of those of classes that are in ids(id), from one text of each."""

    def whole(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.tobytes() for h in shingled(b.column(1), size)], pa.binary())], names=["id", "s"])

    named = stored(classes.join(ids.distinct(), "id").select("id", F.col("one.doc_id").alias("_d"), F.col("one.v").alias("_v")), "compared")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("v")).join(few(named, 32), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("v") == F.col("_v"))).select("id", "text")
    s = stored(texts.mapInArrow(whole, "id long, s binary"), "whole-sets")
    if s.groupBy("id").count().filter("count > 1").head(1):  # of rows that are there several times; else sets aren't moved for it
        s = s.dropDuplicates(["id"])
    return s


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int = SHINGLE, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """Those of pairs(a, b), which are different, that are linked: first by the suffix filter, then on whole sets."""

    def by_bins(batches):
        for b in batches:
            n, m = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, BINS).astype(np.int32) for i in (4, 5))
            # n + m less what only one of them has is twice what they have in common
            common = n + m - np.abs(x - y).sum(axis=1)
            keep = pa.array((alike[0] + alike[1]) * common >= 2 * alike[0] * (n + m))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns[:2]], names=["a", "b"])

    def compared(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(alike[1] * both >= alike[0] * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    about = classes.select("id", "n", "bins")
    sized = pairs.join(about.toDF("a", "n", "x"), "a").join(about.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    asked = stored(sized.mapInArrow(by_bins, "a long, b long"), "asked")
    s = whole_sets(asked.select(F.col("a").alias("id")).unionAll(asked.select("b")), classes, docs, size)
    return stored(asked.join(s.toDF("a", "x"), "a").join(s.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(compared, "a long, b long"), "linked")


def hubs(met: DataFrame) -> DataFrame:
    """met(h, id, ...) with hub, the class that comes first where it meets others, in an order that is the same everywhere."""
    return met.join(met.groupBy("h").agg(F.min(F.struct(F.xxhash64("id").alias("by"), *(c for c in met.columns if c != "h"))).alias("hub")), "h")


def asked_once(met: DataFrame, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """a, b: for each class b of met(h, id, n, at) that can be linked with the first class somewhere, the first of these."""
    able = hubs(met).filter((F.col("id") != F.col("hub.id")) & can_meet(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at"), alike))
    return able.groupBy("id").agg(F.min(F.struct("hub.by", "hub.id")).alias("hub")).select(F.col("hub.id").alias("a"), F.col("id").alias("b"))


def families(met: DataFrame, rows: int = ROWS, grams: int = GRAMS) -> DataFrame:
    """f, i, j, own, id, root: each class of met(h, id, n, root), in each of its families, once for each pair of blocks, i and j, that its own is in. Families of one component are left out."""
    each = stored(hubs(met).groupBy(F.col("hub.id").alias("f"), "id").agg(F.first("n").alias("n"), F.first("root").alias("root")), "families")
    about = each.groupBy("f").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most")
    blocks = F.greatest(F.ceil(F.col("c") / rows), F.ceil(F.col("s") / grams), F.lit(1)).cast("int")
    each = each.join(few(stored(about.select("f", blocks.alias("blocks")), "open-families"), 16), "f").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = each.select("f", "own", "id", "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    return each.select("f", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "id", "root")


def linked_in_families(met: DataFrame, classes: DataFrame, docs: DataFrame, size: int = SHINGLE, alike: tuple[int, int] = ALIKE, rows: int = ROWS, grams: int = GRAMS) -> DataFrame:
    """a, b: edges that connect all classes of met(h, id, n, root) of different components that meet and are linked.

    In a worker two blocks of a family are filtered by sizes and bins first, and those left by the n-grams in common of their prefixes; what may be linked goes on
    as parts, the connected classes of this graph, to be verified on whole sets. A part is named by its classes, so one found in several families is verified once."""
    a, b = alike
    block = ["f", "i", "j", "own", "id", "root"]

    def sized(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n, n of each two, and whether they can be linked by it."""
        n, root, own, i, j = (table.column(x).to_numpy() for x in ("n", "root", "own", "i", "j"))
        n = n.astype(np.int32)
        both = n[:, None] + n[None, :]
        mask = (root[:, None] != root[None, :]) & (b * np.minimum(n[:, None], n[None, :]) >= a * np.maximum(n[:, None], n[None, :]))
        if len(i) and i[0] != j[0]:
            mask &= own[:, None] != own[None, :]
        return n, both, mask

    def by_bins(table: pa.Table) -> pa.Table:
        _, both, mask = sized(table)
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint16).reshape(-1, BINS).astype(np.int32)
        x, y = np.nonzero(np.triu(mask))
        keep = np.zeros(len(mask), bool)
        for s in range(0, len(x), 1 << 16):
            p, q = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
            able = (a + b) * (both[p, q] - np.abs(bins[p] - bins[q]).sum(axis=1)) >= 2 * a * both[p, q]
            keep[p[able]] = keep[q[able]] = True
        return table.select(block).filter(pa.array(keep))

    def possible(table: pa.Table) -> pa.Table:
        from xxhash import xxh3_64_intdigest

        ids = table.column("id").to_numpy()
        n, both, mask = sized(table)
        # of the prefix that ends first all common n-grams are in both, so others are no more than what is left of its set
        left = -(-a * n // b) - 1
        met = in_common([x.values.to_numpy() for x in table.column("prefix")])
        mask &= (met > 0) & ((a + b) * (met + np.maximum(left[:, None], left[None, :])) >= a * both)
        keep = mask.any(axis=1)
        ids, part = ids[keep], connected(mask)[keep]
        order = np.lexsort((ids, part))
        ids, part = ids[order], part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        names = [xxh3_64_intdigest(p.tobytes()) for p in np.split(ids, cuts) if len(p)]
        sizes = np.diff(np.concatenate([[0], cuts, [len(ids)]])) if len(ids) else []
        return pa.table({"part": pa.array(np.repeat(np.array(names, np.uint64), sizes).view(np.int64), pa.int64()), "id": pa.array(ids, pa.int64())})

    def exact(table: pa.Table) -> pa.Table:
        ids, s = table.column("id").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("s")]
        n, both = np.array([len(x) for x in s]), in_common(s)
        label = connected(b * both >= a * ((n[:, None] + n[None, :]).astype(np.int32) - both))
        keep = label != np.arange(len(ids))
        return pa.table({"a": ids[label[keep]], "b": ids[keep]})

    able = families(met, rows, grams).join(classes.select("id", "n", "bins"), "id").select(*block, "n", "bins").groupBy("f", "i", "j")
    able = stored(able.applyInArrow(by_bins, "f long, i int, j int, own int, id long, root long"), "possible-by-bins")
    some = classes.select("id", "n", "prefix").join(few(stored(able.select("id").distinct(), "possible-ids"), 16), "id", "left_semi")
    found = able.join(some, "id").select(*block, "n", "prefix").groupBy("f", "i", "j")
    found = stored(found.applyInArrow(possible, "part long, id long").distinct(), "possible")
    return stored(found.join(whole_sets(found.select("id"), classes, docs, size), "id").groupBy("part").applyInArrow(exact, "a long, b long"), "linked")


def links(classes: DataFrame, docs: DataFrame, size: int = SHINGLE, alike: tuple[int, int] = ALIKE, rows: int = ROWS) -> DataFrame:
    """node, root: the components, of more than one, of stored classes(id, one, n, prefix, bins) by their links."""
    each = classes.select("id", F.posexplode("prefix").alias("at", "h"))
    several = each.groupBy("h").count().filter("count > 1").select("h")
    met = stored(each.join(several, "h", "left_semi").join(classes.select("id", "n"), "id").select("h", "id", "n", "at"), "met")
    edges = verified(asked_once(met, alike), classes, docs, size, alike)
    nodes = stored(components(edges), "components")
    rooted = met.join(nodes, F.col("id") == F.col("node"), "left").select("h", "id", "n", F.coalesce("root", "id").alias("root"))
    apart = rooted.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("h")
    more = linked_in_families(stored(rooted.join(apart, "h", "left_semi"), "still-met"), classes, docs, size, alike, rows)
    return stored(components(edges.unionAll(more)), "components")


def join(docs: DataFrame, size: int = SHINGLE, alike: tuple[int, int] = ALIKE, most: int = MOST, rows: int = ROWS) -> DataFrame:
    """doc_id, v (a hash of the text), n (size of the set), root (a number that names the component; null for empty sets), component_id (its least doc_id) for every row of docs(doc_id, text)."""
    each = stored(sets(docs, frequent(docs, size, most), size, alike), "sets")
    one = each.filter("n > 0").groupBy("key").agg(F.min(F.struct("doc_id", "v")).alias("one"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bins").alias("bins"))
    classes = stored(one.select(F.monotonically_increasing_id().alias("id"), "*"), "classes")
    nodes = links(classes, docs, size, alike, rows)
    of = classes.select("id", "key", "least").join(nodes, F.col("id") == F.col("node"), "left").select("key", "least", F.coalesce("root", "id").alias("root"))
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(named, "root").select("key", "root", "component_id")
    return each.join(of, "key", "left").select("doc_id", "v", "n", "root", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
