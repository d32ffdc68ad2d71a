"""Near copies by exact similarity of shingles.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of at least 0.8; groups are what such pairs
connect. Texts with the same set are merged first. SimHash proposes pairs: fingerprints of the sets within its radius, found by its vantage-point
trees, a pair for each linked fingerprint and one for each further set with the same, which are compared exactly. Near copies whose fingerprints lie farther apart, as most do at this similarity, come from prefixes: with the shingles of every text in one order, two
near copies share a shingle among the first 1 + n/5 of each, so no pair is lost, whatever the order is. Shingles that a bounded sample
shows to be common come last in it, so that few texts meet at them. Where several texts meet, each is first compared with the first of them;
what that connects needs no further comparing, so a large group of near copies makes no pairs. What it leaves open is compared in a second round, in
families of the texts that meet at shingles with the same first text: workers get blocks of a bounded size, first of prefixes and then, of those that can be alike, of whole
sets, and send one edge for each text that is connected, never pairs. Comparing is exact, up to equal 64-bit hashes of different shingles.

Defined cases: words are those of SimHash; a null or blank text has no shingles and all of these are one group; a text of one to four
words is one shingle; a null doc_id stays null; repeated rows all get their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, release, stored
from .simhash import LOWERED, RADIUS, components, near_edges, voted

SHINGLE = 5
#: The least similarity is ALIKE[0] / ALIKE[1].
ALIKE = (4, 5)
#: Texts in which common shingles are looked for; how many of these have one that is common; common shingles at most.
SAMPLE, COMMON, MOST = 8192, 8, 1 << 18
#: Places between marks of a prefix; what the places of common shingles begin with.
MARKS, LATE = 16, (1 << 63) - (1 << 32)
#: Words whose hashes a worker remembers.
REMEMBERED = 1 << 16
#: Classes and shingles of a block at most, on average; shingles that are counted at once.
ROWS, SHINGLES, COLUMNS = 1024, 1 << 20, 2048


def joined(w: np.ndarray, size: int) -> np.ndarray:
    """The hash of each size hashes of words in a row."""
    n = max(0, len(w) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += w[k : k + n] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(33))


def shingler(size: int = SHINGLE):
    """A function from a text to the sorted hashes of its different shingles."""
    from xxhash import xxh64_intdigest

    known: dict[bytes, int] = {}

    def hashed(word: bytes) -> int:
        if (h := known.get(word)) is None:
            if len(known) >= REMEMBERED:
                known.clear()
            h = known[word] = xxh64_intdigest(word)
        return h

    def shingles(text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(LOWERED).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < size:
            return np.array([xxh64_intdigest(b" ".join(words))], np.uint64)
        return np.unique(joined(np.fromiter(map(hashed, words), np.uint64, len(words)), size))

    return shingles


def common(docs: DataFrame) -> np.ndarray:
    """Shingles that are common in a sample of docs(text), the most common last."""
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, docs.count() // SAMPLE))) == 0)

    def run(batches):
        shingles = shingler()
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()).view(np.int64))], names=["h"])

    top = some.select("text").mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST)
    return np.array([r[0] for r in top.collect()][::-1], np.int64).view(np.uint64)


def marked(n: int) -> np.ndarray:
    """MARKS + 1 indices into a prefix of n shingles, evenly from the first to the last."""
    return np.arange(MARKS + 1) * (n - 1) // MARKS


def before(marks: np.ndarray, n: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each set (marks and length of its prefix) and each of the ends of other prefixes, at least how many of its shingles come before that end and
    its own: these are in its prefix."""
    out = np.zeros((len(n), len(other)), np.int32)
    for i, (m, size) in enumerate(zip(marks, n.tolist())):
        inside = np.searchsorted(m, np.minimum(other, m[-1]))  # marks before the end
        out[i] = np.where(inside > 0, marked(size)[np.maximum(inside, 1) - 1] + 1, 0)
    return out


def prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, v (a hash of the text), key (names the set of shingles), n (its size), fp (its SimHash fingerprint), prefix (its first shingles), marks (the places in the order of
    MARKS + 1 of these, from the first to the last) for docs(doc_id, text)."""
    late = common(docs)
    order = np.argsort(late)
    late, rank = late[order], order + 1
    kinds = pa.schema([("doc_id", pa.int64()), ("v", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("fp", pa.int64()), ("prefix", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64()))])

    def run(batches):
        from xxhash import xxh3_128_digest

        shingles = shingler()
        for b in batches:
            keys, sizes, fps, firsts, marks = [], [], [], [], []
            for t in b.column(2):
                h = shingles(t.as_py())
                n = len(h)
                keys.append(xxh3_128_digest(h.tobytes()))
                sizes.append(n)
                fps.append(voted(h))
                place = (h >> np.uint64(1)).view(np.int64)  # in the order; common shingles follow all others
                if len(late) and n:
                    at = np.minimum(np.searchsorted(late, h), len(late) - 1)
                    ranks = np.where(late[at] == h, rank[at], 0)
                    order = np.argsort(ranks, kind="stable")
                    place = np.where(ranks > 0, LATE + ranks, place)[order]
                    h = h[order]
                firsts.append(h[: n - -(-ALIKE[0] * n // ALIKE[1]) + 1].view(np.int64))
                marks.append(place[marked(len(firsts[-1]))] if n else place)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))], schema=kinds)

    return docs.select("doc_id", F.xxhash64("text").alias("v"), "text").mapInArrow(run, "doc_id long, v long, key binary, n int, fp long, prefix array<long>, marks array<long>")


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - -(-ALIKE[0] * n // ALIKE[1]) + 1


def candidates(meetings: DataFrame) -> DataFrame:
    """a, b of those pairs of meetings(a, b, n, m: one row for each shingle that both prefixes have, and the sets' sizes) that can be alike.

    Of the prefix that ends first all common shingles are in both prefixes, so no more than these and the rest of its set are common."""
    a, b = ALIKE
    rest = lambda n: F.floor((a * n + b - 1) / b) - 1
    n, m = F.col("n").cast("long"), F.col("m").cast("long")
    sized = meetings.filter(b * F.least(n, m) >= a * F.greatest(n, m))
    return sized.groupBy("a", "b", "n", "m").count().filter((a + b) * (F.col("count") + F.greatest(rest(n), rest(m))) >= a * (n + m))


def in_place(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b of candidates that can be alike by the places of their prefixes too: beyond the end of the one that ends first, no more are common than either has left."""

    def run(batches):
        for b in batches:
            n, m, both = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4))
            x, y = (np.stack([v.values.to_numpy() for v in b.column(i)]) if len(b) else np.zeros((0, MARKS + 1), np.int64) for i in (5, 6))
            left = [np.array([int(before(p[i : i + 1], prefix_size(k[i : i + 1]), q[i : i + 1, -1])[0, 0]) for i in range(len(b))], np.int64) for p, q, k in ((x, y, n), (y, x, m))]
            keep = pa.array((ALIKE[0] + ALIKE[1]) * (both + np.minimum(n - left[0], m - left[1])) >= ALIKE[0] * (n + m))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns[:2]], names=["a", "b"])

    marks = classes.select("id", "marks")
    found = pairs.join(marks.withColumnsRenamed({"id": "a", "marks": "x"}), "a").join(marks.withColumnsRenamed({"id": "b", "marks": "y"}), "b")
    return found.select("a", "b", "n", "m", "count", "x", "y").mapInArrow(run, "a long, b long")


def shingle_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """id, s: the sorted hashes of the shingles of those of classes that are in ids(id)."""
    named = stored(classes.join(ids.distinct(), "id").select("id", F.col("one.doc_id").alias("_d"), F.col("one.v").alias("_v")), "compared")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("v")).join(few(named, 32), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("v") == F.col("_v"))).select("id", "text")

    def sets(batches):
        shingles = shingler()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["id", "s"])

    return stored(texts.mapInArrow(sets, "id long, s binary").dropDuplicates(["id"]), "shingle-sets")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sets(id, s) are alike."""

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(ALIKE[1] * both >= ALIKE[0] * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("x")), sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "alike")


def in_common(arrays: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of arrays, which are sets, have in common."""
    at = np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
    token, which, n = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1  # of those that several sets have
    several = (n > 1)[which]
    at, which = at[several], number[which[several]]
    order = np.argsort(which, kind="stable")
    at, which = at[order], which[order]
    out = np.zeros((len(arrays), len(arrays)), np.float32)
    for s in range(0, int((n > 1).sum()), COLUMNS):
        a, b = np.searchsorted(which, (s, s + COLUMNS))
        x = np.zeros((len(arrays), COLUMNS), np.float32)
        x[at[a:b], which[a:b] - s] = 1
        out += x @ x.T
    return out.astype(np.int32)


def connected(mask: np.ndarray) -> np.ndarray:
    """For each of the nodes of a symmetric matrix the least one that it is connected with."""
    label = np.arange(len(mask), dtype=np.int32)
    while True:
        least = np.minimum(label, np.where(mask, label[None, :], np.int32(len(label))).min(axis=1, initial=len(label)))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def families(shared: DataFrame, nodes: DataFrame, rows: int = ROWS, size: int = SHINGLES) -> DataFrame:
    """f, kind, i, j, id, n, met (shingles at which the class meets others), root: the classes to be compared with each other. All classes that meet at shingles with the same first class are a family,
    so every two that meet anywhere are in one, and no class is sent once for each of its shingles. A family in which all are connected, or that has no third
    member, is settled. Families beyond rows or size are cut into blocks; those of its most frequent root are compared with blocks of the rest only."""
    each = shared.groupBy(F.col("first.id").alias("f"), "id").agg(F.first("n").alias("n"), F.count("*").alias("met"))
    each = each.withColumn("met", F.sum("met").over(Window.partitionBy("id")).cast("int"))
    each = each.join(nodes.select(F.col("node").alias("id"), "root"), "id", "left").select("f", "id", "n", "met", F.coalesce("root", "id").alias("root"))
    each = stored(each, "families")
    release(each.sparkSession)
    roots = each.groupBy("f", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = lambda c, s: F.greatest(F.ceil(c / rows), F.ceil(s / size), F.lit(1)).cast("int")
    about = roots.groupBy("f").agg(F.max(F.struct("c", "root", "s")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("n_roots"))
    about = about.filter("n_roots > 1 and c > 2").select(F.col("f").alias("_f"), F.col("top.root").alias("top"), blocks(F.col("c"), F.col("s")).alias("all"), blocks(F.col("top.c"), F.col("top.s")).alias("inner"), blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("outer"))
    each = each.join(few(stored(about, "open-families"), 48), F.col("f") == F.col("_f"))
    to = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda n: F.pmod(F.xxhash64("id"), n)
    one = F.array(to("all", F.lit(0), F.lit(0)))
    inner = F.transform(upto(F.col("outer")), lambda j: to("both", place(F.col("inner")), j))
    own = place(F.col("outer"))
    outer = F.concat(F.transform(upto(F.col("inner")), lambda i: to("both", i, own)), F.transform(upto(F.col("outer")), lambda k: to("outer", F.least(k, own), F.greatest(k, own))))
    return each.select("f", "id", "n", "met", "root", F.inline(F.when(F.col("all") == 1, one).when(F.col("root") == F.col("top"), inner).otherwise(outer)))


def can_be_alike(n: np.ndarray, root: np.ndarray, both: np.ndarray, marks: list[np.ndarray]) -> np.ndarray:
    """Which two of sets of n shingles with so many of their prefixes' in common, at most, can be alike and have different roots.

    Beyond the end of the prefix that ends first, no more are common than either set has left."""
    a, b = ALIKE
    n = n.astype(np.int32)
    mask = (both > 0) & (root[:, None] != root[None, :])
    mask &= b * np.minimum(n[:, None], n[None, :]) >= a * np.maximum(n[:, None], n[None, :])
    left = n[:, None] - before(np.stack(marks), prefix_size(n), np.array([m[-1] for m in marks]))
    mask &= (a + b) * (both + np.minimum(left, left.T)) >= a * (n[:, None] + n[None, :])
    return mask


def linked(shared: DataFrame, nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: edges that connect, with nodes(node, root), all classes that meet in shared and are alike. Blocks are compared in workers, which send no pairs:
    first sizes and places of prefixes, then the prefixes of those that can be alike by these, then the sets of those that can be by their prefixes."""
    by = ["f", "kind", "i", "j"]

    def sized(table: pa.Table) -> pa.Table:
        n, root, met = (table.column(x).to_numpy() for x in ("n", "root", "met"))
        marks = [x.values.to_numpy() for x in table.column("marks")]
        keep = pa.array(can_be_alike(n, root, np.minimum(met[:, None], met[None, :]), marks).any(axis=1))
        return pa.table([table.column(x).filter(keep) for x in (*by, "id", "root")], names=[*by, "id", "root"])

    def possible(table: pa.Table) -> pa.Table:
        from xxhash import xxh3_64_intdigest

        n, root, prefix = table.column("n").to_numpy(), table.column("root").to_numpy(), [x.values.to_numpy().view(np.uint64) for x in table.column("prefix")]
        mask = can_be_alike(n, root, in_common(prefix), [x.values.to_numpy() for x in table.column("marks")])
        keep = mask.any(axis=1)
        ids, part = table.column("id").to_numpy()[keep], connected(mask)[keep]
        order = np.lexsort((ids, part))
        ids, part = ids[order], part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        # a part is named by its ids, so that one found in several families is compared once
        names = [xxh3_64_intdigest(x.tobytes()) for x in np.split(ids, cuts) if len(x)]
        sizes = np.diff(np.concatenate([[0], cuts, [len(ids)]])) if len(ids) else []
        return pa.table({"part": pa.array(np.repeat(np.array(names, np.uint64), sizes).view(np.int64), pa.int64()), "id": pa.array(ids, pa.int64())})

    def exact(table: pa.Table) -> pa.Table:
        ids, sets = table.column("id").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("s")]
        n, both = np.array([len(x) for x in sets]), in_common(sets)
        label = connected(ALIKE[1] * both >= ALIKE[0] * ((n[:, None] + n[None, :]).astype(np.int32) - both))
        keep = label != np.arange(len(ids))
        return pa.table({"a": ids[label[keep]], "b": ids[keep]})

    head = "f long, kind string, i int, j int, id long"
    small = families(shared, nodes).join(classes.select("id", "marks"), "id").select(*by, "id", "n", "met", "root", "marks")
    some = stored(small.groupBy(*by).applyInArrow(sized, f"{head}, root long"), "possible-by-size")
    release(docs.sparkSession)
    prefixed = some.join(classes.select("id", "n", "prefix", "marks").join(few(stored(some.select("id").distinct(), "possible-ids"), 16), "id", "left_semi"), "id")
    found = stored(prefixed.select(*by, "id", "n", "root", "prefix", "marks").groupBy(*by).applyInArrow(possible, "part long, id long").distinct(), "possible")
    release(docs.sparkSession)
    if not found.head(1):
        return found.select(F.col("id").alias("a"), F.col("id").alias("b"))
    sets = shingle_sets(found.select("id"), classes, docs)
    return stored(found.join(sets, "id").groupBy("part").applyInArrow(exact, "a long, b long"), "linked")


def near_fingerprints(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: pairs of classes(id, n, fp) that SimHash links, to be compared: one for each linked fingerprint, between the first classes that have the two, and one for each further class of a fingerprint."""
    some = classes.filter("n > 0").select("id", "fp")
    heads = stored(some.groupBy("fp").agg(F.min("id").alias("head")), "fingerprints")
    same = some.join(heads, "fp").filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    edges = stored(near_edges(heads.select("fp"), radius), "near-fingerprints")
    ends = [heads.select(F.col("fp").alias(end), F.col("head").alias(f"_{end}")) for end in ("a", "b")]
    return same.unionByName(edges.join(ends[0], "a").join(ends[1], "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, v (a hash of the text), root (a number that names the group) for every row of docs(doc_id, text)."""
    each = stored(prefixes(docs), "prefixes")
    merged = each.groupBy("key").agg(F.min(F.struct("doc_id", "v")).alias("one"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.first("marks").alias("marks"))
    classes = stored(merged.select(F.monotonically_increasing_id().alias("id"), "key", "one", "n", "fp", "prefix", "marks"), "classes")
    release(docs.sparkSession)
    proposed = near_fingerprints(classes)
    met = Window.partitionBy("h")
    places = classes.select("id", "n", F.explode("prefix").alias("h"))
    shared = places.select("*", F.count("*").over(met).alias("c"), F.min(F.struct("id", "n")).over(met).alias("first")).filter("c > 1").drop("c")
    shared = stored(shared, "shared")
    release(docs.sparkSession)

    # pairs that also meet elsewhere may be missing here; they are then in families
    first = shared.filter(F.col("id") != F.col("first.id")).select(F.col("first.id").alias("a"), F.col("id").alias("b"), F.col("first.n").alias("n"), F.col("n").alias("m"))
    asked = stored(in_place(candidates(first), classes).unionByName(proposed).distinct(), "first-pairs")
    edges = alike(asked, shingle_sets(asked.select(F.col("a").alias("id")).unionAll(asked.select("b")), classes, docs))
    nodes = stored(components(edges), "groups")
    release(docs.sparkSession)
    more = linked(shared, nodes, classes, docs)
    if more.head(1):
        nodes = stored(components(edges.unionByName(more)), "groups")
    of = classes.select("id", "key").join(nodes, F.col("id") == F.col("node"), "left").select("key", F.coalesce("root", "id").alias("root"))
    return each.select("doc_id", "v", "key").join(of, "key").select("doc_id", "v", "root")
