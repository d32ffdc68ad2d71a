"""Near-duplicates by SimHash and vantage-point trees.

A worker turns each text into a 64-bit fingerprint. Equal fingerprints are merged before anything else, so copies never meet as
pairs. The top of a vantage-point tree is built on the driver from a bounded sample (SAMPLE, eight megabytes) of the distinct fingerprints, with
as many leaves as there must be shards of a fixed size; its leaves are the shards. Every fingerprint has one home shard and is also
sent as a query to each shard that its ball overlaps by the triangle bounds. Where more than a fixed number would ask in one shard, by the sample, the questions are dealt to
several groups that each hold the shard's own fingerprints, so no group grows with the input. A shard goes on splitting by vantage points until blocks are small, compares these exactly and returns, instead of pairs,
one edge from each linked fingerprint to the root of its group there. Edges of all shards are joined to components by alternating
large and small stars; a fingerprint's component is the smallest document id in it.

Defined cases: a null or blank text has fingerprint zero, linked like any other; texts of one or two words are one shingle, and those of any length
are read whole; a bit that half the hashes have is 0; a null doc_id is never a component's id unless the component has no other; repeated rows all get their row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored
from .words import mix

#: Bits by which linked fingerprints differ at most; comparisons of a block.
RADIUS, BLOCK = 3, 1 << 17
#: Fingerprints whose home is one shard, and those that ask in one group, on average; fingerprints for each leaf that the tree's top is built from, and in all at most.
SHARD, ASKING, PER_LEAF, SAMPLE = 1 << 13, 1 << 18, 128, 1 << 20
SHINGLE, SEED = 3, 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of text, as a signed integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWERED).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return int(np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64).view(np.int64)[0])
    n, counts = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for s in range(0, n, CHUNK):
        part = words[s : s + CHUNK + SHINGLE - 1]
        h = np.array([xxh64_intdigest(b"%b %b %b" % x, SEED) for x in zip(part, part[1:], part[2:])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def voted(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes, as a signed integer: each bit that over half of them have."""
    counts = np.zeros(64, np.int64)
    for s in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[s : s + CHUNK].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, v (a hash of the text), fp for docs(doc_id, text)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array([fingerprint(t.as_py()) for t in b.column(2)], pa.int64())], names=["doc_id", "v", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("v"), "text").mapInArrow(run, "doc_id long, v long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def vantage(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point among points and the distance that parts them best; None if no tried point parts them."""
    best = None
    for v in points[:: max(1, len(points) // 5)][:5]:
        d = distance(points[:: max(1, len(points) // 2048)], v)
        mu = int(np.median(d))
        if mu >= d.max():
            mu = int(d.max()) - 1
        inside = int((d <= mu).sum())
        # the fewer points lie within the radius of the border, and the more even the halves, the better
        cost = int((np.abs(d.astype(int) - mu) <= RADIUS).sum()) + abs(2 * inside - len(d))
        if 0 < inside < len(d) and (best is None or cost < best[0]):
            best = (cost, v, mu)
    return best and best[1:]


def grow(points: np.ndarray, depth: int, leaves: list) -> tuple | int:
    """A tree (vantage, distance, inside, outside) whose leaves are numbers."""
    at = vantage(points) if depth and len(points) > 8 else None
    if at is None:
        leaves.append(len(leaves))
        return leaves[-1]
    inside = distance(points, at[0]) <= at[1]
    return (*at, grow(points[inside], depth - 1, leaves), grow(points[~inside], depth - 1, leaves))


def overlapped(tree, points: np.ndarray, index: np.ndarray, home: np.ndarray, radius: int, out: list) -> None:
    """Appends (leaf, index, home) for every leaf and the points whose ball overlaps it; home: whether the leaf holds the point."""
    if not len(points):
        return
    if not isinstance(tree, tuple):
        out.append((tree, index, home))
        return
    v, mu, a, b = tree
    d = distance(points, v).astype(np.int16)
    for sub, reach, holds in ((a, d <= mu + radius, d <= mu), (b, d > mu - radius, d > mu)):
        overlapped(sub, points[reach], index[reach], (home & holds)[reach], radius, out)


class Groups:
    """Union-find over indices; label is kept fully compressed."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.label[a], self.label[b]
        if not (differ := ra != rb).any():
            return
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = x = parent.get(p, p)
            return x

        for x, y in np.unique(np.stack([ra[differ], rb[differ]], 1), axis=0).tolist():
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        roots = np.arange(len(self.label))
        for x in parent:
            roots[x] = find(x)
        self.label = roots[self.label]


def link_near(points: np.ndarray, held: np.ndarray, asking: np.ndarray, radius: int, groups: Groups, linked: np.ndarray) -> None:
    """Links each point in asking with each in held that is within radius; both are indices into points."""
    if not len(held) or not len(asking):
        return
    at = vantage(points[held]) if len(held) * len(asking) > BLOCK else None
    if at is None:
        for s in range(0, len(asking), rows := max(1, BLOCK // len(held))):
            q = asking[s : s + rows]
            i, j = np.nonzero(distance(points[q][:, None], points[held][None, :]) <= radius)
            i, j = q[i], held[j]
            if (other := i != j).any():
                linked[i[other]] = linked[j[other]] = True
                groups.link(i[other], j[other])
        return
    dh, dq = (distance(points[x], at[0]).astype(np.int16) for x in (held, asking))
    link_near(points, held[dh <= at[1]], asking[dq <= at[1] + radius], radius, groups, linked)
    link_near(points, held[dh > at[1]], asking[dq > at[1] - radius], radius, groups, linked)


def near_edges(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, asking: int = ASKING, most: int = SAMPLE) -> DataFrame:
    """a, b: edges between distinct fingerprints fps.fp whose components are those of all pairs within radius."""
    n = fps.count()
    depth = max(4, math.ceil(math.log2(max(1, n / shard))))
    sample = min(most, PER_LEAF << depth)
    seen = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp")).limit(sample).collect()], np.int64).view(np.uint64)
    leaves: list = []
    tree = grow(seen, depth, leaves)
    # how many fingerprints ask in each leaf, by the sample; a leaf's questions are dealt to so many groups, of which each holds all its own fingerprints
    asked: list = []
    overlapped(tree, seen, np.arange(len(seen)), np.ones(len(seen), bool), radius, asked)
    groups = np.ones(len(leaves), np.int64)
    for leaf, index, _ in asked:
        groups[leaf] = max(1, -(-len(index) * n // (max(1, len(seen)) * asking)))
    begin = np.cumsum(groups) - groups
    kinds = pa.schema([("shard", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_()), ("asks", pa.bool_())])

    def send(batches):
        for b in batches:
            p, out = b.column(0).to_numpy().view(np.uint64), []
            overlapped(tree, p, np.arange(len(p)), np.ones(len(p), bool), radius, out)
            for leaf, index, home in out:
                own = (mix(p[index]) % np.uint64(groups[leaf])).astype(np.int64)
                held = np.repeat(index[home], groups[leaf])
                to, fp = np.tile(np.arange(groups[leaf]), int(home.sum())), p[held]
                asks = np.repeat(own[home], groups[leaf]) == to
                others = ~home
                shards = np.concatenate([to, own[others]]) + begin[leaf]
                yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(np.concatenate([fp, p[index][others]]).view(np.int64)), pa.array(np.arange(len(shards)) < len(to)), pa.array(np.concatenate([asks, np.ones(int(others.sum()), bool)]))], schema=kinds)

    def compare(table: pa.Table) -> pa.Table:
        p, home, asks = table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy(), table.column("asks").to_numpy()
        groups, linked = Groups(len(p)), np.zeros(len(p), bool)
        link_near(p, np.flatnonzero(home), np.flatnonzero(asks), radius, groups, linked)
        a, b = p[linked].view(np.int64), p[groups.label[linked]].view(np.int64)
        return pa.table({"a": pa.array(a[a != b]), "b": pa.array(b[a != b])})

    return fps.select("fp").mapInArrow(send, "shard long, fp long, home boolean, asks boolean").groupBy("shard").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(a, b): its component's smallest node. Alternates large and small stars, each round stored."""
    e = stored(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select("v", "v").distinct())
        state = now
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))  # u has the neighbour v
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # large: (u, v) with v < u
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        e = stored(small.filter("u <> v").distinct(), "stars")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, v (a hash of the text), fp, root (a fingerprint that names the component), component_id for every row of docs(doc_id, text)."""
    each = stored(fingerprints(docs), "fingerprints")
    classes = stored(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    nodes = stored(components(near_edges(classes.select("fp"), radius)), "components")
    of = classes.join(nodes, classes["fp"] == nodes["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return each.join(of.join(ids, "root").select("fp", "root", "component_id"), "fp", "left").select("doc_id", "v", "fp", "root", "component_id")
