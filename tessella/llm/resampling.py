"""Importance resampling towards a target: a draw, without putting back, of documents that look like those of another table.

Both tables are counted in hashed buckets of features, in one pass and one small aggregation each. A bucket's gain is the logarithm of how much
likelier the target is to have it; a document's weight is the mean gain of its features, looked up in an array of BUCKETS numbers, which is all
that is sent to workers. Weight plus Gumbel noise, made from the document's id, is its score; the highest scores are the draw.

Where the draw ends is found by radix selection: with score, id and what else tells rows apart as digits of one key, a round counts the
rows for each value of the next digit among those that share all digits found so far, and only these counts come to the driver, at most
2^DIGIT a round. The end is exact, whatever ties there are, and nothing is sorted for it. Only the rows drawn are then sorted, by ranges.

Defined cases: null, empty and wordless texts have no features and weight 0; long texts are read whole; a null doc_id draws its noise as an empty
one and comes last among ties; repeated rows are drawn and ranked one by one; with an empty target gains come from the documents alone; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, few, stored

#: Buckets of features; longest run of words that is a feature; words that a document must have to be drawn; the part that is drawn; the seed of the noise.
BUCKETS, LONGEST, LEAST_WORDS, SHARE, SEED = 10_000, 1, 20, (10, 100), 2024
#: Bits of a digit.
DIGIT = 16
#: Words whose buckets a worker remembers.
REMEMBERED = 1 << 16
SIGN = 1 << 63

_bytes = bytearray(b" " * 256)
_bytes[0x30:0x3A], _bytes[0x80:] = range(0x30, 0x3A), range(0x80, 0x100)
for _a, _b in zip(UPPER.encode(), LOWER.encode()):
    _bytes[_a] = _bytes[_b] = _b
#: Bytes of words, with A-Z in lower case; others become spaces.
WORD_BYTES = bytes(_bytes)


class Buckets(dict):
    """Word to bucket, for the words seen lately."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, word: bytes) -> int:
        from zlib import crc32

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = b = crc32(word) % self.n
        return b


def bucketer(buckets: int, longest: int):
    """A function from a text to its number of words and the buckets of its features."""
    from zlib import crc32

    known = Buckets(buckets)

    def features(text: str | None) -> tuple[int, np.ndarray]:
        words = (text or "").encode().translate(WORD_BYTES).split()
        found = [np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
        for k in range(2, longest + 1):
            runs = map(b" ".join, zip(*(words[i:] for i in range(k))))
            found.append(np.fromiter(map(crc32, runs), np.int64, max(0, len(words) - k + 1)) % buckets)
        return len(words), np.concatenate(found)

    return features


def counted(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of texts(text) are in each bucket. Each task sends one row a bucket at most."""

    def run(batches):
        features, n = bucketer(buckets, longest), np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0):
                n += np.bincount(features(t.as_py())[1], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths by which a feature of each bucket speaks for the target."""
    from math import floor, log

    s_all, t_all, n = float(docs.sum()), float(target.sum()), len(docs)
    return np.array([floor(1000 * log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(docs.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight for every row of docs(doc_id, text)."""

    def run(batches):
        features = bucketer(len(gain), longest)
        for b in batches:
            rows = [(w, len(f), int(gain[f].sum()) // max(1, len(f))) for w, f in (features(t.as_py()) for t in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (zip(*rows) if rows else repeat([], 3)))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def up_to(rows: DataFrame, keys: list[str], k: int, digit: int = DIGIT) -> Column:
    """A condition that holds for exactly the k first of stored rows, ordered by long columns that together are unique.

    Each round is one count by the next digit over rows with the digits found so far; digits that all rows have in common are passed over."""
    if k <= 0:
        return F.lit(False)
    signed = lambda v: v - (1 << 64) if v >= SIGN else v
    bits = lambda c: F.col(c).bitwiseXOR(F.lit(-SIGN))  # noqa: E731  in the order of unsigned numbers
    top = lambda c, shift: F.shiftrightunsigned(bits(c), shift)
    ends = rows.agg(F.count("*"), *(f(c) for c in keys for f in (F.min, F.max))).first()
    if k >= ends[0]:
        return F.lit(True)
    same, bounds = F.lit(True), []  # rows that share the columns done; column, bits left over and digits found, of each
    for i, c in enumerate(keys):
        low, high = (int(x) + SIGN for x in ends[1 + 2 * i : 3 + 2 * i])
        shift = (low ^ high).bit_length()
        value, whole = low >> shift, False
        while shift and not whole:
            width = min(digit, shift)
            inside = same & (F.lit(True) if shift == 64 else top(c, shift) == signed(value))
            shift -= width
            for d, n in sorted(map(tuple, rows.filter(inside).groupBy(top(c, shift).bitwiseAND(F.lit((1 << width) - 1)).alias("digit")).count().collect())):
                if k <= n:
                    break
                k -= n
            value, whole = value << width | d, k == n  # whole: all that share these digits belong to the first
        bounds.append((c, shift, value))
        if whole:
            break
        same &= F.col(c) == value - SIGN
    c, shift, value = bounds.pop()
    first = top(c, shift) <= value if shift else F.col(c) <= value - SIGN
    for c, _, value in reversed(bounds):
        first = (F.col(c) < value - SIGN) | ((F.col(c) == value - SIGN) & first)
    return first


def ranked(rows: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """rows with their place, from 1, in the order of keys: sorted by ranges, numbered in each, and moved on by the counts of those before."""
    sort = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "drawn")
    sizes = sort.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_least"))
    # a row a partition
    before = sizes.select("_part", "_least", (F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    out = sort.join(few(stored(before, "ranges"), 24), "_part")
    return out.withColumn(name, F.col("_at") - F.col("_least") + F.col("_before") + 1).drop("_part", "_at", "_least", "_before")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) for every row of docs(doc_id, text), drawn to look like target(text)."""
    gain = gains(counted(docs, buckets, longest), counted(target, buckets, longest))
    scored = weighed(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    able = F.col("n_words") >= least_words
    keys = {"_score": -F.col("score"), "_none": F.col("doc_id").isNull().cast("long"), "_id": F.coalesce("doc_id", F.lit(0)), "_n": F.col("n_features"), "_row": F.monotonically_increasing_id()}
    scored = stored(scored.select("doc_id", "n_features", "weight", "score", able.alias("_able"), *(v.alias(k) for k, v in keys.items())), "scored")
    first = scored.filter("_able")
    drawn = F.col("_able") & up_to(first, list(keys), share[0] * first.count() // share[1])
    out = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(ranked(scored.filter(drawn), list(keys)).select(*out, "rank"))
