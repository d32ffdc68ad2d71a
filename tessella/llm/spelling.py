"""Spelling variants: frequent words and the words that are one edit away.

Words are counted over all texts, in each task first. Pairs come from rare-first prefix filtering of bigrams: one edit destroys at most two bigrams of either
word, so of the three that are rarest in one order of all bigrams two near words share one, at places that differ by one at most. Besides,
one edit leaves either the first or the second half of the shorter word as it is, so what is joined on is a bigram of the prefix together with one
of the halves; a frequent bigram alone gathers nothing. Places and lengths limit what the join lets through, and each pair that is left is verified
by its edit distance. Bigrams are counted over all words; their table has at most as many rows as there are pairs of letters, which bounds what is sent to workers.

Forms are followed by doubling: each round a word takes the root of its root, so chains as long as n allows take a few rounds.

Defined cases: null, empty and letterless texts have no words; long texts are read whole; a null doc_id perturbs as an empty one; repeated rows
count each; ties between forms go to the smallest word in code-point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored

#: One in so many runs, by its hash, loses a letter; shortest words; fewest occurrences; times that a form is as frequent as the word, at least.
PERTURBED, SHORTEST, LEAST, TIMES = 31, 7, 2, 10
#: Rarest bigrams that are joined on: one more than an edit destroys.
PREFIX = 3
#: Words that a worker counts before it sends the counts.
HELD = 1 << 18

_bytes = bytearray(b" " * 256)
_bytes[0xC0:] = range(0xC0, 0x100)
for _a, _b in zip(UPPER.encode(), LOWER.encode()):
    _bytes[_a] = _bytes[_b] = _b
#: Latin-1 bytes of words, with A-Z in lower case; others become spaces.
LETTERS = bytes(_bytes)


def runs(doc_id: int | None, text: str | None, perturbed: int = PERTURBED, shortest: int = SHORTEST) -> Counter:
    """How often each word of at least so many letters is in text, in Latin-1, after its perturbation. All letters are of Latin-1; what isn't separates like other characters."""
    from zlib import crc32

    found, out = Counter((text or "").encode("latin-1", "replace").translate(LETTERS).split()), Counter()
    seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in found.items():
        if len(word) >= shortest:
            h = crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
            if h % perturbed == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            out[word] += n
    return out


def words(docs: DataFrame, perturbed: int = PERTURBED, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n of the words of docs(doc_id, text) that are long and frequent enough."""

    def batch(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        held = Counter()
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                held.update(runs(i.as_py(), t.as_py(), perturbed, shortest))
                if len(held) >= HELD:
                    yield batch(held)
                    held = Counter()
        yield batch(held)

    each = docs.select("doc_id", "text").mapInArrow(run, "word string, n long").filter(F.length("word") >= shortest)
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def bigrams(vocabulary: DataFrame) -> dict[str, int]:
    """The place of each bigram of vocabulary(word) in the order from rare to frequent."""
    each = vocabulary.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    return {r[0]: k for k, r in enumerate(each.groupBy("gram").count().orderBy("count", "gram").collect())}


def prefix(word: str, order: dict[str, int], size: int = PREFIX) -> list[tuple[int, int]]:
    """Place in the order and position of the rarest bigrams of word; the earlier of equal ones first."""
    return sorted((order[word[i : i + 2]], i) for i in range(len(word) - 1))[:size]


def keys(vocabulary: DataFrame) -> DataFrame:
    """long, key, at, word, n: for each word of vocabulary(word, n) a row for each bigram of its prefix and each half of the shorter word of a pair, once
    for pairs in which it is the shorter or as long as the other, and once for those in which it is longer by one. key is a hash of length, half and bigram."""
    order = bigrams(vocabulary)

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            longer, key, at, index = [], [], [], []
            for k, w in enumerate(b.column(0)):
                w = w.as_py()
                grams = prefix(w, order)
                for is_longer in (False, True):
                    m = len(w) - is_longer  # of the shorter word
                    half = m // 2
                    for name in (f"{m}<{w[:half]}", f"{m}>{w[half + is_longer :]}"):
                        for g, i in grams:
                            longer.append(is_longer)
                            key.append(xxh64_intdigest(f"{name} {g}") - (1 << 63))
                            at.append(i)
                            index.append(k)
            some = b.take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(longer, pa.bool_()), pa.array(key, pa.int64()), pa.array(at, pa.int32()), *some.columns], names=["longer", "key", "at", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(run, "longer boolean, key long, at int, word string, n long")


def pairs(vocabulary: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: the pairs of words of a stored vocabulary(word, n) that are one edit apart, once each."""
    each = keys(vocabulary)
    a = each.filter("NOT longer").select("key", F.col("at").alias("a_at"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = each.select("key", F.col("at").alias("b_at"), F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    close = (F.abs(F.col("a_at") - F.col("b_at")) <= 1) & (F.col("longer") | (F.col("a") < F.col("b")))
    return a.join(b, "key").filter(close & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root for every row of stored forms(word, form), in which no chain of forms comes back to a word."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        more = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        if not now.join(more, F.col("root") == F.col("_word"), "left_semi").head(1):
            return now
        now = stored(now.join(more, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root")), "roots")


def variants(docs: DataFrame, times: int = TIMES, **counted) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of docs(doc_id, text)."""
    vocabulary = stored(words(docs, **counted), "words")
    found = stored(pairs(vocabulary), "near-words")
    both = found.unionAll(found.select("b", "b_n", "a", "a_n")).toDF("word", "n", "near", "near_n")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    of = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    frequent = -F.col("best.n") >= times * F.col("n")
    of = stored(of.select("word", "n_near", F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.n")).alias("form_n")), "forms")
    of = of.join(roots(of.filter("form IS NOT NULL")), "word", "left")
    return vocabulary.join(of, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
