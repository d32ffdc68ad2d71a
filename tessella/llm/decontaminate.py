"""Benchmark decontamination by winnowing.

A text's k-grams of words are hashed, and each window of ten words selects the least hash among its k-grams. Windows with the same
words select the same hash, so every shared window is found by joining the selected hashes of documents and benchmark: no span
of ten words is missed. Only hashes and places are joined. The windows at the places of hits are then taken from the texts of the documents
that have any, and joined with the benchmark's windows word for word. Items of fewer than ten words are one window, hashed whole, and documents
are hashed at the few lengths that such items have.

The benchmark's hashes are broadcast while their counted bytes are within a bound. Beyond it they are joined by a shuffle, first to
find the documents with any hit. Windows that the same items have are a class, and a document's windows are reduced to its distinct classes before these are
joined with items, so a window that many items and very many documents share makes one row for each of them, not for each pair.

Defined cases: null and empty texts have no words; texts of any length are read whole, and a row is never repeated with its text; a benchmark item without
words has no window, items with the same words all count; an empty benchmark contaminates nothing; repeated rows all get their row, and documents of
one id but different texts are judged apart; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, few, let, stored

#: Words of a window and of a k-gram. The bytes up to which the benchmark's hashes are broadcast.
WINDOW, K, BROADCAST_BYTES = 10, 5, 32 << 20
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of text after A-Z are lower-cased."""

    def inner(w):  # only the first and the last piece can be empty
        first = F.when(F.get(w, F.lit(0)) == "", 1).otherwise(0)
        last = F.when((F.size(w) > 1) & (F.get(w, F.size(w) - 1) == ""), 1).otherwise(0)
        return F.slice(w, first + 1, F.size(w) - first - last)

    return let(F.split(ascii_lower(F.coalesce(text, F.lit(""))), APART), inner)


def upto(first: int, last: Column) -> Column:
    """first, first + 1, ..., last; empty where last is less."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def selected(words: Column) -> Column:
    """The hash that each window of ten words selects. Places are read one by one: slices of arrays would be copied for each word."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = lambda h: F.transform(upto(0, F.size(h) - K), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(K))))
    least = lambda g: F.transform(upto(0, F.size(g) - (WINDOW - K + 1)), lambda i: F.least(*(F.get(g, i + k) for k in range(WINDOW - K + 1))))
    return let(let(hashes, grams), least)


def places(words: Column, shorter: list[int]) -> Column:
    """m, at, n: the hash m that each window of n words from word at on selects; windows of shorter lengths are hashed whole."""
    struct = lambda m, at, n: F.struct(m.alias("m"), at.cast("int").alias("at"), F.lit(n).alias("n"))
    long = F.transform(selected(words), lambda m, i: struct(m, i + 1, WINDOW))
    short = lambda n: F.transform(upto(1, F.size(words) - (n - 1)), lambda i: struct(F.xxhash64(F.slice(words, i, n)), i, n))
    return F.concat(long, *map(short, shorter))


def windows(items: DataFrame) -> DataFrame:
    """item_id, m, n, win (the words, joined by spaces) of every window of items(item_id, text)."""
    cut = items.select("item_id", item_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    long = cut.filter(F.size("w") >= WINDOW).select("item_id", "w", F.posexplode(selected(F.col("w"))).alias("i", "m"))
    long = long.select("item_id", "m", F.lit(WINDOW).alias("n"), F.array_join(F.slice("w", F.col("i") + 1, WINDOW), " ").alias("win"))
    return long.unionAll(cut.filter(F.size("w") < WINDOW).select("item_id", F.xxhash64("w").alias("m"), F.size("w").alias("n"), F.array_join("w", " ").alias("win"))).distinct()


def matches(docs: DataFrame, keys: tuple[str, ...]) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return on


def hits(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, v, at, n, win: the windows of bench that occur in docs(doc_id, v, text), with the place of the first word."""
    keys, renamed = ("doc_id", "v"), {"doc_id": "_doc_id", "v": "_v"}
    marks = bench.select("m", "n").distinct()
    facts = bench.agg(F.collect_set(F.when(F.col("n") < WINDOW, F.col("n"))).alias("shorter"), F.sum(F.octet_length("win") + 64).alias("bytes")).first()
    shorter, words = sorted(facts["shorter"]), item_words(F.col("text"))
    small = (facts["bytes"] or 0) <= BROADCAST_BYTES
    near = F.broadcast if small else lambda d: d
    if not small:  # find the documents first: of their windows' hashes the distinct ones are far fewer
        distinct = F.array_distinct(F.transform(places(F.col("w"), shorter), lambda p: p["m"]))
        ids = stored(docs.select(*keys, words.alias("w")).select(*keys, F.explode(distinct).alias("m")).join(marks.select("m").distinct(), "m", "left_semi").select(*keys).distinct(), "possible")
        docs = docs.join(few(ids.withColumnsRenamed(renamed), 32), matches(docs, keys), "left_semi")
    cut = docs.select(*keys, words.alias("w"))  # a column of its own: lambdas that name the expression would compute it anew for every word
    if shorter:
        each = cut.select(*keys, F.inline(places(F.col("w"), shorter)))
    else:
        each = cut.select(*keys, F.posexplode(selected(F.col("w"))).alias("at", "m")).select(*keys, "m", (F.col("at") + 1).alias("at"), F.lit(WINDOW).alias("n"))
    met = each.join(near(marks), ["m", "n"], "left_semi").groupBy(*keys).agg(F.collect_set(F.struct("at", "n")).alias("places"))
    met = stored(met, "possible-places")
    bytes_ = met.agg(F.sum(F.size("places") * 16 + 32)).first()[0] or 0
    met = met.withColumnsRenamed(renamed)
    with_text = docs.join(F.broadcast(met) if bytes_ <= BROADCAST_BYTES else met, matches(docs, keys)).select(*keys, "places", words.alias("w"))
    window = lambda p: F.struct(p["at"].alias("at"), p["n"].alias("n"), F.array_join(F.slice("w", p["at"], p["n"]), " ").alias("win"))
    every = with_text.select(*keys, F.inline(F.transform("places", window)))
    return every.join(near(bench.select("n", "win").distinct()), ["n", "win"], "left_semi").select(*keys, "at", "n", "win").distinct()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, v (a hash of the text, with which doc_id names a text even where ids repeat), text."""
    return docs.select("doc_id", F.xxhash64("text").alias("v"), "text")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, v of docs(doc_id, text) in which a window of items occurs."""
    return hits(keyed(docs), stored(windows(items), "benchmark-windows")).select("doc_id", "v").distinct()


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, v, n_words, n_hit, spans (array of at, to: maximal hit runs of words), items (sorted ids as strings) for every row of docs(doc_id, text)."""
    bench = stored(windows(items), "benchmark-windows")
    own = keyed(docs)
    # windows with the same items are a class
    classed = stored(bench.groupBy("win").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")).withColumn("class", F.xxhash64("items")), "benchmark-classes")
    found = stored(hits(own, bench).join(classed.select("win", "class"), "win").drop("win"), "contamination")
    listed = classed.groupBy("class").agg(F.first("items").alias("items"))
    named = found.select("doc_id", "v", "class").distinct().join(listed, "class").groupBy("doc_id", "v").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    first = F.array().cast("array<struct<at:int,to:int>>")

    def step(spans, x):
        last = F.get(spans, F.size(spans) - 1)
        grown = F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(F.struct(last["at"].alias("at"), F.greatest(last["to"], x["to"]).alias("to"))))
        return F.when(F.coalesce(x["at"] <= last["to"], F.lit(False)), grown).otherwise(F.concat(spans, F.array(x)))

    spans = found.groupBy("doc_id", "v").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("to")))).alias("s")).select("doc_id", "v", F.aggregate("s", first, step).alias("spans"))
    out = own.select("doc_id", "v", F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    for more in (spans, named):
        more = more.withColumnsRenamed({"doc_id": "_doc_id", "v": "_v"})
        out = out.join(more, matches(out, ("doc_id", "v")), "left").drop("_doc_id", "_v")
    none = F.array().cast("array<string>")
    covered = F.aggregate("spans", F.lit(0), lambda a, s: a + s["to"] - s["at"])
    return out.select("doc_id", "v", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", first).alias("spans"), F.coalesce("items", none).alias("items"))
