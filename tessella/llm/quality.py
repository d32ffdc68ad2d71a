"""Quality rules with adaptive thresholds.

Counts are taken of every whole text by built-in functions. The method then adapts to the corpus: each ratio is an integer number of
thousandths, and a histogram sketch of it is kept per language and source. Sketches merge by adding counts, so partial ones are
combined before the shuffle, the order of merging doesn't matter, and the rank error is none at the resolution of a thousandth. The fence of a
ratio is the median of its group's values above 0, of documents that pass the base, plus SPREAD times the distance between their quartiles, within BOUNDS on
both sides: it rises and falls with what is ordinary in the group. Values beyond the upper bound don't count there, so a minority of bad documents, however bad, can't
lift a fence. Where most of a group's documents have the ratio above 0, its level is ordinary in the group (a source of tables, or of code): the same rule over all values
of the group, without an upper bound, lifts the fence if it gives more. Groups with fewer than ENOUGH values take the fence of their language, small languages that of the corpus, and where even the corpus has too
few the ratio is UNTOLD. The fences, at most one row for each language and source, are joined with the counts and decide.

Defined cases: a null or empty text has no words and fails the base; texts of any length are counted whole; a null language or source is a group of its own; ratios of a
text without words are 0, and a ratio that equals its fence is kept; repeated rows all count and all get their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let, space_words, stored

WINDOW = 8
#: For each ratio, in thousandths: the bounds of its fence where few documents have it (from 300 of repeats on the base decides), and that fence where too few values tell.
BOUNDS = {"symbols": (20, 80), "dup_lines": (175, 700), "repeats": (150, 300)}
UNTOLD = {"symbols": 40, "dup_lines": 350, "repeats": 300}
#: Times the distance between quartiles that a fence is above the median; values that a group needs.
SPREAD, ENOUGH = 3, 50


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of so many words that are found twice or more in the array."""

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            at = lambda k: F.get(s, k)["h"]
            return F.sort_array(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (F.coalesce(at(k - 1) == x["h"], F.lit(False)) | F.coalesce(at(k + 1) == x["h"], F.lit(False))).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"]))

        first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + window).alias("end"), (a["n"] + i + window - F.greatest(i, a["end"])).alias("n"))
        return F.aggregate(let(order, starts), first, step)["n"]

    # places are read one by one: slices of arrays would be copied for each word
    each = F.transform(words, lambda w: F.xxhash64(w))
    hashes = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))
    counted = let(let(each, hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(words) < window, 0).otherwise(counted).cast("long")


def counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep and the counts of every document."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    per = docs.select(*keep, text.alias("text"), space_words(F.col("text")).alias("w"))
    per = per.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.when(F.instr("text", "\n") == 0, F.struct(F.lit(1).cast("long").alias("lines"), F.lit(0).cast("long").alias("dup")))
        .otherwise(let(lines, lambda x: F.struct(F.size(x).cast("long").alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))))
        .alias("l"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    return per.select(*keep, "n_words", "word_chars", "n_symbols", F.col("l.lines").alias("n_lines"), F.col("l.dup").alias("n_dup_lines"), "n_repeat_words")


def ratios() -> dict[str, Column]:
    part = lambda a, b: F.floor(F.least(F.lit(1000), F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1)))).cast("int")
    return {"symbols": part("n_symbols", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words")}


def base_rule() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def sketch(stats: DataFrame, by: list[str]) -> DataFrame:
    """by, ratio, value, n: the mergeable histogram sketch of each ratio in each group."""
    each = F.explode(F.create_map(*(x for k, v in ratios().items() for x in (F.lit(k), v)))).alias("ratio", "value")
    return stats.select(*by, each).groupBy(*by, "ratio", "value").agg(F.count("*").alias("n"))


def quartiles(sketched: DataFrame, by: list[str]) -> DataFrame:
    """by, ratio, size, q1, q2, q3 from a sketch of which rows with the same by and value are merged first."""
    merged = sketched.groupBy(*by, "ratio", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "ratio")  # at most 1001 rows
    ranked = merged.select(*by, "ratio", "value", F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(group).alias("size"))
    return ranked.groupBy(*by, "ratio").agg(F.first("size").alias("size"), *(F.min(F.when(F.col("upto") * 4 >= F.col("size") * k, F.col("value"))).alias(f"q{k}") for k in (1, 2, 3)))


def by_level(groups: DataFrame, sketched: DataFrame, value: Column, least: int) -> DataFrame:
    """groups(lang, source, ratio) with value, of the quartiles of sketched, of the group, its language and the corpus as g, l, a: null for too few values."""
    for k, by in {"g": ["lang", "source"], "l": ["lang"], "a": []}.items():
        q = quartiles(sketched, by).select(*(F.col(b).alias(f"{k}_{b}") for b in by), F.col("ratio").alias(f"{k}_ratio"), F.when(F.col("size") >= least, value).alias(k))
        on = groups["ratio"] == q[f"{k}_ratio"]
        for b in by:
            on &= groups[b].eqNullSafe(q[f"{k}_{b}"])
        groups = groups.join(q, on, "left").select(*groups.columns, k)
    return groups


def fences(stats: DataFrame, spread: int = SPREAD, least: int = ENOUGH) -> DataFrame:
    """lang, source and the fence of each ratio: that of the group, its language or the corpus, the first with enough values above 0."""
    upper = F.lit(0)
    for r, (_, high) in BOUNDS.items():
        upper = F.when(F.col("ratio") == r, high).otherwise(upper)
    passed = stored(sketch(stats.filter(~base_rule()), ["lang", "source"]), "quality-sketch")
    rule = F.col("q2") + spread * (F.col("q3") - F.col("q1"))
    usual = by_level(passed.select("lang", "source", "ratio").distinct(), passed, F.when(F.col("q2") > 0, rule).otherwise(0), least)
    usual = usual.select("lang", "source", "ratio", F.coalesce("g", "l", "a", F.lit(0)).alias("usual"))
    groups = by_level(usual, passed.filter((F.col("value") > 0) & (F.col("value") <= upper)), rule, least)
    found = F.coalesce("g", "l", "a")
    rare = lambda r: F.when(found.isNull(), UNTOLD[r]).otherwise(F.least(F.greatest(found, F.lit(BOUNDS[r][0])), F.lit(BOUNDS[r][1])))
    held = lambda r: F.greatest(rare(r), F.col("usual"))
    return groups.groupBy("lang", "source").agg(*(F.max(F.when(F.col("ratio") == r, held(r))).alias(f"fence_{r}") for r in BOUNDS))


def judge(docs: DataFrame, spread: int = SPREAD, least: int = ENOUGH, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep, counts, fences (null for groups of which no document passes the base), base_failed, kept for docs(text, keep); keep has lang and source."""
    stats = stored(counts(docs, keep), "quality-counts")
    limits = fences(stats, spread, least)
    on = stats["lang"].eqNullSafe(limits["lang"]) & stats["source"].eqNullSafe(limits["source"])
    # One row for each language and source; Spark broadcasts it below its own threshold of bytes and shuffles beyond.
    joined = stats.join(limits, on, "left").drop(limits["lang"]).drop(limits["source"])
    base = base_rule()
    over = F.lit(False)
    for r, v in ratios().items():
        over |= F.coalesce(v > F.col(f"fence_{r}"), F.lit(False))
    return joined.select(*stats.columns, *(F.col(f"fence_{r}") for r in BOUNDS), base.alias("base_failed"), (~base & ~over).alias("kept"))
