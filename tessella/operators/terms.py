"""Glossaries of any size: terms are a table, found in texts by a join on one of their words, so a plan doesn't grow with them.

A text falls into pieces, words and what lies between them. A term of whole words is a row of whole pieces, so it can begin only where the first
of its words is a word of the text: words are joined to terms on that, and the few pairs that meet are held against each other. Terms that
may lie within words, or have no word, are rows of characters and are joined on their first two; texts are taken apart so only if there are such terms.
Texts aren't shuffled to find terms while the table of terms is within a counted size, beyond which Spark joins by shuffles; what is found in a text comes back to it by its hash.

Defined cases: a null text has no matches; copies of a text are told the same; of terms with one key the last one counts, at the place of the first; a null
or empty term is dropped; nulls in a term's other columns are the defaults; an empty table of terms or texts gives no matches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import B, W, let, text
from ..sources.staged import stored
from .glossary import SCHEMA, Term

PIECE = f"[{W}]+|[^{W}]+"
#: Bytes, by count, up to which the table of terms is broadcast.
BROADCAST_BYTES = 32 << 20
MATCH = "array<struct<pos:int,ord:int,occ:int,matched:string,term:string,category:string,locked:boolean,pattern:string,expected:string>>"


def fold(c: Column) -> Column:
    """A form in which strings are alike if a regular expression that ignores case takes them for alike; the long s is an s there, which lower() doesn't make of it."""
    return F.replace(F.lower(c), F.lit("ſ"), F.lit("s"))


def table(spark: SparkSession, terms: list[Term]) -> DataFrame:
    """A list of terms as a table."""
    return spark.createDataFrame([(i, t.term, t.translations, t.category, t.transliteration, t.locked, t.case_sensitive, t.whole_word) for i, t in enumerate(terms)], f"ord int, {SCHEMA}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The terms of a file with one JSON object in a line; the order is that of the lines."""
    lines = spark.read.schema(SCHEMA).json(path)
    return lines.select(F.monotonically_increasing_id().alias("ord"), "*")


def index(terms: DataFrame) -> DataFrame:
    """What terms(ord, term, and of the rest of a term's columns what there is) are joined by, stored."""
    default = {"translations": F.create_map().cast("map<string,string>"), "category": F.lit("general"), "locked": F.lit(True), "case_sensitive": F.lit(False), "whole_word": F.lit(True)}
    df = terms.filter("term <> ''").select("ord", "term", *((F.coalesce(n, d) if n in terms.columns else d).alias(n) for n, d in default.items()))
    key = F.when(F.col("case_sensitive"), F.col("term")).otherwise(F.lower("term"))
    df = df.groupBy(key.alias("_k")).agg(F.min("ord").alias("ord"), F.max_by(F.struct("term", *default), "ord").alias("t")).select(F.col("ord").cast("int").alias("ord"), "t.*")
    by_word = F.col("whole_word") & F.col("term").rlike(f"[{W}]")
    edge, quoted = F.when(F.col("whole_word"), F.lit(B)).otherwise(""), F.concat(F.lit(r"\Q"), F.replace("term", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    df = df.withColumns({
        "by_word": by_word,
        "parts": F.when(by_word, F.regexp_extract_all("term", F.lit(PIECE), F.lit(0))).otherwise(F.split("term", "")),
        "pattern": F.concat(F.when(F.col("case_sensitive"), "").otherwise("(?iu)"), edge, quoted, edge),
    })
    df = df.withColumn("before", F.when(F.col("by_word") & ~F.get("parts", F.lit(0)).rlike(f"^[{W}]"), 1).otherwise(0))
    join_key = F.when(F.col("by_word"), F.get("parts", "before")).otherwise(F.concat(F.get("parts", F.lit(0)), F.coalesce(F.get("parts", F.lit(1)), F.lit(""))))
    return stored(df.withColumns({"key": fold(join_key), "folded": F.transform("parts", fold), "n": F.size("parts")}).drop("parts"), "terms")


def pairs(texts: DataFrame, parts: Column, keys, terms: DataFrame, most: int) -> DataFrame:
    """_v, i, lead, near and the columns of terms for each place of texts(_v, ...) with a key of some terms.

    near: the parts around place i, from two before it, which are lead parts if there are so many, to most after it."""

    def around(p: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            first = F.greatest(i - 2, F.lit(0))
            return F.struct(i.alias("i"), (i - first).alias("lead"), keys(p, i).alias("keys"), F.slice(p, first + 1, F.lit(most + 3)).alias("near"))

        return F.transform(p, one)

    rows = texts.select("_v", F.explode(let(parts, around)).alias("x")).select("_v", "x.i", "x.lead", "x.near", F.explode("x.keys").alias("key"))
    return rows.join(terms, "key")


def occurrences(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """_v, ord, n, i, matched: each place where one of terms, an index, is in texts(_v, _t); places of one term may overlap."""
    counts = terms.groupBy("by_word").agg(F.max("n").alias("most"), F.max(F.length("term")).alias("longest"), F.sum(F.octet_length("term") * 4 + 160).alias("bytes"))
    out = None
    for by_word, most, longest, size in counts.collect():  # two rows at most
        some = terms.filter(F.col("by_word") == by_word).select("key", "ord", "before", "n", "folded", "pattern")
        some = F.broadcast(some) if size <= BROADCAST_BYTES else some
        if by_word:
            # a piece longer than any term stays so when it is cut
            parts = F.transform(F.regexp_extract_all("_t", F.lit(PIECE), F.lit(0)), lambda p: F.left(p, F.lit(longest + 1)))
            keys = lambda p, i: F.array(fold(F.get(p, i)))
        else:
            parts = F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", ""))
            keys = lambda p, i: F.array_distinct(F.array(fold(F.get(p, i)), fold(F.concat(F.get(p, i), F.coalesce(F.get(p, i + 1), F.lit(""))))))
        met = pairs(texts, parts, keys, some, most).withColumn("at", F.col("lead") - F.col("before")).filter("at >= 0")
        met = met.withColumn("got", F.slice("near", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("n"))).filter(F.transform("got", fold) == F.col("folded"))
        edge = F.when(F.col("at") > 0, F.right(F.get("near", F.col("at") - 1), F.lit(1))).otherwise("")
        met = met.select("_v", "ord", "n", "i", "pattern", F.array_join("got", "").alias("matched"), edge.alias("left"), F.coalesce(F.left(F.get("near", F.col("at") + F.col("n")), F.lit(1)), F.lit("")).alias("right"))
        # what decides about case and edges is the pattern, asked at this place alone
        there = F.regexp_like(F.concat("left", "matched", "right"), F.concat(F.lit("(?s)^.{"), F.length("left").cast("string"), F.lit("}"), F.col("pattern")))
        met = met.filter(there).select("_v", "ord", "n", "i", "matched")
        out = met if out is None else out.unionByName(met)
    return texts.sparkSession.createDataFrame([], "_v string, ord int, n int, i int, matched string") if out is None else out


def apart(places: Column, n: Column) -> Column:
    """Of places (i, matched), in order, those that begin where the one taken before has ended."""
    first = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<i:int,matched:string>>").alias("out"))
    step = lambda a, x: F.when(x["i"] >= a["end"], F.struct((x["i"] + n).alias("end"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a)
    return F.when(n == 1, places).otherwise(F.aggregate(places, first, step)["out"])


def marked(df: DataFrame, c: str, terms: DataFrame, out: str = "_m", lang: str | None = None) -> DataFrame:
    """Adds out, the matches of terms in c as glossary.matches lists them, with each one's term; expected: its translation into lang."""
    known = index(terms)
    # the column of the text is taken by a name that no column of df has
    hashed = df.withColumn(v := _free(df, "_v"), F.md5(text(c)))
    texts = hashed.select(F.col(v).alias("_v"), text(c).alias("_t")).filter("_t <> ''")
    per = occurrences(texts, known).groupBy("_v", "ord").agg(F.first("n").alias("n"), F.sort_array(F.collect_set(F.struct("i", "matched"))).alias("xs"))
    per = per.select("_v", "ord", F.posexplode(apart(F.col("xs"), F.col("n"))).alias("occ", "x"))
    facts = known.select("ord", "term", "category", "locked", "pattern", (F.try_element_at("translations", F.lit(lang)) if lang else F.lit(None).cast("string")).alias("expected"))
    size = facts.agg(F.sum(F.octet_length("term") * 4 + 160)).first()[0] or 0
    per = per.join(F.broadcast(facts) if size <= BROADCAST_BYTES else facts, "ord")
    per = per.groupBy(F.col("_v").alias(w := _free(df, "_w"))).agg(F.collect_list(F.struct("ord", "occ", F.col("x.matched").alias("matched"), "term", "category", "locked", "pattern", "expected")).alias(out))
    both = hashed.join(per, F.col(v) == F.col(w), "left")
    rows = lambda low: F.sort_array(F.transform(out, lambda m: F.struct(F.instr(low, F.lower(m["matched"])).alias("pos"), *(m[k].alias(k) for k in ("ord", "occ", "matched", "term", "category", "locked", "pattern", "expected")))))
    return both.withColumn(out, F.coalesce(let(F.lower(text(c)), rows), F.array().cast(MATCH))).drop(v, w)


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def found(df: DataFrame, key: str, c: str, terms: DataFrame) -> DataFrame:
    """key, match_no, matched, term, category, locked for every occurrence in df, as glossary.found has them."""
    m = _free(df, "_m")
    return marked(df, c, terms, m).select(key, F.posexplode(m).alias("match_no", "m")).select(key, "match_no", *(F.col(f"m.{x}").alias(x) for x in ("matched", "term", "category", "locked")))


def lock(df: DataFrame, c: str, terms: DataFrame, form: str = "<<{category}:{index}>>", out: str = "locked_text") -> DataFrame:
    """Adds out and placeholders, as glossary.lock does."""
    m = _free(df, "_m")
    parts = re.split(r"(\{category\}|\{index\})", form)

    def named(ms: Column) -> Column:
        before = lambda x, i: F.size(F.filter(F.slice(ms, F.lit(1), i), lambda y: y["category"] == x["category"]))
        name = lambda x, i: F.concat(*(x["category"] if p == "{category}" else before(x, i).cast("string") if p == "{index}" else F.lit(p) for p in parts))
        return F.transform(ms, lambda x, i: F.struct(x["pattern"].alias("pattern"), x["matched"].alias("matched"), name(x, i).alias("name")))

    # in two halves at the first match, with the name between them
    step = lambda t, x: let(F.split(t, x["pattern"], 2), lambda p: F.when(F.size(p) == 2, F.concat(F.get(p, F.lit(0)), x["name"], F.get(p, F.lit(1)))).otherwise(t))
    named_rows = marked(df, c, terms, m).withColumn(m, let(F.filter(m, lambda x: x["locked"]), named))
    locked = F.aggregate(m, text(c), step)
    return named_rows.withColumns({out: locked, "placeholders": F.map_from_entries(F.transform(m, lambda x: F.struct(x["name"], x["matched"])))}).drop(m)


def verify(df: DataFrame, key: str, source: str, target: str, lang: str, terms: DataFrame) -> DataFrame:
    """key, type, original, expected, severity of every occurrence of a locked term whose translation is not in the target, as glossary.verify has them."""
    m = _free(df, "_m")
    out = marked(df, source, terms, m, lang).select(key, F.lower(text(target)).alias("_t"), F.explode(m).alias("m"))
    out = out.filter(F.col("m.locked") & (F.coalesce("m.expected", F.lit("")) != "") & ~F.contains("_t", F.lower("m.expected")))
    there = F.contains("_t", F.lower("m.matched"))
    return out.select(key, F.when(there, "untranslated_term").otherwise("missing_term").alias("type"), F.col("m.matched").alias("original"), "m.expected", F.when(there, "error").otherwise("warning").alias("severity"))
