"""Glossary operators: terms found in texts, locked before translation, restored and verified after it.

A glossary is a small dimension (tens to thousands of terms) whose entries become part of the plan: a text is matched against a
term only where it contains the term as plain characters, so most terms cost a byte search and few a regular expression. Nothing is
joined pairwise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import B, W, let, text


@dataclass(frozen=True)
class Term:
    term: str
    translations: dict = field(default_factory=dict)
    category: str = "general"
    transliteration: dict = field(default_factory=dict)
    locked: bool = True
    case_sensitive: bool = False
    whole_word: bool = True

    @property
    def key(self) -> str:
        return self.term if self.case_sensitive else self.term.lower()

    @property
    def pattern(self) -> str:
        quoted = "".join(c if c.isalnum() else "\\" + c for c in self.term)
        return ("" if self.case_sensitive else "(?iu)") + (f"{B}{quoted}{B}" if self.whole_word else quoted)


#: The builtin terms (fixed values): names that are kept as they are, then category, term and Hindi translation.
NAMES = [
    "Maruti Suzuki", "Tata Motors", "Mahindra", "Hyundai", "Toyota", "Honda", "Kia", "MG", "Skoda", "Volkswagen", "BMW", "Mercedes",
    "Audi", "Jeep", "Ford", "Nissan", "Renault", "Swift", "Baleno", "WagonR", "Alto", "Brezza", "Creta", "Venue", "Nexon", "Punch",
    "Harrier", "Safari", "Scorpio", "Thar", "XUV700", "Bolero",
]
HINDI = [
    ("technical", "engine", "इंजन"),
    ("technical", "transmission", "ट्रांसमिशन"),
    ("technical", "mileage", "माइलेज"),
    ("technical", "fuel efficiency", "ईंधन दक्षता"),
    ("technical", "horsepower", "हॉर्सपावर"),
    ("technical", "torque", "टॉर्क"),
    ("technical", "suspension", "सस्पेंशन"),
    ("technical", "brakes", "ब्रेक"),
    ("technical", "airbags", "एयरबैग"),
    ("technical", "ABS", "ABS"),
    ("technical", "ESP", "ESP"),
    ("technical", "infotainment", "इंफोटेनमेंट"),
    ("technical", "touchscreen", "टचस्क्रीन"),
    ("technical", "sunroof", "सनरूफ"),
    ("technical", "boot space", "बूट स्पेस"),
    ("technical", "ground clearance", "ग्राउंड क्लीयरेंस"),
    ("technical", "wheelbase", "व्हीलबेस"),
    ("technical", "turbo", "टर्बो"),
    ("technical", "automatic", "ऑटोमैटिक"),
    ("technical", "manual", "मैनुअल"),
    ("technical", "CVT", "CVT"),
    ("technical", "DCT", "DCT"),
    ("technical", "AMT", "AMT"),
    ("unit", "kmpl", "किलोमीटर प्रति लीटर"),
    ("unit", "km/l", "किलोमीटर प्रति लीटर"),
    ("unit", "kmph", "किलोमीटर प्रति घंटा"),
    ("unit", "km/h", "किलोमीटर प्रति घंटा"),
    ("unit", "cc", "सीसी"),
    ("unit", "litre", "लीटर"),
    ("unit", "bhp", "बीएचपी"),
    ("unit", "Nm", "एनएम"),
    ("unit", "mm", "एमएम"),
    ("price", "lakh", "लाख"),
    ("price", "crore", "करोड़"),
    ("price", "on-road price", "ऑन-रोड कीमत"),
    ("price", "ex-showroom", "एक्स-शोरूम"),
    ("general", "test drive", "टेस्ट ड्राइव"),
    ("general", "service center", "सर्विस सेंटर"),
    ("general", "warranty", "वारंटी"),
    ("general", "insurance", "बीमा"),
    ("general", "EMI", "EMI"),
    ("general", "down payment", "डाउन पेमेंट"),
    ("general", "exchange", "एक्सचेंज"),
    ("general", "resale value", "रिसेल वैल्यू"),
]


def builtin() -> list[Term]:
    return [Term(x, {"hi": x}, "brand") for x in NAMES] + [Term(term, {"hi": hindi}, category) for category, term, hindi in HINDI]


def merged(terms: list[Term]) -> list[Term]:
    """One term per key: the last given, at the place of the first."""
    return list({t.key: t for t in terms}.values())


SCHEMA = "term string, translations map<string,string>, category string, transliteration map<string,string>, locked boolean, case_sensitive boolean, whole_word boolean"


def load(spark: SparkSession, path: str) -> list[Term]:
    """The terms of a JSON file {"terms": [...]}, with defaults for what is missing; entries without a term are dropped."""
    rows = spark.read.schema(f"terms array<struct<{SCHEMA.replace(' string', ':string').replace(' map', ':map').replace(' boolean', ':boolean').replace(', ', ',')}>>").json(path, multiLine=True, mode="PERMISSIVE").select(F.explode("terms").alias("t")).select("t.*").filter("term <> ''").collect()
    default = lambda x, d: d if x is None else x
    return [Term(r["term"], default(r["translations"], {}), default(r["category"], "general"), default(r["transliteration"], {}), default(r["locked"], True), default(r["case_sensitive"], False), default(r["whole_word"], True)) for r in rows]


def save(spark: SparkSession, terms: list[Term], path: str) -> None:
    rows = spark.createDataFrame([([(t.term, t.translations, t.category, t.transliteration, t.locked, t.case_sensitive, t.whole_word) for t in terms],)], f"terms array<struct<{SCHEMA.replace(' string', ':string').replace(' map', ':map').replace(' boolean', ':boolean').replace(', ', ',')}>>")
    rows.coalesce(1).write.mode("overwrite").json(path)


def matches(c: Column | str, terms: list[Term]) -> Column:
    """array of struct(pos, ord, occ, matched): every occurrence of every term, ordered by where its text first occurs, then by term."""
    c, terms = text(c), merged(terms)
    none = F.array().cast("array<struct<pos:int,ord:int,occ:int,matched:string>>")
    row = lambda low, k: lambda m, i: F.struct(F.instr(low, F.lower(m)).alias("pos"), F.lit(k).alias("ord"), i.alias("occ"), m.alias("matched"))
    each = lambda low, k, t: F.transform(F.regexp_extract_all(c, F.lit(t.pattern), F.lit(0)), row(low, k))

    def listed(low: Column) -> Column:
        # under case folding the long s is an s, which lower() doesn't make of it
        there = F.replace(low, F.lit("ſ"), F.lit("s"))
        return let(there, lambda x: F.sort_array(F.concat(none, *(F.when(F.contains(x, F.lit(t.term.lower())), each(low, k, t)).otherwise(none) for k, t in enumerate(terms)))))

    return let(F.lower(c), listed) if terms else none


def attribute(terms: list[Term], name: str, number: Column) -> Column:
    """An attribute of the term with a number."""
    return F.element_at(F.array(*(F.lit(getattr(t, name)) for t in merged(terms))), number + 1)


def found(df: DataFrame, key: str, c: str, terms: list[Term]) -> DataFrame:
    """key, match_no, matched, term, category, locked for every occurrence in df."""
    out = df.select(key, F.posexplode(matches(c, terms)).alias("match_no", "m"))
    return out.select(key, "match_no", F.col("m.matched").alias("matched"), *(attribute(terms, a, F.col("m.ord")).alias(a) for a in ("term", "category", "locked")))


def lock(df: DataFrame, c: str, terms: list[Term], form: str = "<<{category}:{index}>>", out: str = "locked_text") -> DataFrame:
    """Adds out, the text with the first remaining match of each found term replaced by a numbered placeholder, and placeholders, a map to what was matched."""
    terms = merged(terms)
    row = list(enumerate(terms))
    keep = F.filter(matches(c, terms), lambda m: F.element_at(F.array(*(F.lit(t.locked) for t in terms)), m["ord"] + 1))
    category = lambda m: attribute(terms, "category", m["ord"])

    def numbered(ms: Column) -> Column:
        before = lambda m, i: F.size(F.filter(F.slice(ms, F.lit(1), i), lambda x: category(x) == category(m)))
        parts = re.split(r"(\{category\}|\{index\})", form)
        name = lambda m, i: F.concat(*(category(m) if p == "{category}" else before(m, i).cast("string") if p == "{index}" else F.lit(p) for p in parts))
        return F.transform(ms, lambda m, i: F.struct(m["ord"].alias("ord"), m["matched"].alias("matched"), name(m, i).alias("name")))

    def replaced(t: Column, x: Column) -> Column:
        # in two halves at the first match: places of regexp_instr count characters beyond the basic plane twice
        halves = None
        for k, term in row:
            halves = (F if halves is None else halves).when(x["ord"] == k, F.split(t, term.pattern, 2))
        return let(halves, lambda p: F.when(F.size(p) == 2, F.concat(F.get(p, F.lit(0)), x["name"], F.get(p, F.lit(1)))).otherwise(t))

    marked = df.withColumn("_m", let(keep, numbered))
    if not terms:
        return df.withColumns({out: text(c), "placeholders": F.create_map().cast("map<string,string>")})
    return marked.withColumns({out: F.aggregate("_m", text(c), replaced), "placeholders": F.map_from_entries(F.transform("_m", lambda x: F.struct(x["name"], x["matched"])))}).drop("_m")


def restore(c: Column | str, placeholders: Column | str, lang: Column | str, terms: list[Term]) -> Column:
    """c with each placeholder replaced by its term's translation, or by what was matched. lang: a language, or a column of each row's.

    Terms are looked up in lower case: a case-sensitive term with capitals is thus not found and stays as matched."""
    lang = lang if isinstance(lang, Column) else F.lit(lang)
    known = {(k, t.key): x for t in merged(terms) for k, x in t.translations.items()}
    # a language and a term are one key, since neither has the mark between them
    lookup = F.create_map(*(F.lit(x) for (k, t), x in known.items() for x in (f"{k}\n{t}", x))) if known else F.create_map().cast("map<string,string>")
    entries = F.map_entries(F.col(placeholders) if isinstance(placeholders, str) else placeholders)
    said = lambda e: F.coalesce(F.try_element_at(lookup, F.concat(lang, F.lit("\n"), F.lower(e["value"]))), e["value"])
    return F.aggregate(entries, text(c), lambda t, e: F.replace(t, e["key"], said(e)))


def verify(df: DataFrame, key: str, source: str, target: str, lang: str, terms: list[Term]) -> DataFrame:
    """key, type, original, expected, severity of every occurrence of a locked term whose translation is not in the target."""
    expected = F.element_at(F.array(*(F.lit(t.translations.get(lang)) for t in merged(terms))), F.col("m.ord") + 1)
    out = df.select(key, text(target).alias("_t"), F.explode(matches(source, terms)).alias("m")).withColumns({"expected": expected, "locked": attribute(terms, "locked", F.col("m.ord"))})
    out = out.filter(F.col("locked") & (F.coalesce("expected", F.lit("")) != "") & ~F.contains(F.lower("_t"), F.lower("expected")))
    there = F.contains(F.lower("_t"), F.lower("m.matched"))
    return out.select(key, F.when(there, "untranslated_term").otherwise("missing_term").alias("type"), F.col("m.matched").alias("original"), "expected", F.when(there, "error").otherwise("warning").alias("severity"))


def translation_of(c: Column | str, lang: str, terms: list[Term]) -> Column:
    """The translation of a locked term given by name, else null."""
    known = {t.key: t.translations[lang] for t in merged(terms) if t.locked and lang in t.translations}
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.lower(text(c))) if known else F.lit(None).cast("string")
