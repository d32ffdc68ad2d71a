"""Glossaries as tables give what glossaries in the plan give, at a size of plan that doesn't depend on them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.operators import glossary, terms

T = glossary.Term
TERMS = [
    T("test drive", {"hi": "टेस्ट ड्राइव"}, "general"), T("drive", {"hi": "ड्राइव"}, "verb"), T("The", {"hi": "x"}, "name", case_sensitive=True), T("the", {}, "general", locked=False),
    T("a b a", {"hi": "aba"}, "self"), T("km/l", {"hi": "kmpl"}, "unit"), T(".net", {"hi": "net"}, "tech"), T("c++", {"hi": "cpp"}, "tech"), T("++", {"hi": "pp"}, "sign"),
    T("riv", {"hi": "r"}, "part", whole_word=False), T("é", {"hi": "e"}, "part", whole_word=False), T("aa", {}, "part", whole_word=False), T("DRIVE", {"hi": "D"}, "last"), T("s", {"hi": "s"}, "one"),
    T("टेस्ट", {"hi": "t"}, "script"), T("a\\Eb", {"hi": "q"}, "odd"), T("😀 ok", {"hi": "o"}, "odd"),
]
BITS = ["test", "drive", "Test", "DRIVE", "the", "The", "a", "b", "km", "l", "net", "c", "+", "é", "É", "aaa", "ſ", "S", "टेस्ट", "\\E", "😀", "ok", "_", "1"]


def texts(seed, n=150):
    rng = random.Random(seed)
    made = ["".join(rng.choice(BITS) + rng.choice([" ", " ", " ", "", "/", ".", "++", "\n", "  ", "-"]) for _ in range(rng.randrange(0, 40))) for _ in range(n)]
    return [*made, None, "", "a b a b a b a", "x.net .net a.net", "c++ c++d d++e", "test drive" * 3, "aaaaa aaaa", "w" * 5000 + " the " + "-" * 5000, made[0], "a\\Eb a\\eb"]


def rows(df):
    return Counter(str(r) for r in df.collect())


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i if i % 40 else None, t, "x", i) for i, t in enumerate(texts(1))], "id int, text string, _m string, i int").repartition(3)


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_found(spark, df, bound, monkeypatch):
    monkeypatch.setattr(terms, "BROADCAST_BYTES", bound)
    got, expected = terms.found(df, "id", "text", terms.table(spark, TERMS)), glossary.found(df, "id", "text", TERMS)
    assert got.columns == expected.columns and rows(got) == rows(expected)
    assert len({r["term"] for r in got.collect()}) > 12


def test_lock_and_verify(spark, df):
    known = terms.table(spark, TERMS)
    plain = df.drop("_m")  # glossary.lock takes that name for itself
    got, expected = terms.lock(plain, "text", known), glossary.lock(plain, "text", TERMS)
    assert got.columns == expected.columns and rows(got) == rows(expected)
    both = df.withColumn("out", F.translate("text", "eé", ""))
    got, expected = (m.verify(both, "id", "text", "out", "hi", t) for m, t in ((terms, known), (glossary, TERMS)))
    assert got.columns == expected.columns and rows(got) == rows(expected) and got.count() > 0


def test_empty(spark, df):
    assert terms.found(df, "id", "text", terms.table(spark, [])).count() == 0
    assert terms.found(df.limit(0), "id", "text", terms.table(spark, TERMS)).count() == 0
    plain = terms.lock(df, "text", terms.table(spark, []))
    assert rows(plain.select("locked_text")) == rows(df.select(F.coalesce("text", F.lit("")).alias("locked_text")))


def test_size(spark):
    """The plan of 100,000 terms is as long as that of twenty, and all of them are found."""
    df = spark.range(2000).select("id", F.concat(F.lit("Kit w"), "id", F.lit(" and w"), F.col("id") * 50, F.lit(" part.")).alias("text"))
    many = spark.range(100_000).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("w"), F.col("id"), F.when(F.col("id") % 2 == 0, " part").otherwise("")).alias("term"))
    plan = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString().splitlines())
    got = terms.found(df, "id", "text", many)
    assert plan(got) == plan(terms.found(df, "id", "text", many.limit(20)))
    expected = Counter(t for i in range(2000) for t in ([f"w{i}"] if i % 2 else []) + [f"w{i * 50} part"] if int(t[1:].split()[0]) < 100_000)
    assert Counter(r["term"] for r in got.collect()) == expected
