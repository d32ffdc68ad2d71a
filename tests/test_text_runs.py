"""Repetition found in whole runs of characters and by workers: as the plain definitions have it, without their cost."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import validators as V
from tessella.functions.text import B, S, W


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(4)
    pool = ["the", "The", "cat", "category", "naïve", "É", "é", "Straße", "don't", "--", "x1", "a", "music", "mm", "tt", "t", "12345", "İ", "ΑΣ", "नमस्ते", "ſs", "K", "k", "😀", "Instrumental."]
    texts = [None, "", "  ", "one", "a b a b a b", "the cat the category", "music MUSIC music", "x\u0085x x", "a a a", "go go"]
    for _ in range(400):
        some = rng.sample(pool, rng.randrange(1, 8))
        texts.append("".join(rng.choice(some) + rng.choice([" ", " ", " ", "  ", "\n", " ", ". "]) for _ in range(rng.randrange(1, 40))))
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2).cache()


def test_squash(df):
    out = F.array_join(T.let(T.words("text"), T.dedupe_words), " ")
    for n in (4, 3, 2):
        out = F.regexp_replace(out, rf"(?iu)({B}(?:[{W}]+{S}+){{{n - 1}}}[{W}]+{B})(?:{S}+\1)+", "$1")
    for noise in (rf"{B}(protty|prottty|prr+|t+{S}*t+|d+{S}*d+){B}", rf"{B}(m+m+|h+h+|a+a+|o+o+){B}", r"\p{Nd}{4,}", rf"{B}(music|instrumental|bgm){B}"):
        out = F.regexp_replace(out, f"(?iu){noise}", "")
    both = df.select("i", T.squash("text").alias("got"), T.squeeze(out).alias("plain"), F.col("text").rlike(rf"(?iu)({B}[{W}]+{B})(?:{S}+\1){{2,}}").alias("loop"), V.word_loop(F.col("text")).alias("found"))
    assert [tuple(r) for r in both.filter("got <> plain or loop <> found").collect()] == []
    plan = df.select(T.squash("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "++" in plan and f"{B}(?:" not in plan  # no run of characters is given up piece by piece


def test_phrases(df):
    def plain(words):
        for k in (5, 4, 3, 2):
            if len(words) >= 2 * k and (c := Counter(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))) and c.most_common(1)[0][1] >= 3:
                return c.most_common(1)[0][::-1]

    got = df.select(F.lower(F.array_join(T.words("text"), "\n")).alias("w"), V.repeated_phrase(T.words("text")).alias("p"))
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()  # phrases aren't sorted as strings
    rows = got.collect()
    assert [r["p"] and tuple(r["p"]) for r in rows] == [plain([x for x in r["w"].split("\n") if x]) for r in rows]
    assert sum(r["p"] is not None for r in rows) > 50


def test_validators(df):
    letters = F.regexp_count(F.col("text"), F.lit(r"\p{L}"))
    share = F.coalesce(F.try_divide(F.regexp_count(F.col("text"), F.lit("[ऀ-ॿ]")), letters), F.lit(-1.0))
    r = df.filter("text <> ''").select(V.script("text", F.lit("hi")).alias("s"), share.alias("share"), V.coherence("text").alias("c"), F.size(T.words("text")).alias("n")).collect()
    assert all((x["s"]["code"] == "no_letters") == (x["share"] < 0) and x["s"]["valid"] == (x["share"] >= 0.3 * 0.8) for x in r)
    assert all(x["n"] < 3 for x in r if x["c"]["code"] == "few_words")
