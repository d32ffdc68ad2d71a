"""Text functions and validators against hand-made cases and small Python restatements."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.functions import metrics as M
from tessella.functions import text as T
from tessella.functions import validators as V

SAMPLES = [
    None, "", "   ", "a", "the the the theory of", "no no no", "go go go go go", "hello world. This is fine! ok?", "नमस्ते दुनिया। यह ठीक है।", "aaaaaa bbbb ccc dddd",
    "x\ty\n z w", "one two three one two three one two three end here", "The quick brown fox; jumps, over!!!!! the lazy dog", "♪ la la la ♪", "1234567 mm music BGM prrr", "a-b c_d é'ê “quoted” ₹500",
    "word " * 12, "protty protty protty protty song goes on and on", "Ünï cödé STRASSE straße", "i said said said it",
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "i int, text string")
    got = df.select(
        "i", T.words("text").alias("words"), T.squeeze("text").alias("squeezed"), T.squash("text").alias("squashed"), T.repetition_score("text").alias("rep"), V.char_loop("text").alias("cl"), V.word_loop("text").alias("wl"),
        V.loops("text").alias("loops"), V.coherence("text").alias("coh"), V.garbage_ratio("text").alias("garbage"), T.clean_for_speech("text").alias("clean"), V.repeated_phrase(T.words("text")).alias("phrase"),
    )
    return {r["i"]: r for r in got.collect()}


def test_words_and_space(rows):
    for i, t in enumerate(SAMPLES):
        assert rows[i]["words"] == (t or "").split()
        assert rows[i]["squeezed"] == " ".join((t or "").split())


def test_loop_patterns(rows):
    for i, t in enumerate(SAMPLES):
        assert rows[i]["cl"] == bool(re.search(r"(.)\1{4,}", t or "", re.I)), t
        assert rows[i]["wl"] == bool(re.search(r"(\b\w+\b)(?:\s+\1){2,}", t or "", re.I)), t


def test_repeated_phrase(rows):
    def expected(words):
        for n in range(5, 1, -1):
            if len(words) >= 2 * n:
                (p, c), *_ = Counter(" ".join(words[i : i + n]).lower() for i in range(len(words) - n + 1)).most_common(1)
                if c >= 3:
                    return c, p

    for i, t in enumerate(SAMPLES):
        got = rows[i]["phrase"]
        assert (got and (got["n"], got["item"])) == expected((t or "").split()), t


def test_repetition_score(rows):
    def expected(t):
        words = [re.sub(r"[^\w]", "", w.lower()) for w in t.split()]
        if len(t) < 20 or len(words) < 5:
            return 0.0
        total, i = 0, 0
        while i < len(words):
            j = i + 1
            while j < len(words) and words[i] and words[j] and (words[i] in words[j] or words[j] in words[i]):
                j += 1
            total += j - i if j - i > 1 else 0
            i = j
        return min(1.0, total / len(words))

    for i, t in enumerate(SAMPLES):
        if t is None or t.isascii():
            assert rows[i]["rep"] == pytest.approx(expected(t or "")), t


def test_squash(rows):
    assert rows[5]["squashed"] == "no no"  # two of a run stay, and one repeated word is no phrase
    assert "music" not in rows[14]["squashed"].lower() and "1234567" not in rows[14]["squashed"]
    assert rows[11]["squashed"].startswith("one two three end")
    assert rows[1]["squashed"] == rows[0]["squashed"] == ""


def test_checks(rows):
    assert rows[0]["loops"]["code"] == "short" and rows[9]["loops"]["code"] == "char_loop" and rows[4]["loops"]["code"] == "word_loop"
    assert rows[11]["loops"]["code"] == "phrase_loop" and rows[11]["loops"]["score"] == 0.1
    assert rows[0]["coh"]["code"] == "empty" and rows[2]["coh"]["code"] == "no_sentences" and rows[3]["coh"]["code"] == "short_sentences"
    assert rows[7]["coh"]["valid"] is False or rows[7]["coh"]["score"] > 0.3
    assert rows[12]["clean"].count("!") == 3
    assert rows[1]["garbage"] == 0.0


def test_thresholds(spark):
    """Equality at each border of garbage and script."""
    row = spark.range(1).select(
        V.garbage(F.lit("abcd#")).alias("at"), V.garbage(F.lit("abc##")).alias("over"),
        V.script(F.lit("abcdeдддддд"), F.lit("en")).alias("weak"), V.script(F.lit("aдддд"), F.lit("en")).alias("far"), V.script(F.lit("ab дд"), F.lit("en")).alias("at_min"),
        V.script(F.lit("123"), F.lit("en")).alias("none"), V.script(F.lit("x"), F.lit("xx")).alias("unknown"), V.script(F.lit("नमस्ते दुनिया"), F.lit("hi")).alias("marks"),
    ).first()
    assert row["at"]["valid"] and row["at"]["score"] == pytest.approx(0) and not row["over"]["valid"]
    assert row["weak"]["valid"] and row["weak"]["score"] == pytest.approx(5 / 11 / 0.5)
    assert row["far"]["code"] == "mismatch" and row["at_min"]["score"] == 1.0
    assert row["none"]["code"] == "no_letters" and row["unknown"]["valid"] and row["marks"]["valid"]


def test_assembled_checks(spark):
    df = spark.createDataFrame([("hello there my friend", "hello there my friend", "en", "hi"), ("a b", "abc", "en", "fr"), ("good morning", "bonjour tout le monde, je suis ici.", "en", "fr"), (None, None, "en", "fr")], "s string, t string, sl string, tl string")
    strict = df.select(V.validate_translation("s", "t", "sl", "tl").alias("v")).collect()
    assert strict[0]["v"]["passed"] is False and "mismatch" in strict[0]["v"]["reason"] and "near_copy" in strict[0]["v"]["reason"]
    assert strict[1]["v"]["reason"] == strict[3]["v"]["reason"] == "too_short" and strict[2]["v"]["passed"]
    loose = df.select(V.validate_translation("s", "t", "sl", "tl", strict=False).alias("v")).collect()
    assert loose[0]["v"]["passed"] and loose[0]["v"]["score"] == strict[0]["v"]["score"] and not loose[1]["v"]["passed"]
    asr = spark.range(1).select(V.validate_transcript(F.lit("a fine long sentence"), F.lit("en"), F.lit(0.4)).alias("v")).first()["v"]
    assert asr["reason"] == "low_confidence" and asr["score"] == pytest.approx((1 + 1 + 0.4 + 1) / 4)


def test_gate(spark):
    good = "a perfectly ordinary sentence with many different words inside"
    g = lambda *a: V.gate(*(x if not isinstance(x, (str, float, type(None))) else F.lit(x) for x in a))
    row = spark.range(1).select(g(good, "en", "en", 0.1).alias("a"), g(good, "fr", "en", 0.7).alias("b"), g(good, "fr", "auto", 0.7).alias("c"), g(good, "en", "en", 0.9, -1.2).alias("d"), g(good, "en", "en", 0.9, 0.0, 0.5).alias("e"), g("short", "en", "en", 0.9).alias("f"), g("la la la la la la la la la la", "en", "en", 0.9).alias("h")).first()
    assert list(row) == ["ok", "language", "ok", "avg_logprob", "confidence", "short", "repetition"]


def test_metrics():
    assert M.wer("the cat sat", "the dog sat down") == pytest.approx(2 / 3) and M.wer("", "x") == 0.0 and M.wer("a", "b c d") == 1.0
    assert M.bleu("a b c d", "a b c d") == 0.0 and M.bleu("a b c d e", "a b c d") < 0 and M.bleu("a b c d", "a b c d", standard=True) == pytest.approx(100)
    assert M.chrf("abc", "abc") == pytest.approx(100) and M.chrf("", "abc") == 0.0 and M.chrf("abc", "") == 0.0
    random.seed(1)

    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, p = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
        return d[-1]

    for _ in range(100):
        a, b = ([random.choice("abc") for _ in range(random.randrange(12))] for _ in range(2))
        assert M.edits(a, b) == slow(a, b)


def test_small_functions(spark):
    row = spark.range(1).select(
        T.timecode(F.lit(3661.5)).alias("a"), T.timecode(F.lit(-1.0)).alias("b"), T.timecode(F.lit(59.995)).alias("c"), T.safe_stem(F.lit("__a b/c..")).alias("d"), T.safe_stem(F.lit("///")).alias("e"),
        T.temperature(F.lit("Hi! Really?"), F.lit("English")).alias("f"), T.temperature(F.lit("Hi!"), F.lit("hindi")).alias("g"), T.token_budget(F.lit("")).alias("h"), T.token_budget(F.lit("x" * 1000)).alias("i"),
    ).first()
    assert row["a"] == "1:01:01.50" and row["b"] == "0:00.00" and row["d"] == "a_b_c" and row["e"] == "video"
    assert row["f"] == pytest.approx(0.755) and row["g"] == 0.7 and row["h"] == 96 and row["i"] == 512
