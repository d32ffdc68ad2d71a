"""Steps that several branches of a flow read are done once, and the matching ratio is difflib's."""

import difflib
import random
from collections import Counter
from functools import partial

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import validators
from tessella.functions.scripts import BLOCKS
from tessella.functions.text import A, S, W
from tessella.operators import audio
from tessella.plans import backends, flows, synthesis


class Told(backends.Translator):
    """Writes down what it is asked for; of texts with "echo" it gives back nothing but these."""

    def __init__(self, at: str):
        self.at = at

    def translate(self, text, src, tgt):
        with open(self.at, "a") as f:
            f.write(text + "\n")
        return text if "echo" in text else "Voici une autre phrase tout entiere."


def test_chunks_are_translated_once(spark, tmp_path):
    s = spark.createDataFrame([(1, 0, 0.0, 1.0, "This one says echo and comes back."), (2, 0, 0.0, 1.0, "This one is translated."), (None, 0, 0.0, 1.0, "No video.")], "video int, seg_idx int, start double, end double, text string")
    got = flows.translate_chunks(s, "en", "fr", partial(Told, str(tmp_path / "asked"))).collect()
    asked = Counter((tmp_path / "asked").read_text().splitlines())
    # what failed is asked for a second time, in pieces
    assert sorted(r["video"] for r in got) == [1, 2] and asked == {"This one says echo and comes back.": 2, "This one is translated.": 1}


def test_matching_ratio_is_difflibs():
    r = random.Random(7)
    for k in range(1500):
        letters = ("ab", "abcdefghij", [chr(x) for x in range(97, 170)])[k % 3]
        a, b = ("".join(r.choices(letters, k=r.randrange(320))) for _ in "ab")
        b = (b, "xy" + a + b[: r.randrange(90)], a, a[3:-3])[k % 4]
        a = a[:60] + b[20:] if k % 7 == 0 else a
        assert validators.matched(a, b) == sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()), (a, b)


def test_phrases_of_few_words():
    assert validators.most_frequent("a b c a b d a b".split(), 3) == (3, "a b") and validators.most_frequent("a b c a b d".split(), 3) is None
    assert validators.most_frequent([], 3) is None and validators.most_frequent(["a", "a"], 1) is None


def test_translations_words_are_cut_once(spark):
    """One worker's pass counts words, and the checks on whole runs of characters are those on single ones."""
    r, pool = random.Random(11), ["the", "The", "ΑΣ", "Σ", "İ", "naïve.", "!", ". .", "é", "नमस्ते।", "x1,", "(a)", "\u00a0", "\x1c", "\u2003", "\u200b", "😀", "word"]
    texts = [None, "", " ", " a bc ", "ab  c", "a  bc ", *(r.choice(["", " "]) + "".join(r.choice(pool) + r.choice([" ", " ", "\n", "", ". "]) for _ in range(r.randrange(60))) for _ in range(500)), "go on " * 600, *map(chr, [*range(0xD800), *range(0xE000, 0x3200), *range(0xFF00, 0x10000)])]
    df = spark.createDataFrame([(x, f"b{x}b" if x else "") for x in texts], "t string, u string")
    plan = df.select(validators.validate_translation("u", "t", F.lit("fr"), F.lit("en"), ratio=validators.matching_ratio(validators.plain("u"), validators.plain("t"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "pythonUDF2" not in plan and "split(coalesce(t#" not in plan and "(?s)(?!" not in plan
    words = T.words("t")
    sizes = F.filter(F.transform(F.split(T.text("t"), "[.!?।॥]+"), lambda s: F.size(T.words(s))), lambda n: n > 0)
    total = F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
    good = F.when(~F.col("c.code").isin("ok", "few_good_sentences"), F.col("c.score")).otherwise(F.size(F.filter(sizes, lambda n: (n >= 3) & (n <= 30))) / F.size(sizes))
    code = F.when(F.size(sizes) == 0, F.col("c.valid") == F.lit(False)).when(total / F.size(sizes) < 2, F.col("c.code") == "short_sentences").when(total / F.size(sizes) > 50, F.col("c.code") == "long_sentences").otherwise(F.col("c.code").isin("few_words", "ok", "few_good_sentences"))
    score = F.when(F.col("l.code") == "short", 1.0).when(F.col("l.code") == "ok", T.distinct_words("t") / F.size(words)).when(F.col("l.code") == "phrase_loop", 0.1).otherwise(0.0)
    share = F.regexp_count(T.text("t"), F.lit(rf"(?![{A} ])[^{W}{S[1:-1]}{BLOCKS}.,!?;:'\"\-]")) / F.greatest(F.length(T.text("t")), F.lit(1))
    script = F.try_divide(F.regexp_count(T.text("t"), F.lit("[a-zA-Z]")), F.regexp_count(T.text("t"), F.lit(r"\p{L}")))
    both = df.select("t", validators.loops("t").alias("l"), validators.coherence("t").alias("c"), validators.garbage_ratio("t").alias("g"), validators.script("t", F.lit("en")).alias("s"), T.shorter("t", 5).alias("five"), T.shorter("t", 3).alias("three"))
    wrong = ~code | (F.col("c.score") != good) | (F.col("l.score") != score) | ((F.col("l.code") == "short") != (F.size(words) < 4)) | (F.col("g") != share) | (F.col("s.score") != F.when(script.isNull(), 0.0).otherwise(F.least(F.lit(1.0), script / 0.5)))
    wrong = wrong | (F.col("five") != (F.length(T.strip("t")) < 5)) | (F.col("three") != (F.length(T.strip("t")) < 3)) | (F.col("l.code").isin("ok", "phrase_loop") & ((F.col("l.code") == "ok") != validators.repeated_phrase(words).isNull()))
    assert both.filter(wrong).collect() == []
    assert {r["l"]["code"] for r in both.collect()} >= {"short", "ok", "phrase_loop"}


def test_transcripts_read_cleaned_segments(spark):
    """A text is squashed in one place of the plan, and no table with a row a video is broadcast."""
    rows = [(1, 0, 0.0, 1.0, "music"), (1, 1, 1.0, 2.0, "Nobody heard those words."), (2, 0, 0.0, 9.0, " "), (3, 0, 0.0, 40.0, "One two three four five. Six seven eight nine ten."), (None, 0, 0.0, 1.0, "Said nowhere.")]
    s = spark.createDataFrame(rows, "video int, seg_idx int, start double, end double, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        assert plan(flows.cleaned(s)).count("protty") == 1
        segments, summary = flows.postprocess_transcript(s, 1.0)
        assert "protty" not in plan(segments) and "Broadcast" not in plan(summary)
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert sorted((r["video"] or 0, r["part_idx"], r["text"]) for r in segments.collect()) == [(0, 0, "Said nowhere."), (1, 0, "Nobody heard those words."), (3, 0, "One two three four five."), (3, 1, "Six seven eight nine ten.")]
    assert sorted((r["video"], r["text"], r["segments"], r["gate"]) for r in summary.collect()) == [(1, rows[1][4], 1, "ok"), (3, rows[3][4], 2, "ok")]


def test_plans_of_timed_speech_read_no_samples(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 0.4, "Some words that are spoken here."), (1, 1, 1.0, 9.0, "Ü")], "video int, seg_idx int, start double, end double, text string")
    plan, track = synthesis.timed(synthesis.voices(s, synthesis.Tone, synthesis.CarefulTone, rate=100), 100)
    reads = lambda df: "samples:array" in df._jdf.queryExecution().executedPlan().toString()
    assert not reads(plan) and reads(track)
    assert [(r["seg_idx"], r["n"]) for r in plan.orderBy("seg_idx").collect()] == [(0, 40), (1, 800)]


def test_fit(spark):
    df = spark.createDataFrame([([1, 2, 3], 2), ([1, 2, 3], 5), ([1, 2, 3], 0), ([], 2), (None, 2), ([1, 2], None)], "s array<short>, n int")
    assert [r[0] for r in df.select(audio.fit("s", "n")).collect()] == [[1, 2], [1, 2, 3, 0, 0], [1, 2, 3], [0, 0], None, []]


def test_plain_empty_of_each_character(spark):
    df = spark.range(0x110000).filter("id NOT BETWEEN 55296 AND 57343").selectExpr("cast(unhex(lpad(hex(id), 8, '0')) AS binary) AS b").selectExpr("decode(b, 'UTF-32') AS c")
    differ = df.filter((validators.plain("c") == "") != validators.is_plain_empty("c"))
    assert differ.count() == 0 and df.filter(validators.is_plain_empty("c")).count() > 900_000
