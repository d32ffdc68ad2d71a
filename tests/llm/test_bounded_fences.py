"""Fences decide in both directions, in the operator and in the pipeline's stage."""

import corpus_pipeline as P
from tessella.llm import quality


def doc(i, source, symbols=0, repeated=0):
    """50 words of ten characters, some with symbols, and repeated words of an eight-word passage found twice or more."""
    w = [f"w{i:05d}{k:04d}" for k in range(50 - repeated)] + [f"p{k:09d}" for k in range(8)] * (repeated // 8)
    return i, " ".join(["#" * 9 + chr(97 + k) if k < symbols else x for k, x in enumerate(w)]), "en", source, 0


def test_stage(spark):
    rows = [doc(i, "clean") for i in range(140)]
    rows += [doc(200 + i, "bad", 6 + i % 15) for i in range(60)] + [doc(300 + i, "bad") for i in range(140)]  # 30 % have 108 to 360 thousandths
    # 160 documents with one symbol in 50 words: ordinary in this source; three with twice as many are not
    rows += [doc(500 + i, "marked", 1) for i in range(160)] + [doc(700 + i, "marked", 2) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r[0] for r in rows} - {200 + i for i in range(60)} - {700 + i for i in range(3)}
    assert {r["doc_id"] for r in quality.judge(df).filter("kept").collect()} == kept
    assert {r["doc_id"] for r in P.quality_rules(spark, df, "").collect()} == kept


def test_both_directions(spark):
    """Fences below and above the floor, within the bounds."""
    stats = []
    for source, values in (("low", [60 + i % 8 for i in range(80)]), ("high", [100 + 5 * (i % 60) for i in range(80)]), ("few", [500] * 10)):
        stats += [("en" if source != "few" else "fr", source, 1000, 0, 1000, 0, 1000, v) for v in values]
        stats += [("en" if source != "few" else "fr", source, 1000, 0, 1000, v, 1000, 0) for v in values]
    df = spark.createDataFrame(stats, "lang string, source string, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_words long, n_repeat_words long")
    got = {r["source"]: r for r in quality.fences(df).collect()}
    assert got["low"]["fence_dup_lines"] == 175 and got["low"]["fence_repeats"] == 150  # the lower bounds
    assert got["high"]["fence_dup_lines"] > quality.UNTOLD["dup_lines"] and got["high"]["fence_repeats"] == 300
    assert {r["fence_symbols"] for r in got.values()} == {quality.UNTOLD["symbols"]}  # nothing to go by


def test_a_source_of_symbols(spark):
    """Where most documents are full of symbols they are ordinary; the same documents as a minority of another source are rejected, and so is what is extreme even here."""
    rows = [doc(i, "tables", 10 + i % 12) for i in range(400)] + [doc(500 + i, "tables", 50) for i in range(3)]
    rows += [doc(1000 + i, "prose") for i in range(300)] + [doc(1400 + i, "prose", 10 + i % 12) for i in range(60)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == set(range(400)) | set(range(1000, 1300))
    by = {r["source"]: r["fence_symbols"] for r in got}
    assert by["tables"] > quality.BOUNDS["symbols"][1] >= by["prose"]
    # no constant gives these verdicts: what is rejected in one source is kept in the other
    kept, gone = ({r["n_symbols"] for r in got if r["source"] == s and r["kept"] == k} for s, k in (("tables", True), ("prose", False)))
    assert gone <= kept and sum(r["source"] == "prose" and not r["kept"] for r in got) >= 0.01 * len(got)
