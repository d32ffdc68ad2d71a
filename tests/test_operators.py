"""Timeline, chunking, glossary, routing, evaluation and audio operators on hand-made rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import audio, chunking, evaluation, glossary, requests, routing, timeline

SEG = "video string, seg_idx int, start double, end double, text string"


def seg(spark, *rows):
    return spark.createDataFrame([("v", i, *r) for i, r in enumerate(rows)], SEG)


def test_fix_timestamps(spark):
    got = timeline.fix_timestamps(seg(spark, (2.0, 1.0, "a b"), (5.0, None, "x"), (6.0, 6.5, "a b c d e f"), (7.0, 30.0, ""), (None, 1.0, None))).orderBy("seg_idx").collect()
    assert [(r["start"], r["end"]) for r in got] == [(1.0, 2.0), (5.0, 5.5), (6.0, 7.5), (7.0, 30.0), (0.0, 1.0)]
    assert got[2]["words_per_second"] == 12.0 and got[2]["duration"] == 1.5


def test_gaps(spark):
    df = seg(spark, (0.0, 1.0, "a"), (3.5, 4.0, "b"), (19.0, 20.0, "c"), (35.1, 36.0, "d"))
    assert [r["large_gap"] for r in timeline.gaps(df).orderBy("seg_idx").collect()] == [False, False, True, True]
    got = timeline.refinable_gaps(df).orderBy("seg_idx").collect()
    assert [(r["gap_no"], r["clip_start"], r["clip_end"]) for r in got] == [(1, 1.05, 3.45), (2, 4.05, 18.95)]


def test_split(spark):
    df = seg(spark, (0.0, 20.0, "One two. Three four five."), (20.0, 40.0, "a b c d e f g h"), (40.0, 60.0, "a b c d e f g"), (60.0, 70.0, "x. y."), (70.0, 90.0, " "))
    got = timeline.split_overlong(timeline.fix_timestamps(df)).orderBy("seg_idx", "part_idx").collect()
    assert [r["text"] for r in got] == ["One two.", "Three four five.", "a b c d", "e f g h", "a b c d e f g", "x. y.", " "]
    assert got[0]["start"] == 0.0 and got[0]["end"] == got[1]["start"] == pytest.approx(20 * 8 / 24) and got[1]["end"] == 20.0
    assert got[0]["duration"] == pytest.approx(20 * 8 / 24)


def test_merge_gaps(spark):
    df = seg(spark, (0.0, 1.0, "first one"), (10.0, 11.0, "last one"))
    new = seg(spark, (5.0, 6.0, "middle text"), (7.0, 7.1, "tiny"), (8.0, 9.0, "  "))
    got = timeline.merge_gaps(df, timeline.keep_recovered(new)).orderBy("seg_idx").collect()
    assert [r["text"] for r in got] == ["first one", "middle text", "last one"] and [r["gap_refined"] for r in got] == [None, True, None]


def test_music_and_skips(spark):
    df = timeline.flag_music(seg(spark, (0.0, 10.0, "hi"), (0.0, 1.0, "some Music here"), (0.0, 1.0, "la la la"), (0.0, 1.0, "fine words"), (0.0, 1.0, "♪")))
    assert [r["is_suspicious"] for r in df.orderBy("seg_idx").collect()] == [True, True, True, False, True]
    assert timeline.music_heavy(df).first()["music_heavy"] is True
    assert timeline.skip_suspicious(df).count() == 5  # too many are suspicious, so all stay
    assert [r["seg_idx"] for r in timeline.skip_suspicious(df, 0.9).collect()] == [3]
    low = timeline.low_confidence(df.withColumn("avg_logprob", F.lit(-2.0)), first=2).collect()
    assert [r["candidate_no"] for r in low] == [1, 2]


def test_accept_refinement(spark):
    row = spark.range(1).select(*(timeline.accept_refinement(F.lit(a), F.lit(b)).alias(n) for n, a, b in (("a", "x" * 30, "y" * 10), ("b", "x" * 33, "y" * 10), ("c", "abc", "abcde"), ("d", "abc", "  ")))).first()
    assert list(row) == ["y" * 10, "x" * 33, "abc", "abc"]


def test_anchored_chunks(spark):
    df = seg(spark, *((float(s), s + 1.0, "t") for s in (0, 30, 50, 100, 130, 131)))
    got = timeline.anchored_chunks(df, 45.0)
    assert [r["chunk_id"] for r in got.orderBy("seg_idx").collect()] == [0, 0, 1, 2, 2, 2]
    assert [r["chunk_id"] for r in timeline.anchored_chunks(df, 30.0).orderBy("seg_idx").collect()] == [0, 0, 1, 2, 2, 3]
    n = timeline.normalize_chunks(got).orderBy("seg_idx").collect()
    assert [r["start"] for r in n] == [0.0, 30.0, 0.0, 0.0, 30.0, 31.0] and n[0]["chunk_end"] == 31.0


def test_silence(spark):
    c = spark.createDataFrame([("v", 0, 1.0, 5.0, True), ("v", 1, 7.0, 9.0, False), ("v", 2, 10.0, 12.0, True), ("v", 3, 12.02, 13.0, True)], "video string, chunk_id int, chunk_start double, chunk_end double, produced boolean")
    assert [r["silence"] for r in timeline.chunk_silence(c).orderBy("chunk_id").collect()] == [1.0, 2.0, 5.0, 0.0]
    s = timeline.segment_silence(seg(spark, (1.0, 2.0, "a"), (3.0, 4.0, " "), (5.0, 6.0, "b"))).orderBy("seg_idx").collect()
    assert [r["silence"] for r in s] == [1.0, 3.0]


def test_estimate(spark):
    df = spark.createDataFrame([("v", "One two three. Four!  Five six.", 12.0), ("w", " ", 5.0), ("x", "a b", 0.0)], "video string, text string, duration double")
    got = timeline.estimate_timings(df).orderBy("seg_idx").collect()
    assert [(r["video"], r["start"], r["end"], r["text"]) for r in got] == [("v", 0.0, 6.0, "One two three."), ("v", 6.0, 8.0, "Four!"), ("v", 8.0, 12.0, "Five six.")]


def test_transcript(spark):
    assert timeline.transcript(seg(spark, (0.0, 1.0, " a "), (1.0, 2.0, ""), (2.0, 3.0, "b"))).first()["text"] == "a b"


def test_chunkers():
    assert chunking.by_sentences("  ") == [] and chunking.by_sentences("a  b") == ["a b"]
    out = chunking.by_sentences("aaa bbb. " + "c" * 25 + ". dd ee", 10)
    assert out == ["aaa bbb.", "c" * 10, "c" * 10, "c" * 5 + ".", "dd ee"]
    words = [f"w{i}." for i in range(300)]
    assert " ".join(chunking.by_sentences(" ".join(words), 50)).split() == words
    assert chunking.semantic("short", [(1.0, 2.0), (3.0, 4.0)]) == [("short", 1.0, 2.0)] and chunking.semantic("short") == [("short", None, None)]
    text = " ".join(f"{'x' * 60}{i}." for i in range(9))
    got = chunking.semantic(text, [(float(i), i + 0.5) for i in range(9)], limit=300)
    assert [(a, b) for _, a, b in got] == [(0.0, 2.5), (3.0, 5.5), (6.0, 8.5)]
    assert chunking.speakable("tiny") == [] and chunking.speakable("tiny", lossless=True) == ["tiny"] and chunking.speakable("just long enough") == ["just long enough"]
    assert chunking.speakable("Hello there my friend. ok, " + "w " * 30 + ". A good ending follows", 40)[-1] == "ok, A good ending follows"
    # a held clause comes after the over-long one that follows it
    assert chunking.speakable("short one, " + "word " * 12 + "end.", 30)[-1] == "short one,"


def test_speakable_in_any_text():
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice(["a", "bb", "dddd", " ", " ", ". ", "! ", ", ", "; ", "x" * rng.randrange(1, 30)]) for _ in range(rng.randrange(60)))
        whole, held = chunking.speakable(t, 25, 5, lossless=True), chunking.speakable(t, 25, 5)
        assert " ".join(whole).split() == t.split()  # in order, and nothing is lost
        # otherwise words may come in another order, and one short piece at the end may be missing
        rest = Counter(t.split())
        rest.subtract(Counter(" ".join(held).split()))
        assert min(rest.values(), default=0) >= 0 and len(" ".join(rest.elements())) < 5 or len(" ".join(t.split())) < 5
        assert all(len(x) <= 25 or " " not in x for x in (*whole, *held))


def test_pack_requests(spark):
    def greedy(texts):
        groups, c, b, n, g = [], 0, 0, 0, -1
        for t in texts:
            t = (t or "").strip()
            if not t or len(t) >= 4000:
                groups.append(None)
                continue
            k = len(t.encode())
            if n == 0 or c + len(t) + 28 > 4000 or b + k + 28 > 4200 or n >= 24:
                g, c, b, n = g + 1, len(t), k, 1
            else:
                c, b, n = c + len(t) + 28, b + k + 28, n + 1
            groups.append(g)
        return groups

    texts = ["x"] * 30 + ["y" * 3990, " ", None, "z" * 4000] + ["é" * 1500] * 4 + ["w" * 1000] * 6
    df = spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "batch string, item int, text string")
    got = requests.pack_requests(df).orderBy("item").collect()
    assert [r["group_id"] for r in got] == greedy(texts) and [r["item"] for r in got if r["alone"]] == [33]


@pytest.mark.parametrize("seed, block, budgets", [(0, 6, (60, 70, 6)), (1, 24, (150, 120, 5)), (2, 7, (40, 400, 7)), (3, 1000, (90, 90, 9))])
def test_requests_over_blocks(spark, seed, block, budgets):
    """Groups of batches in many blocks are those of one greedy pass, wherever the blocks are cut."""
    rng = random.Random(seed)
    most, octets, items = budgets
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, " ", "é" * rng.randrange(1, most + 5)] + ["x" * rng.randrange(1, 20)] * 6)) for i in range(700)]
    expected, state = {}, {}
    for b, i, t in rows:
        t = (t or "").strip()
        if not t or len(t) >= most:
            expected[b, i] = None
            continue
        g, c, k, n = state.get(b, (-1, 0, 0, 0))
        if n == 0 or c + len(t) + 28 > most or k + len(t.encode()) + 28 > octets or n >= items:
            g, c, k, n = g + 1, len(t), len(t.encode()), 1
        else:
            c, k, n = c + len(t) + 28, k + len(t.encode()) + 28, n + 1
        state[b], expected[b, i] = (g, c, k, n), g
    df = spark.createDataFrame(rows, "batch string, item int, text string").repartition(5)
    got = requests.pack_requests(df, most, octets, items, block).collect()
    assert {(r["batch"], r["item"]): r["group_id"] for r in got} == expected and len(got) == len(rows)
    assert max(g for g in expected.values() if g is not None) > 40


def test_no_requests(spark):
    df = spark.createDataFrame([("b", 1, None), ("b", 2, " ")], "batch string, item int, text string")
    assert [r["group_id"] for r in requests.pack_requests(df).collect()] == [None, None] and requests.pack_requests(df.limit(0)).collect() == []


def test_glossary(spark):
    T = glossary.Term
    terms = [T("fuel efficiency", {"hi": "FE"}, "technical"), T("fuel", {"hi": "F"}, "technical"), T("MG", {"hi": "MG!"}, "brand", case_sensitive=True), T("km/l", {"hi": "KL"}, "unit"), T("old", {}, "general"), T("loose", {"hi": "L"}, "general", locked=False)]
    df = spark.createDataFrame([(1, "Fuel efficiency of MG is 20 km/l; mg and fuel are old, loose"), (2, "nothing"), (3, None)], "id int, text string")
    found = glossary.found(df, "id", "text", terms).orderBy("id", "match_no").collect()
    # "fuel" first occurs within "Fuel efficiency", and at one place terms keep their order
    assert [(r["matched"], r["term"]) for r in found] == [("Fuel efficiency", "fuel efficiency"), ("Fuel", "fuel"), ("fuel", "fuel"), ("MG", "MG"), ("km/l", "km/l"), ("old", "old"), ("loose", "loose")]
    locked = glossary.lock(df, "text", terms).orderBy("id").collect()
    assert locked[0]["locked_text"] == "<<technical:0>> of <<brand:0>> is 20 <<unit:0>>; mg and <<technical:1>> are <<general:0>>, loose"
    assert locked[0]["placeholders"]["<<technical:0>>"] == "Fuel efficiency" and locked[1]["locked_text"] == "nothing" and locked[2]["placeholders"] == {}
    restored = glossary.lock(df, "text", terms).select("id", glossary.restore("locked_text", "placeholders", "hi", terms).alias("r")).orderBy("id").collect()
    assert restored[0]["r"] == "FE of MG is 20 KL; mg and F are old, loose"
    issues = glossary.verify(df.withColumn("out", F.lit("FE and km/l")), "id", "text", "out", "hi", terms).orderBy("original").collect()
    assert [(r["type"], r["original"]) for r in issues] == [("missing_term", "MG"), ("untranslated_term", "km/l")]
    assert len(glossary.builtin()) == 76 and len(glossary.merged(glossary.builtin())) == 76
    assert spark.range(1).select(glossary.translation_of(F.lit("FUEL"), "hi", terms).alias("x"), glossary.translation_of(F.lit("loose"), "hi", terms).alias("y")).first() == ("F", None)


def test_glossary_files(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"terms": [{"term": "a b", "translations": {"hi": "x"}, "locked": false}, {"term": "c"}, {"translations": {}}]}')
    terms = glossary.load(spark, str(tmp_path / "g.json"))
    assert [(t.term, t.locked, t.category) for t in terms] == [("a b", False, "general"), ("c", True, "general")]
    glossary.save(spark, terms, str(tmp_path / "out"))
    assert glossary.load(spark, str(tmp_path / "out")) == terms


def test_routing(spark):
    df = spark.createDataFrame([("en", "hi", "x"), ("ur", "en", "x"), ("ja", "ko", "x"), ("hi", "en", "main ghar ja raha hoon"), ("hi", "en", "मैं घर जा रहा हूँ")], "src string, tgt string, text string")
    got = {(r["src"], r["text"]): (r["backend"], r["resolved_src"]) for r in routing.route_texts(df).collect()}
    assert got == {("en", "x"): ("indictrans2", "en"), ("ur", "x"): ("indictrans2", "ur"), ("ja", "x"): ("indictrans2", "ja"), ("hi", "main ghar ja raha hoon"): ("google", "auto"), ("hi", "मैं घर जा रहा हूँ"): ("indictrans2", "hi")}
    assert {r["backend"] for r in routing.route(df, requested="NLLB").collect()} == {"nllb"}
    v = spark.createDataFrame([(60.0, None), (300.0, 7.0), (600.0, 8.0), (601.0, 20.0), (601.0, 14.0)], "duration double, gb double")
    got = {(r["duration"], r["gb"]): (r["category"], r["tier"], r["chunk_seconds"], r["use_cpu"]) for r in routing.strategy(v).collect()}
    assert got == {(60.0, None): ("short", "cpu", 45.0, False), (300.0, 7.0): ("medium", "low", 75.0, False), (600.0, 8.0): ("long", "mid", 150.0, False), (601.0, 20.0): ("very_long", "high", 360.0, False), (601.0, 14.0): ("very_long", "mid", 210.0, True)}
    with pytest.raises(Exception, match="unknown language"):
        spark.range(1).select(routing.model_code(F.lit("xx"))).collect()


def test_evaluation(spark):
    df = spark.createDataFrame([("a", float(x), float(x), 0.0) for x in (1, 2, 3, 4)] + [("b", 5.0, 1.0, 1.0)], "k string, wer double, chrf double, bleu double")
    got = {r["k"]: r["wer_median"] for r in evaluation.aggregate(df, "k").collect()}
    assert got == {"a": 3.0, "b": 5.0}
    h = spark.createDataFrame([("m", "x", 0, 0.2, 50.0, 10.0), ("m", "x", 1, 0.1, 50.0, 20.0), ("m", "x", 2, 0.11, 47.4, 19.0), ("m", "y", 0, 0.1, 1.0, 1.0)], "benchmark string, backend string, ts int, wer_mean double, chrf_mean double, bleu_mean double")
    got = {r["metric"]: (r["severity"], round(r["delta_percent"], 3)) for r in evaluation.regression(h).collect()}
    assert got == {"wer_mean": ("warning", 10.0), "chrf_mean": ("warning", 5.2)} or got == {"wer_mean": ("critical", 10.0), "chrf_mean": ("warning", 5.2)}
    c = evaluation.compare(h.filter("ts = 0"), h.filter("ts = 1"), "benchmark", "backend")
    got = {(r["backend"], r["metric"]): (r["improved"], r["delta"]) for r in c.collect()}
    assert got["x", "bleu_mean"] == (True, 10.0) and got["y", "chrf_mean"] == (False, -1.0) and got["x", "wer_mean"][0]


def test_audio(spark):
    x = [0, 100, -200, 300] * 5
    row = spark.createDataFrame([(x, [10] * 20)], "s array<short>, t array<short>").select(
        audio.peak_rms("s", 8).alias("rms"), audio.crossfade("s", "t", 4).alias("fade"), audio.crossfade("s", "t", 20).alias("plain"), audio.fit("s", F.lit(3)).alias("cut"), audio.fit("s", F.lit(22)).alias("pad"),
        audio.clip("s", 10, F.lit(0.5), F.lit(1.0)).alias("clip"), audio.silence(F.lit(0.001)).alias("silence"), audio.wav_info(audio.wav_bytes("s", 8000)).alias("wav"), audio.stretch_factors(F.lit(5.0)).alias("f"), audio.stretch_factors(F.lit(1.04)).alias("none"),
        audio.stretch_factors(F.lit(0.2)).alias("slow"), audio.joined_length(F.array(F.lit(20), F.lit(20), F.lit(3)), 4).alias("n"),
    ).first()
    assert row["rms"] == math.floor(math.sqrt(np.mean(np.square(x[:8])))) and len(row["fade"]) == 36 and len(row["plain"]) == 40
    a, b, w = np.array(x[-4:]), np.full(4, 10), np.linspace(0, 1, 4)
    assert row["fade"][16:20] == (a * (1 - w) + b * w).astype(np.int16).tolist()
    assert row["cut"] == x[:3] and row["pad"] == x + [0, 0] and row["clip"] == x[5:10] and len(row["silence"]) == 24
    assert row["wav"]["duration"] == 20 / 8000 and row["wav"]["samples"] == x and row["f"] == [2.0, 2.0, 1.25] and row["none"] == [] and row["n"] == 39
    assert row["slow"] == pytest.approx([0.5, 0.5, 0.8])
    bad = spark.createDataFrame([(bytearray(b"x"),)], "b binary").select(audio.wav_info("b").alias("w")).first()["w"]
    assert bad["duration"] == 0.0 and bad["samples"] is None


def test_attach_and_speakers(spark):
    df = seg(spark, (0.0, 10.0, "a"), (10.0, 40.0, "b"), (70.0, 71.0, "c"))
    got = timeline.attach_texts(df, seg(spark, (0.0, 0.0, "x"), (0.0, 0.0, "y"))).orderBy("seg_idx").collect()
    assert [r["text"] for r in got] == ["x", "y"]
    turns = spark.createDataFrame([("v", "s2", 0.0, 4.0), ("v", "s1", 4.0, 8.0), ("v", "s3", 8.0, 100.0), ("v", "s1", 70.0, 70.5)], "video string, speaker string, start double, end double")
    got = timeline.assign_speakers(df, turns, bin_seconds=5.0).orderBy("seg_idx").collect()
    assert [r["speaker_id"] for r in got] == ["s1", "s3", "s3"]
    assert timeline.assign_speakers(df, turns.limit(0)).first()["speaker_id"] == "spk_00"
