"""Sources, streams, flows and the driver's entry points."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tessella.operators import glossary, timeline
from tessella.plans import backends, batches, flows
from tessella.sources import files
from tessella.streaming import streams

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_checkpoints(spark, tmp_path):
    at = str(tmp_path / "c")
    df = spark.range(3)
    assert files.load_checkpoint(spark, at, "one", "k") is None
    files.save_checkpoint(df, at, "one", "k")
    assert files.load_checkpoint(spark, at, "one", "k").count() == 3 and files.load_checkpoint(spark, at, "one", None).columns == ["id"]
    assert files.load_checkpoint(spark, at, "one", "other") is None
    files.save_checkpoint(df, at, "two", None)
    assert files.load_checkpoint(spark, at, "two", "other").count() == 3


def test_benchmark_and_history(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"name": "b", "src_lang": "en", "tgt_lang": "hi", "segments": [{"source": "a", "reference": "x"}, {"source": "b", "reference": "y", "context": "c"}]}))
    rows = files.read_benchmarks(spark, str(tmp_path / "b.json")).orderBy("segment_index")
    assert [(r["source"], r["context"]) for r in rows.collect()] == [("a", None), ("b", "c")]
    assert [r["name"] for r in files.list_benchmarks(spark, str(tmp_path)).collect()] == ["b"]
    files.write_benchmark(rows, str(tmp_path / "out"))
    assert files.read_benchmarks(spark, str(tmp_path / "out")).count() == 2
    h = spark.createDataFrame([("b", "m", 0.1)], "benchmark string, backend string, wer_mean double").withColumn("ts", F.current_timestamp())
    for _ in range(2):
        files.append_history(h, str(tmp_path / "h"))
    assert files.read_history(spark, str(tmp_path / "h")).count() == 2
    with pytest.raises(Exception):
        files.read_benchmarks(spark, str(tmp_path / "absent.json")).count()


def test_review(spark, tmp_path):
    s = spark.createDataFrame([("v", 0, 0.0, 3.2, "old"), ("v", 1, 3.2, 4.0, "keep"), ("v", 2, 4.0, 5.0, "third")], "video string, seg_idx int, start double, end double, text string")
    lines = ["# head", "", '0:00.00 - 0:03.20  "new text"', "0:03.20 - 0:04.00", "raw line"]
    edits = spark.createDataFrame([("v", i, x) for i, x in enumerate(lines)], "video string, line_no int, line string")
    got = [r["text"] for r in files.apply_review(s, edits).orderBy("seg_idx").collect()]
    assert got == ["new text", "0:03.20 - 0:04.00", "raw line"]
    files.write_review(s, str(tmp_path / "r"))
    text = spark.read.text(str(tmp_path / "r")).collect()
    assert "0:00.00 - 0:03.20  old" in [r["value"] for r in text]
    assert spark.range(1).select(files.resume_key(F.lit("a"), F.lit(None), F.lit(3))).first()[0] == "a||3"


def test_logs(spark):
    lines = ["[2/5] Transcribing", "Pipeline complete", "Stop requested", "ERROR x", "a warning", "info: y", "hello", " "]
    got = streams.classified(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r["progress"], r["severity"]) for r in got] == [(34.0, "step"), (100.0, "success"), (None, "interrupted"), (None, "error"), (None, "warning"), (None, "info"), (None, "text"), (None, "empty")]


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "run1.log").write_text("[1/5] go\n[3/5] on\nERROR bad\n")
    q = streams.classified(streams.read_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("logs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    rows = spark.table("logs").collect()
    assert {r["run_id"] for r in rows} == {"run1.log"} and sorted(r["progress"] or 0 for r in rows) == [0, 14.0, 54.0]


def test_anchored_stream(spark, tmp_path):
    starts = [0.0, 30.0, 50.0, 100.0, 130.0, 131.0]
    for part in (0, 1):
        (tmp_path / "in").mkdir(exist_ok=True)
        at = tmp_path / "in" / f"{part}.json"
        at.write_text("\n".join(json.dumps({"video": "v", "seg_idx": i, "start": starts[i]}) for i in range(3 * part, 3 * part + 3)))
        os.utime(at, (1000 + part, 1000 + part))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.readStream.schema("video string, seg_idx int, start double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = streams.anchored_stream(src, 45.0).writeStream.format("memory").queryName("chunks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = [r["chunk_id"] for r in spark.table("chunks").orderBy("seg_idx").collect()]
    batch = timeline.anchored_chunks(spark.read.schema("video string, seg_idx int, start double").json(str(tmp_path / "in")), 45.0)
    assert got == [r["chunk_id"] for r in batch.orderBy("seg_idx").collect()] == [0, 0, 1, 2, 2, 2]


def test_sessions(spark):
    df = spark.createDataFrame([("v", s) for s in (0, 1, 10)], "video string, s int").select("video", F.timestamp_seconds("s").alias("ts"))
    assert [r["segments"] for r in streams.inactivity(df).orderBy("begin").collect()] == [2, 1]


def test_flows(spark):
    s = spark.createDataFrame([("v", 0, 0.0, 2.0, "hello there my good friend"), ("v", 1, 2.0, 4.0, "music"), ("v", 2, 4.0, 6.0, "we are here today")], "video string, seg_idx int, start double, end double, text string")
    rows, summary = flows.postprocess_transcript(s.withColumns({"language": F.lit("en"), "expected": F.lit("en"), "language_probability": F.lit(1.0)}))
    assert rows.count() == 2 and summary.first()["gate"] == "ok" and summary.first()["text"] == "hello there my good friend we are here today"
    t = spark.createDataFrame([("1", "this is a plain sentence", "en", "fr"), ("2", "", "en", "fr")], "id string, text string, src string, tgt string")

    class Good(backends.Translator):
        def translate(self, text, src, tgt):
            return "voici une phrase assez claire."

    got = {r["id"]: (r["passed"], r["wave"]) for r in flows.translate(t, [], [backends.Identity, Good]).collect()}
    assert got == {"1": (True, 1), "2": (False, 1)}
    e = spark.createDataFrame([("r", "a", 1.0, "ok"), ("r", "b", 3.0, "failed")], "run_id string, stage string, seconds double, status string")
    r = flows.run_report(e).first()
    assert (r["status"], r["total_seconds"], r["slowest"]) == ("failed", 4.0, "b")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_corpus(tmp_path):
    """The rest imports and lists its queries where the corpus operators are absent."""
    code = "import __spark_entry__ as e; n = e.queries(); assert 'q_validation_summary' in n and not [x for x in n if x.startswith('op') or x == 'pipeline']; e.oracle_sql()"
    subprocess.run(["cp", "-r", f"{REPO}/tessella", f"{REPO}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/tessella/llm"], check=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_settings(spark, monkeypatch):
    from tessella.plans.settings import Settings

    assert Settings.load().max_segment_seconds == 15.0
    monkeypatch.setenv("TESSELLA_EXACT_FIT", "off")
    monkeypatch.setenv("TESSELLA_REFINE_SEGMENTS", "3")
    spark.conf.set("tessella.refine_segments", "5")
    s = Settings.load(spark, target_lang="fr")
    spark.conf.unset("tessella.refine_segments")
    assert (s.exact_fit, s.refine_segments, s.target_lang) == (False, 5, "fr")


def test_delimited():
    class Upper(backends.Translator):
        calls = 0

        def translate(self, text, src, tgt):
            self.calls += 1
            return text.upper()

    class Eats(Upper):
        def translate(self, text, src, tgt):
            return super().translate(text, src, tgt).replace("###__SEGMENT_BOUNDARY__###", "")

    up = Upper()
    assert backends.Delimited(up).translate_batch(["a", "b " * 10, "c"], "x", "y") == ["A", "B " * 9 + "B", "C"] and up.calls == 1
    assert backends.Delimited(Eats()).translate_batch(["a", "b"], "x", "y") == ["A", "B"]
    up = Upper()
    assert backends.Delimited(up).translate_batch(["z" * 5000, *["q"] * 30], "x", "y")[1:] == ["Q"] * 30 and up.calls == 3


def test_chunk_translation(spark):
    s = spark.createDataFrame([("v", i, float(i), i + 0.9, f"This is the sentence number {i} with several more words of text.") for i in range(30)], "video string, seg_idx int, start double, end double, text string")

    class Picky(backends.Translator):
        def translate(self, text, src, tgt):
            return "non " * 3 if len(text) > 220 else "voici une phrase courte. " + text[:5]

    got = flows.translate_chunks(s, "en", "fr", Picky).orderBy("chunk_idx").collect()
    assert got[0]["start"] == 0.0 and all("voici" in r["text"] for r in got) and all(0 < r["quality_score"] <= 1 for r in got)


class Losing(backends.Translator):
    """Loses a mark of requests that hold "lossy", fails on "bad"."""

    def translate(self, text, src, tgt):
        if "bad" in text:
            raise ValueError("bad text")
        return (text.replace("###__SEGMENT_BOUNDARY__###", "", 1) if "lossy" in text else text).replace("home", "maison")


def test_batches(spark):
    """Each text comes back to its item, by the first wave that gives it back."""
    texts = ["home one", "", "home two", None, "  Google home ", "x " * 1600 + "home.", "home " * 900]
    rows = [("joined", i, t) for i, t in enumerate(texts)] + [("lossy", 0, "lossy home"), ("lossy", 1, "home"), ("bad", 0, "bad home"), ("bad", 1, "home"), (None, 7, "home of no batch")]
    df = spark.createDataFrame(rows, "batch string, item int, text string")
    terms = [glossary.Term("Google", {"fr": "Gogol"}, "brand")]
    got = {(r["batch"], r["item"]): r for r in batches.translate_batches(df, "en", "fr", terms, {"google": Losing}, requested="google").collect()}
    assert len(got) == len(rows)
    level = {k: r["level"] for k, r in got.items()}
    assert [level["joined", i] for i in range(7)] == ["joined", "blank", "joined", "blank", "joined", "joined", "each"]
    assert level["lossy", 0] == level["lossy", 1] == "each" and level["bad", 1] == "each" and level[None, 7] == "each"
    assert level["bad", 0] == "failed" and got["bad", 0]["error"] == "ValueError: bad text" and got["bad", 0]["translation"] is None
    assert [got["joined", i]["translation"] for i in (0, 1, 2, 3)] == ["maison one", "", "maison two", ""]
    assert got["joined", 4]["translation"] == "Gogol maison" and got["joined", 6]["translation"] == " ".join(["maison"] * 900)
    assert got["lossy", 0]["translation"] == "lossy maison" and got["bad", 1]["translation"] == "maison"
    # a backend that only fails, and the fallback
    got = {(r["batch"], r["item"]): r for r in batches.translate_batches(df, "en", "fr", terms, {"marian": Losing, "google": backends.Identity}, requested="marian").collect()}
    assert got["bad", 0]["level"] == "fallback" and got["bad", 0]["translation"] == "bad home" and got["bad", 0]["error"] == "ValueError: bad text"
    assert got["joined", 0]["level"] == "each" and got["joined", 0]["translation"] == "maison one"


def test_batches_are_routed_by_all_their_text(spark):
    rows = [("roman", i, "kya haal hai bhai") for i in range(3)] + [("roman", 9, "क"), ("deva", 0, "hello"), ("deva", 1, "नमस्ते दुनिया यह ठीक है")]
    locked = spark.createDataFrame(rows, "batch string, item int, locked_text string")
    got = {r["batch"]: (r["backend"], r["src"]) for r in batches.route_batches(locked, "hi", "en", "indictrans2").collect()}
    assert got == {"roman": ("google", "auto"), "deva": ("indictrans2", "hi")}
