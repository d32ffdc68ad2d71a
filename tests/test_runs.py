"""Runs that are broken off and go on; the full pipeline."""

import os

import pytest
from pyspark.sql import functions as F

from tessella.plans import backends, runs
from tessella.sources.staged import stored

SEG = "video string, seg_idx int, start double, end double, text string"
#: Words that say something, so that no segment is music.
ROWS = [("a", i, 2.0 * i, 2.0 * i + 1.9, f"we say {w} number {w} now") for i, w in enumerate("one two three four five".split())] + [("b", 0, None, None, "First untimed words. Then some more of them."), ("b", 1, 30.0, 60.0, "A sentence of the long one. " * 3), ("c", 0, 0.0, 9.0, " ")]


@pytest.fixture
def segments(spark):
    return stored(spark.createDataFrame(ROWS, SEG), "segments")


class Breaks(Exception):
    pass


@pytest.mark.parametrize("broken", ["renumbered", "speech"])
def test_goes_on_after_a_break(spark, segments, tmp_path, monkeypatch, broken):
    """Wherever a run breaks, the next one makes only what wasn't whole, and what it gives is the same."""
    names = dict(zip(["clock", "renumbered", "translated", "speech", "merged"], ["videos", "transcript", "translated", "speech", "merged"]))
    made = []
    for f in names:
        monkeypatch.setattr(runs, f, lambda *a, f=f, g=getattr(runs, f), **k: made.append(f) or g(*a, **k))
    dub = lambda root: runs.dub(runs.Run(spark, str(tmp_path / root), "k"), segments, "file-1", "en", "fr", [], {None: backends.Identity})
    whole = dub("whole")["merged"].table.collect()
    assert made == list(names)

    made.clear()
    with monkeypatch.context() as m:
        def fails(*a, **k):
            raise Breaks

        m.setattr(runs, broken, fails)
        with pytest.raises(Breaks):
            dub("broken")
    before = list(made)
    assert before == list(names)[: list(names).index(broken)]
    made.clear()
    out = dub("broken")
    assert made == list(names)[len(before) :] and [s.resumed for s in out.values()] == [n in before for n in names]
    assert sorted(out["merged"].table.collect()) == sorted(whole)
    made.clear()
    assert all(s.resumed for s in dub("broken").values()) and made == []
    summary = {r["status"] for r in runs.Run(spark, str(tmp_path / "broken"), "k").summary().collect()}
    assert summary == {"failed", "ok"}


def test_half_written_is_not_read(spark, segments, tmp_path):
    """A table without its commit is none, and a commit is of one key and one fingerprint."""
    root = str(tmp_path)
    run = runs.Run(spark, root, "k")

    def dies():
        spark.range(5).write.parquet(f"{root}/tables/one-half")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        run.step("one", ["f"], dies)
    assert run.report().first()["status"] == "interrupted"
    one = run.step("one", ["f"], lambda: spark.range(7).toDF("x"), p=1)
    assert not one.resumed and one.table.count() == 7 and [r["rows"] for r in run.report().filter("status = 'ok'").collect()] == [7]
    again = lambda key, made_from, **p: runs.Run(spark, root, key).step("one", made_from, lambda: spark.range(2).toDF("x"), **p).resumed
    assert again("k", ["f"], p=1) and not again("k", ["g"], p=1) and not again("k", ["f"], p=2) and not again("other", ["f"], p=1)


def test_what_changed_is_made_again(spark, segments, tmp_path):
    """Another language keeps the transcript; reviewed lines keep it too and change what follows; other files change all."""
    dub = lambda source="f", tgt="fr", **k: [s.name for s in runs.dub(runs.Run(spark, str(tmp_path), "k"), segments, source, "en", tgt, [], {None: backends.Identity}, **k).values() if not s.resumed]
    assert dub() == ["videos", "transcript", "translated", "speech", "merged"] and dub() == []
    assert dub(tgt="es") == ["translated", "speech", "merged"] and dub(chunk_seconds=3.0) == ["speech", "merged"]
    lines = stored(spark.createDataFrame([("a", 0, "0:00.00 - 0:01.90  another text of the first one")], "video string, line_no int, line string"), "lines")
    assert dub(review=lines, review_source="r1") == ["reviewed", "translated", "speech", "merged"]
    assert dub(source="g") == ["videos", "transcript", "translated", "speech", "merged"]


def test_files_fingerprint(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(3).write.parquet(at)
    one = runs.files_fingerprint(spark, at)
    assert runs.files_fingerprint(spark, at) == one
    spark.range(1).write.mode("append").parquet(at)
    assert runs.files_fingerprint(spark, at) != one


def test_steps_of_the_pipeline(spark, segments, tmp_path):
    """Values of each step: languages that are the same keep texts, untimed segments get times, pads fill up to the video's end."""
    out = {k: s.table for k, s in runs.dub(runs.Run(spark, str(tmp_path), "k"), segments, "f", "en", "en", [], {}, chunk_seconds=4.0).items()}
    assert {r["video"]: r["category"] for r in out["videos"].collect()} == {"a": "short", "b": "short", "c": "short"}
    assert [r["text"] for r in out["translated"].filter("video = 'a'").orderBy("seg_idx").collect()] == [r[4] for r in ROWS[:5]]
    assert out["transcript"].filter("video = 'c'").count() == 0
    merged = {r["video"]: r for r in out["merged"].collect()}
    assert merged["a"]["pad"] == pytest.approx(merged["a"]["video_seconds"] - merged["a"]["audio_seconds"]) and merged["c"]["spoken_segments"] == 0 and merged["c"]["pad"] == 9.0
    assert merged["a"]["chunks"] == 2 and merged["a"]["spoken_segments"] == 5
    assert os.path.isdir(tmp_path / "steps") and out["speech"].filter(F.size("pieces") == 0).count() == 0
