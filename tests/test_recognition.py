"""Listening again to doubtful segments and gaps, against one video after the other."""

import pytest

from tessella.operators import timeline
from tessella.plans import flows, recognition

SCHEMA = "video string, seg_idx int, start double, end double, text string, avg_logprob double, is_suspicious boolean, note string"


class Told(recognition.Recognizer):
    """Says what is planned for a clip's start in whole seconds, and notes in a file that it was asked."""

    plan: dict = {}
    log = ""

    def listen(self, video, start, end, language):
        with open(self.log, "a") as f:
            f.write(f"{video} {start:.2f} {end:.2f} {language}\n")
        if (said := self.plan.get((video, round(start)))) is None:
            raise KeyError("nothing")
        return [x for x in said if x[0] < end - start]


@pytest.fixture()
def told(tmp_path):
    class Here(Told):
        log = str(tmp_path / "asked")
        plan = {
            ("a", 0): [(0.0, 1.0, " better words "), (1.0, 2.0, ""), (1.0, 2.0, "here")],
            ("a", 5): [(0.0, 1.0, "tiny")],
            ("a", 2): [(0.5, 1.0, "found it"), (1.0, 1.1, "too short"), (1.2, 2.0, " ")],
            ("a", 10): [],
            ("b", 9): [(3.0, 3.9, "late words")],
            ("b", 13): [(0.0, 0.9, "second wave")],
        }

    return Here


def rows():
    a = [("a", 0, 0.0, 2.0, "bad words", -2.0, None, "n"), ("a", 1, 5.0, 7.0, "a long enough text to keep here", None, True, "n"), ("a", 2, 8.0, 9.5, "fine", -0.1, False, "n"), ("a", 3, 12.0, 13.0, "fine too", -1.1, False, "n")]
    b = [("b", 0, 8.0, 9.0, "one", None, None, None), ("b", 1, 19.0, 20.0, "two", None, None, None)]
    c = [("c", 7, 0.0, 1.0, "alone", -3.0, None, None), ("c", 9, 30.0, 31.0, "too far", None, None, None)]
    return a + b + c


def told_of(df):
    return sorted((r["video"], r["seg_idx"], round(r["start"], 2), round(r["end"], 2), r["text"], r["refined"], r["gap_refined"]) for r in df.collect())


def test_one_round(spark, told):
    got = recognition.refined(spark.createDataFrame(rows(), SCHEMA), told, "en")
    assert told_of(got) == [
        ("a", 0, 0.0, 2.0, "better words here", True, False), ("a", 1, 2.55, 3.05, "found it", False, True), ("a", 2, 5.0, 7.0, "a long enough text to keep here", False, False), ("a", 3, 8.0, 9.5, "fine", False, False), ("a", 4, 12.0, 13.0, "fine too", False, False),
        ("b", 0, 8.0, 9.0, "one", False, False), ("b", 1, 12.05, 12.95, "late words", False, True), ("b", 2, 19.0, 20.0, "two", False, False),
        ("c", 7, 0.0, 1.0, "alone", False, False), ("c", 9, 30.0, 31.0, "too far", False, False),
    ]
    assert {r["note"] for r in got.filter("video = 'a'").collect()} == {"n", None}
    asked = sorted(open(told.log).read().split("\n")[:-1])
    assert asked == ["a 0.00 2.25 en", "a 2.05 4.95 en", "a 4.75 7.25 en", "a 9.55 11.95 en", "b 9.05 18.95 en", "c 0.00 1.25 en"]


def test_rounds(spark, told):
    """Further rounds ask only for clips that are new, see what earlier ones recovered, and end by themselves."""
    got = recognition.refined(spark.createDataFrame(rows(), SCHEMA), told, rounds=9)
    assert [x[4] for x in told_of(got) if x[0] == "b"] == ["one", "late words", "second wave", "two"]
    asked = open(told.log).read().split("\n")[:-1]
    assert len(asked) == len(set(asked))
    assert recognition.refined(spark.createDataFrame([], SCHEMA), told, rounds=2).count() == 0
    plain = spark.createDataFrame([r[:5] for r in rows()], SCHEMA.split(", avg")[0])
    assert recognition.refined(plain, told).columns == [*plain.columns, "refined", "gap_refined"]


def test_limits(spark, told):
    """Each round takes the first few of a video; the next round takes those after them."""
    many = spark.createDataFrame([("v", i, 100.0 + 5 * i, 101.0 + 5 * i, "some words", -2.0, None, None) for i in range(5)], SCHEMA)
    recognition.refined(many, told, rounds=1, most_segments=2, most_gaps=1).count()
    assert len(open(told.log).read().split("\n")[:-1]) == 3
    recognition.refined(many, told, rounds=2, most_segments=2, most_gaps=1).count()
    assert len(open(told.log).read().split("\n")[:-1]) == 3 + 6


def test_flow(spark, told):
    df = spark.createDataFrame(rows(), SCHEMA)
    heard, summary = flows.postprocess_transcript(df.drop("is_suspicious"), 1.0, lambda d: recognition.refined(d, told))
    first, before = flows.postprocess_transcript(df.drop("is_suspicious"), 1.0)
    text = {r["video"]: r["text"] for r in summary.collect()}
    assert text["b"] == "one late words two" and text["a"].startswith("better words here found it")
    assert {r["video"]: r["low_confidence_segments"] for r in summary.collect()} == {r["video"]: r["low_confidence_segments"] for r in before.collect()}
    assert heard.count() == first.count() + 2
    assert timeline.renumbered(first).count() == first.count()
