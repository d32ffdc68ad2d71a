"""Composite flows: each is a plan of the operators, with retries as waves over what is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import validators
from ..functions.text import squash, strip
from ..operators import chunking, glossary, routing, timeline
from ..sources.staged import sorted_in, stored
from .backends import translated


def cleaned(segments: DataFrame) -> DataFrame:
    """Segments squashed, without empty texts, fixed, split and flagged."""
    # no text is split into an empty one; asked before the split, Spark would squash each text once for the answer and again for the row
    df = timeline.split_overlong(timeline.fix_timestamps(segments.withColumn("text", squash("text")))).filter("text <> ''")
    df = timeline.flag_music(df)
    return df if "avg_logprob" in df.columns else df.withColumn("avg_logprob", F.lit(0.0))


def postprocess_transcript(segments: DataFrame, lang_prob: float | None = None, refine: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, summary): squashed, without empty texts, fixed, split and flagged; and per video its text, confidence, and gate.

    segments has video, seg_idx, start, end, text, and may have avg_logprob, language, expected and language_probability. refine: listens again, as recognition.refined
    does; texts are those after it, confidence and music those of what was heard first. Cleaned segments are stored, as all that is asked of a video reads them."""
    have = segments.columns
    df = stored(cleaned(segments), "heard")
    again = df if refine is None else refine(timeline.renumbered(df))
    summary = timeline.transcript(again).join(sorted_in(timeline.confidence_summary(df)), "video").join(sorted_in(timeline.music_heavy(df).select("video", "music_ratio", "music_heavy")), "video")
    facts = segments.groupBy("video").agg(*(F.first(c, ignorenulls=True).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (("language", "string"), ("expected", "string"), ("language_probability", "double"))))
    prob = F.lit(lang_prob) if lang_prob is not None else F.coalesce("language_probability", F.lit(0.0))
    summary = summary.join(sorted_in(facts), "video").withColumn("gate", validators.gate("text", "language", "expected", prob, "avg_logprob"))
    return again, summary.withColumn("passed", F.col("gate") == "ok")


def translate(df: DataFrame, terms: list, waves: list, strict: bool = True) -> DataFrame:
    """Locks terms, routes, translates, restores and validates df(id, text, src, tgt); what fails goes on to the next of waves.

    waves: in the order of trial, each a backend factory, or factories by the name of the backend that a row is routed to. The first wave takes a row's resolved
    source language. Terms are restored in each row's own target language. Adds translation, passed, score, reason, backend, wave; the last wave's result stays
    even if it failed. Each wave is stored, so that no model is called again for what follows it."""
    left = routing.route_texts(glossary.lock(df, "text", terms))
    held = [*df.columns, "locked_text", "placeholders", "backend", "resolved_src"]
    out = None
    for k, factory in enumerate(waves):
        asked = left.select(*(F.col(c).alias("source" if c == "text" else "_src" if c == "src" else c) for c in held)).withColumnsRenamed({"locked_text": "text"})
        asked = asked.withColumn("src", F.col("resolved_src" if k == 0 else "_src"))
        tried = translated(asked, factory).withColumnsRenamed({"text": "locked_text"}).drop("src").withColumnsRenamed({"source": "text", "_src": "src"})
        tried = tried.withColumn("translation", glossary.restore("hypothesis", "placeholders", F.col("tgt"), terms))
        tried = tried.withColumn("_r", validators.copy_ratio("text", "translation", "src", "tgt"))
        tried = tried.withColumn("_v", validators.validate_translation("text", "translation", "src", "tgt", strict, F.col("_r")))
        tried = stored(tried.select(*held, "translation", "_v.*", F.lit(k).alias("wave")), f"wave-{k}")
        done = tried if k == len(waves) - 1 else tried.filter("passed")
        out = done if out is None else out.unionByName(done)
        left = tried.filter(~F.col("passed")).select(*held)
    return out


def translate_chunks(segments: DataFrame, src: str, tgt: str, factory, small: int = 220) -> DataFrame:
    """video, chunk_idx, start, end, text, quality_score: a video's text in semantic chunks, each translated and checked strictly.

    A chunk that fails is translated again in pieces of at most small characters, checked but not held back; its score is their mean. What was tried first is stored, so no chunk is translated or checked twice."""
    times = F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "start", "end"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    whole = segments.filter("video IS NOT NULL").groupBy("video").agg(timeline.joined_texts().alias("text"), times.alias("times"))
    chunks = chunking.chunk_semantic(whole).withColumns({"src": F.lit(src), "tgt": F.lit(tgt)})

    def tried(df: DataFrame, strict: bool) -> DataFrame:
        out = translated(df, factory).withColumn("_r", validators.copy_ratio("text", "hypothesis", "src", "tgt"))
        return out.withColumn("_v", validators.validate_translation("text", "hypothesis", "src", "tgt", strict, F.col("_r"))).withColumns({"passed": F.col("_v.passed"), "score": F.col("_v.score")}).drop("_v", "_r")

    key = ["video", "chunk_idx", "start", "end"]
    first = stored(tried(chunks, True), "chunks")
    good = first.filter("passed").select(*key, F.col("hypothesis").alias("text"), F.col("score").alias("quality_score"))
    pieces = first.filter(~F.col("passed")).select(*key, "src", "tgt", F.posexplode_outer(chunking.chunked("text", chunking.by_sentences, limit=small)).alias("i", "text"))
    rows = F.sort_array(F.collect_list(F.struct("i", F.coalesce("hypothesis", F.lit("")).alias("h"))))
    again = tried(pieces, False).groupBy(*key).agg(F.array_join(F.filter(F.transform(rows, lambda x: x["h"]), lambda h: h != ""), " ").alias("text"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("quality_score"))
    return good.unionByName(again)


def synthesis_plan(segments: DataFrame, most: float = 60.0, limit: int = 80) -> DataFrame:
    """Segments in chunks of time, relative to them, with pieces to speak and the silence before each."""
    df = timeline.normalize_chunks(timeline.anchored_chunks(segments.filter(strip("text") != ""), most))
    silence = timeline.segment_silence(df.withColumnRenamed("video", "_v").withColumn("video", F.concat_ws("/", F.col("_v").cast("string"), "chunk_id")))
    return silence.drop("video").withColumnRenamed("_v", "video").withColumn("pieces", chunking.chunked("text", chunking.speakable, limit=limit))


def run_report(stages: DataFrame) -> DataFrame:
    """run_id, status, total_seconds, slowest, seconds (by stage) for events(run_id, stage, seconds, status)."""
    worst = F.when(F.count_if(F.col("status") == "failed") > 0, "failed").when(F.count_if(F.col("status") == "interrupted") > 0, "interrupted").otherwise("ok")
    return stages.groupBy("run_id").agg(worst.alias("status"), F.sum("seconds").alias("total_seconds"), F.max_by("stage", F.struct("seconds", "stage")).alias("slowest"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "seconds")))).alias("seconds"))
