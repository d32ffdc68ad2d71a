"""Runs that resume: steps committed once, and found again by what they were made from.

A step's table is written under a name of its own, which nothing reads until one row in the table of steps names it: that row is the commit, a single file
that Spark's committer moves into place when it is whole. What a step was made from is its fingerprint: the run's key, its own parameters and
the fingerprints of the steps or files before it. A later run takes a step whose fingerprint is there, makes all others, and leaves nothing half done to be read;
a run that was broken off goes on after its last whole step. Rows are counted while they are written, by an observation, and reports are of what really ran.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import audio, chunking, routing, timeline
from ..operators.timeline import renumbered
from ..sources import files
from ..sources.staged import sorted_in
from . import batches
from .flows import cleaned, run_report
from .settings import Settings

STEPS = "run_key string, run_id string, step string, fingerprint string, path string, rows long, seconds double, status string, saved_at timestamp"


def digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def files_fingerprint(spark: SparkSession, path: str) -> str:
    """Of names, sizes and times of the files under path; none is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    n, total = listed.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return digest(n, total)


@dataclass(frozen=True)
class Step:
    """A committed step: its table, what it was made from, and whether it was there already."""

    name: str
    table: DataFrame
    fingerprint: str
    resumed: bool


class Run:
    """One run with a key, under a folder that driver and executors share. Runs with the same key find each other's steps; two at a time do no harm, but may make a step twice."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key, self.id = spark, root.rstrip("/"), key, uuid.uuid4().hex[:12]

    def steps(self) -> DataFrame:
        """All rows of the table of steps, of all runs."""
        try:
            return self.spark.read.schema(STEPS).parquet(f"{self.root}/steps")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], STEPS)

    def _note(self, step: str, fingerprint: str, path: str | None, rows: int | None, seconds: float, status: str) -> None:
        row = self.spark.createDataFrame([(self.key, self.id, step, fingerprint, path, rows, seconds, status)], STEPS.rpartition(",")[0])
        row.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/steps")

    def step(self, name: str, made_from: list, make: Callable[[], DataFrame], **parameters) -> Step:
        """The step's table: that of an earlier run if it was made from the same, else made now. made_from: steps and fingerprints of files.

        What make raises is noted as failed, or interrupted, and goes on to the caller."""
        fingerprint = digest(self.key, name, parameters, [x.fingerprint if isinstance(x, Step) else x for x in made_from])
        done = self.steps().filter((F.col("step") == name) & (F.col("fingerprint") == fingerprint) & (F.col("status") == "ok") & F.col("path").isNotNull())
        found = done.orderBy(F.desc("saved_at")).first()
        if found:
            self._note(name, fingerprint, found["path"], found["rows"], 0.0, "resumed")
            return Step(name, self.spark.read.parquet(found["path"]), fingerprint, True)
        at, began, seen = f"{self.root}/tables/{name}-{uuid.uuid4().hex}", time.time(), Observation()
        try:
            df = make()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(at)
        except BaseException as e:
            self._note(name, fingerprint, None, None, time.time() - began, "failed" if isinstance(e, Exception) else "interrupted")
            raise
        self._note(name, fingerprint, at, seen.get["rows"], time.time() - began, "ok")
        return Step(name, self.spark.read.schema(df.schema).parquet(at), fingerprint, False)

    def report(self) -> DataFrame:
        """run_id, step, status, rows, seconds of this key's runs; the last row of a step counts."""
        last = Window.partitionBy("run_id", "step").orderBy(F.desc("saved_at"))
        mine = self.steps().filter(F.col("run_key") == self.key).withColumn("_k", F.row_number().over(last)).filter("_k = 1")
        return mine.select("run_id", "step", "status", "rows", "seconds")

    def summary(self) -> DataFrame:
        """run_id, status, total_seconds, slowest, seconds of this key's runs."""
        return run_report(self.report().withColumnRenamed("step", "stage"))


def key_of(*fields) -> str:
    """A run's key: its fields joined by |, None as empty."""
    return "|".join("" if f is None else str(f) for f in fields)


def clock(segments: DataFrame, gb: float | None = None, force_cpu: bool = False) -> DataFrame:
    """video, duration, segments, and the strategy for it."""
    each = segments.groupBy("video").agg(F.coalesce(F.max(F.greatest("start", "end")), F.lit(0.0)).alias("duration"), F.count("*").alias("segments")).withColumn("gb", F.lit(gb).cast("double"))
    return routing.strategy(each, force_cpu=force_cpu)


def translated(segments: DataFrame, videos: DataFrame, src: str, tgt: str, terms: list, factories: dict, requested: str | None, settings: Settings) -> DataFrame:
    """video, seg_idx, start, end, text, estimated: each video's segments in the target language. One language for both leaves texts as they are; suspicious segments are skipped where few are;
    a video of which no segment has a text gets its sentences' estimated times over its duration; a text of which nothing came back stays empty."""
    kept = timeline.skip_suspicious(segments, settings.skip_suspicious_ratio) if settings.skip_suspicious else segments.filter(strip("text") != "")
    kept = kept.select("video", "seg_idx", "start", "end", "text")
    if src != tgt:
        out = batches.translate_batches(kept.select(F.col("video").alias("batch"), F.col("seg_idx").alias("item"), "text"), src, tgt, terms, factories, requested)
        texts = out.select(F.col("batch").alias("video"), F.col("item").alias("seg_idx"), F.coalesce("translation", F.lit("")).alias("_t"))
        kept = kept.join(sorted_in(texts), ["video", "seg_idx"], "left").select("video", "seg_idx", "start", "end", F.col("_t").alias("text"))
    untimed = kept.filter(F.col("start").isNull()).groupBy("video").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), " ").alias("text"))
    estimated = timeline.estimate_timings(untimed.join(sorted_in(videos.select("video", "duration")), "video"))
    return kept.filter(F.col("start").isNotNull()).withColumn("estimated", F.lit(False)).unionByName(estimated.withColumn("seg_idx", F.col("seg_idx").cast("int")))


def speech(segments: DataFrame, chunk_seconds: float, settings: Settings) -> DataFrame:
    """video, chunk_id, seg_idx, start, end (of the video), silence (before it in its chunk), pieces: what is to be spoken when."""
    spoken = timeline.anchored_chunks(segments.filter(strip("text") != ""), chunk_seconds)
    relative = timeline.normalize_chunks(spoken.withColumns({"_a": F.col("start"), "_b": F.col("end")}))
    quiet = timeline.segment_silence(relative.withColumn("_v", F.col("video")).withColumn("video", F.struct("_v", "chunk_id")))
    return quiet.select(F.col("_v").alias("video"), "chunk_id", "seg_idx", F.col("_a").alias("start"), F.col("_b").alias("end"), "silence", chunking.chunked("text", chunking.speakable, limit=settings.tts_chunk_chars).alias("pieces"))


def merged(videos: DataFrame, spoken: DataFrame) -> DataFrame:
    """video, category, video_seconds, audio_seconds, pad, spoken_segments, chunks: how a video's new sound track is made as long as it."""
    each = spoken.groupBy("video").agg(F.max("end").alias("audio_seconds"), F.count("*").alias("spoken_segments"), F.countDistinct("chunk_id").alias("chunks"))
    out = videos.select("video", "category", F.col("duration").alias("video_seconds")).join(sorted_in(each), "video", "left")
    out = out.withColumns({"audio_seconds": F.coalesce("audio_seconds", F.lit(0.0)), "spoken_segments": F.coalesce("spoken_segments", F.lit(0)), "chunks": F.coalesce("chunks", F.lit(0))})
    return audio.pad_plan(out)


def dub(run: Run, segments: DataFrame, source: str, src: str, tgt: str, terms: list, factories: dict, requested: str | None = None, review: DataFrame | None = None, review_source: str | None = None, settings: Settings = Settings(), gb: float | None = None, chunk_seconds: float = 300.0) -> dict[str, Step]:
    """All steps from recognized segments(video, seg_idx, start, end, text) to the plan of the sound track: videos, transcript, translated, speech, merged.

    source names what segments were read from, review_source what the reviewed lines were. Each step is committed; a step is made again only if something that it depends on has changed, so a
    change of the target language keeps the transcript."""
    videos = run.step("videos", [source], lambda: clock(segments, gb), gb=gb)
    transcript = run.step("transcript", [source], lambda: renumbered(cleaned(segments)))
    edited = transcript
    if review is not None:
        edited = run.step("reviewed", [transcript, review_source], lambda: files.apply_review(transcript.table, review))
    told = dict(src=src, tgt=tgt, terms=digest([str(t) for t in terms]), requested=requested, skip=[settings.skip_suspicious, settings.skip_suspicious_ratio])
    out = run.step("translated", [edited, videos], lambda: translated(edited.table, videos.table, src, tgt, terms, factories, requested, settings), **told)
    spoken = run.step("speech", [out], lambda: speech(out.table, chunk_seconds, settings), chunk_seconds=chunk_seconds, chars=settings.tts_chunk_chars)
    last = run.step("merged", [videos, spoken], lambda: merged(videos.table, spoken.table))
    return {s.name: s for s in (videos, transcript, edited, out, spoken, last)}
