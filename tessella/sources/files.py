"""Sources and sinks: segments, transcripts, benchmarks, metric history, checkpoints, review timelines and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import S, squeeze, strip, text, timecode

SEGMENTS = "video string, seg_idx int, start double, end double, text string, speaker_id string, avg_logprob double, no_speech_prob double, is_suspicious boolean, suspicion_reason string, refined boolean, gap_refined boolean"
BENCHMARK = "name string, description string, src_lang string, tgt_lang string, segments array<struct<source:string,reference:string,context:string>>"
HISTORY = "benchmark string, backend string, ts timestamp, wer_mean double, wer_median double, chrf_mean double, bleu_mean double, num_segments long"
#: First lines of a review file (fixed values).
REVIEW_HEAD = ["# Edit only the transcript text after the time range.", "# Keep one segment per line. Timeline format:", "# 0:00.00 - 0:03.20  text", ""]


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments from JSON lines."""
    return spark.read.schema(SEGMENTS).json(path)


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """A row per segment of benchmark files: name, src_lang, tgt_lang, segment_index, source, reference, context. A missing path fails."""
    files = spark.read.schema(BENCHMARK).json(path, multiLine=True)
    return files.select("name", "src_lang", "tgt_lang", F.posexplode("segments").alias("segment_index", "s")).select("name", "src_lang", "tgt_lang", "segment_index", "s.*")


def write_benchmark(df: DataFrame, path: str) -> None:
    """Benchmarks from rows as read_benchmarks() gives them, one file for each name."""
    rows = F.sort_array(F.collect_list(F.struct("segment_index", "source", "reference", "context")))
    out = df.groupBy("name", "src_lang", "tgt_lang").agg(F.transform(rows, lambda x: F.struct(x["source"].alias("source"), x["reference"].alias("reference"), x["context"].alias("context"))).alias("segments"))
    # a file holds one object, so each has a folder of its own
    out.withColumns({"description": F.lit(""), "file": F.concat_ws("_", "name", "src_lang", "tgt_lang")}).write.partitionBy("file").mode("append").json(path)


def list_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """name: the stems of the JSON files in a folder, result and history files included."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("name"))


def append_history(df: DataFrame, path: str) -> None:
    """Adds metric rows to the history table; nothing that is there is read or written again."""
    df.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).parquet(path)


def save_checkpoint(df: DataFrame, root: str, step: str, run_key: str | None) -> None:
    """A step's table, with the time and the key of its run."""
    df.withColumns({"_saved_at": F.current_timestamp(), "_run_key": F.lit(run_key).cast("string")}).write.mode("overwrite").parquet(f"{root}/{step}")


def load_checkpoint(spark: SparkSession, root: str, step: str, run_key: str | None) -> DataFrame | None:
    """A step's table; None if it is missing or can't be read, or if both it and the caller have a key and the keys differ."""
    from pyspark.errors import PySparkException

    try:
        df = spark.read.parquet(f"{root}/{step}")
        saved = df.select("_run_key").first()
    except PySparkException:
        return None
    if run_key and saved and saved[0] and saved[0] != run_key:
        return None
    return df.drop("_saved_at", "_run_key")


def resume_key(*fields: Column | str) -> Column:
    """What identifies a run: its fields joined by |, nulls as empty."""
    return F.concat_ws("|", *(F.coalesce(F.col(f).cast("string") if isinstance(f, str) else f.cast("string"), F.lit("")) for f in fields))


def review_line(start: Column | str = "start", end: Column | str = "end", c: Column | str = "text") -> Column:
    return F.concat(timecode(F.coalesce(start, F.lit(0.0))), F.lit(" - "), timecode(F.coalesce(end, start, F.lit(0.0))), F.lit("  "), squeeze(c))


def write_review(df: DataFrame, path: str) -> None:
    """One review text for each video, under path/video=..., in order."""
    lines = F.sort_array(F.collect_list(F.struct("seg_idx", review_line().alias("l"))))
    out = df.groupBy("video").agg(F.array_join(F.concat(F.array(*map(F.lit, REVIEW_HEAD)), F.transform(lines, lambda x: x["l"])), "\n").alias("value"))
    out.write.mode("overwrite").partitionBy("video").text(path)


def review_text(line: Column | str) -> Column:
    """The text of a review line: what follows its time range, or all of it, without one pair of quotes around it."""
    t = strip(line)
    after = F.when(t.rlike(rf"^{S}*[\p{{Nd}}:.]+{S}*-{S}*[\p{{Nd}}:.]+{S}+.*\z"), F.regexp_extract(t, rf"^{S}*[\p{{Nd}}:.]+{S}*-{S}*[\p{{Nd}}:.]+{S}+(.*)\z", 1)).otherwise(t)
    after = strip(after)
    quoted = (F.length(after) >= 2) & F.substring(after, 1, 1).isin('"', "'") & (F.substring(after, 1, 1) == F.substring(after, -1, 1))
    return F.when(quoted, strip(F.substring(after, F.lit(2), F.length(after) - 2))).otherwise(after)


def apply_review(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """segments with the texts of lines(video, line_no, line), by order; comments and blank lines don't count, an empty text keeps the segment's."""
    by = Window.partitionBy("video")
    real = lines.filter((strip("line") != "") & ~strip("line").startswith("#"))
    edits = real.select("video", (F.row_number().over(by.orderBy("line_no")) - 1).alias("_n"), review_text("line").alias("_t"))
    out = segments.withColumn("_n", F.row_number().over(by.orderBy("seg_idx")) - 1).join(edits, ["video", "_n"], "left")
    return out.withColumn("text", F.when(F.coalesce("_t", F.lit("")) != "", F.col("_t")).otherwise(F.col("text"))).drop("_n", "_t")


def write_transcript(df: DataFrame, path: str) -> None:
    """df(video, text) as one text file for each video."""
    df.select("video", text("text").alias("value")).write.mode("overwrite").partitionBy("video").text(path)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """path and the bytes of audio files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
