"""Streams of log lines and of segments, with the batch operators they agree with."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.text import strip, text

#: Markers of a run's steps with the progress they mean (fixed values).
STEPS = {"[1/5]": 14.0, "[2/5]": 34.0, "[3/5]": 54.0, "[4/5]": 82.0, "[5/5]": 96.0}


def classify(line: Column | str) -> Column:
    """struct(progress, severity) of a log line; the first rule that fits counts, and progress is null where a line says nothing of it."""
    raw, lower = text(line), F.lower(strip(line))
    has = lambda *words: F.lower(raw).rlike("|".join(words))
    result = lambda p, s: F.struct(F.lit(p).cast("double").alias("progress"), F.lit(s).alias("severity"))
    out = None
    for mark, percent in STEPS.items():
        out = (F if out is None else out).when(F.contains(raw, F.lit(mark)), result(percent, "step"))
    out = out.when(has("finished with exit code 0", "pipeline complete", "output is ready"), result(100.0, "success"))
    for words, severity in ((("interrupted", "stop requested"), "interrupted"), (("pipeline failed", "error"), "error"), (("warn",), "warning"), (("info",), "info")):
        out = out.when(has(*words), result(None, severity))
    return out.otherwise(F.when(lower == "", result(None, "empty")).otherwise(result(None, "text")))


def classified(lines: DataFrame) -> DataFrame:
    """Adds progress and severity to lines(line), streaming or not."""
    return lines.withColumn("_c", classify("line")).withColumns({"progress": F.col("_c.progress"), "severity": F.col("_c.severity")}).drop("_c")


def run_progress(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """run_id, progress (that of the last line with any, of lines at one time the greatest), errors, warnings, lines for lines(run_id, ts, line); a stream gets a watermark."""
    rows = classified(lines.withWatermark("ts", late) if lines.isStreaming else lines)
    last = F.max_by("progress", F.when(F.col("progress").isNotNull(), F.struct("ts", "progress")))
    return rows.groupBy("run_id").agg(last.alias("progress"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count("*").alias("lines"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of run_id (the file), ts (when it was written) and line of growing log folders."""
    lines = spark.readStream.format("text").load(path)
    return lines.select(F.col("_metadata.file_name").alias("run_id"), F.col("_metadata.file_modification_time").alias("ts"), F.col("value").alias("line"))


def inactivity(segments: DataFrame, gap: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """video, begin, finish, segments: stretches without a pause of gap between starts, by a session window over ts."""
    rows = segments.withWatermark("ts", late) if segments.isStreaming else segments
    out = rows.groupBy("video", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("segments"))
    return out.select("video", F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), "segments")


class Anchored(StatefulProcessor):
    """Numbers chunks of a video's segments; the state is the present chunk's number and where it began."""

    def __init__(self, most: float):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chunk", StructType([StructField("anchor", DoubleType()), StructField("chunk", IntegerType())]))

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values("seg_idx")
        anchor, chunk = self.state.get() if self.state.exists() else (None, -1)
        out = []
        for start in batch["start"]:
            if anchor is None or start - anchor > self.most:
                anchor, chunk = float(start), chunk + 1
            out.append(chunk)
        self.state.update((anchor, chunk))
        yield pd.DataFrame({"video": key[0], "seg_idx": batch["seg_idx"].to_numpy(), "start": batch["start"].to_numpy(), "chunk_id": out})

    def close(self) -> None:
        pass


def anchored_stream(segments: DataFrame, most: float = 300.0) -> DataFrame:
    """video, seg_idx, start, chunk_id of a stream of segments(video, seg_idx, start) that comes in order; equals timeline.anchored_chunks()."""
    video = segments.schema["video"].dataType.simpleString()
    return segments.select("video", "seg_idx", "start").groupBy("video").transformWithStateInPandas(statefulProcessor=Anchored(most), outputStructType=f"video {video}, seg_idx int, start double, chunk_id int", outputMode="Append", timeMode="None")
