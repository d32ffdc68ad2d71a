"""Waves of listening again: to segments of low confidence, and to gaps in which speech may have been missed.

Each wave asks the model for the first few clips of every video that it hasn't been asked for, stores what it said, and puts this into the transcript. Waves end when one changes nothing, or
after a given number; with one, each clip is as in a single pass over the transcript.

Defined cases: a clip at which the model fails keeps its error and changes nothing; nothing heard, or a text much shorter than before, leaves a segment as it is; recovered segments under 0.2 seconds or without text
are left out; videos in which nothing was recovered keep their numbers and times; null times are those of fix_timestamps; seg_idx tells a video's segments apart; an empty table stays empty."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squash, strip
from ..operators import timeline
from ..sources.staged import stored

HEARD = "array<struct<start:double,end:double,text:string>>"


class Recognizer:
    """What is said between two times of a video: (start, end, text), in seconds from the clip's start."""

    def listen(self, video, start: float, end: float, language: str | None) -> list[tuple[float, float, str]]:
        raise NotImplementedError


class Echo(Recognizer):
    """Stand-in: says how many tenths of a second a clip has; fails for multiples of 7, and says no for multiples of 3."""

    def listen(self, video, start: float, end: float, language: str | None) -> list[tuple[float, float, str]]:
        n = int((end - start) * 10)
        if n % 7 == 0:
            raise ValueError(f"{n} tenths")
        return [(0.0, end - start, "no")] if n % 3 == 0 else [(0.0, min(end - start, 1.0), f"echo {n}"), (1.0, 1.1, "um")]


def listened(clips: DataFrame, factory: Callable[[], Recognizer], language: str | None) -> DataFrame:
    """Adds heard and error to clips(video, clip_start, clip_end). A worker creates a model when its first clip comes."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in clips.schema.fields), f"heard {HEARD}", "error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            said, errors = [], []
            for video, start, end in zip(b["video"], b["clip_start"], b["clip_end"]):
                try:
                    model = model or factory()
                    said.append([{"start": s, "end": e, "text": t} for s, e, t in model.listen(video, start, end, language)])
                    errors.append(None)
                except Exception as e:  # a clip that fails changes nothing; the error is stored with it
                    said.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.assign(heard=pd.Series(said, index=b.index, dtype=object), error=pd.Series(errors, index=b.index, dtype=object))

    return clips.mapInPandas(run, schema)


def again(df: DataFrame, factory: Callable[[], Recognizer], language: str | None, first: int, margin: float) -> DataFrame:
    """df with better texts for the first so many doubtful segments of each video that weren't asked for; sets asked and refined."""
    low = timeline.low_confidence(df.filter(~F.col("asked")), first=first)
    begin = F.greatest(F.lit(0.0), F.col("start") - margin)
    clips = low.select("video", "seg_idx", begin.alias("clip_start"), (F.col("end") + margin).alias("clip_end"))
    heard = stored(listened(clips, factory, language), "heard-again")
    said = F.filter(F.transform("heard", lambda x: squash(strip(x["text"]))), lambda t: t != "")
    new = heard.select("video", "seg_idx", F.array_join(said, " ").alias("_new"))
    out = df.join(new, ["video", "seg_idx"], "left").withColumn("_t", timeline.accept_refinement("text", "_new"))
    better = F.col("_new").isNotNull() & (F.col("_new") != "") & (F.col("_t") == strip("_new"))
    return out.withColumns({"asked": F.col("asked") | F.col("_new").isNotNull(), "refined": F.col("refined") | better, "text": F.col("_t")}).select(*df.columns)


def between(df: DataFrame, known: DataFrame | None, factory: Callable[[], Recognizer], language: str | None, first: int) -> DataFrame:
    """What was heard in the first so many gaps of each video that aren't among the clips of known: video, clip_start, clip_end, heard, error."""
    clips = timeline.refinable_gaps(df, first=(1 << 31) - 1).select("video", "clip_start", "clip_end")
    if known is not None:
        clips = clips.join(known.select("video", "clip_start", "clip_end"), ["video", "clip_start", "clip_end"], "left_anti")
    numbered = clips.withColumn("_k", F.row_number().over(Window.partitionBy("video").orderBy("clip_start", "clip_end")))
    return stored(listened(numbered.filter(F.col("_k") <= first).drop("_k"), factory, language), "heard-between")


def refined(segments: DataFrame, factory: Callable[[], Recognizer], language: str | None = None, rounds: int = 1, most_segments: int = 8, most_gaps: int = 6, margin: float = 0.25) -> DataFrame:
    """segments(video, seg_idx, start, end, text, and any others), numbered anew in videos with recovered ones, with refined and gap_refined.

    Segments are candidates by avg_logprob and is_suspicious, as far as they have these columns. A video costs at most most_segments and most_gaps clips a round."""
    have = [c for c in ("avg_logprob", "is_suspicious") if c in segments.columns]
    lacking = {c: F.lit(None).cast(t) for c, t in (("avg_logprob", "double"), ("is_suspicious", "boolean")) if c not in have}
    df = segments.withColumns({**lacking, "asked": F.lit(False), "refined": F.lit(False), "gap_refined": F.lit(False)})
    columns, known = df.columns, None
    for _ in range(rounds):
        before = df
        df = stored(again(df, factory, language, most_segments, margin), "refined")
        heard = between(df, known, factory, language, most_gaps)
        known = heard if known is None else known.unionByName(heard)
        each = heard.select("video", "clip_start", F.explode("heard").alias("h"))
        found = each.select("video", F.lit(None).cast(df.schema["seg_idx"].dataType).alias("seg_idx"), (F.col("clip_start") + F.col("h.start")).alias("start"), (F.col("clip_start") + F.col("h.end")).alias("end"), F.col("h.text").alias("text"))
        found = stored(timeline.keep_recovered(found).withColumns({"asked": F.lit(False), "refined": F.lit(False)}), "recovered")
        if not found.isEmpty():
            hit = found.select("video").distinct()
            merged = timeline.renumbered(timeline.merge_gaps(df.join(hit, "video", "left_semi"), found))
            df = stored(df.join(hit, "video", "left_anti").select(*columns).unionByName(merged.select(*columns)), "refined")
        elif df.filter("asked").count() == before.filter("asked").count():
            break
    return df.drop("asked", *lacking)
