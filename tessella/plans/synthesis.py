"""Timed synthesis: segments spoken in pieces, spoken again where nothing is heard, fitted to their slots, and put on one track.

Models run in two stored waves, so none is called again for what follows. Where a segment begins depends on how long all before it came out; this is a window over a
table of numbers, in which no samples move. The track is made in blocks of samples, a group each, so its length is bounded by no row and no task.

Defined cases: null and blank texts aren't spoken, and don't move the time; what a model raises is kept as the piece's error and counts as no sound; a segment without any sound
moves the time to its start and has no part in the track; null starts and ends are those of segments without a length, at 0 or at the start; seg_idx tells a video's segments apart; an empty table gives an empty plan and
track; further columns are ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze, strip
from ..operators import audio, chunking
from ..sources.staged import stored

#: Samples of a block of the track, and those of finished blocks that a worker returns at once.
BLOCK, READY = 1 << 18, 1 << 20


class Synthesizer:
    """Samples of 16 bits for a text."""

    def speak(self, text: str, language: str | None, rate: int) -> np.ndarray:
        raise NotImplementedError


class Tone(Synthesizer):
    """Stand-in: a square wave of 0.06 seconds a character; by the text's length it may say nothing (11), whisper (7) or break off (5)."""

    careful = False

    def speak(self, text: str, language: str | None, rate: int) -> np.ndarray:
        n, loud = len(text) * (rate * 6 // 100), 1000
        if len(text) % 11 == 0:
            n = 0
        elif not self.careful and len(text) % 7 == 0:
            loud = 40
        elif not self.careful and len(text) % 5 == 0:
            n = rate // 25
        return np.where(np.arange(n) % 2, -loud, loud).astype(np.int16)


class CarefulTone(Tone):
    """Stand-in: the same without whispering and breaking off."""

    careful = True


def spoken(pieces: DataFrame, factory: Callable[[], Synthesizer], language: str | None, rate: int) -> DataFrame:
    """Adds samples and error to pieces(text). A worker creates a model when its first piece comes, and passes on what is spoken at READY samples."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields), "samples array<short>", "error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            first, out, errors, waiting = 0, [], [], 0
            for i, t in enumerate(b.column("text").to_pylist()):
                try:
                    model = model or factory()
                    out.append(np.asarray(model.speak(t, language, rate), np.int16))
                    errors.append(None)
                except Exception as e:  # a piece that fails is spoken again; its error stays if that fails too
                    out.append(np.zeros(0, np.int16))
                    errors.append(f"{type(e).__name__}: {e}")
                waiting += len(out[-1])
                if waiting >= READY or i == b.num_rows - 1:
                    samples = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)], dtype=np.int32)), pa.array(np.concatenate(out)))
                    yield pa.RecordBatch.from_arrays([*b.slice(first, len(out)).columns, samples, pa.array(errors, pa.string())], names=[*b.schema.names, "samples", "error"])
                    first, out, errors, waiting = i + 1, [], [], 0

    return pieces.mapInArrow(run, schema)


def heard(df: DataFrame, rate: int) -> DataFrame:
    """Adds produced, rms and retry to df(samples, target)."""
    return audio.retry(df.withColumns({"produced": F.size("samples") / F.lit(float(rate)), "rms": audio.peak_rms("samples")})).drop("too_short", "too_quiet")


def voices(segments: DataFrame, first: Callable[[], Synthesizer], again: Callable[[], Synthesizer] | None, language: str | None = None, rate: int = 24000, limit: int = 80) -> DataFrame:
    """video, seg_idx, start, end, target, piece, text, samples, error, produced, rms, retry, attempts: a row for each piece of segments(video, seg_idx, start, end, text).

    Pieces that come out too short or too quiet for their segment are spoken by again, which stays the result; retry then says that this isn't heard either."""
    begin = F.coalesce("start", F.lit(0.0))
    timed = segments.filter(strip("text") != "").select("video", "seg_idx", begin.alias("start"), F.coalesce("end", begin).alias("end"), squeeze("text").alias("text"))
    timed = timed.withColumn("target", F.greatest(F.lit(0.05), F.col("end") - F.col("start")))
    cut = chunking.in_pieces(timed, lambda t: [(x,) for x in chunking.speakable(t, limit) or [t]], ["text"], {"text": "string"})
    cut = cut.select("video", "seg_idx", "start", "end", "target", F.col("chunk_idx").alias("piece"), "text")
    tried = stored(heard(spoken(cut, first, language, rate), rate).withColumn("attempts", F.lit(1)), "voices")
    if again is None:
        return tried
    left = tried.filter("retry").select(*cut.columns)
    second = stored(heard(spoken(left, again, language, rate), rate).withColumn("attempts", F.lit(2)), "voices-again")
    return tried.filter(~F.col("retry")).unionByName(second)


def stretched(samples: Column, speed: Column) -> Column:
    """Stand-in for a time stretch: the samples at every speed-th place."""
    n = F.floor(F.size(samples) / speed).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(samples, F.floor(i * speed).cast("int")))).otherwise(samples)


def whole(pieces: DataFrame, rate: int, locked: bool = True, fade: int = 30, exact: bool = True, **speeds: float) -> DataFrame:
    """video, seg_idx, start, end, target, attempts, produced (seconds before they are fitted), samples: pieces joined to segments.

    locked: a segment that isn't as long as its slot is stretched within speeds, and then cut or filled up to it. exact=False does the latter only where the stretch leaves more than the tolerance."""
    tolerance = speeds.get("tolerance", 0.06)
    n = int(rate * fade / 1000)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("piece", "samples"))), lambda x: x["samples"])
    out = pieces.groupBy("video", "seg_idx", "start", "end", "target").agg(F.max("attempts").alias("attempts"), rows.alias("_r"))
    out = out.withColumn("samples", F.aggregate(F.slice("_r", F.lit(2), F.size("_r")), F.element_at("_r", 1), lambda a, x: audio.crossfade(a, x, n))).drop("_r")
    out = out.withColumn("produced", F.size("samples") / F.lit(float(rate)))
    if not locked:
        return out
    plan = audio.duration_plan(out, exact=exact, **speeds)
    plan = plan.withColumn("_s", F.when(F.col("stretch") & (F.col("produced") > 0), stretched(F.col("samples"), F.col("speed"))).otherwise(F.col("samples")))
    fits = F.lit(exact) | (F.col("stretch") & (F.abs(F.size("_s") / F.lit(float(rate)) - F.col("target")) > tolerance))
    slot = F.floor(F.col("target") * rate + 0.5).cast("int")
    return plan.withColumn("samples", F.when((F.col("produced") > 0) & fits, audio.fit("_s", slot)).otherwise(F.col("_s"))).select(*out.columns)


def schedule(lengths: DataFrame, rate: int, locked: bool = True, fade: int = 30) -> DataFrame:
    """video, seg_idx, part (0 silence, 1 speech), length, fade, at (all in samples): the parts of each video's track, for lengths(video, seg_idx, start, end, n).

    The time before a segment is the end of the last one that has sound (locked: of its slot), or the start of a later one without sound. A part fades into what is before it
    where both are longer than the fade, which shortens the track; so a place is a sum over all parts before."""
    in_order = Window.partitionBy("video").orderBy("seg_idx")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    sounds = F.col("n") > 0
    ends = F.col("end") if locked else F.col("start") + F.col("n") / F.lit(float(rate))
    df = lengths.withColumns({"_epoch": F.sum(sounds.cast("int")).over(so_far), "_to": F.when(sounds, ends).otherwise(F.col("start"))})
    since = Window.partitionBy("video", "_epoch").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.max("_to").over(since)
    df = df.withColumn("_cursor", F.when(F.col("_epoch") == 0, F.greatest(F.lit(0.0), reached)).otherwise(reached))
    df = df.withColumn("_gap", F.greatest(F.lit(0.0), F.col("start") - F.coalesce(F.lag("_cursor").over(in_order), F.lit(0.0))))
    quiet = F.floor(F.col("_gap") * rate + 0.5).cast("long")
    parts = df.select("video", "seg_idx", F.posexplode(F.array(quiet, F.col("n").cast("long"))).alias("part", "length")).filter("length > 0")
    k = int(rate * fade / 1000)
    each = Window.partitionBy("video").orderBy("seg_idx", "part").rowsBetween(Window.unboundedPreceding, -1)
    # what is joined so far is longer than the fade just if the plain sum is: before that no join has faded
    long = F.coalesce(F.sum("length").over(each), F.lit(0)) > k
    parts = parts.withColumn("fade", F.when(long & (F.col("length") > k), k).otherwise(0))
    before = F.coalesce(F.sum(F.col("length") - F.col("fade")).over(each), F.lit(0))
    return parts.withColumn("at", before - F.col("fade"))


def track(parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """video, block, samples: the track in blocks of so many samples (the last is shorter), for the parts of a schedule with their samples, null for silence.

    A block is in one task, which has only the samples that lie in it and lays one block after the other; parts are laid in order, each faded over what is there, as joining them one after the other does."""
    last = F.floor((F.col("at") + F.col("length") - 1) / block)
    df = parts.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), last)))
    low, high = F.greatest("at", F.col("block") * block), F.least(F.col("at") + F.col("length"), (F.col("block") + 1) * block)
    inside = F.slice("samples", (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))
    df = df.select("video", "block", "seg_idx", "part", "fade", (low - F.col("at")).alias("skip"), (low - F.col("block") * block).alias("first"), (high - low).alias("n"), inside.alias("samples"))
    kind = parts.schema["video"].dataType.simpleString()

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, end, ready, waiting = None, np.zeros(0, np.int16), 0, [], 0

        def emitted(video: pa.DataType) -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(x) for _, x in ready)], dtype=np.int32)
            samples = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x for _, x in ready])))
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in ready], video), pa.array([k[1] for k, _ in ready], pa.int64()), samples], names=["video", "block", "samples"])

        for b in batches:
            sound = b.column("samples")
            heard, starts, values = sound.is_valid().to_numpy(zero_copy_only=False).tolist(), sound.offsets.to_numpy().tolist(), sound.values.to_numpy(zero_copy_only=False)
            numbers = (b.column(x).to_numpy().tolist() for x in ("fade", "skip", "first", "n"))
            for video, at, given, start, fade, skip, first, n in zip(b.column("video").to_pylist(), b.column("block").to_pylist(), heard, starts, *numbers):
                if (video, at) != key:
                    if key is not None:
                        ready.append((key, out[:end]))
                        waiting += end
                    if waiting >= READY:
                        yield emitted(b.schema.field("video").type)
                        ready, waiting = [], 0
                    key, out, end = (video, at), np.zeros(block, np.int16), 0
                m = min(n, max(0, fade - skip))
                if m > 0:
                    share = np.arange(skip, skip + m) / (fade - 1) if fade > 1 else np.zeros(m)
                    out[first : first + m] = np.trunc(out[first : first + m] * (1 - share) + (values[start : start + m] if given else 0) * share)
                out[first + m : first + n] = values[start + m : start + n] if given else 0
                end = max(end, first + n)
        if key is not None:
            ready.append((key, out[:end]))
            yield emitted(b.schema.field("video").type)

    # sorted in each task, so a block's rows follow each other there; one call for each of the many blocks would cost more than the samples
    together = df.repartition("video", "block").sortWithinPartitions("video", "block", "seg_idx", "part")
    return together.mapInArrow(lay, f"video {kind}, block long, samples array<short>")


def timed(pieces: DataFrame, rate: int = 24000, locked: bool = True, fade: int = 30, block: int = BLOCK, exact: bool = True, **speeds: float) -> tuple[DataFrame, DataFrame]:
    """(plan, track) of voices: plan has video, seg_idx, start, attempts, produced, n (samples of the segment), silence, at (samples before it, and where it begins, null without sound); track the blocks."""
    done = stored(whole(pieces, rate, locked, min(30, fade), exact, **speeds).withColumn("n", F.size("samples")), "spoken")  # so that only the track reads samples
    lengths = done.select("video", "seg_idx", "start", "end", "n")
    parts = stored(schedule(lengths, rate, locked, fade), "schedule")
    key = ["video", "seg_idx"]
    placed = parts.groupBy(*key).agg(F.sum(F.when(F.col("part") == 0, F.col("length"))).alias("_q"), F.max(F.when(F.col("part") == 1, F.col("at"))).alias("at"))
    plan = done.select(*key, "start", "attempts", "produced", "n").join(placed, key, "left").select(*key, "start", "attempts", "produced", "n", F.coalesce("_q", F.lit(0)).alias("silence"), "at")
    sound = done.select(*key, F.lit(1).alias("part"), "samples")
    return plan, track(parts.join(sound, [*key, "part"], "left"), block)
