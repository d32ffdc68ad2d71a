"""Operators on timed segments: rows of a video, with seg_idx, start, end (seconds) and text.

What looks at neighbours is a window over (video, seg_idx), so it is one shuffle by video; what looks at a row alone is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import B, S, W, let, sentences, squash, squeeze, strip, text, word_count, words
from ..sources.staged import sorted_in

ORDER = ("video", "seg_idx")


def ordered(video: str = "video", *by: str) -> Window:
    return Window.partitionBy(video).orderBy(*(by or ("seg_idx",)))


def fix_timestamps(df: DataFrame, compat: bool = False) -> DataFrame:
    """Swaps inverted times, lengthens segments that are too short for their words, and adds duration and words_per_second.

    words_per_second is that before the last lengthening. compat: keeps only the columns that identify and time a segment."""
    start, end = F.coalesce("start", F.lit(0.0)), F.coalesce("end", "start", F.lit(0.0))
    out = df.withColumns({"_a": F.least(start, end), "_b": F.greatest(start, end), "_w": word_count("text")})
    long = F.greatest(F.lit(0.5), F.col("_w") / 8.0)
    out = out.withColumn("_d", F.when(F.col("_b") - F.col("_a") < 0.5, long).otherwise(F.col("_b") - F.col("_a")))
    out = out.withColumn("_e", F.when(F.col("_b") - F.col("_a") < 0.5, F.col("_a") + long).otherwise(F.col("_b")))
    rate = F.when(F.col("_d") > 0, F.col("_w") / F.col("_d")).otherwise(0.0)
    out = out.withColumns({"words_per_second": rate, "_e": F.when(rate > 8, F.col("_a") + F.col("_w") / 4.0).otherwise(F.col("_e"))})
    out = out.withColumns({"start": F.col("_a"), "end": F.col("_e"), "text": text("text"), "duration": F.col("_e") - F.col("_a")}).drop("_a", "_b", "_w", "_d", "_e")
    return out.select(*ORDER, "start", "end", "text", "duration", "words_per_second") if compat else out


def renumbered(df: DataFrame) -> DataFrame:
    """Segments, and the parts of split ones, numbered anew in each video."""
    by = ["seg_idx", *(["part_idx"] if "part_idx" in df.columns else [])]
    return df.withColumn("seg_idx", (F.row_number().over(ordered("video", *by)) - 1).cast("int")).drop("part_idx")


def gaps(df: DataFrame, large: float = 3.0) -> DataFrame:
    """Adds gap, the time since the previous segment's end (null for the first), and large_gap."""
    gap = F.col("start") - F.lag("end").over(ordered())
    return df.withColumn("gap", gap).withColumn("large_gap", F.coalesce(F.col("gap") > large, F.lit(False)))


def refinable_gaps(df: DataFrame, least: float = 2.5, most: float = 15.0, first: int = 6, margin: float = 0.05) -> DataFrame:
    """The first so many gaps of each video worth listening to again, with the clip to cut."""
    before = df.withColumn("prev_end", F.coalesce(F.lag("end").over(ordered()), F.lit(None).cast("double")))
    found = before.filter((F.col("start") - F.col("prev_end")).between(least, most))
    found = found.withColumn("gap_no", F.row_number().over(ordered())).filter(F.col("gap_no") <= first)
    a = F.greatest(F.lit(0.0), F.col("prev_end") + margin)
    return found.select(*ORDER, "gap_no", "prev_end", F.col("start").alias("next_start"), a.alias("clip_start"), F.greatest(a + 0.10, F.col("start") - margin).alias("clip_end"))


def keep_recovered(df: DataFrame) -> DataFrame:
    """Of segments recovered in gaps those with text after squashing and 0.2 seconds or more."""
    return df.withColumn("text", squash("text")).filter((F.col("text") != "") & (F.col("end") - F.col("start") >= 0.20))


def merge_gaps(df: DataFrame, recovered: DataFrame) -> DataFrame:
    """Segments and recovered ones in order of time, fixed and split again."""
    both = df.unionByName(recovered.withColumn("gap_refined", F.lit(True)), allowMissingColumns=True)
    both = both.withColumn("seg_idx", F.row_number().over(ordered("video", "start", "end", F.col("seg_idx").asc_nulls_last())) - 1)
    return split_overlong(fix_timestamps(both))


def parts_of(c: Column | str) -> Column:
    """A text's sentences; of a single one its halves by words, if it has eight."""
    t = strip(c)

    def halves(w: Column) -> Column:
        half = F.floor(F.size(w) / 2).cast("int")
        return F.when(F.size(w) >= 8, F.array(F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, F.size(w)), " "))).otherwise(F.array(t))

    return let(sentences(t, ".!?।"), lambda p: F.when(F.size(p) >= 2, p).otherwise(let(words(t), halves)))


def split_overlong(df: DataFrame, most: float = 15.0, recompute: bool = True) -> DataFrame:
    """Splits segments longer than most at sentences, or by halves; time goes by characters. Adds part_idx.

    recompute: duration and words_per_second, where there, are those of the parts and not of the whole."""
    t, most = strip("text"), max(2.0, most)
    out = df.withColumn("_p", F.when((F.col("end") - F.col("start") > most) & (t != ""), parts_of("text")).otherwise(F.array(F.col("text"))))
    size = lambda x: F.greatest(F.lit(1), F.length(x))
    start, end = F.col("start"), F.col("end")
    total = F.aggregate("_p", F.lit(0), lambda a, x: a + size(x))
    timed = F.transform("_p", lambda x, i: F.struct(x.alias("text"), F.aggregate(F.slice("_p", F.lit(1), i), F.lit(0), lambda a, y: a + size(y)).alias("before"), size(x).alias("n")))
    out = out.withColumns({"_n": F.size("_p"), "_t": total}).select("*", F.posexplode(timed).alias("part_idx", "_x"))
    at = lambda n: F.when(n == F.col("_t"), end).otherwise(F.least(end, start + (end - start) * n / F.col("_t")))
    done = F.col("_x.before")
    a, b = F.when((F.col("_n") == 1) | (done == 0), start).otherwise(at(done)), F.when(F.col("_n") == 1, end).otherwise(at(done + F.col("_x.n")))
    out = out.withColumns({"_a": a, "_b": b}).withColumns({"start": F.col("_a"), "end": F.col("_b"), "text": F.col("_x.text")})
    if recompute and "duration" in df.columns:
        split, length = F.col("_n") > 1, F.col("end") - F.col("start")
        out = out.withColumns({"duration": F.when(split, length).otherwise(F.col("duration")), "words_per_second": F.when(split, F.coalesce(F.try_divide(word_count("text"), length), F.lit(0.0))).otherwise(F.col("words_per_second"))})
    return out.drop("_p", "_n", "_t", "_x", "_a", "_b")


def is_music(c: Column | str, length: Column) -> Column:
    """Few words for the time, or signs of music, or a word three times in a row."""
    t = text(c)
    few = (length > 2) & (F.coalesce(F.try_divide(word_count(c), length), F.lit(1.0)) < 0.3)
    return few | t.rlike(rf"(?iu){B}(music|instrumental|bgm|background){B}") | t.rlike("[♪♫]") | t.rlike(rf"(?iu)([{W}]+){S}+\1{S}+\1")


def flag_music(df: DataFrame) -> DataFrame:
    """Adds is_suspicious and suspicion_reason."""
    found = is_music("text", F.coalesce("end", F.lit(0.0)) - F.coalesce("start", F.lit(0.0)))
    return df.withColumn("is_suspicious", found).withColumn("suspicion_reason", F.when(F.col("is_suspicious"), "music_or_noise"))


def music_heavy(df: DataFrame, most: float = 0.3) -> DataFrame:
    """video, segments, suspicious, music_ratio, music_heavy."""
    out = df.groupBy("video").agg(F.count("*").alias("segments"), F.count_if("is_suspicious").alias("suspicious"))
    return out.withColumn("music_ratio", F.col("suspicious") / F.col("segments")).withColumn("music_heavy", F.col("music_ratio") > most)


def skip_suspicious(df: DataFrame, most: float = 0.25) -> DataFrame:
    """Drops empty segments, and suspicious ones of videos of which they are no larger share than most."""
    flag = F.coalesce("is_suspicious", F.lit(False))
    share = F.avg(flag.cast("int")).over(Window.partitionBy("video"))
    return df.withColumn("_s", share).filter(~flag | (F.col("_s") > most)).filter(strip("text") != "").drop("_s")


def low_confidence(df: DataFrame, least: float = -1.1, first: int = 8) -> DataFrame:
    """The first so many segments of each video with a low log probability or a flag."""
    low = (F.coalesce("avg_logprob", F.lit(0.0)) < least) | F.coalesce("is_suspicious", F.lit(False))
    return df.filter(low).withColumn("candidate_no", F.row_number().over(ordered())).filter(F.col("candidate_no") <= first)


def accept_refinement(original: Column | str, refined: Column | str) -> Column:
    """The refined text, unless it is empty or much shorter than the original."""
    new = strip(refined)
    return F.when((new != "") & (F.length(new) >= F.greatest(F.lit(6), F.floor(F.length(strip(original)) / 3))), new).otherwise(text(original))


def confidence_summary(df: DataFrame, least: float = -1.1) -> DataFrame:
    """video, segments, avg_logprob (0 without any), low_confidence_segments."""
    return df.groupBy("video").agg(F.count("*").alias("segments"), F.coalesce(F.avg("avg_logprob"), F.lit(0.0)).alias("avg_logprob"), F.count_if(F.col("avg_logprob") < least).alias("low_confidence_segments"))


def joined_texts() -> Column:
    """A group's texts in order, empty ones skipped."""
    items = F.sort_array(F.collect_list(F.struct("seg_idx", strip("text").alias("t"))))
    return F.array_join(F.filter(F.transform(items, lambda x: x["t"]), lambda x: x != ""), " ")


def transcript(df: DataFrame) -> DataFrame:
    """video, text: the segments' texts in order, empty ones skipped."""
    return df.groupBy("video").agg(joined_texts().alias("text"))


def anchored_chunks(df: DataFrame, most: float = 300.0) -> DataFrame:
    """Adds chunk_id: a new chunk begins where a start is more than most after that of the chunk's first segment.

    The anchor moves with the data, so no fixed or session window is the same; each video is folded in order, once. A fold reads one
    video's starts and carries two numbers; chunk numbers of its segments come back as one array."""
    starts = df.groupBy("video").agg(F.sort_array(F.collect_list(F.struct("seg_idx", F.coalesce("start", F.lit(0.0)).alias("start")))).alias("_s"))
    first = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<struct<from:int,chunk:int>>").alias("cuts"))

    # only where a chunk begins is kept, so the fold's state grows with chunks and not with segments
    def step(a: Column, x: Column) -> Column:
        new = a["anchor"].isNull() | (x["start"] - a["anchor"] > most)
        cut = F.struct(x["seg_idx"].cast("int").alias("from"), F.size(a["cuts"]).alias("chunk"))
        return F.when(new, F.struct(x["start"].alias("anchor"), F.concat(a["cuts"], F.array(cut)).alias("cuts"))).otherwise(a)

    cuts = starts.select("video", F.explode(F.aggregate("_s", first, step, lambda a: a["cuts"])).alias("_c")).select("video", F.col("_c.from").alias("seg_idx"), F.col("_c.chunk").alias("_chunk"))
    marked = df.join(sorted_in(cuts), ["video", "seg_idx"], "left")
    return marked.withColumn("chunk_id", F.max("_chunk").over(ordered().rowsBetween(Window.unboundedPreceding, 0))).drop("_chunk")


def normalize_chunks(df: DataFrame) -> DataFrame:
    """Adds chunk_start and chunk_end, those of a chunk's first and last segment, and makes start and end relative."""
    whole = Window.partitionBy("video", "chunk_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumns({"chunk_start": F.first("start").over(whole), "chunk_end": F.last(F.coalesce("end", "start")).over(whole)})
    start = F.greatest(F.lit(0.0), F.coalesce("start", "chunk_start") - F.col("chunk_start"))
    return out.withColumns({"start": start, "end": F.greatest(start, F.coalesce("end", "start", "chunk_start") - F.col("chunk_start"))})


def chunk_silence(df: DataFrame, least: float = 0.03) -> DataFrame:
    """A row per chunk of video, chunk_id, chunk_start, chunk_end, produced with the silence before it; only produced chunks move the cursor."""
    before = Window.partitionBy("video").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("produced"), F.col("chunk_end"))).over(before), F.lit(0.0)))
    gap = F.greatest(F.lit(0.0), F.col("chunk_start") - cursor)
    return df.withColumn("silence", F.when(gap > least, gap).otherwise(0.0))


def segment_silence(df: DataFrame) -> DataFrame:
    """Adds the silence before each segment when durations are locked: since the previous segment that has text."""
    kept = df.filter(strip("text") != "")
    cursor = F.coalesce(F.lag("end").over(ordered()), F.lit(0.0))
    return kept.withColumn("silence", F.greatest(F.lit(0.0), F.col("start") - cursor))


def estimate_timings(df: DataFrame, duration: str = "duration") -> DataFrame:
    """video, seg_idx, start, end, text, estimated: a text's sentences timed by their share of words. Rows without text or time yield none."""
    d, total = F.col(duration), F.aggregate("_w", F.lit(0), lambda a, x: a + x)
    out = df.filter(d > 0).withColumn("_s", sentences(squeeze("text"))).withColumn("_w", F.transform("_s", lambda s: F.greatest(F.lit(1), word_count(s))))
    step = lambda w: F.greatest(F.lit(0.05), w / F.col("_t") * d)
    out = out.withColumn("_t", total).withColumn("_d", F.transform("_w", step))
    # ends are capped at the duration; a capped running sum is the same as the cap of the sum
    ran = lambda k: F.least(d, F.aggregate(F.slice("_d", F.lit(1), k), F.lit(0.0), lambda a, x: a + x))
    rows = F.transform("_s", lambda s, i: F.struct(s.alias("text"), F.round(ran(i), 3).alias("start"), F.when(i == F.size("_s") - 1, F.round(d, 3)).otherwise(F.round(ran(i + 1), 3)).alias("end")))
    return out.select("video", F.posexplode(rows).alias("seg_idx", "_x")).select("video", "seg_idx", "_x.start", "_x.end", "_x.text", F.lit(True).alias("estimated"))


def attach_texts(df: DataFrame, texts: DataFrame) -> DataFrame:
    """df with the texts of texts(video, seg_idx, text), by order within a video; what either has more of is left out."""
    number = lambda d: d.withColumn("_n", F.row_number().over(ordered()))
    other = number(texts).select("video", "_n", F.col("text").alias("_t"))
    return number(df).join(other, ["video", "_n"]).withColumn("text", F.col("_t")).drop("_n", "_t")


def assign_speakers(df: DataFrame, turns: DataFrame, bin_seconds: float = 30.0, default: str = "spk_00") -> DataFrame:
    """Adds speaker_id: the speaker of turns(video, speaker, start, end) who overlaps a segment longest, of equal ones, to a microsecond, the first by name.

    An interval join on the bins that both lie in, so only neighbours in time meet; overlaps are counted in the bin where they begin."""
    span = lambda: F.explode(F.sequence(F.floor(F.col("start") / bin_seconds), F.floor(F.greatest("start", "end") / bin_seconds))).alias("_bin")
    a = df.select("video", "seg_idx", "start", "end", span())
    b = turns.select("video", "speaker", F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.floor(F.col("start") / bin_seconds), F.floor(F.greatest("start", "end") / bin_seconds))).alias("_bin"))
    both = a.join(b, ["video", "_bin"]).filter((F.col("start") < F.col("e")) & (F.col("s") < F.col("end")))
    both = both.filter(F.floor(F.greatest("start", "s") / bin_seconds) == F.col("_bin"))
    shared = both.groupBy("video", "seg_idx", "speaker").agg(F.round(F.sum(F.least("end", "e") - F.greatest("start", "s")), 6).alias("o"))
    best = shared.groupBy("video", "seg_idx").agg(F.min(F.struct(-F.col("o"), "speaker")).alias("b")).select("video", "seg_idx", F.col("b.speaker").alias("_sp"))
    return df.join(best, ["video", "seg_idx"], "left").withColumn("speaker_id", F.coalesce("_sp", F.lit(default))).drop("_sp")
