"""Arithmetic on audio: samples are arrays of 16-bit numbers, plans are columns."""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, let

BLOCK = 8192


def wav_info(content: Column | str) -> Column:
    """struct(duration, rate, channels, samples) of WAV bytes; samples of 16-bit audio, interleaved. What can't be read has duration 0."""

    @F.pandas_udf("duration double, rate int, channels int, samples array<short>")
    def read(files: pd.Series) -> pd.DataFrame:
        import numpy as np

        rows = []
        for b in files:
            try:
                with wave.open(io.BytesIO(b)) as w:
                    n, rate = w.getnframes(), w.getframerate()
                    data = np.frombuffer(w.readframes(n), np.int16) if w.getsampwidth() == 2 else None
                    rows.append((n / rate if rate else 0.0, rate, w.getnchannels(), data))
            except Exception:  # not a WAV file
                rows.append((0.0, None, None, None))
        return pd.DataFrame(rows, columns=["duration", "rate", "channels", "samples"])

    return read(col(content))


def wav_bytes(samples: Column | str, rate: int = 24000, channels: int = 1) -> Column:
    """WAV bytes of 16-bit samples."""

    @F.pandas_udf("binary")
    def write(s: pd.Series) -> pd.Series:
        import numpy as np

        def one(x) -> bytes:
            out = io.BytesIO()
            with wave.open(out, "wb") as w:
                w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
                w.writeframes(np.asarray(x if x is not None else [], np.int16).tobytes())
            return out.getvalue()

        return s.map(one)

    return write(col(samples))


def peak_rms(samples: Column | str, block: int = BLOCK) -> Column:
    """The largest root mean square, rounded down, of blocks of so many samples; 0 of none."""
    s = col(samples)
    starts = F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s), F.lit(block))).otherwise(F.array().cast("array<int>"))
    rms = lambda b: F.floor(F.sqrt(F.aggregate(b, F.lit(0.0), lambda a, x: a + x.cast("double") * x) / F.size(b)))
    return F.coalesce(F.array_max(F.transform(starts, lambda i: rms(F.slice(s, i, block)))), F.lit(0)).cast("double")


def clip(samples: Column | str, rate: int, start, end) -> Column:
    """Samples from start to end in seconds, at least 0.05 of them."""
    a, b = col(start), col(end)
    return F.slice(col(samples), (F.floor(F.greatest(F.lit(0.0), a) * rate) + 1).cast("int"), F.round(F.greatest(F.lit(0.05), b - a) * rate).cast("int"))


def reference_clip(samples: Column | str, rate: int, most: float = 6.0) -> Column:
    """The first so many seconds, or all if they are fewer."""
    return F.slice(col(samples), 1, int(rate * most))


def silence(seconds: Column | str, rate: int = 24000) -> Column:
    return F.array_repeat(F.lit(0).cast("short"), F.round(F.greatest(F.lit(0.0), col(seconds)) * rate).cast("int"))


def crossfade(a: Column | str, b: Column | str, n: int) -> Column:
    """a then b with n samples faded into each other, if both are longer; values are cut off towards zero."""
    a, b = col(a), col(b)
    plain = F.concat(a, b)
    if n <= 0:
        return plain
    share = lambda i: i.cast("double") / (n - 1) if n > 1 else F.lit(0.0)
    tail, head = F.slice(a, F.size(a) - n + 1, F.lit(n)), F.slice(b, 1, n)
    mixed = F.transform(F.arrays_zip(tail.alias("x"), head.alias("y")), lambda p, i: (p["x"] * (1 - share(i)) + p["y"] * share(i)).cast("int").cast("short"))
    return F.when((F.size(a) > n) & (F.size(b) > n), F.concat(F.slice(a, F.lit(1), F.size(a) - n), mixed, F.slice(b, F.lit(n + 1), F.size(b)))).otherwise(plain)


def joined_length(lengths: Column | str, n: int) -> Column:
    """Samples of parts joined in order by crossfades of n: each join that fades shortens by n."""
    step = lambda a, x: F.when((F.lit(n) > 0) & (a > n) & (x > n), a + x - n).otherwise(a + x)
    return F.aggregate(F.slice(col(lengths), F.lit(2), F.size(col(lengths))), F.element_at(col(lengths), 1).cast("long"), step)


def fit(samples: Column | str, n: Column | str) -> Column:
    """Exactly n samples, by cutting or silence; unchanged for n of 0 or less."""
    s, n = col(samples), col(n)
    return F.when(n <= 0, s).otherwise(F.concat(F.slice(s, F.lit(1), F.greatest(n, F.lit(0))), F.array_repeat(F.lit(0).cast("short"), F.greatest(n - F.size(s), F.lit(0)))))


def gain(samples: Column | str, db: float, limit: float = 0.95) -> Column:
    """Samples amplified by db, within limit of full scale."""
    top = int(limit * 32767)
    return F.transform(col(samples), lambda x: F.greatest(F.lit(-top), F.least(F.lit(top), (x * 10 ** (db / 20)).cast("int"))).cast("short"))


def stretch_factors(speed: Column | str) -> Column:
    """Factors from 0.5 to 2 whose product is speed; none if it is within 0.05 of 1 or not positive."""
    s = col(speed)
    many = F.greatest(F.lit(0), F.when(s > 2, F.ceil(F.log2(s)) - 1).when(s < 0.5, F.ceil(-F.log2(s)) - 1).otherwise(0)).cast("int")
    one = F.when(s > 2, 2.0).otherwise(0.5)
    factors = let(F.struct(many.alias("k"), one.alias("f")), lambda x: F.concat(F.array_repeat(x["f"], x["k"]), F.array(s / F.pow(x["f"], x["k"]))))
    return F.when((s <= 0) | (F.abs(s - 1) < 0.05), F.array().cast("array<double>")).otherwise(factors)


def duration_plan(df: DataFrame, slowest: float = 0.80, fastest: float = 1.25, tolerance: float = 0.06, exact: bool = True) -> DataFrame:
    """Adds target, raw_speed, speed, stretch and exact_fit for df(start, end, produced): how a spoken segment is made to last as long as its slot."""
    low, high = min(slowest, fastest), max(slowest, fastest)
    out = df.withColumn("target", F.greatest(F.lit(0.05), F.col("end") - F.col("start"))).withColumn("raw_speed", F.col("produced") / F.col("target"))
    speed = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.greatest(F.lit(low), F.least(F.lit(high), F.col("raw_speed")))))
    return out.withColumns({"speed": speed, "stretch": F.abs(F.col("produced") - F.col("target")) > tolerance, "exact_fit": F.lit(exact)})


def pad_plan(df: DataFrame) -> DataFrame:
    """Adds pad, the seconds of silence that bring audio_seconds up to video_seconds."""
    return df.withColumn("pad", F.greatest(F.lit(0.0), F.col("video_seconds") - F.col("audio_seconds")))


def retry(df: DataFrame, quiet: float = 80.0) -> DataFrame:
    """Adds too_short, too_quiet and retry for df(produced, rms, target)."""
    short = F.col("produced") <= F.greatest(F.lit(0.05), F.least(F.lit(0.15), 0.15 * F.col("target")))
    low = (F.col("target") >= 0.20) & (F.col("rms") < quiet)
    return df.withColumns({"too_short": short, "too_quiet": low, "retry": short | low})
