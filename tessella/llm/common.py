"""What several corpus operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staged import shared_dir, stored  # noqa: F401

#: The ASCII white space that separates words, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def release(spark: SparkSession) -> None:
    """Has the driver drop what it no longer refers to, so that Spark deletes the shuffle files of jobs that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(c: Column) -> Column:
    """c with A-Z, and nothing else, in lower case. On ASCII texts the much faster lower() is the same."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def space_words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of text as an array; null and blank texts have none."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE + "+")),
    )


#: Bytes up to which a table whose rows were counted is broadcast.
BROADCAST_BYTES = 32 << 20


def few(df: DataFrame, row_bytes: int) -> DataFrame:
    """A stored df, marked for broadcast if its counted rows of at most about row_bytes are within BROADCAST_BYTES; otherwise as it is, to be shuffled."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
