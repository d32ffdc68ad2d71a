"""Tables between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table whose rows were counted is broadcast.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Only a session on one machine may leave it out: it gets one under /tmp."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return "file:///tmp/tessella-shared"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage ends there, so lost executors lose nothing of it.

    The tables of an application lie together under its id and can be deleted when it has ended."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def sorted_in(df: DataFrame) -> DataFrame:
    """df, to be joined by sorting: Spark would broadcast it by the size of its compressed files, of which rows in the driver can be many times as large."""
    return df.hint("merge")


def few_or_sorted(df: DataFrame, row_bytes: int) -> DataFrame:
    """A stored df, broadcast if its counted rows of at most about row_bytes are within BROADCAST_BYTES, else to be joined by sorting."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else sorted_in(df)
