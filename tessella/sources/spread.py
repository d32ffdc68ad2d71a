"""Work for all cores where a table lies in fewer row groups than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of a usual Parquet row group, which only one task can read.
ROW_GROUP = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, just read, dealt over all cores if its few files can't hold a row group for each; larger tables stay as they are.

    A scan's tasks are splits of files, but a row group goes to one of them alone, so a small table of long texts would keep one core busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df._jdf.inputFiles()) >= cores:  # counted where Spark has listed them
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * ROW_GROUP else df
