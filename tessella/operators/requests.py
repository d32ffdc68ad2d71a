"""Texts packed into requests: greedy groups, in order, within budgets, for batches of any size.

A group that begins at a text takes all that follow while they fit, so where the next one begins depends on where this one does, and on nothing before it. Groups hold
MAX_ITEMS texts at most, so a block of texts can be entered at MAX_ITEMS places. Each block finds out for all of these where it is left and
after how many groups; blocks are then composed, a row for each, and told where they are entered. No task holds a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text
from ..sources.staged import sorted_in, stored

#: The mark between the texts of a request, and its budgets (fixed values).
DELIMITER, MARK = "\n###__SEGMENT_BOUNDARY__###\n", "###__SEGMENT_BOUNDARY__###"
MAX_CHARS, MAX_BYTES, MAX_ITEMS = 4000, 4200, 24
#: Texts of a block.
BLOCK = 1 << 15


def sendable(c: Column | str) -> Column:
    """A text as it is put into a request: without the mark, without white space around it."""
    return F.btrim(F.regexp_replace(F.replace(text(c), F.lit(MARK), F.lit(" ")), r"^[\t-\r\x1c-\x1f \x85\p{Z}]+|[\t-\r\x1c-\x1f \x85\p{Z}]+\z", ""))


def following(chars: np.ndarray, octets: np.ndarray, max_chars: int, max_bytes: int, max_items: int) -> np.ndarray:
    """For a group that begins at each text, where the next one begins."""
    at, more, end = np.arange(len(chars)), len(DELIMITER), np.full(len(chars), len(chars))
    for sizes, most in ((chars, max_chars), (octets, max_bytes)):
        total = np.concatenate([[0], np.cumsum(sizes + more)])
        end = np.minimum(end, np.searchsorted(total, total[:-1] + more + most, "right") - 1)
    return np.maximum(at + 1, np.minimum(end, at + max_items))


def numbered(df: DataFrame) -> DataFrame:
    """df(batch, item, ...) with n, the place of each row in its batch: sorted by ranges, and counted over these, a row a batch and range."""
    sort = stored(df.repartitionByRange("batch", "item").sortWithinPartitions("batch", "item").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "sorted")
    sizes = sort.groupBy("batch", "_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("batch").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("batch").alias("_b"), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"))
    return sort.join(sorted_in(starts), F.col("batch").eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_p"))).withColumn("n", F.col("_at") + F.col("_shift")).drop("_b", "_p", "_part", "_at", "_shift")


def pack_requests(df: DataFrame, max_chars: int = MAX_CHARS, max_bytes: int = MAX_BYTES, max_items: int = MAX_ITEMS, block: int = BLOCK) -> DataFrame:
    """batch, item, group_id, alone, chars, bytes for df(batch, item, text): groups of a batch's texts, in order of item, within the budgets of a request.

    Blank texts belong to no group; a text of max_chars or more goes alone; neither ends a group. An item that a batch has twice is two texts, in any order. A null batch is one batch."""
    if block < max_items:
        raise ValueError("a block holds at least a group")
    t = sendable("text")
    sized = df.select("batch", "item", F.length(t).alias("chars"), F.octet_length(t).alias("bytes"))
    fits = (F.col("chars") > 0) & (F.col("chars") < max_chars)
    rows = numbered(sized.filter(fits))
    # the first texts of a block also close the groups of that before it
    own = F.floor(F.col("n") / block)
    to = F.when((F.col("n") % block < max_items) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    rows = stored(rows.select("*", F.explode(to).alias("block")), "blocks")
    kind = df.schema["batch"].dataType.simpleString()

    def each(table: pa.Table) -> tuple[pa.Table, int, np.ndarray]:
        table = table.sort_by("n")
        begin = int(table.column("block")[0].as_py()) * block
        m = int((table.column("n").to_numpy() < begin + block).sum())  # of the block itself
        return table, m, following(table.column("chars").to_numpy().astype(np.int64), table.column("bytes").to_numpy().astype(np.int64), max_chars, max_bytes, max_items)

    def through(table: pa.Table) -> pa.Table:
        table, m, after = each(table)
        left, groups = np.arange(len(after) + 1), np.zeros(len(after) + 1, np.int64)
        for i in range(m - 1, -1, -1):
            left[i], groups[i] = left[after[i]], groups[after[i]] + 1
        entered = np.minimum(np.arange(max_items), m)
        return pa.table({"batch": table.column("batch").slice(0, 1), "block": table.column("block").slice(0, 1), "left": pa.array([(left[entered] - m).tolist()]), "groups": pa.array([groups[entered].tolist()])})

    def composed(table: pa.Table) -> pa.Table:
        table, at, n, entry, first = table.sort_by("block"), 0, 0, [], []
        for left, groups in zip(table.column("left").to_pylist(), table.column("groups").to_pylist()):
            entry.append(at)
            first.append(n)
            at, n = left[at], n + groups[at]
        return pa.table({"_b": table.column("batch"), "_k": table.column("block"), "entry": pa.array(entry, pa.int32()), "first": pa.array(first, pa.int64())})

    def grouped(table: pa.Table) -> pa.Table:
        table, m, after = each(table)
        i, g, out = int(table.column("entry")[0].as_py()), int(table.column("first")[0].as_py()), np.full(m, -1, np.int64)
        out[:i] = g - 1  # of the group that the block before has begun
        while i < m:
            out[i : after[i]] = g
            i, g = int(after[i]), g + 1
        return table.select(["batch", "item", "chars", "bytes"]).slice(0, m).append_column("group_id", pa.array(out))

    blocks = stored(rows.groupBy("batch", "block").applyInArrow(through, f"batch {kind}, block long, left array<long>, groups array<long>"), "through")
    entries = blocks.groupBy("batch").applyInArrow(composed, f"_b {kind}, _k long, entry int, first long")
    item = df.schema["item"].dataType.simpleString()
    told = rows.join(sorted_in(entries), F.col("batch").eqNullSafe(F.col("_b")) & (F.col("block") == F.col("_k"))).drop("_b", "_k")
    out = told.groupBy("batch", "block").applyInArrow(grouped, f"batch {kind}, item {item}, chars int, bytes int, group_id long")
    rest = sized.filter(~fits).select("batch", "item", F.lit(None).cast("long").alias("group_id"), (F.col("chars") >= max_chars).alias("alone"), "chars", "bytes")
    return out.select("batch", "item", F.col("group_id").cast("int"), F.lit(False).alias("alone"), "chars", "bytes").unionByName(rest.withColumn("group_id", F.col("group_id").cast("int")))
