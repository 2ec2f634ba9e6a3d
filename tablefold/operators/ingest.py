"""From raw rows to a version: one row a key, in key order, with offsets, blocks and content sums."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import row_sum, text_of
from ..functions.lineage import checkpointed
from .rowdiff import checked_key

#: Rows of a block (fixed value).
BLOCK_ROWS = 255


def one_per_key(df: DataFrame, pk: Sequence[str], drop_empty_keys: bool = False) -> DataFrame:
    """One row of each key: the first by all columns. Without a key, distinct rows.

    ``drop_empty_keys`` also drops rows whose key cells are all empty.
    """
    key = checked_key(df, pk)
    if drop_empty_keys:
        cells = [text_of(F.col(f"`{c}`"), df.schema[c].dataType) for c in key or df.columns]
        df = df.where(F.concat(*cells) != "")
    if not key:
        return df.dropDuplicates()
    # the least row of a key, as a struct, is partly aggregated before the shuffle, which a window would not be
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.dropDuplicates()
    least = df.groupBy(*(F.col(f"`{c}`") for c in key)).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("_row"))
    return least.select(*(F.col(f"`{c}`") if c in key else F.col(f"_row.`{c}`") for c in df.columns))


def numbered(df: DataFrame, order: Sequence[str], name: str = "row") -> DataFrame:
    """df with the 0-based position of each row in the order of ``order``, which should be a key.

    Rows are dealt by range, sorted in each range and kept with their place in
    it; only the ranges' counts are added up in one place. (A window over all
    rows would be one task.)
    """
    dealt = df.repartitionByRange(*(F.col(f"`{c}`") for c in order)).sortWithinPartitions(*(F.col(f"`{c}`") for c in order))
    kept = checkpointed(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row a range
    placed = kept.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_before") + within).cast("long").alias(name))


def blocks(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """df in key order with row, block and offset of each row."""
    rows = numbered(df, checked_key(df, pk) or df.columns)
    return rows.withColumn("block", F.floor(F.col("row") / BLOCK_ROWS)).withColumn("offset", F.col("row") % BLOCK_ROWS)


def block_sums(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """block, rows, sum (over its rows' sums in order) and the first key of each block, as text."""
    placed = blocks(df.withColumn("_sum", row_sum(df)), pk)
    first = F.array(*(text_of(F.col(f"`{c}`"), df.schema[c].dataType) for c in (pk or df.columns)))
    return placed.groupBy("block").agg(
        F.count("*").alias("rows"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "_sum"))), lambda x: x["_sum"]), "")).alias("sum"),
        F.array_join(F.min_by(first, "offset"), "|").alias("first_key"),
    )


def table_sum(df: DataFrame, pk: Sequence[str]) -> str:
    """The identity of a version: of its columns, key, and rows, in whatever order they came.

    Rows' sums are added as numbers of 128 bits in four parts, so that rows need
    no order; a version holds a key once, so equal sums mean equal rows.
    """
    sums = row_sum(df)
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring(sums, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    parts = [part(i).alias(f"p{i}") for i in range(4)]
    r = df.agg(F.count("*").alias("rows"), *parts).first()
    text = "|".join([*df.columns, "", *pk, "", str(r["rows"]), *(r[f"p{i}"] for i in range(4))])
    return hashlib.md5(text.encode()).hexdigest()


def duplicate_keys(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their number of rows."""
    return df.groupBy(*(F.col(f"`{c}`") for c in checked_key(df, pk) or df.columns)).agg(F.count("*").alias("rows")).where("rows > 1")


def rows_at(df: DataFrame, pk: Sequence[str], offsets: Sequence[int]) -> DataFrame:
    """The rows at the given positions in key order."""
    return numbered(df, checked_key(df, pk) or df.columns).where(F.col("row").isin(list(offsets)))


def block_range(df: DataFrame, pk: Sequence[str], start: int, end: int) -> DataFrame:
    """The rows of blocks start <= block < end."""
    return blocks(df, pk).where((F.col("block") >= start) & (F.col("block") < end))
