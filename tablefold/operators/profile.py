"""Column profiles of a table, and the difference of two profiles.

All figures come from one aggregate: the count of each value of each column,
partly aggregated before its shuffle. The table is unpivoted once, whatever
the number of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import parsed, round2, text_of
from ..functions.lineage import checkpointed

#: Most frequent values that a profile holds, step of its percentiles, and numbers that these need (fixed values).
TOP, STEP, LEAST = 20, 5, 20
#: Ranges of values in which running counts are made, for each column.
RANGES = 64


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, count) of all columns, values as text and nulls as ''."""
    cells = [F.struct(F.lit(c).alias("column"), text_of(F.col(f"`{c}`"), df.schema[c].dataType).alias("value")) for c in columns or df.columns]
    return df.select(F.explode(F.array(*cells)).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("count"))


def basic_stats(counts: DataFrame) -> DataFrame:
    """Counts, lengths in bytes, and numeric figures of each column; these are null unless every value is a number."""
    number, size, n = parsed(F.col("value")), F.octet_length("value"), F.col("count")
    figure = F.when(~F.isnan(number), number)  # nan is a number, of which nothing is reckoned
    filled = F.col("value") != ""
    some = counts.groupBy("column").agg(
        F.sum("count").alias("rows"),
        F.sum(F.when(filled, 0).otherwise(n)).alias("na_count"),
        F.sum(F.when(filled, n).otherwise(0)).alias("filled"),
        F.bool_and(F.when(filled, number.isNotNull())).alias("numeric"),
        F.min(figure).alias("min"),
        F.max(figure).alias("max"),
        F.sum(F.when(filled, figure * n)).alias("total"),
        F.coalesce(F.min(F.when(filled, size)), F.lit(0)).alias("min_str_len"),
        F.coalesce(F.max(size), F.lit(0)).alias("max_str_len"),
        F.sum(size * n).alias("bytes"),
    )
    numeric = F.coalesce("numeric", F.lit(False))
    return some.select(
        "column",
        "rows",
        "na_count",
        "filled",
        numeric.alias("numeric"),
        *(F.when(numeric, F.col(c)).alias(c) for c in ("min", "max")),
        F.when(numeric, round2(F.col("total") / F.col("filled"))).alias("mean"),
        F.col("min_str_len").cast("int"),
        F.col("max_str_len").cast("int"),
        F.when(F.col("filled") == 0, 0).otherwise(F.floor(F.col("bytes") / F.col("filled") + 0.5)).cast("int").alias("avg_str_len"),
    )


def deviations(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """(column, std_deviation): from the rounded mean, over all rows, missing ones among them."""
    some = stats.where("numeric").select("column", "mean", "rows")
    squares = counts.where("value <> ''").join(F.broadcast(some), "column")  # a row a column
    number = parsed(F.col("value"))
    part = F.when(~F.isnan(number), F.col("count") * F.pow(number - F.col("mean"), 2))
    return squares.groupBy("column").agg(round2(F.sqrt(F.sum(part) / F.max("rows"))).alias("std_deviation"))


def _rank(total: Column, at: Column) -> Column:
    """The percent rank of the at-th of ``total`` numbers, cut to a whole number."""
    return F.floor(F.lit(100.0) / total * (at + 0.5)).cast("int")


def _running(numbers: DataFrame) -> DataFrame:
    """(column, n, count) with cum, the running count in value order, and the number and count before, per column.

    Values are dealt into ranges by quantiles drawn beforehand, so that a
    column of many distinct values is not the work of one task; ranges are
    joined up by their sums.
    """
    edges = numbers.groupBy("column").agg(F.percentile_approx("n", [i / RANGES for i in range(1, RANGES)], 1000).alias("edges")).collect()
    frame = numbers.sparkSession.createDataFrame([(r["column"], sorted(set(r["edges"]))) for r in edges], "column string, edges array<double>")
    dealt = numbers.join(F.broadcast(frame), "column").withColumn("range", F.size(F.filter("edges", lambda e: e <= F.col("n")))).drop("edges")
    sums = dealt.groupBy("column", "range").agg(F.sum("count").alias("in_range"), F.max("n").alias("last"))
    order = Window.partitionBy("column").orderBy("range")
    before = sums.select(
        "column",
        "range",
        F.coalesce(F.sum("in_range").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.lag("last").over(order).alias("last"),
    )
    within = Window.partitionBy("column", "range").orderBy("n")
    return dealt.join(F.broadcast(before), ["column", "range"]).select(  # RANGES rows a column
        "column",
        "n",
        "count",
        (F.col("base") + F.sum("count").over(within)).alias("cum"),
        (F.col("base") + F.sum("count").over(within) - F.col("count")).alias("before"),
        F.coalesce(F.lag("n").over(within), "last").alias("previous"),
    )


def percentiles(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """(column, percentiles, median) of numeric columns; percentiles only from LEAST numbers on.

    Each distinct value answers for the percents between the ranks of the last
    number before it and of its own last one, so no value meets all percents.
    """
    numeric = stats.where("numeric AND filled > 0").select("column", F.col("filled").alias("total"))
    numbers = counts.where("value <> ''").join(F.broadcast(numeric), "column")
    numbers = numbers.groupBy("column", parsed(F.col("value")).alias("n")).agg(F.sum("count").alias("count")).where(~F.isnan("n"))
    run = _running(numbers).join(F.broadcast(numeric), "column")
    own, last = _rank(F.col("total"), F.col("cum") - 1), _rank(F.col("total"), F.col("before") - 1)
    first = F.col("before") == 0
    percent = F.explode(F.filter(F.sequence(F.lit(STEP), F.lit(100 - STEP), F.lit(STEP)), lambda p: (p <= own) & (first | (p > last))))
    hit = run.select("*", percent.alias("p"))
    # a value is met exactly from the rank of its first number on; below, the line through it and its predecessor goes on
    step = F.floor(F.col("total") * (F.col("p") - last)).cast("double") / 100 * (F.col("n") - F.col("previous"))
    value = F.when(first | (F.col("p") >= _rank(F.col("total"), F.col("before"))), F.col("n")).otherwise(round2(F.col("n") + step))
    found = hit.select("column", "p", "total", value.alias("v"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"])
    return found.groupBy("column").agg(F.when(F.max("total") >= LEAST, listed).alias("percentiles"), F.max(F.when(F.col("p") == 50, F.col("v"))).alias("median"))


def top_values(counts: DataFrame, stats: DataFrame, top: int = TOP) -> DataFrame:
    """(column, rank, value, count): the most frequent values; none for a column without repeats.

    Ties go by value. Values are ranked in salted parts first, so that no task ranks a whole column.
    """
    by = [F.desc("count"), F.asc("value")]
    salted = counts.where("value <> ''").withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(RANGES)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("column", "salt").orderBy(*by))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*by))).where(F.col("rank") <= top)
    repeats = ranked.where("rank = 1 AND count > 1").select("column")
    return ranked.join(F.broadcast(repeats), "column", "left_semi").select("column", "rank", "value", "count")


def counted(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Value counts, written once for the several figures that are made of them, and their basic figures (a row a column)."""
    counts = checkpointed(value_counts(df, columns))
    return counts, checkpointed(basic_stats(counts))


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row a column, with the figures of its values, top values and percentiles; made at once, to be compared and read again."""
    counts, stats = counted(df, columns)
    top = top_values(counts, stats).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias("t"))
    top = top.select("column", F.transform("t", lambda x: F.struct(x["value"].alias("v"), x["count"].alias("c"))).alias("top_values"))
    whole = (
        stats.join(deviations(counts, stats), "column", "left")
        .join(percentiles(counts, stats), "column", "left")
        .join(top, "column", "left")
        .select("column", "rows", "na_count", "min", "max", "mean", "median", "std_deviation", "min_str_len", "max_str_len", "avg_str_len", "top_values", "percentiles")
    )
    return checkpointed(whole)


SCALARS = ["na_count", "min", "max", "mean", "median", "std_deviation", "min_str_len", "max_str_len", "avg_str_len"]


def scalar_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(column, stat, old, new, unchanged) of two profiles; figures that are 0 or missing in both are left out, but for na_count."""
    stats = lambda s: F.array(*(F.struct(F.lit(c).alias("stat"), F.col(f"{s}.{c}").cast("double").alias("value")) for c in SCALARS))
    sides = [df.alias(s).select("column", F.explode(stats(s)).alias("x")).select("column", F.col("x.stat").alias("stat"), F.col("x.value").alias(s)) for s, df in (("old", old), ("new", new))]
    both = sides[1].join(sides[0], ["column", "stat"], "full_outer")
    zero = (F.coalesce("old", F.lit(0.0)) == 0) & (F.coalesce("new", F.lit(0.0)) == 0)
    return both.where(~zero | (F.col("stat") == "na_count")).select("column", "stat", "old", "new", F.col("old").eqNullSafe(F.col("new")).alias("unchanged"))


def top_values_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(column, position, value, old_count, new_count, old_pct, new_pct): old top values in their order, then new ones."""
    sides = [df.select("column", F.col("rows").alias(f"{s}_rows"), F.posexplode("top_values").alias(f"{s}_at", "x")).select("column", f"{s}_rows", f"{s}_at", F.col("x.v").alias("value"), F.col("x.c").alias(f"{s}_count")) for s, df in (("old", old), ("new", new))]
    both = sides[0].join(sides[1], ["column", "value"], "full_outer")
    rows = [df.select("column", F.col("rows").alias(f"{s}_all")) for s, df in (("old", old), ("new", new))]
    both = both.join(F.broadcast(rows[0]), "column", "left").join(F.broadcast(rows[1]), "column", "left")
    order = Window.partitionBy("column").orderBy(F.col("old_at").isNull(), "old_at", "new_at")
    count = lambda s: F.coalesce(f"{s}_count", F.lit(0))
    pct = lambda s: F.coalesce(F.floor(count(s) / F.col(f"{s}_all") * 100 + 0.5).cast("int"), F.lit(0))
    return both.select(
        "column", F.row_number().over(order).alias("position"), "value", count("old").alias("old_count"), count("new").alias("new_count"), pct("old").alias("old_pct"), pct("new").alias("new_pct")
    )


def percentiles_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(column, percent, old, new): percentiles in pairs; lists of different lengths have old ones of 0."""
    both = new.select("column", F.col("percentiles").alias("n")).join(old.select("column", F.col("percentiles").alias("o")), "column", "left").where("n IS NOT NULL")
    same = F.size("n") == F.coalesce(F.size("o"), F.lit(-1))
    pairs = F.transform("n", lambda v, i: F.struct(((i + 1) * STEP).alias("percent"), F.when(same, F.get("o", i)).otherwise(0.0).alias("old"), v.alias("new")))
    return both.select("column", F.explode(pairs).alias("x")).select("column", "x.*")


def table_diff(new: DataFrame | None, old: DataFrame | None) -> DataFrame:
    """One row for each column of two profiles: status (added, removed, changed, unchanged), the rows of both versions
    and its differences in figures, percentiles and top values; new columns in front, no row at all if nothing changed.

    A version without a profile has no columns.
    """
    one = new if new is not None else old.limit(0)
    other = old if old is not None else new.limit(0)
    scalars = scalar_diff(one, other).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("stat", "old", "new", "unchanged"))).alias("figures"))
    top = top_values_diff(one, other).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("position", "value", "old_count", "new_count", "old_pct", "new_pct"))).alias("top_values"))
    percent = percentiles_diff(one, other).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("percent", "old", "new"))).alias("percentiles"))
    sides = one.select("column", F.col("rows").alias("new_rows")).join(other.select("column", F.col("rows").alias("old_rows")), "column", "full_outer")
    both = sides.join(scalars, "column", "left").join(top, "column", "left").join(percent, "column", "left")
    moved = (
        F.exists(F.coalesce("figures", F.array().cast("array<struct<stat:string,old:double,new:double,unchanged:boolean>>")), lambda x: ~x["unchanged"])
        | F.coalesce(F.exists("top_values", lambda x: (x["old_count"] != x["new_count"]) | (x["old_pct"] != x["new_pct"])), F.lit(False))
        | F.coalesce(F.exists("percentiles", lambda x: ~x["old"].eqNullSafe(x["new"])), F.lit(False))
    )
    status = F.when(F.col("old_rows").isNull(), "added").when(F.col("new_rows").isNull(), "removed").when(moved, "changed").otherwise("unchanged")
    judged = both.select("column", status.alias("status"), "new_rows", "old_rows", "figures", "top_values", "percentiles")
    any_change = judged.where((F.col("status") != "unchanged") | ~F.col("new_rows").eqNullSafe(F.col("old_rows"))).limit(1).select(F.lit(1).alias("_any"))
    return judged.join(F.broadcast(any_change), F.lit(True), "left_semi")
