"""Differences of two versions of a table, by primary key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import row_sum, text_of
from .coldiff import compare_columns

ADDED, REMOVED, MODIFIED, UNCHANGED = "added", "removed", "modified", "unchanged"


def checked_key(df: DataFrame, pk: Sequence[str]) -> list[str]:
    missing = [c for c in pk if c not in df.columns]
    if missing:
        raise ValueError(f"no such primary key column: {', '.join(missing)}")
    return list(pk)


def _comparable(new: DataFrame, old: DataFrame, new_pk: Sequence[str], old_pk: Sequence[str]) -> bool:
    """Rows can be matched if the keys have the same names; without keys, if the columns are the same."""
    return list(new_pk) == list(old_pk) and (bool(new_pk) or new.columns == old.columns)


def _side(df: DataFrame, key: Sequence[str], name: str, cells: Sequence[str]) -> DataFrame:
    """Key columns and row identity, and cells if asked for: nothing else goes through the shuffle."""
    keys = [F.col(f"`{c}`").alias(f"{name}_k{i}") for i, c in enumerate(key)]
    return df.select(*keys, row_sum(df).alias(f"{name}_sum"), *([F.struct(*(F.col(f"`{c}`") for c in cells)).alias(name)] if cells else []))


def row_diff(
    new: DataFrame, old: DataFrame, pk: Sequence[str], old_pk: Sequence[str] | None = None, unchanged: bool = False, cells: bool = False
) -> DataFrame:
    """One row for each key that was added, removed or modified (or unchanged, if asked for).

    Returns status, the key columns, sum and old_sum; with ``cells`` also the
    structs new and old. Versions whose column lists differ have all matched
    rows modified. Without a key the whole row is the key, and rows are added or
    removed only. Keys are matched null-safely, in one full outer join.
    """
    old_pk = pk if old_pk is None else old_pk
    key = checked_key(new, pk) or list(new.columns)
    same = _comparable(new, old, pk, old_pk)
    if same:
        checked_key(old, pk)
    else:  # nothing can be matched, and nothing is reported
        new, old, key = new.limit(0), old.limit(0), [c for c in key if c in old.columns]
    n = _side(new, key, "new", new.columns if cells else ())
    o = _side(old, key, "old", old.columns if cells else ())
    on = F.lit(True) if not key else F.expr(" AND ".join(f"new_k{i} <=> old_k{i}" for i in range(len(key))))
    joined = n.join(o, on, "full_outer")
    differs = F.lit(True) if new.columns != old.columns else F.col("new_sum") != F.col("old_sum")
    status = F.when(F.col("old_sum").isNull(), ADDED).when(F.col("new_sum").isNull(), REMOVED).when(differs, MODIFIED).otherwise(UNCHANGED)
    out = joined.select(
        status.alias("status"),
        *(F.when(F.col("new_sum").isNull(), F.col(f"old_k{i}")).otherwise(F.col(f"new_k{i}")).alias(c) for i, c in enumerate(key)),
        F.col("new_sum").alias("sum"),
        F.col("old_sum"),
        *(["new", "old"] if cells else []),
    )
    return out if unchanged else out.where(F.col("status") != UNCHANGED)


def summary(new: DataFrame, old: DataFrame, pk: Sequence[str], old_pk: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, columns added and removed, rows modified, and the keys if they changed."""
    old_pk = pk if old_pk is None else old_pk
    d = row_diff(new, old, pk, old_pk)
    columns = compare_columns(old.columns, [new.columns], pk)
    count = lambda s: F.count_if(F.col("status") == s)
    return d.agg(
        count(ADDED).alias("rows_added"),
        count(REMOVED).alias("rows_removed"),
        count(MODIFIED).alias("rows_modified"),
        F.lit(len(columns.added[0])).cast("long").alias("columns_added"),
        F.lit(len(columns.removed[0])).cast("long").alias("columns_removed"),
        F.lit(None if list(pk) == list(old_pk) else f"{','.join(old_pk)}->{','.join(pk)}").cast("string").alias("key_change"),
    )


def summary_line() -> Column:
    """A summary's row as text: rows: +1/-1/m2; columns: +1/-1; primary key: a->a,b; '' if nothing changed."""
    rows = F.concat_ws(
        "/",
        F.when(F.col("rows_added") > 0, F.concat(F.lit("+"), "rows_added")),
        F.when(F.col("rows_removed") > 0, F.concat(F.lit("-"), "rows_removed")),
        F.when(F.col("rows_modified") > 0, F.concat(F.lit("m"), "rows_modified")),
    )
    columns = F.concat_ws(
        "/",
        F.when(F.col("columns_added") > 0, F.concat(F.lit("+"), "columns_added")),
        F.when(F.col("columns_removed") > 0, F.concat(F.lit("-"), "columns_removed")),
    )
    return F.concat_ws(
        "; ",
        F.when(rows != "", F.concat(F.lit("rows: "), rows)),
        F.when(columns != "", F.concat(F.lit("columns: "), columns)),
        F.when(F.col("key_change").isNotNull(), F.concat(F.lit("primary key: "), "key_change")),
    )


def multi_summary(versions: dict[str, tuple[DataFrame, DataFrame, Sequence[str]]]) -> DataFrame:
    """(branch, summary) of several (new, old, pk), by branch; branches without changes are left out."""
    parts = [summary(new, old, pk).select(F.lit(name).alias("branch"), summary_line().alias("summary")) for name, (new, old, pk) in sorted(versions.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.where("summary <> ''")


def cell_diff(new: DataFrame, old: DataFrame, pk: Sequence[str]) -> DataFrame:
    """One row for each cell that differs in a modified row: key columns, column, old and new as text.

    A column that one version lacks has null there.
    """
    layout = compare_columns(old.columns, [new.columns], pk).names
    d = row_diff(new, old, pk, cells=True).where(F.col("status") == MODIFIED)

    def cell(side: str, df: DataFrame, c: str) -> Column:
        return text_of(F.col(f"{side}.`{c}`"), df.schema[c].dataType) if c in df.columns else F.lit(None).cast("string")

    cells = F.array(*(F.struct(F.lit(c).alias("column"), cell("old", old, c).alias("old"), cell("new", new, c).alias("new")) for c in layout if c not in pk))
    return d.select(*pk, F.explode(F.filter(cells, lambda x: ~x["old"].eqNullSafe(x["new"]))).alias("x")).select(*pk, "x.*")


def combined_rows(new: DataFrame, old: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Modified rows in the union layout, each cell as [value], or as [new, old] where they differ."""
    layout = compare_columns(old.columns, [new.columns], pk).names
    d = row_diff(new, old, pk, cells=True).where(F.col("status") == MODIFIED)

    def cell(c: str) -> Column:
        n = text_of(F.col(f"new.`{c}`"), new.schema[c].dataType) if c in new.columns else None
        o = text_of(F.col(f"old.`{c}`"), old.schema[c].dataType) if c in old.columns else None
        if n is None or o is None:
            return F.array(n if o is None else o)
        return F.when(n == o, F.array(n)).otherwise(F.array(n, o))

    return d.select(*(cell(c).alias(c) for c in layout))


def labelled(new: DataFrame, old: DataFrame, pk: Sequence[str], new_name: str = "new", old_name: str = "old") -> DataFrame:
    """The difference as labelled lines: section, key text, line, label and cells in the union layout.

    Ordered by (section, key, line) they read: the header lines, then changed
    rows by key, a modified row after its base row, then removed rows.
    """
    layout = compare_columns(old.columns, [new.columns], pk).names
    spark = new.sparkSession
    heads = []
    for i, (name, df) in enumerate(((old_name, old), (new_name, new))):
        heads.append((i, f"COLUMNS IN {name}", [c if c in df.columns else "" for c in layout]))
        heads.append((2 + i, f"PRIMARY KEY IN {name}", ["true" if c in pk else "" for c in layout]))
    head = spark.createDataFrame(heads, "line int, label string, cells array<string>").select(F.lit(0).alias("section"), F.lit("").alias("key"), "line", "label", "cells")
    d = row_diff(new, old, pk, cells=True)
    side = lambda s, df: F.array(*(text_of(F.col(f"{s}.`{c}`"), df.schema[c].dataType) if c in df.columns else F.lit("") for c in layout))
    n, o = side("new", new), side("old", old)
    line = lambda i, label, cells: F.struct(F.lit(i).alias("line"), F.lit(label).alias("label"), cells.alias("cells"))
    lines = (
        F.when(F.col("status") == ADDED, F.array(line(0, f"ADDED IN {new_name}", n)))
        .when(F.col("status") == REMOVED, F.array(line(0, f"REMOVED IN {new_name}", o)))
        .otherwise(F.array(line(0, f"BASE ROW FROM {old_name}", o), line(1, f"MODIFIED IN {new_name}", n)))
    )
    key = F.concat_ws("\x00", *(text_of(F.col(f"`{c}`"), (new if c in new.columns else old).schema[c].dataType) for c in pk)) if pk else F.concat_ws("\x00", F.coalesce(n, o))
    body = d.select(F.when(F.col("status") == REMOVED, 2).otherwise(1).alias("section"), key.alias("key"), F.explode(lines).alias("x"))
    return head.unionByName(body.select("section", "key", "x.*"))
