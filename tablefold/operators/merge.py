"""Merge of several versions against their common ancestor, cell by cell."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import text_of
from .coldiff import ColumnDiff, compare_columns
from .rowdiff import checked_key


@dataclass
class Merge:
    """rows: every key that some version has, with the union columns, ``dropped`` (the row goes without a question),
    ``resolved``, ``unresolved`` (columns in conflict) and ``versions`` (each one's cells as text, base first).

    A column has the type that the versions give it, and is text if they differ in it.
    """

    columns: ColumnDiff
    pk: list[str]
    rows: DataFrame

    def conflicts(self) -> DataFrame:
        """Rows that need a decision: proposed cells, unresolved columns, and each version's cells (base first)."""
        return self.rows.where("NOT dropped AND NOT resolved").select(*self.columns.names, "unresolved", "versions")

    def resolved(self) -> DataFrame:
        return self.rows.where("NOT dropped AND resolved").select(*self.columns.names)

    def result(self, resolutions: DataFrame | None = None, without: Sequence[str] | None = None) -> DataFrame:
        """The merged version: resolved rows, and conflicting ones as ``resolutions`` says.

        resolutions has the key, the union columns and a boolean ``drop``. A
        conflict that it doesn't name fails the job: rows are never left out in
        silence. ``without`` are columns to leave out; by default those that
        some layer removed, if no resolutions are given, else none.
        """
        removed = [c for c in self.columns.names if any(c in r for r in self.columns.removed)]
        gone = set(without) if without is not None else set(removed if resolutions is None else [])
        open_ = self.conflicts().select(*(F.col(f"`{c}`") for c in self.columns.names))
        named = open_.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(self.pk)))
        if resolutions is None:
            decided = open_.withColumns({"_named": F.lit(False), "_drop": F.lit(False)})
        else:
            cells = [F.col(f"`{c}`").cast(open_.schema[c].dataType).alias(c) for c in self.columns.names]
            chosen = resolutions.select(*cells, F.coalesce("drop", F.lit(False)).alias("_drop"), F.lit(True).alias("_named"))
            same = [named[f"_k{i}"].eqNullSafe(chosen[f"`{c}`"]) for i, c in enumerate(self.pk)]
            decided = named.join(chosen, reduce(lambda a, b: a & b, same), "left").withColumn("_named", F.coalesce("_named", F.lit(False)))
        unnamed = F.raise_error("a conflict has no resolution: see conflicts()").cast("boolean")
        decided = decided.where(F.when(F.col("_named"), ~F.col("_drop")).otherwise(unnamed)).select(*(F.col(f"`{c}`") for c in self.columns.names))
        return self.resolved().unionByName(decided).select(*(c for c in self.columns.names if c not in gone))

    def lines(self, names: Sequence[str]) -> DataFrame:
        """Conflicts as labelled lines: has_base, line, label and cells as text; the resolution proposed comes last.

        In order of (has_base, key, line), rows that base lacks come first.
        """
        cells = F.array(*(text_of(F.col(f"`{c}`"), self.rows.schema[c].dataType) for c in self.columns.names))
        labels = [f"CONFLICT {'BASE' if i == 0 else 'IN'} {n}" for i, n in enumerate(names)]
        each = [F.struct(F.lit(i).alias("line"), F.lit(label).alias("label"), F.get(F.col("versions"), F.lit(i)).alias("cells")) for i, label in enumerate(labels)]
        last = F.struct(F.lit(len(names)).alias("line"), F.lit("RESOLUTION").alias("label"), cells.alias("cells"))
        has_base = F.get(F.col("versions"), F.lit(0)).isNotNull().alias("has_base")
        rows = self.conflicts().select(*self.pk, has_base, F.explode(F.filter(F.array(*each, last), lambda x: x["cells"].isNotNull())).alias("_x"))
        return rows.select(*self.pk, "has_base", "_x.*")


def merge(base: DataFrame, layers: Sequence[DataFrame], pk: Sequence[str]) -> Merge:
    """Compares layers with base by key, in one shuffle of all versions together.

    A cell is the only value that layers changed it to, or base's. It is in
    conflict if layers changed it to different values, or one changed it while
    another removed its column or the whole row. A row that layers removed goes
    if no other layer changed it, and is a conflict otherwise.
    Without a key, the whole row is the key.
    """
    key = checked_key(base, pk)
    for layer in layers:
        checked_key(layer, pk)
    diff = compare_columns(base.columns, [x.columns for x in layers], pk)
    key = key or diff.names
    versions = [base, *layers]

    def cell(df: DataFrame, c: str) -> Column:
        own = F.col(f"`{c}`")
        if c not in df.columns:
            return blank(c)
        return own if kinds[c] == df.schema[c].dataType else text_of(own, df.schema[c].dataType)

    def blank(c: str) -> Column:
        return F.lit("") if kinds[c] == T.StringType() else F.lit(None).cast(kinds[c])

    kinds = {}
    for c in diff.names:
        found = {df.schema[c].dataType for df in versions if c in df.columns}
        kinds[c] = found.pop() if len(found) == 1 else T.StringType()

    every = None
    for i, df in enumerate(versions):
        keys = [text_of(cell(df, c), kinds[c]).alias(f"_k{n}") for n, c in enumerate(key)]
        side = df.select(F.lit(i).alias("_v"), *keys, F.struct(*(cell(df, c).alias(f"c{j}") for j, c in enumerate(diff.names))).alias("_cells"))
        every = side if every is None else every.unionAll(side)
    keys = [f"_k{n}" for n in range(len(key))]
    grouped = every.groupBy(*keys).agg(*(F.max(F.when(F.col("_v") == i, F.col("_cells"))).alias(f"_{i}") for i in range(len(versions))))
    return Merge(diff, list(key), grouped.select(*_resolve(diff, len(layers), key, kinds, blank)))


def _resolve(diff: ColumnDiff, n: int, key: Sequence[str], kinds: dict[str, T.DataType], blank: Callable[[str], Column]) -> list[Column]:
    has = lambda i: F.col(f"_{i}").isNotNull()
    at = lambda i, j: F.col(f"_{i}.c{j}")
    text = lambda i, j: text_of(at(i, j), kinds[diff.names[j]])
    any_removed = has(0) & _any(~has(i) for i in range(1, n + 1))
    same_cells = lambda i: reduce(lambda a, b: a & b, (text(i, j) == text(0, j) for j in range(len(diff.names))), F.lit(True))
    changed_row = _any(has(i) & (F.lit(True) if diff.layers[i - 1] != diff.base else ~has(0) | ~same_cells(i)) for i in range(1, n + 1))
    dropped = has(0) & any_removed & ~changed_row
    cells, conflicts = [], []
    for j, c in enumerate(diff.names):
        holders = [i for i in range(1, n + 1) if c in diff.layers[i - 1]]
        lacking = [i for i in range(1, n + 1) if c in diff.base and i not in holders]
        cell = lambda i, j=j: F.struct(text(i, j).alias("text"), at(i, j).alias("value"))
        if c in diff.base:
            changes = [F.when(has(i) & (~has(0) | (text(i, j) != text(0, j))), cell(i)) for i in holders]
            gone = _any([any_removed, *(has(i) for i in lacking)])
        else:
            changes = [F.when(has(i), cell(i)) for i in holders]
            gone = F.lit(False)
        values = F.array_compact(F.array_distinct(F.array(*changes))) if changes else F.array()
        many = F.size(values)
        conflict = (many > 1) | ((many > 0) & gone)
        before = F.when(has(0), at(0, j)).otherwise(blank(c))
        kept = F.when(_any(has(i) for i in lacking), blank(c)).otherwise(before)
        if c in key:  # which all versions share
            value = F.coalesce(*(at(i, j) for i in range(n + 1)))
        elif changes:
            value = F.when(conflict, before).when(many == 1, values[0]["value"]).otherwise(kept)
        else:
            value = kept
        cells.append(value.alias(c))
        conflicts.append(F.when(conflict, F.lit(c)))
    unresolved = F.array_compact(F.array(*conflicts))
    as_text = lambda i: F.when(has(i), F.array(*(text(i, j) for j in range(len(diff.names)))))
    return [
        *cells,
        dropped.alias("dropped"),
        (~any_removed & (F.size(unresolved) == 0)).alias("resolved"),
        unresolved.alias("unresolved"),
        F.array(*(as_text(i) for i in range(n + 1))).alias("versions"),
    ]


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
