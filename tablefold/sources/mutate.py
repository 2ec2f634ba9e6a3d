"""Changed copies of a table, for tests and benchmarks; the same seed changes the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _draw(df: DataFrame, key: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) from a row's key."""
    return F.pmod(F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in key)), F.lit(1_000_003)) / 1_000_003


def remove_rows(df: DataFrame, key: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    return df.where(_draw(df, key, seed) >= share)


def modify_rows(df: DataFrame, key: Sequence[str], columns: Sequence[str], share: float, seed: int = 1) -> DataFrame:
    """About ``share`` of the rows get another value in one of the text columns."""
    hit = _draw(df, key, seed) < share
    which = F.pmod(F.xxhash64(F.lit(seed + 1), *(F.col(f"`{c}`") for c in key)), F.lit(len(columns)))
    changed = {c: F.when(hit & (which == i), F.concat(F.col(f"`{c}`").cast("string"), F.lit("~"))).otherwise(F.col(f"`{c}`").cast("string")) for i, c in enumerate(columns)}
    return df.withColumns(changed)


def add_rows(df: DataFrame, key: Sequence[str], share: float, seed: int = 3) -> DataFrame:
    """About ``share`` of the rows once more under new keys: text keys get a suffix, numbers go on beyond the largest."""
    more = df.where(_draw(df, key, seed) < share)
    for c in key:
        own = F.col(f"`{c}`")
        if isinstance(df.schema[c].dataType, T.NumericType):
            low, top = df.agg(F.min(own), F.max(own)).first()
            more = more.withColumn(c, (own - F.lit(low) + F.lit(top) + 1).cast(df.schema[c].dataType))
        else:
            more = more.withColumn(c, F.concat(own.cast("string"), F.lit(f"+{seed}")))
    return df.unionByName(more)


def column_name(number: int) -> str:
    """col_a, ..., col_z, col_aa, ...: the names of generated columns."""
    letters = ""
    number += 1
    while number:
        number, rest = divmod(number - 1, 26)
        letters = chr(ord("a") + rest) + letters
    return f"col_{letters}"


def add_columns(df: DataFrame, key: Sequence[str], count: int, seed: int = 4) -> DataFrame:
    """``count`` text columns more, under the first generated names that are free."""
    free = (n for i in range(count + len(df.columns)) if (n := column_name(i)) not in df.columns)
    names = [next(free) for _ in range(count)]
    return df.withColumns({n: F.hex(F.xxhash64(F.lit(seed), F.lit(n), *(F.col(f"`{c}`") for c in key))) for n in names})


def remove_columns(df: DataFrame, count: int, keep: Sequence[str] = (), seed: int = 5) -> DataFrame:
    """Without ``count`` of the columns, never those of ``keep``, such as the key."""
    free = [c for c in df.columns if c not in keep]
    gone = sorted(free, key=lambda c: hashlib.md5(f"{seed}|{c}".encode()).hexdigest())[:count]
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in gone))


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def move_column(df: DataFrame, name: str, to: int) -> DataFrame:
    rest = [c for c in df.columns if c != name]
    return df.select(*rest[:to], name, *rest[to:])
