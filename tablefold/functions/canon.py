"""Column expressions that tables are identified, compared and measured by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Plain decimal numbers with an optional exponent; no blanks or type suffixes.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
#: Infinities and what is no number, by name, which count as numbers of a column.
SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"
#: Hexadecimal numbers with a binary exponent, of up to 15 digits.
HEXADECIMAL = r"^([+-]?)0[xX](?=[0-9a-fA-F.]{1,16}[pP])([0-9a-fA-F]*)[.]?([0-9a-fA-F]*)[pP]([+-]?[0-9]{1,4})$"


def text_of(column: Column, kind: T.DataType) -> Column:
    """A cell as text; nulls are empty. Different floats have different texts, which read back as what they were."""
    return F.coalesce(column.cast("string"), F.lit(""))


def four_digits(df: DataFrame) -> DataFrame:
    """df with floats as decimals of four digits, which all engines write alike; loses what lies beyond."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    return df.withColumns({c: F.col(f"`{c}`").cast("decimal(38,4)") for c in floats})


def canonical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All cells as text, as a table read from CSV has them."""
    return df.select(*(text_of(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in columns or df.columns))


def row_sum(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A 128-bit identity of a row's cells in column order; column names don't enter.

    Cells are framed by their byte length, so that no two rows share an encoding.
    """
    parts = []
    for c in columns or df.columns:
        cell = text_of(F.col(f"`{c}`"), df.schema[c].dataType)
        parts += [F.octet_length(cell).cast("string"), F.lit(":"), cell]
    return F.md5(F.concat(*parts) if parts else F.lit(""))


def round2(x: Column) -> Column:
    """Two decimals, halves away from zero, on the binary value as it is."""
    return F.signum(x) * F.floor(F.abs(x) * 100 + 0.5) / 100


def parsed(cell: Column) -> Column:
    """A text cell as a double, or null if it is none; a decimal or hexadecimal number that is out of range is none.

    inf, infinity and nan are read in any case.
    """
    plain = F.when(cell.rlike(NUMBER), cell.try_cast("double"))
    part = lambda i: F.regexp_extract(cell, HEXADECIMAL, i)
    digits = F.conv(F.concat(part(2), part(3)), 16, 10).try_cast("double")
    scale = F.pow(F.lit(2.0), part(4).try_cast("int") - 4 * F.length(part(3)))
    hexadecimal = F.when(cell.rlike(HEXADECIMAL) & (F.length(F.concat(part(2), part(3))) > 0), digits * scale * F.when(part(1) == "-", -1.0).otherwise(1.0))
    number = F.coalesce(plain, hexadecimal)
    special = F.when(cell.rlike("(?i)nan$"), F.lit(float("nan"))).when(cell.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(cell.rlike(SPECIAL), special).otherwise(F.when(F.abs(number) < float("inf"), number))


def displayed(x: Column, digits: int = 6) -> Column:
    """A double as text with at most so many decimals: no trailing zeros, and no point for whole numbers."""
    text = F.format_string(f"%.{digits}f", x)
    return F.when(text.contains("."), F.regexp_replace(text, "[.]?0+$", "")).otherwise(text)


def short_id(digest: Column) -> Column:
    """The seven characters that a digest is shown by."""
    return F.substring(digest, 1, 7)


def first_line(message: Column) -> Column:
    return F.substring_index(message, "\n", 1)


def readable_size(size: Column) -> Column:
    """Bytes in the largest unit of 1024 that leaves one or more."""
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    out = F.concat(size.cast("long").cast("string"), F.lit(f" {units[0]}"))
    for power, unit in enumerate(units[1:], 1):
        out = F.when(size >= 1024**power, F.concat(F.format_number(size / 1024**power, 2), F.lit(f" {unit}"))).otherwise(out)
    return out
