"""CSV tables in and out: all cells are text, empty cells are '' and headers are kept as written."""

from __future__ import annotations

import csv
import sys
import uuid
from collections.abc import Sequence
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import ingest


def named(header: Sequence[str]) -> list[str]:
    """The header with empty names replaced by unnamed__1, unnamed__2, ..., passing over names in use."""
    used, out, n = set(header), [], 0
    for name in header:
        if not name:
            n += 1
            while f"unnamed__{n}" in used:
                n += 1
            name = f"unnamed__{n}"
        out.append(name)
    return out


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A CSV file with a header, quoted as in RFC 4180; a row of another width is an error."""
    head = spark.read.text(path).limit(1).first()
    if head is None:
        raise ValueError(f"{path} has no header")
    header = named(next(csv.reader([head[0]], delimiter=delimiter)))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    rows = spark.read.csv(
        path, schema=schema, header=True, enforceSchema=True, sep=delimiter, quote='"', escape='"', multiLine=True, mode="FAILFAST", inferSchema=False
    )
    return rows.na.fill("").toDF(*header)


def read_stdin(spark: SparkSession, folder: str, delimiter: str = ",", stream: BinaryIO | None = None) -> DataFrame:
    """A CSV table from standard input, or another stream, by way of a file in ``folder``, which all executors must reach."""
    path = f"{folder.rstrip('/')}/stdin-{uuid.uuid4().hex}.csv"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        while chunk := (stream or sys.stdin.buffer).read(1 << 20):
            out.write(bytearray(chunk))
    finally:
        out.close()
    return read_csv(spark, path, delimiter)


def preview(spark: SparkSession, path: str, pk: Sequence[str] = (), delimiter: str = ",") -> DataFrame:
    """A CSV file as a version would hold it, one row a key with its row number, without storing it."""
    rows = ingest.one_per_key(read_csv(spark, path, delimiter), pk)
    return ingest.numbered(rows, list(pk) or rows.columns)


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """The rows in their order, with a header; quotes are doubled."""
    df.write.mode("overwrite").csv(path, header=True, sep=delimiter, quote='"', escape='"', emptyValue="", nullValue="")
