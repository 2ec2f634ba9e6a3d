"""A logistic regression over hashed features, fitted by follow-the-regularised-leader updates.

Only fitting sees labels, and only a sample of labelled rows. Two parameters bound
it, its rows and the bytes of their texts (whole texts: rows are left out, texts
aren't cut). Fitting is one task over that bounded sample, in a fixed order, so a
repeated attempt gives the same weights; scoring runs in every task with the
weights broadcast (their number is the parameter ``bits``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .shipping import checkpointed


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of doc_id, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int) -> DataFrame:
    """(order, doc_id, text, y) of at most ``most`` documents with a label and ``most_bytes`` of text, drawn by a hash of doc_id.

    Labels of one document that contradict each other count as their mean,
    halves up. A document counts once, with its least text. A text that alone is
    beyond an eighth of ``most_bytes`` is left out.
    """
    drawn = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.when(F.avg(label) >= 0.5, 1.0).otherwise(0.0).alias("y"))
        .withColumn("order", F.xxhash64("doc_id"))
        .orderBy("order", "doc_id")
        .limit(most)
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    of_docs = texts.join(F.broadcast(drawn), "doc_id").where(F.octet_length("text") <= most_bytes // 8)  # at most ``most`` ids
    once = checkpointed(of_docs.groupBy("doc_id", "order", "y").agg(F.min("text").alias("text")))
    # the figures of at most ``most`` rows are added up in one place, their texts are not
    before = Window.orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = once.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(drawn.select("doc_id", "order")), "doc_id")
    fits = fits.withColumn("sum", F.sum("size").over(before)).where(F.col("sum") <= most_bytes).select("doc_id")
    return once.join(F.broadcast(fits), "doc_id").select("order", "doc_id", "text", "y")


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, float]], size: int, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.1, scale: np.ndarray | None = None
) -> np.ndarray:
    """Weights (the last one is the intercept) from rows of (feature ids, values, label); ``scale`` multiplies the values by feature."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(ids):
        zi = z[ids]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[ids])) / alpha + l2))

    for _ in range(epochs):
        for ids, values, y in rows:
            values = np.append(values if scale is None else values * scale[ids], 1.0)
            ids = np.append(ids, size)
            w = weights(ids)
            p = sigmoid(np.array([w @ values]))[0]
            g = (p - y) * values
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha * w
            n[ids] += g * g
    return weights(np.arange(size + 1))


def with_score(docs: DataFrame, score: Callable) -> DataFrame:
    """The rows of docs with the column score that ``score(column names)`` maps them to; a column of that name goes."""
    docs = docs.drop("score")
    return docs.mapInArrow(score(docs.columns), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


#: From record batches with texts to the rows' features: for each row ids and values.
Featurise = Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]


def features(sample: DataFrame, featurise: Featurise) -> DataFrame:
    """(order, y, ids, values) of the sampled rows."""

    def run(batches):
        for batch in tk.steps(batches, "text"):
            ids, values = zip(*featurise(tk.column(batch, "text")))  # steps have a row at least
            count = np.array([len(x) for x in ids])
            yield pa.RecordBatch.from_arrays(
                [tk.column(batch, "order"), tk.column(batch, "doc_id"), tk.column(batch, "y"), tk.lists(pa.array(np.concatenate(ids).astype(np.int32)), count), tk.lists(pa.array(np.concatenate(values).astype(np.float32)), count)],
                names=["order", "doc_id", "y", "ids", "values"],
            )

    return sample.mapInArrow(run, "order long, doc_id long, y double, ids array<int>, values array<float>")


def fit(featured: DataFrame, train: Callable[[list[tuple[np.ndarray, np.ndarray, float]]], np.ndarray]) -> np.ndarray:
    """The weights that ``train`` makes of all rows of the bounded sample, in one task whose memory follows from its bounds."""

    def run(batches):
        rows = []
        for batch in batches:
            y, ids, values = (batch.column(batch.schema.get_field_index(c)) for c in ("y", "ids", "values"))
            rows += [(i.values.to_numpy(), v.values.to_numpy(), float(t.as_py())) for i, v, t in zip(ids, values, y)]
        yield pa.RecordBatch.from_arrays([pa.array([train(rows).astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    one = featured.repartition(1).sortWithinPartitions("order", "doc_id").mapInArrow(run, "weights binary")
    row = one.first()
    return np.frombuffer(row["weights"], np.float32) if row else train([]).astype(np.float32)
