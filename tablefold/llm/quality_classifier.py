"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Tokens are runs of letters and digits and runs of other marks, as written.
Features are the shares of a text's one- and two-token runs, hashed to 2**bits
cells. Two-token runs that stood up to 16 tokens before count once more, all in
cell 0 whatever their tokens, and tokens equal to the one before in cell 1. A
score is the dot product of shares and weights, through the logistic function.

Null and empty texts have no features: their score is that of the intercept.
Texts of any length are scored whole. Every row of the input gives one row with
its columns (one named score is replaced), repeated rows equal ones, whatever
rows stand around them. Labels that tie count as 1. With no labelled rows all
scores are 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear
from . import textkit as tk

SCALE = 8.0
LAGS = 16
HELD_OUT = (4, 2)


def _grams(column: pa.Array, bits: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Text index and feature id of every n-gram."""
    words = tk.Texts(column, tk.alnum_classes(punctuation=True))
    hashes = words.hashes()
    docs, ids = [], []
    doc = words.doc_of_word()  # the array goes on from text to text, repeats don't
    again = np.zeros(len(hashes), bool)
    for lag in range(1, min(LAGS, len(hashes) - 1) + 1):
        same = hashes[lag:] == hashes[:-lag]
        again[lag:-1] |= same[:-1] & same[1:] & (doc[: -lag - 1] == doc[lag + 1 :])
    twice = np.flatnonzero((hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])) + 1
    for cell, at in enumerate((np.flatnonzero(again), twice)):
        docs.append(np.searchsorted(words.first, at, "right") - 1)
        ids.append(np.full(len(at), cell))
    for k in orders:
        starts, grams = words.grams(hashes, k)
        docs.append(np.searchsorted(words.first, starts, "right") - 1)
        ids.append((grams >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(ids), len(words.first) - 1


def featurise(bits: int, orders: tuple[int, ...]):
    def run(column):
        doc, ids, n = _grams(column, bits, orders)
        key, count = np.unique((doc << bits) | ids, return_counts=True)
        ends = np.searchsorted(key, np.arange(n + 1) << bits)
        for a, b in zip(ends[:-1], ends[1:]):
            yield key[a:b] & ((1 << bits) - 1), SCALE * count[a:b] / max(1, count[a:b].sum())

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, max_bytes: int = 96 << 20, bits: int = 18, orders: tuple[int, ...] = (1, 2)) -> np.ndarray:
    """Weights fitted on at most ``max_rows`` labelled documents with at most ``max_bytes`` of text."""
    sample = linear.labelled_sample(docs, labels, label, max_rows, max_bytes)

    def train(rows):
        return linear.ftrl(rows, 1 << bits, epochs=3, alpha=0.5, l1=0.05, l2=0.01)

    return linear.fit(linear.features(sample, featurise(bits, orders)), train)


def _score(weights, bits, orders, names):
    def run(batches):
        w = weights.value
        for batch in tk.steps(batches, "text"):
            doc, ids, n = _grams(tk.column(batch, "text"), bits, orders)
            total = np.bincount(doc, w[ids], n) / np.maximum(1, np.bincount(doc, minlength=n))
            score = linear.sigmoid(SCALE * total + w[-1])
            yield pa.RecordBatch.from_arrays([*(tk.column(batch, c) for c in names), pa.array(score)], names=[*names, "score"])

    return run


def score_quality(docs: DataFrame, weights: np.ndarray, bits: int = 18, orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """The rows of docs with a column score, the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    return linear.with_score(docs, lambda names: _score(sent, bits, orders, names))


def learnable(labels: DataFrame, held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    return labels.where(linear.crc_mod(F.col("doc_id"), held_out[0]) != held_out[1])


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string").alias("text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, fit_quality(docs, learnable(labels)))
    return scored.select(
        "doc_id",
        (linear.crc_mod(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
