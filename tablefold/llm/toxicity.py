"""Toxicity: character n-grams scaled by naive Bayes log-count ratios, under a linear classifier.

Texts are lower-cased in A-Z, and white space counts as a blank. A feature is
the presence of a run of 3 to 6 characters (code points), hashed to 2**bits
cells; its value is the log ratio of its smoothed document counts in either class, and the weights
on those values are fitted by follow-the-regularised-leader. What is scored
with is the product of weight and ratio, which the L1 term leaves sparse.

Null and empty texts, and those of fewer characters than a run, have no features:
their score is that of the intercept. Texts of any length are scored whole. Every
row gives one row with its columns (one named score is replaced), repeated rows
equal ones, whatever rows stand around them. Labels that tie count as 1. With no
labelled rows all scores are 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear
from . import textkit as tk

ORDERS = (3, 4, 5, 6)
HELD_OUT = (3, 1)


def _fold() -> np.ndarray:
    table = tk.folded()
    table[0x09:0x0E] = 0x20
    return table


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each character of UTF-8 bytes as the number that its bytes make, and the offsets of texts in characters."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(data)))
    out = data[at].astype(np.uint64)
    for k in (1, 2, 3):
        wide = np.flatnonzero(size > k)
        if len(wide):
            out[wide] |= data[at[wide] + k].astype(np.uint64) << np.uint64(8 * k)
    return out, np.searchsorted(at, offsets)


def _ids(chars: np.ndarray, bits: int, orders: tuple[int, ...]):
    """For each order, the feature id of the run that starts at each character."""
    key = chars
    for k in range(2, max(orders) + 1):
        if len(chars) < k:
            return
        key = key[:-1] * np.uint64(0xD1B54A32D192ED03) + chars[k - 1 :]
        if k in orders:
            yield k, tk.mix64(key + np.uint64(k)) >> np.uint64(64 - bits)


def featurise(bits: int, orders: tuple[int, ...]):
    """Ids of the n-grams that a text holds, with value 1."""

    def run(column):
        data, offsets = tk.raw(column)
        chars, offsets = characters(_fold()[data], offsets)
        for a, b in zip(offsets[:-1], offsets[1:]):
            ids = [x for _, x in _ids(chars[a:b], bits, orders)]
            ids = np.unique(np.concatenate(ids)) if ids else np.zeros(0, np.uint64)
            yield ids, np.ones(len(ids))

    return run


def log_ratios(rows, size: int, smooth: float = 50.0) -> np.ndarray:
    """log(P(feature | 1) / P(feature | 0)) from counts of documents, each class with its part of ``smooth`` further ones.

    A feature that few documents hold so has a ratio near 0.
    """
    n = np.array([1e-9, 1e-9])
    count = np.zeros((2, size))
    for ids, _, y in rows:
        count[int(y > 0.5), ids] += 1
        n[int(y > 0.5)] += 1
    q, p = (count + smooth * (n / n.sum())[:, None]) / n[:, None]
    return np.log(p) - np.log(q)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 8_000, max_bytes: int = 32 << 20, bits: int = 20, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Scoring weights (the last one is the intercept) from at most ``max_rows`` labelled documents with at most ``max_bytes`` of text."""
    sample = linear.labelled_sample(docs, labels, label, max_rows, max_bytes)

    def train(rows):
        r = log_ratios(rows, 1 << bits)
        w = linear.ftrl(rows, 1 << bits, epochs=4, alpha=0.1, l1=6.0, l2=1.0, scale=r)
        w[:-1] *= r
        return w

    return linear.fit(linear.features(sample, featurise(bits, orders)), train)


def _score(weights, bits, orders, names):
    def run(batches):
        w = weights.value
        weighs = w[:-1] != 0
        fold = _fold()
        for batch in tk.steps(batches, "text"):
            data, offsets = tk.raw(tk.column(batch, "text"))
            chars, offsets = characters(fold[data], offsets)
            n = batch.num_rows
            hits = [np.zeros(0, np.int64)]
            for k, ids in _ids(chars, bits, orders):
                at = np.flatnonzero(weighs[ids])
                doc = np.searchsorted(offsets, at, "right") - 1
                at, doc = (x[at + k <= offsets[doc + 1]] for x in (at, doc))
                hits.append((doc << bits) | ids[at].astype(np.int64))
            key = np.unique(np.concatenate(hits))
            total = np.bincount(key >> bits, w[key & ((1 << bits) - 1)], n)
            yield pa.RecordBatch.from_arrays([*(tk.column(batch, c) for c in names), pa.array(linear.sigmoid(total + w[-1]))], names=[*names, "score"])

    return run


def score_toxicity(docs: DataFrame, weights: np.ndarray, bits: int = 20, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """The rows of docs with a column score, the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    return linear.with_score(docs, lambda names: _score(sent, bits, orders, names))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string").alias("text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = linear.crc_mod(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]
    scored = score_toxicity(docs, fit_toxicity(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
