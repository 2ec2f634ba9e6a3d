"""Removal of word windows that start in an earlier document, behind a count-min filter.

A window is ``width`` consecutive words of one text. Its anchor is the least
hash among the runs of ``gram`` words inside it, so equal windows have equal
anchors, and one anchor serves some dozen windows in a row (a segment).

1. Each task counts anchors of its segments into a count-min sketch of two rows
   and sends the cells it touched; cells of all tasks are added up. A window
   occurs at most as often as its anchor, so a cell sum is an overestimate of
   the window's count, and a window whose cells hold one is in one place only.
   What is kept of the sum is one bit a cell: two or more, or not.
2. A second pass sends only segments with an anchor that the sketch estimates
   repeated, and these are grouped exactly, by anchor and window hash (128 bits
   together). None is lost: a wider or narrower sketch changes how many unique
   windows are sent, never the result.

Identical segments go as one row from each task, with the least doc_id, before
any shuffle: a passage that a third of all documents share comes down to a row
for each task. Documents are keyed by doc_id and text hash, so
repeated rows get repeated results. Null and empty texts have no words, and texts
of any length are compared whole. Of windows that tie in doc_id, as in repeated
rows or in one text, none removes the other. A null doc_id is larger than any
other: its row never removes words from others. Other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk

CHUNK_BITS = 16
_LAST = np.iinfo(np.int64).max


def _runs_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    best, span = values, 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    rest = width - span
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best


class Segments:
    """Windows of a step of texts, and the segments of windows that share an anchor."""

    MOST = 32  # windows in a segment; longer ones, as periodic texts have, are cut

    def __init__(self, column: pa.Array, width: int, gram: int):
        words = tk.Texts(column, tk.space_classes())
        hashes = words.hashes()
        starts = tk.gram_starts(words.first, width)
        self.counts = words.counts
        if not len(starts):
            self.starts = self.doc = self.pos = self.size = np.zeros(0, np.int64)
            self.windows = self.anchor = np.zeros(0, np.uint64)
            return
        at = np.arange(len(hashes) - gram + 1)  # runs over a text's end too, which no window has
        grams = tk.range_hashes(hashes, at, at + gram, 0xC2B2AE3D27D4EB4F)
        least = _runs_min(grams, width - gram + 1)[starts]
        self.windows = tk.range_hashes(hashes, starts, starts + width, 0xA0761D6478BD642F)
        new = np.ones(len(starts), bool)
        new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(starts)))
        parts = (size + self.MOST - 1) // self.MOST
        if (parts > 1).any():
            inner = tk.ranges(parts) * self.MOST
            size = np.minimum(np.repeat(size, parts) - inner, self.MOST)
            first = np.repeat(first, parts) + inner
        self.starts, self.size = first, size
        self.anchor = least[first]
        word = starts[first]
        self.doc = np.searchsorted(words.first, word, "right") - 1
        self.pos = word - words.first[self.doc]


def cells(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each anchor in the sketch's two rows."""
    shift = np.uint64(64 - bits)
    return [anchor >> shift, tk.mix64(anchor ^ np.uint64(0x5851F42D4C957F2D)) >> shift]


def _count(width: int, gram: int, bits: int):
    def run(batches):
        held: list[list[np.ndarray]] = [[], []]
        total = 0

        def flush():
            for row in (0, 1):
                if not held[row]:
                    continue
                cell, n = np.unique(np.concatenate(held[row]), return_counts=True)
                held[row].clear()
                low = (cell & np.uint64((1 << CHUNK_BITS) - 1)).astype("<u2")
                chunk = (cell >> np.uint64(CHUNK_BITS)).astype(np.int64)
                cut = np.flatnonzero(np.diff(chunk, prepend=-1))
                ends = np.append(cut[1:], len(chunk))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((chunk[cut] * 2 + row).astype(np.int32)),
                        pa.array([low[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                        pa.array([low[a:b][n[a:b] > 1].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                    ],
                    names=["chunk", "once", "more"],
                )

        for batch in tk.steps(batches, "text"):
            anchor = Segments(tk.column(batch, "text"), width, gram).anchor
            for row, cell in enumerate(cells(anchor, bits)):
                held[row].append(cell)
            total += len(anchor)
            if total > 4_000_000:
                yield from flush()
                total = 0
        yield from flush()

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    count = np.zeros(1 << CHUNK_BITS, np.uint8)
    for once, more in zip(pdf["once"], pdf["more"]):
        touched = np.frombuffer(once, "<u2")
        count[touched] = np.minimum(count[touched], 1) + 1
        count[np.frombuffer(more, "<u2")] = 2
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bits": [np.packbits(count > 1).tobytes()]})


def repeated_cells(docs: DataFrame, width: int, gram: int, bits: int) -> list[np.ndarray]:
    """For each row of the merged sketch, a bit a cell that is set where its sum is two or more.

    Its size is fixed by ``bits``: 2 * 2**bits / 8 bytes.
    """
    merged = (
        docs.select("text")
        .mapInArrow(_count(width, gram, bits), "chunk int, once binary, more binary")
        .groupBy("chunk")
        .applyInPandas(_add, "chunk int, bits binary")
    )
    rows = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(2)]
    size = 1 << (CHUNK_BITS - 3)
    for r in merged.toLocalIterator(prefetchPartitions=True):
        at = (r["chunk"] >> 1) * size
        rows[r["chunk"] & 1][at : at + size] = np.frombuffer(r["bits"], np.uint8)
    return rows


class Seen:
    """The least doc_id of each repeated segment that a task has met; its size is bounded by the task's input."""

    def __init__(self):
        self.keys, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def least(self, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Takes in the ids of distinct sorted keys, and returns the least one of each so far."""
        at = np.searchsorted(self.keys, keys)
        inside = at < len(self.keys)
        old = np.zeros(len(keys), bool)
        old[inside] = self.keys[at[inside]] == keys[inside]
        self.ids[at[old]] = np.minimum(self.ids[at[old]], ids[old])
        out = ids.copy()
        out[old] = self.ids[at[old]]
        self.keys = np.insert(self.keys, at[~old], keys[~old])
        self.ids = np.insert(self.ids, at[~old], ids[~old])
        return out


def _candidates(width: int, gram: int, bits: int, sketch):
    def run(batches):
        rows = sketch.value
        seen = Seen()
        for batch in tk.steps(batches, "text"):
            s = Segments(tk.column(batch, "text"), width, gram)
            keep = np.ones(len(s.anchor), bool)
            for row, cell in zip(rows, cells(s.anchor, bits)):
                keep &= (row[(cell >> np.uint64(3)).astype(np.int64)] >> (7 - (cell & np.uint64(7)).astype(np.uint8))) & 1 == 1
            at = np.flatnonzero(keep)
            if not len(at):
                continue
            ids = tk.column(batch, "doc_id")
            order_id = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
            first, size, doc = s.starts[at], s.size[at], s.doc[at]
            # segments of the same windows: all but those of the least doc_id that the task has met are decided here
            whole = tk.range_hashes(s.windows, first, first + size) ^ s.anchor[at]
            known, index = np.unique(whole, return_inverse=True)
            least = np.full(len(known), _LAST)
            np.minimum.at(least, index, order_id[doc])
            met = seen.least(known, least)
            decided = order_id[doc] > met[index]
            sent = np.where(decided, 0, size)
            flat = np.repeat(first, sent) + tk.ranges(sent)
            mask = np.where(decided, (np.int64(1) << size) - 1, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(doc)),
                    tk.column(batch, "text_hash").take(pa.array(doc)),
                    pa.array(s.pos[at].astype(np.int32)),
                    pa.array(tk.as_long(s.anchor[at])),
                    tk.lists(pa.array(tk.as_long(s.windows[flat])), sent),
                    pa.array(mask),
                ],
                names=["doc_id", "text_hash", "pos", "anchor", "windows", "mask"],
            )

    return run


def repeated_windows(docs: DataFrame, width: int = 50, gram: int = 25, cells_per_anchor: int = 8, bits: int | None = None) -> DataFrame:
    """(doc_id, text_hash, removed): the windows of each text that also start in a document of smaller doc_id.

    ``removed`` holds (pos, mask): bit i of mask stands for the window at word pos + i.
    ``bits`` is the sketch's width as a power of two; by default about
    ``cells_per_anchor`` cells for each anchor that the size of the input lets
    expect, within 2**18 and 2**29 cells (128 MB for both rows).
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash")
    )
    if bits is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        anchors = size / 6 / ((width - gram + 2) / 2)
        bits = min(29, max(18, int(np.ceil(np.log2(1 + cells_per_anchor * anchors)))))
    sketch = spark.sparkContext.broadcast(repeated_cells(texts, width, gram, bits))
    sent = texts.mapInArrow(
        _candidates(width, gram, bits, sketch), "doc_id long, text_hash long, pos int, anchor long, windows array<long>, mask long"
    )
    offset = F.posexplode_outer("windows").alias("i", "window")
    order_id = F.coalesce("doc_id", F.lit(_LAST))
    decided = F.col("window").isNull()
    # segments that a task has decided have no window to be compared by, and spread over all tasks
    spread = F.when(decided, F.xxhash64("doc_id", "text_hash", "pos"))
    by = Window.partitionBy("anchor", "window", spread)
    return (
        sent.select("doc_id", "text_hash", "pos", "mask", "anchor", offset)
        .withColumn("least", F.min(order_id).over(by))
        .where(decided | (order_id > F.col("least")))
        .groupBy("doc_id", "text_hash", "pos")
        .agg(F.bit_or(F.when(decided, F.col("mask")).otherwise(F.expr("shiftleft(1L, i)"))).alias("mask"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("pos", "mask")).alias("removed"))
    )


def _cut(width: int):
    def run(batches):
        for batch in tk.steps(batches, "text"):
            texts, removed = raw_texts(tk.column(batch, "text")), tk.column(batch, "removed")
            kept_texts, n_words, n_removed = [], [], []
            for text, spans in zip(texts, removed):
                words = text.split()
                n_words.append(len(words))
                spans = spans.as_py()
                if not spans:
                    n_removed.append(0)
                    kept_texts.append(b" ".join(words))
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                for span in spans:
                    mask, pos = span["mask"], span["pos"]
                    while mask:
                        low = (mask & -mask).bit_length() - 1
                        edge[pos + low] += 1
                        edge[pos + low + width] -= 1
                        mask &= mask - 1
                keep = np.cumsum(edge[:-1]) == 0
                n_removed.append(len(words) - int(keep.sum()))
                kept_texts.append(b" ".join(compress(words, keep.tolist())))
            yield pa.RecordBatch.from_arrays(
                [tk.column(batch, "doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def raw_texts(column: pa.Array) -> list[bytes]:
    data, offsets = tk.raw(column)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def remove_repeats(docs: DataFrame, width: int = 50, **sketch) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    found = repeated_windows(docs, width, **sketch)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    same = texts["doc_id"].eqNullSafe(found["doc_id"]) & (texts["text_hash"] == found["text_hash"])
    both = texts.join(found, same, "left").select(texts["doc_id"], "text", "removed")
    return both.mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept_text string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
