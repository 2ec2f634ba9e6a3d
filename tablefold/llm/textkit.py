"""Vectorised word splitting and hashing of Arrow text columns, used inside Spark tasks.

Texts are handled as UTF-8 bytes: every separator of the operators is an ASCII
byte, so a byte scan splits exactly as a scan of characters would. Null texts
count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step works on; a longer text makes a step of its own.
STEP_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def space_classes() -> np.ndarray:
    """Byte classes with words as runs of anything but the six ASCII white spaces."""
    table = np.ones(256, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


def alnum_classes(punctuation: bool = False) -> np.ndarray:
    """Words as runs of ASCII letters, digits and all bytes over 0x7F; runs of other marks as class 2 if asked for."""
    table = np.zeros(256, np.uint8)
    if punctuation:
        table[:] = 2
        table[[0x20, *range(0x09, 0x0E)]] = 0
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = 1
    return table


def folded() -> np.ndarray:
    """Bytes with A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, which spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, mult: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier modulo 2**64, and of its inverse."""
    have = _POWERS.get(mult)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for m in (mult & _M64, pow(mult, -1, 1 << 64)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[mult] = (out[0], out[1])
    return have[0][:n], have[1][:n]


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, mult: int = _MULT) -> np.ndarray:
    """A 64-bit hash of each values[start:end], which depends on those values and their order only."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(values) + 1, mult)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts])


class Texts:
    """The words of a slice of a text column, as flat arrays.

    ``offsets`` are byte offsets of texts, ``starts`` and ``ends`` of words;
    words of text i are ``first[i]:first[i + 1]``.
    """

    def __init__(self, column: pa.Array, classes: np.ndarray, fold: np.ndarray | None = None):
        self.data, self.offsets = raw(column)
        if fold is not None:
            self.data = fold[self.data]
        kind = classes[self.data]
        n = len(kind)
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        cut[1:n] |= kind[1:] != kind[:-1]
        cuts = np.flatnonzero(cut)
        if n:
            starts, ends = cuts[:-1], cuts[1:]
            keep = kind[starts] != 0
            self.starts, self.ends = starts[keep], ends[keep]
            self.kinds = kind[self.starts]
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.kinds = np.zeros(0, np.uint8)
        self.first = np.searchsorted(self.starts, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return range_hashes(_BYTE[self.data], self.starts, self.ends)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words and hashes of all runs of k words inside one text."""
        starts = gram_starts(self.first, k)
        return starts, range_hashes(hashes, starts, starts + k, 0xC2B2AE3D27D4EB4F)


def gram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Positions in a flat word array at which k words of one text follow."""
    many = np.maximum(np.diff(first) - k + 1, 0)
    return np.repeat(first[:-1], many) + ranges(many)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. c-1 for each count c, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def as_long(hashes: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed longs that Spark has."""
    return hashes.view(np.int64)


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
