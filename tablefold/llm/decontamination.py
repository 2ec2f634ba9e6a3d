"""Benchmark decontamination with a BM25 index of test items, pruned by block maxima.

Test items are indexed by word (runs of letters and digits, lower-cased); a
posting holds the item's BM25 impact as a share of the score that the item
reaches against itself, so scores lie in 0..1 for every item. Items stand in up
to BLOCKS blocks, and each term keeps its largest impact in each block.

Every passage of every text is a query: windows of twice the longest item's
words (of the items' class of lengths, see below), one half apart, so that each
item's whole length fits into some window.
As in block-max WAND, a block of items is skipped for a passage whose terms'
block maxima sum to less than the threshold; the items of the other blocks are
scored in full, and all above the threshold are retrieved. These steps run for
many passages at once. A retrieved item counts only if the
text around holds most of its question's and its answer's word trigrams (the
answer is the item's last quarter), or a near copy of it: all words but one in
eight, about, in their places but for so many shifts, among them most of the
question's and of the answer's. One edit breaks up to three trigrams, which can
be all that a short part has, but a single word; overlaps are shares of trigrams
in the first case, of words in the second. Items under six words have no near copies.

What BM25 weighs by (how many items hold a word, the number of items and their
mean length) is counted over the whole benchmark, as DataFrames, before items are
dealt into shards of about ``shard_bytes`` of text and of one class of lengths (up
to 8, 64, 512 words and so on, which is half a passage's width for that class), so
that a very long item widens only the passages that are held against its own
class. An item's score is the same whatever the shards and the other items' lengths. Several shards are
broadcast to one pass over the documents.

Null and empty texts match nothing; null or empty items are left out. Every
document row is judged for itself, so repeated rows get repeated results, as do
repeated items; items of one id but different texts are items of their own, and
their best match is given. Texts of any length are searched whole. An empty
benchmark leaves all documents, an empty table of documents is left empty; other
columns are ignored, or handed on whole by ``without_benchmark``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shipping import checkpointed

BLOCKS = 64
#: Bytes of item text in one broadcast index, and of those that one pass over the documents searches.
SHARD_BYTES, PASS_BYTES = 2 << 20, 32 << 20


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(words))
    at = np.arange(len(words) - k + 1)
    return tk.range_hashes(words, at, at + k, 0xC2B2AE3D27D4EB4F)


def _csr(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in a sorted array of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))


def _expand(begin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all entries of the given rows, and which of ``rows`` each belongs to."""
    many = begin[rows + 1] - begin[rows]
    return np.repeat(begin[rows], many) + tk.ranges(many), np.repeat(np.arange(len(rows)), many)


def _words(column: pa.Array) -> tk.Texts:
    return tk.Texts(pc.utf8_lower(column), tk.alnum_classes())


class Index:
    """An inverted index of items with block maxima.

    ``weights`` are the whole benchmark's number of items, their mean length, and word hashes with the number of
    items that hold each; without, they are taken from the items given. ``stride`` is half a passage's words, by default
    those of the longest item.
    """

    def __init__(self, ids: list, texts: list[str], weights: tuple | None = None, stride: int | None = None, k1: float = 1.2, b: float = 0.75, answer_share: float = 0.25):
        t = _words(pa.array(texts, pa.string()))
        words, count = t.hashes(), t.counts
        n = len(texts)
        self.ids = np.array(ids, np.int64)
        self.stride = stride or int(count.max(initial=1))
        doc = t.doc_of_word()
        self.terms, term = np.unique(words, return_inverse=True)
        key, tf = np.unique(term * max(n, 1) + doc, return_counts=True)
        term, item = key // max(n, 1), key % max(n, 1)
        if weights is None:
            weights = n, count.mean() if n else 1.0, self.terms, np.bincount(term, minlength=len(self.terms))
        of_all, mean, known, held_by = weights
        df = held_by[np.searchsorted(known, self.terms)]
        idf = np.log1p((of_all - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * count[item] / max(1.0, mean))
        impact = idf[term] * tf * (k1 + 1) / (tf + norm)
        impact /= np.bincount(item, impact, n)[item]
        self.begin, self.item, self.impact = _csr(term, len(self.terms)), item, impact
        self.block_items = max(4, -(-n // BLOCKS))
        self.block_max = np.zeros((len(self.terms), n // self.block_items + 1), np.float32)
        np.maximum.at(self.block_max, (term, item // self.block_items), impact)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.terms >> np.uint64(48)] = True
        self.parts = []
        for i in range(n):
            own = words[t.first[i] : t.first[i + 1]]
            cut = len(own) - max(1, int(len(own) * answer_share))
            self.parts.append((np.unique(_grams(own[:cut] if cut else own, 3)), np.unique(_grams(own[cut:], 3)), min(3, max(1, cut)), min(3, len(own) - cut), own, cut))

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that are terms, and the terms."""
        at = np.flatnonzero(self.maybe[words >> np.uint64(48)])
        term = np.searchsorted(self.terms, words[at])
        term[term == len(self.terms)] = 0
        hit = self.terms[term] == words[at]
        return at[hit], term[hit]


def _summed(key: np.ndarray, value: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys whose values sum to ``least`` or more, and the sums."""
    key, at = np.unique(key, return_inverse=True)
    total = np.bincount(at, value, len(key))
    keep = total >= least - 1e-9
    return key[keep], total[keep]


def _near_copy(own: np.ndarray, cut: int, region: np.ndarray, question: float, answer: float) -> tuple[float, float] | None:
    """Shares of the question's and the answer's words in a near copy of an item that the region holds, if it holds one."""
    edits = (len(own) + 2) // 8
    if not edits:
        return None
    order = np.argsort(own, kind="stable")
    low = np.searchsorted(own[order], region, "left")
    many = np.searchsorted(own[order], region, "right") - low
    word = order[np.repeat(low, many) + tk.ranges(many)]
    shift = np.repeat(np.arange(len(region)), many) - word
    by = np.argsort(shift, kind="stable")
    word, shift = word[by], shift[by]
    begin = np.flatnonzero(np.diff(shift, prepend=np.iinfo(np.int64).min))
    end = np.searchsorted(shift, shift[begin] + edits, "right")
    best = None
    for a, b in zip(begin.tolist(), end.tolist()):
        if b - a < len(own) - edits:
            continue
        held = np.unique(word[a:b])
        shares = float((held < cut).sum() / cut), float((held >= cut).sum() / (len(own) - cut))
        if len(held) >= len(own) - edits and shares[0] >= question and shares[1] >= answer:
            best = max(best or shares, shares)
    return best


def search(index: Index, column: pa.Array, threshold: float, question: float, answer: float):
    """(row, item, score, question overlap, answer overlap) of the verified matches in a column of texts."""
    t = _words(column)
    return _search(index, t, t.hashes(), threshold, question, answer)


def _search(index: Index, t: tk.Texts, words: np.ndarray, threshold: float, question: float, answer: float):
    stride = index.stride
    halves = np.maximum(1, -(-t.counts // stride))  # halves of each text; passage j is halves j and j + 1
    half_first = np.concatenate([[0], np.cumsum(halves)])
    at, term = index.lookup(words)
    doc = np.searchsorted(t.first, at, "right") - 1
    half = half_first[doc] + (at - t.first[doc]) // stride
    if not len(at):
        return []
    # block maxima summed over halves, then over passages; a word that repeats counts again, so sums are upper bounds
    cut = np.flatnonzero(np.diff(half, prepend=-1))
    blocks = index.block_max.shape[1]
    bound = np.zeros((half_first[-1] + 1, blocks), np.float32)
    bound[half[cut]] = np.add.reduceat(index.block_max[term], cut, axis=0)
    last = np.zeros(half_first[-1], bool)
    last[half_first[1:] - 1] = True
    bound[:-1][~last] += bound[1:][~last]
    live = np.flatnonzero(bound[:-1] >= threshold - 1e-4)  # passage * blocks + block
    if not len(live):
        return []
    alive = np.zeros(half_first[-1] + 1, bool)
    alive[live // blocks] = True
    # distinct terms of the passages that remain: each word is in the passage of its half and of the one before
    before = half > half_first[doc]
    p = np.concatenate([half, half[before] - 1])
    q = np.concatenate([term, term[before]])
    keep = alive[p]
    pair = np.unique(p[keep] * len(index.terms) + q[keep])
    p, q = pair // len(index.terms), pair % len(index.terms)
    entry, owner = _expand(index.begin, q)
    item = index.item[entry]
    wanted = np.zeros((half_first[-1] + 1) * blocks, bool)
    wanted[live] = True
    inside = wanted[p[owner] * blocks + item // index.block_items]
    entry, owner, item = entry[inside], owner[inside], item[inside]
    found, score = _summed(p[owner] * len(index.ids) + item, index.impact[entry], threshold)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p, i, s in zip((found // len(index.ids)).tolist(), (found % len(index.ids)).tolist(), score.tolist()):
        row = int(np.searchsorted(half_first, p, "right")) - 1
        low = t.first[row] + (p - half_first[row]) * stride
        region = words[max(t.first[row], low - stride) : min(t.first[row + 1], low + 3 * stride)]
        q_set, a_set, q_k, a_k, own, cut = index.parts[i]
        if len(region) < max(q_k, a_k):
            continue
        q_share = float(np.isin(q_set, _grams(region, q_k)).mean())
        a_share = float(np.isin(a_set, _grams(region, a_k)).mean())
        if q_share < question or a_share < answer:
            q_share, a_share = _near_copy(own, cut, region, question, answer) or (-1.0, -1.0)
        if q_share >= 0:
            best[row, i] = max(best.get((row, i), (0.0, 0.0, 0.0)), (s, q_share, a_share))
    return [(row, i, *x) for (row, i), x in sorted(best.items())]


def _item_words(batches):
    """(item, size, words): the distinct word hashes of each item, and how many words it has."""
    for batch in tk.steps(batches, "text"):
        t = _words(tk.column(batch, "text"))
        hashes = t.hashes()
        sets = [np.unique(hashes[a:b]) for a, b in zip(t.first[:-1], t.first[1:])]
        yield pa.RecordBatch.from_arrays(
            [tk.column(batch, "item"), pa.array(t.counts.astype(np.int32)), tk.lists(pa.array(tk.as_long(np.concatenate(sets))), np.array([len(s) for s in sets]))], names=["item", "size", "words"]
        )


def passes(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES, pass_bytes: int = PASS_BYTES):
    """Lists of indexes, each to be searched in one pass over the documents; together they hold the whole benchmark."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where(F.col("item_id").isNotNull() & F.regexp_like("text", F.lit("[0-9A-Za-z\u0080-\uffff]"))).distinct()
    items = items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    words = checkpointed(items.mapInArrow(_item_words, "item long, size int, words array<long>").where("size > 0"))
    known = words.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    if not known["n"]:
        return
    held_by = checkpointed(words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")))
    # items of a length within a factor of eight are one class; a class is dealt into shards by hash
    sized = checkpointed(words.select("item", F.ceil(F.log2("size") / 3).cast("int").alias("length")).join(items, "item").select("item", "item_id", "text", "length"))
    totals = sized.groupBy("length").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy("length").collect()  # a row a power of eight
    held, size = [], 0
    for length, total in ((r["length"], r["bytes"]) for r in totals):
        shards = -(-total // shard_bytes)
        for k in range(shards):
            part = sized.where((F.col("length") == length) & (F.pmod(F.col("item"), F.lit(shards)) == k))
            rows = part.orderBy("item_id", "text").select("item_id", "text").collect()  # shard_bytes, about
            terms = held_by.join(words.join(part.select("item"), "item").select(F.explode("words").alias("word")).distinct(), "word").orderBy("word").collect()
            if rows:
                word = np.array([r["word"] for r in terms], np.int64).view(np.uint64)
                order = np.argsort(word)
                weights = known["n"], known["mean"], word[order], np.array([r["df"] for r in terms], np.int64)[order]
                held.append(spark.sparkContext.broadcast(Index([r["item_id"] for r in rows], [r["text"] for r in rows], weights, 8**length)))
                size += total // shards
                if size >= pass_bytes:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.6, answer: float = 0.6, shard_bytes: int = SHARD_BYTES, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for each item that a document holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = docs.sparkSession.createDataFrame([], schema)
    for held in passes(benchmark, shard_bytes, pass_bytes):

        def run(batches, held=held):
            for batch in tk.steps(batches, "text"):
                best: dict[tuple[int, int], tuple] = {}
                t = _words(tk.column(batch, "text"))
                words = t.hashes()
                for sent in held:
                    for row, item, *shares in _search(sent.value, t, words, threshold, question, answer):
                        key = row, int(sent.value.ids[item])
                        best[key] = max(best.get(key, tuple(shares)), tuple(shares))
                if best:
                    row, item, *shares = map(np.array, zip(*((*k, *v) for k, v in sorted(best.items()))))
                    yield pa.RecordBatch.from_arrays(
                        [tk.column(batch, "doc_id").take(pa.array(row)), pa.array(item), *map(pa.array, shares)],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

        found = found.union(docs.mapInArrow(run, schema))
    return found


def without_benchmark(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.6, answer: float = 0.6, shard_bytes: int = SHARD_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of docs, whole and as they are, whose text holds no item."""
    for held in passes(benchmark, shard_bytes, pass_bytes):

        def run(batches, held=held):
            for batch in tk.steps(batches, "text"):
                clean = np.ones(batch.num_rows, bool)
                t = _words(tk.column(batch, "text"))
                words = t.hashes()
                for sent in held:
                    clean[[h[0] for h in _search(sent.value, t, words, threshold, question, answer)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
