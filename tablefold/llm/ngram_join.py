"""Join of documents whose word n-gram sets have a Jaccard similarity of a threshold or more.

An LSH forest: each of ``trees`` trees holds a label of ``depth`` MinHash values
(two bytes of each) for each text, and is the prefix trie of its labels. Texts
meet in a tree if they stand below a common open node. All nodes of full depth
are open; then the prefixes that a text is matched by are shortened, a value at a
time and in all its trees, until two texts at the threshold miss each other with
a chance of 1 - ``recall`` at most: the product of 1 - threshold**length over the
trees. A crowded node, of more than ``crowd`` texts, is passed over: its texts
keep longer prefixes in that tree and make up for them by shorter ones in their
other trees, down to ``least_depth``. Texts that can't reach the recall in that
way open their crowded nodes too. So prefixes differ from text to text with what
the tries hold, and the recall does not. Lengths follow from the size of nodes
far above a pair's own, so that a partner's presence doesn't decide on them.

Copies (texts of one n-gram set) are one node of the search. Common nodes are
kept as one edge from each text to the least below it, never as pairs; their
components are where links can be. Pairs that meet are compared exactly, on
whole n-gram sets: in components of up to ``block_grams`` n-grams and
``block_texts`` texts at once, several components to a group; larger components,
which chains of weak matches can make, are compared bucket by bucket, a large
bucket in blocks with each pair of blocks a group of its own, and a pair counts
in the first tree in which it meets. Either way just the pairs that meet in some
tree are compared. Only counts of links and a spanning forest of them leave a
group, so that a group of copies never makes rows in its square.

Words are runs of anything but ASCII white space, as written; a text of fewer
than n words is one n-gram of its words. Null and empty texts, and rows with a
null doc_id, link to nothing: their class is their own doc_id. Rows that repeat
doc_id and text are copies of each other, and so are rows that repeat a doc_id
with another text if their n-grams are equal; if not, they are texts of their
own. Texts of any length are compared whole. An empty table gives an empty
result; other columns are ignored, or handed on whole by ``one_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .shipping import checkpointed


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, of at most ``depth`` values, at which texts at the threshold reach the recall if no node is crowded."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    raise ValueError("no prefix reaches that recall: more trees are needed")


def gram_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams."""
    words = tk.Texts(column, tk.space_classes())
    hashes = words.hashes()
    starts, grams = words.grams(hashes, n)
    first = np.searchsorted(starts, words.first)
    for i in range(len(words.first) - 1):
        if first[i] < first[i + 1]:
            yield np.unique(grams[first[i] : first[i + 1]])
        else:
            a, b = words.first[i : i + 2]
            yield tk.range_hashes(hashes, np.array([a]), np.array([b]), 0xC2B2AE3D27D4EB4F) if a < b else np.zeros(0, np.uint64)


def _digest(flat: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    """Two sums of 64 bits over each n-gram set, by which equal sets are known."""
    return [tk.as_long(np.add.reduceat(tk.mix64(flat ^ np.uint64(c)), cut)) for c in (0x1234567, 0x89ABCDEF01)]


def _sign(n: int, trees: int, depth: int):
    rng = np.random.default_rng(20240501)
    mult = rng.integers(0, 1 << 63, trees * depth, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, trees * depth, np.uint64)

    def run(batches):
        for batch in tk.steps(batches, "text"):
            sets = list(gram_sets(tk.column(batch, "text"), n))
            size = np.array([len(s) for s in sets])
            full = np.flatnonzero(size)
            if not len(full):
                continue
            flat = np.concatenate(sets)
            cut = np.concatenate([[0], np.cumsum(size[full])[:-1]])
            values = np.empty((len(full), trees * depth), ">u2")
            for i in range(trees * depth):
                values[:, i] = (tk.mix64(np.minimum.reduceat(flat * mult[i] + add[i], cut)) >> np.uint64(48)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    *(tk.column(batch, c).take(pa.array(full)) for c in ("doc_id", "text_hash")),
                    pa.array(size[full].astype(np.int32)),
                    *(pa.array(d) for d in _digest(flat, cut)),
                    pa.array([row.tobytes() for row in values], pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_grams", "d1", "d2", "labels"],
            )

    return run


_PLACES = "array<struct<bucket:long,tree:int,parts:int>>"


def _sets(n: int):
    def run(batches):
        for batch in tk.steps(batches, "text"):
            sets = list(gram_sets(tk.column(batch, "text"), n))
            size = np.array([len(s) for s in sets])
            own = np.zeros(len(sets), bool)
            full = np.flatnonzero(size)
            if len(full):  # a doc_id may have other texts, too
                cut = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                own[full] = _digest(np.concatenate(sets), cut)[0] == tk.column(batch, "d1").to_numpy()[full]
            at = np.flatnonzero(own)
            if len(at):
                kept = [tk.column(batch, c).take(pa.array(at)) for c in ("node", "root", "copies", "keys", "places")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, tk.lists(pa.array(tk.as_long(np.concatenate([sets[i] for i in at]))), size[at])], names=["node", "root", "copies", "keys", "places", "grams"]
                )

    return run


def shared(sets: list[np.ndarray], cut: int = 0, step: int = 1 << 23) -> np.ndarray:
    """How many elements each two sets share: each of the first ``cut`` with each of the others, or, without, all with all."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[value] > 1
    _, value = np.unique(value[keep], return_inverse=True)
    order = np.argsort(value, kind="stable")
    owner, value = owner[keep][order], value[order]
    total = np.zeros((cut or n, n - cut), np.float32)
    step = min(4096, max(64, step // n))
    for low in range(0, int(value.max(initial=-1)) + 1, step):
        a, b = np.searchsorted(value, [low, low + step])
        has = np.zeros((n, step), np.float32)
        has[owner[a:b], value[a:b] - low] = 1
        total += has[: cut or n] @ has[cut:].T
    return total


def _links(pdf: pd.DataFrame, threshold: float) -> list[tuple[int, int, int, int]]:
    """(node, linked node or -1, linked texts, linked documents) inside one component, or a bucket or two of its blocks."""
    lo, hi, tree = pdf["lo"].iat[0], pdf["hi"].iat[0], pdf["tree"].iat[0]
    pdf = pdf.drop_duplicates("node").sort_values(["own", "node"])
    # of two blocks, each text of one is compared with each of the other; pairs inside a block have a group of their own
    cut = int((pdf["own"] == lo).sum()) if lo != hi else 0
    if lo != hi and cut in (0, len(pdf)):
        return []
    node, copies = pdf["node"].to_numpy(), pdf["copies"].to_numpy()
    sets = [np.asarray(g, np.int64) for g in pdf["grams"]]
    size = np.array([len(s) for s in sets], np.float64)
    left, right = slice(0, cut or len(node)), slice(cut, len(node))
    both = shared(sets, cut)
    linked = np.empty(both.shape, bool)
    for a in range(0, len(both), 512):
        part = both[a : a + 512].astype(np.float64)
        linked[a : a + 512] = part >= threshold * (size[left][a : a + 512, None] + size[right] - part) - 1e-6
    if not cut:
        np.fill_diagonal(linked, False)
    keys = np.stack(pdf["keys"].to_list())
    if tree < 0:  # a component: pairs that meet in some tree
        meet = np.zeros(linked.shape, bool)
        for t in range(keys.shape[1]):
            meet |= keys[left, t][:, None] == keys[right, t]
        linked &= meet
    for t in range(tree):  # a bucket: pairs that meet in an earlier tree are compared there
        linked &= keys[left, t][:, None] != keys[right, t]
    sides = [(node[left], copies[right], linked), (node[right], copies[left], linked.T)][: 2 if cut else 1]
    out = [(int(r[i]), -1, int(has[i].sum()), int(c[has[i]].sum())) for r, c, has in sides for i in np.flatnonzero(has.any(1))]
    # a spanning forest of the links, by search from the least member of each part
    seen = np.zeros(len(node), bool)
    for i in np.argsort(node):
        front = [] if seen[i] else [i]
        seen[i] = True
        while front:
            at = front.pop()
            if cut and at >= cut:
                new = np.flatnonzero(linked[:, at - cut] & ~seen[left])
            else:
                new = cut + np.flatnonzero(linked[at] & ~seen[right])
            seen[new] = True
            front += new.tolist()
            out += [(int(node[j]), int(node[i]), 0, 0) for j in new]
    return out


def _verify(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("root", sort=False):  # a bucket's texts are of one component
            if len(part) > 1:
                out += _links(part, threshold)
        return pd.DataFrame(out, columns=["node", "other", "texts", "documents"])

    return run


def _key(level) -> Column:
    """The trie node at a level above a label, as a number."""
    return F.xxhash64("tree", F.substring("label", 1, 2 * level) if isinstance(level, int) else F.expr(f"substring(label, 1, 2 * {level})"))


def forest(texts: DataFrame, threshold: float, trees: int, depth: int, recall: float, crowd: int, least_depth: int = 3) -> DataFrame:
    """(node, tree, bucket) for each tree in which a text of (node, labels) stands below an open node that others may share.

    bucket names the highest open node above the text in that tree.
    """
    usual = prefix_length(threshold, trees, depth, recall)
    least_depth = min(least_depth, usual)
    label = F.struct(F.col("t").alias("tree"), F.expr(f"substring(labels, t * {2 * depth} + 1, {2 * depth})").alias("label"))
    rows = texts.select("node", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t"), "labels").select("node", label.alias("x")).select("node", "x.*")
    # texts alone below their shortest prefix meet nobody in that tree
    floor = rows.withColumn("floor", _key(least_depth))
    rows = checkpointed(floor.join(floor.groupBy("floor").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "floor").drop("floor"))
    path = rows.select("node", "tree", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), _key(k).alias("bucket")) for k in range(least_depth, depth + 1)))).alias("x"))
    path = path.select("node", "tree", "x.*")
    crowded = checkpointed(path.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("bucket"))
    if crowded.isEmpty():  # all texts shorten alike
        return rows.select("node", "tree", _key(usual).alias("bucket"))
    deepest = path.join(crowded, "bucket").groupBy("node", "tree").agg(F.max("level").alias("crowded"))  # nodes above a crowded one are crowded
    length = lambda k: f"pow({threshold}D, greatest({k}, least({depth}, c + 1)))"
    miss = lambda k: f"pow(1 - pow({threshold}D, {k}), {trees} - size(cs)) * aggregate(cs, 1D, (m, c) -> m * (1 - {length(k)}))"
    enough = [F.when(F.expr(f"{miss(k)} <= {1 - recall}D"), F.lit(k)) for k in range(depth, least_depth - 1, -1)]
    lengths = deepest.groupBy("node").agg(F.collect_list("crowded").alias("cs")).select("node", F.coalesce(*enough, F.lit(0)).alias("length"))
    asked = rows.join(lengths, "node", "left").join(deepest, ["node", "tree"], "left")
    passed_over = F.expr(f"greatest(length, least({depth}, crowded + 1))")
    level = F.when(F.col("length").isNull() | (F.col("length") == 0), usual).when(F.col("crowded").isNull(), F.col("length")).otherwise(passed_over)
    opened = asked.withColumn("level", level).select(_key("level").alias("bucket")).distinct()
    return path.join(opened, "bucket").groupBy("node", "tree").agg(F.min_by("bucket", "level").alias("bucket"))


def _similar(docs: DataFrame, n: int, threshold: float, trees: int, depth: int, recall: float, crowd: int, block_grams: int, block_texts: int) -> DataFrame:
    """(doc_id, text_hash, class_id, first, copy_of, n_copies, n_text_links, n_links) of the rows with words and a doc_id.

    first is (doc_id, text_hash) of the least row of the class.
    """
    signed = checkpointed(
        docs.where(F.col("doc_id").isNotNull()).mapInArrow(_sign(n, trees, depth), "doc_id long, text_hash long, n_grams int, d1 long, d2 long, labels binary")
    )
    row = F.struct("doc_id", "text_hash")
    texts = checkpointed(
        signed.groupBy("d1", "d2")
        .agg(F.min(row).alias("least"), F.count("*").alias("copies"), F.greatest(F.first("n_grams"), F.lit(block_grams // block_texts)).alias("weight"), F.first("labels").alias("labels"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    met = checkpointed(forest(texts.select("node", "labels"), threshold, trees, depth, recall, crowd))
    least = met.groupBy("bucket").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = components(met.join(least, "bucket").select(F.col("node").alias("u"), "v"))

    keys = met.join(near.select("node"), "node", "left_semi").groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("tree", "bucket"))).alias("in_tree"))
    # a tree in which a text meets nobody has a key of its own
    alone = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.try_element_at("in_tree", t), F.xxhash64(F.lit("alone"), "node", t)))
    node = checkpointed(near.join(texts.select("node", "d1", "least", "copies", "weight"), "node").join(keys.select("node", alone.alias("keys")), "node"))
    sized = node.groupBy("root").agg((F.sum("weight") > block_grams).alias("large"))
    node = node.join(sized, "root")
    total = node.where("NOT large").agg(F.sum("weight")).first()[0] or 0
    groups = max(1, math.ceil(8 * total / block_grams))  # each holds several components, or a large one
    place = lambda bucket, tree, parts: F.struct(bucket.cast("long").alias("bucket"), tree.cast("int").alias("tree"), parts.cast("int").alias("parts"))
    whole = place(-1 - F.pmod(F.xxhash64("root"), F.lit(groups)), F.lit(-1), F.lit(1))
    in_bucket = node.where("large").select("node", "weight", F.posexplode("keys").alias("tree", "bucket"))
    buckets = in_bucket.groupBy("bucket").agg(F.count("*").alias("n"), F.ceil(F.sum("weight") / block_grams).alias("parts")).where("n > 1")
    places = in_bucket.join(buckets, "bucket").groupBy("node").agg(F.collect_list(place(F.col("bucket"), F.col("tree"), F.col("parts"))).alias("apart"))
    placed = node.join(places, "node", "left").select(
        "node", "root", "copies", "keys", "d1", F.col("least.doc_id").alias("id"), F.col("least.text_hash").alias("hash"), F.when(F.col("large"), F.col("apart")).otherwise(F.array(whole)).alias("places")
    )
    sets = docs.join(placed, (docs["doc_id"] == placed["id"]) & (docs["text_hash"] == placed["hash"])).select("node", "root", "copies", "keys", "places", "d1", "text")
    sets = sets.mapInArrow(_sets(n), f"node long, root long, copies long, keys array<long>, places {_PLACES}, grams array<long>")
    grouped = (
        sets.select("node", "root", "copies", "keys", "grams", F.explode("places").alias("at"))
        .select("node", "root", "copies", "keys", "grams", "at.*")
        .withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("lo", F.least("own", "with"))
        .withColumn("hi", F.greatest("own", "with"))
        .groupBy("bucket", "tree", "lo", "hi")
    )
    found = checkpointed(grouped.applyInPandas(_verify(threshold), "node long, other long, texts long, documents long"))

    linked = components(found.where("other >= 0").select(F.col("node").alias("u"), F.col("other").alias("v")))
    counts = found.where("other < 0").groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    facts = texts.select("d1", "d2", "node", "least", "copies").join(linked, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = facts.where("root <> node OR texts > 0").groupBy("root").agg(F.min("least").alias("first"))
    facts = facts.join(firsts, "root", "left").withColumn("first", F.coalesce("first", "least")).drop("root", "node")
    return signed.select("doc_id", "text_hash", "d1", "d2").join(facts, ["d1", "d2"]).select(
        "doc_id",
        "text_hash",
        F.col("first.doc_id").alias("class_id"),
        "first",
        F.col("least.doc_id").alias("copy_of"),
        F.col("copies").alias("n_copies"),
        F.coalesce("texts", F.lit(0)).alias("n_text_links"),
        (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )


def _has_words() -> Column:
    return F.regexp_like(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]"))


def _texts_of(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def similar_documents(
    docs: DataFrame,
    n: int = 5,
    threshold: float = 0.8,
    trees: int = 20,
    depth: int = 8,
    recall: float = 0.9999,
    crowd: int = 1_000,
    block_grams: int = 400_000,
    block_texts: int = 4_000,
) -> DataFrame:
    """One row per row of docs: doc_id, class_id, copy_of, n_copies, n_text_links, n_links.

    class_id is the least doc_id that links lead to; copy_of the least doc_id
    of the same n-gram set; n_text_links the other n-gram sets that are linked,
    n_links all other documents that are (copies among them). ``block_grams``
    and ``block_texts`` bound what one comparison holds in memory.
    """
    docs = _texts_of(docs)
    linked = _similar(docs, n, threshold, trees, depth, recall, crowd, block_grams, block_texts).drop("text_hash", "first")
    lone = docs.where(F.col("doc_id").isNull() | ~_has_words())
    zero = F.lit(0).cast("long")
    return linked.unionAll(lone.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), zero + 1, zero, zero))


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 20, depth: int = 8, recall: float = 0.9999, crowd: int = 1_000, block_grams: int = 400_000, block_texts: int = 4_000) -> DataFrame:
    """Whole rows of docs, one of each class: that of the least doc_id. Rows that link to nothing stay.

    Of rows that repeat doc_id and text the least by all columns that can be ordered stays.
    """
    texts = _texts_of(docs)
    similar = _similar(texts, n, threshold, trees, depth, recall, crowd, block_grams, block_texts).select("doc_id", "text_hash", (F.col("first") == F.struct("doc_id", "text_hash")).alias("stays"))
    similar = similar.unionAll(texts.where(~_has_words()).select("doc_id", "text_hash", F.lit(True)))
    rows = similar.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.first("stays").alias("stays"), F.count("*").alias("n"))
    judged = rows.where("NOT stays OR n > 1")
    # the row goes in a struct, so that no name of docs meets one of these
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    both = keyed.join(judged, (F.col("row.doc_id").cast("long") == F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    left = both.where("stays IS NULL OR stays")
    again = left.where("n > 1").groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.where("n IS NULL OR n = 1").select("row.*").unionAll(again.select("row.*"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
