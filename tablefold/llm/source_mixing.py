"""Mixing sources to target weights; SQL functions only.

A source's weight is its share of all tokens raised to an exponent between 0
(all sources alike) and 1 (as they are), normalised. The exponent is bisected
to the least one at which the entropy of the weights is no more than a target
share of that of equal weights, and no source is repeated beyond a limit. So
shares are flattened until their entropy reaches the target, left as they are if
it is above it already, and flattened less where a source would be repeated too
often. Both fall with the exponent, so bisection finds it; a round of it takes
six steps at once, with one pass over the sources that sums for all the
exponents in question. A budget that repeats all sources beyond the limit
whatever the weights is an error.

The weights are realised as block permutations. Documents of a source are dealt
by hash into blocks of about ``block_docs``, and blocks into groups, as many as
a group has blocks. An epoch of a source is all its groups in an order drawn by
hash for that epoch, in each group its blocks, and in each block its documents,
likewise. A source's stream of epochs is cut at its budget, its weight's part of
all tokens wanted: a document is drawn while fewer tokens than that stand before
it. Only sums of groups are ordered in a source, and sums of blocks in a group,
so no task gets a source or all its blocks.

A token is a run of anything but ASCII white space. Null and empty texts have no
tokens; such documents weigh nothing and are drawn with the blocks around them.
A text of any length is one draw. Null sources are one source, the same as ''.
Rows are drawn row by row: repeated rows are drawn each, and rows that tie in
doc_id come by their tokens and a hash of the row; a null doc_id is dealt by that
hash. Sources without tokens are not drawn. Columns named epoch, tokens_before or
mix_order are replaced; no other name clashes. An empty table gives an empty
mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import checkpointed

TOKENS = r"[^\x20\x09-\x0D]+"
STEPS = 50
#: Sources whose figures are broadcast at most; more are joined by salted keys.
BROADCAST_SOURCES = 100_000
SALTS = 64


def _hash(*parts) -> F.Column:
    """A number of 60 bits from the MD5 of the parts, which any SQL engine can compute."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _with_source(rows: DataFrame, figures: DataFrame, few: bool) -> DataFrame:
    """rows with the figures of their source ``_s``."""
    if few:
        return rows.join(F.broadcast(figures), "_s")
    salted = figures.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.col("_h"), F.lit(SALTS)).cast("int")).join(salted, ["_s", "_salt"]).drop("_salt")


def source_weights(sources: DataFrame, budget_ratio: float, entropy_share: float, max_repeats: float) -> DataFrame:
    """sources (_s, docs, tokens) with exponent, weight and budget in tokens; sources without tokens go."""
    if budget_ratio > max_repeats:
        raise ValueError(f"a budget of {budget_ratio} times the tokens repeats some source more than {max_repeats} times, whatever the weights")
    some = sources.where("tokens > 0")
    r = some.agg(F.sum("tokens").alias("total"), F.count("*").alias("n"), F.min("tokens").alias("least")).first()
    total, wanted = r["total"] or 1, math.floor((r["total"] or 1) * budget_ratio)
    share = F.col("tokens") / F.lit(total)

    def sums(exponents: list[float]) -> dict[float, tuple[float, float]]:
        """For each exponent the sums of share ** exponent, and of that times the share's logarithm."""
        each = some.select(share.alias("p"), F.explode(F.array(*map(F.lit, exponents))).alias("x"))
        found = each.groupBy("x").agg(F.sum(F.pow("p", "x")).alias("z"), F.sum(F.pow("p", "x") * F.ln("p")).alias("l"))
        return {s["x"]: (s["z"], s["l"]) for s in found.collect()}  # a row an exponent

    def fits(x: float, z: float, slope: float) -> bool:
        repeats = (r["least"] / total) ** x / z * wanted / r["least"]  # the smallest source is repeated most
        return math.log(z) - x * slope / z <= entropy_share * math.log(r["n"]) + 1e-12 and repeats <= max_repeats

    low, high, steps = 0.0, 1.0, STEPS if r["n"] else 0
    while steps:
        at_once = min(6, steps)
        parts = 1 << at_once
        points = [low + (high - low) * i / parts for i in range(1, parts)]
        found = sums(points)
        good = next((i for i, x in enumerate(points) if fits(x, *found[x])), parts - 1)
        low, high, steps = points[good - 1] if good else low, points[good] if good < parts - 1 else high, steps - at_once
    z = sums([high]).get(high, (1.0, 0.0))[0]
    weight = F.pow(share, F.lit(high)) / F.lit(z)
    return some.select(
        "_s",
        F.col("docs").alias("_docs"),
        F.col("tokens").alias("_tokens"),
        F.lit(high).alias("exponent"),
        weight.alias("weight"),
        F.floor(weight * F.lit(wanted)).alias("budget"),
    )


def _row_hash(docs: DataFrame) -> F.Column:
    """A hash of all cells of a row that have one."""

    def has(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return all(has(f.dataType) for f in kind)
        return has(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)

    return F.xxhash64(F.lit(0), *(F.col(f"`{f.name}`") for f in docs.schema if has(f.dataType)))


def mix_sources(
    docs: DataFrame,
    budget_ratio: float = 1.0,
    entropy_share: float = 0.95,
    max_repeats: float = 4.0,
    block_docs: int = 1000,
    seed: str = "mix",
    tokens: str | None = None,
) -> DataFrame:
    """The columns of docs, once for each time that a row is drawn, with epoch, tokens_before and mix_order.

    tokens_before are the tokens of the source's stream before the row, and
    mix_order their share of the source's budget: ordered by it, the sources are
    interleaved in their weights. ``tokens`` names a column of token counts.
    """
    count = F.col(tokens) if tokens else F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(TOKENS))
    names = [c for c in docs.columns if c not in ("epoch", "tokens_before", "mix_order")]
    same = _row_hash(docs)
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"),  # apart, so that no name of docs meets one of these
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_s"),
        F.coalesce(count, F.lit(0)).cast("long").alias("_n"),
        _hash(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), same.cast("string")))).alias("_h"),
        same.alias("_same"),
    )
    narrow = checkpointed(rows.select("_s", "_n", "_h"))  # for the figures: texts are not read again
    sources = narrow.groupBy("_s").agg(F.count("*").alias("docs"), F.sum("_n").alias("tokens"))
    figures = checkpointed(source_weights(sources, budget_ratio, entropy_share, max_repeats))
    few = figures.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    block = F.pmod(F.col("_h"), F.ceil(F.col("_docs") / block_docs))

    sums = _with_source(narrow, figures, few).groupBy("_s", block.alias("_block")).agg(F.sum("_n").alias("_in_block"))
    # a block's place: its epoch's, its group's and its own tokens before
    group = F.pmod("_block", F.ceil(F.sqrt(F.ceil(F.col("_docs") / block_docs))))
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("budget") - 1) / F.col("_tokens"))))
    figured = _with_source(sums.withColumn("_h", F.col("_block")), figures.where("budget > 0"), few)
    blocks = checkpointed(figured.select("_s", "_block", group.alias("_group"), "_in_block", "_tokens", "budget", epochs.alias("epoch")))
    drawn = lambda c: _hash(F.lit(seed), F.col("_s"), F.col("epoch"), F.lit(c[1:]), F.col(c))
    of_epoch = Window.partitionBy("_s", "epoch").orderBy(drawn("_group"), "_group")
    groups = blocks.groupBy("_s", "epoch", "_group").agg(F.sum("_in_block").alias("_in_group"))
    groups = groups.select("_s", "epoch", "_group", (F.sum("_in_group").over(of_epoch) - F.col("_in_group")).alias("_base"))
    of_group = Window.partitionBy("_s", "epoch", "_group").orderBy(drawn("_block"), "_block")
    before = F.col("epoch") * F.col("_tokens") + F.col("_base") + F.sum("_in_block").over(of_group) - F.col("_in_block")
    placed = (
        blocks.join(groups, ["_s", "epoch", "_group"])
        .withColumn("_before", before)
        .where("_before < budget")
        .groupBy("_s", "_block")
        .agg(F.collect_list(F.struct("epoch", "_before", "budget")).alias("_drawn"))
    )
    inside = Window.partitionBy("_s", "_block").orderBy("_h", "_n", "_same").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        _with_source(rows, figures.select("_s", "_docs"), few)
        .withColumn("_block", block)
        .withColumn("_within", F.sum("_n").over(inside) - F.col("_n"))
        .join(placed, ["_s", "_block"])
        .withColumn("_d", F.explode("_drawn"))
        .withColumn("tokens_before", F.col("_d._before") + F.col("_within"))
        .where("tokens_before < _d.budget")
        .select("_row.*", F.col("_d.epoch").alias("epoch"), "tokens_before", (F.col("tokens_before") / F.col("_d.budget")).alias("mix_order"))
    )


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKENS)).cast("long").alias("n_words"))
    return mix_sources(checkpointed(counted), tokens="n_words")


ORACLE_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_words,
         coalesce(source, '') AS s, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (SELECT s, count(*) AS n_docs, sum(n_words)::BIGINT AS tokens FROM docs GROUP BY s HAVING sum(n_words) > 0),
total AS (SELECT sum(tokens)::BIGINT AS total, count(*) AS n FROM sources),
bisect AS (
  SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (
    SELECT b.i, b.lo, b.hi, (b.lo + b.hi) / 2 AS mid,
           (SELECT -sum(w * ln(w)) <= 0.95 * ln(max(n)) + 1e-12 AND max(w * total / tokens) <= 4
            FROM (SELECT s.tokens, t.n, t.total,
                         pow(s.tokens / t.total, (b.lo + b.hi) / 2) / sum(pow(s.tokens / t.total, (b.lo + b.hi) / 2)) OVER () AS w
                  FROM sources s, total t)) AS ok
    FROM bisect b WHERE b.i < {STEPS})),
figures AS (
  SELECT s.s, s.n_docs, s.tokens,
         floor(pow(s.tokens / t.total, b.hi) / sum(pow(s.tokens / t.total, b.hi)) OVER () * t.total)::BIGINT AS budget
  FROM sources s, total t, bisect b WHERE b.i = {STEPS}),
dealt AS (
  SELECT d.*, f.tokens, f.budget, f.n_docs, d.h % ceil(f.n_docs / 1000)::BIGINT AS block,
         sum(n_words) OVER (PARTITION BY d.s, d.h % ceil(f.n_docs / 1000)::BIGINT ORDER BY d.h ROWS UNBOUNDED PRECEDING) - n_words AS within
  FROM docs d JOIN figures f USING (s) WHERE f.budget > 0),
blocks AS (SELECT s, block, block % ceil(sqrt(ceil(max(n_docs) / 1000)))::BIGINT AS grp, sum(n_words) AS in_block, max(tokens) AS tokens, max(budget) AS budget FROM dealt GROUP BY s, block),
turns AS (SELECT *, unnest(range(0, (budget - 1) // tokens + 1)) AS epoch FROM blocks),
placed AS (
  SELECT s, block, epoch,
         epoch * tokens + sum(in_block) OVER (
           PARTITION BY s, epoch
           ORDER BY ('0x' || substr(md5('mix|' || s || '|' || epoch || '|group|' || grp), 1, 15))::BIGINT, grp,
                    ('0x' || substr(md5('mix|' || s || '|' || epoch || '|block|' || block), 1, 15))::BIGINT, block ROWS UNBOUNDED PRECEDING) - in_block AS before
  FROM turns)
SELECT d.doc_id, d.source, d.n_words, p.epoch, (p.before + d.within)::BIGINT AS tokens_before, ((p.before + d.within) / d.budget)::DOUBLE AS mix_order
FROM dealt d JOIN placed p USING (s, block) WHERE p.before + d.within < d.budget
"""
