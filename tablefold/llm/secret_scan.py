"""Secret scan that links the parts of a credential; SQL functions only.

Strong spans (kinds assign, access and hex) are reported wherever they stand.
Weak candidates are access identifiers (kind identifier), random-looking or
announced values (kind value) and endpoints (kind endpoint): each would be
noise by itself, and is reported only if a complementary part stands within
``scope`` characters of the same text: a secret (assign, hex, value) with an
identifier or endpoint (access, identifier, endpoint). Parts meet in an
interval join over cells of ``scope`` characters: a secret stands in all cells
that it touches with ``scope`` characters more on both sides, a partner in those
of its own span, so that two parts in scope share a cell however long they are.

Positions are code points, ends exclusive. Null and empty texts have no spans,
and texts and matches may be of any length. Every row gives one row; rows that
repeat doc_id and text get equal spans, rows that repeat a doc_id with another
text their own. Spans that tie in their start come by kind. Other columns are
ignored, or handed on whole by ``redact_secrets``, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import checkpointed

#: kind: (pattern, group that has a least length, that length) (fixed values for the first three)
STRONG = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "identifier": (r"""\b(?i:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 1, 3),
    "value": (r"[A-Za-z0-9+/]{32,}={0,2}", 0, 32),
    "endpoint": (r"(?:https?|ftp|jdbc:\w+|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])(?::[0-9]{2,5})?", 0, 7),
}
KINDS = [*STRONG, *WEAK]
#: What a match of a kind must hold besides: a value has a digit, a small and a capital letter somewhere.
HOLDS = {"value": ("[0-9]", "[a-z]", "[A-Z]")}
SECRETS = ("assign", "hex", "value")
_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _spans(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of a kind: what a split leaves between them gives their places."""
    pattern, group, least = (STRONG | WEAK)[kind]
    regex = F.lit(pattern)
    hits = F.regexp_extract_all(text, regex, F.lit(0))
    long = F.regexp_extract_all(text, regex, F.lit(group))
    gaps = F.split(text, pattern, -1)
    state = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("found"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"))
        counts = F.length(x["long"]) >= least
        for some in HOLDS.get(kind, ()):
            counts = counts & F.regexp_like(x["hit"], F.lit(some))
        return F.struct(
            end.alias("at"),
            F.when(counts, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"),
        )

    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), long.alias("long"))
    found = F.aggregate(zipped, state, step, lambda acc: acc["found"])
    return F.when(F.regexp_like(text, regex), found).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _joined(spans: Column) -> Column:
    """kind:start:end of all spans by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def find_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """doc_id, text_hash, base and spans for each row of docs; both are arrays of (start, rank in KINDS, end)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = docs.select(
        F.col("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.concat(*(_spans(text, k) for k in STRONG)).alias("base"),
        F.concat(*(_spans(text, k) for k in WEAK)).alias("weak"),
    )
    parts = checkpointed(parts)  # small: the texts stay behind, and are matched once
    each = (
        parts.where(F.size("weak") > 0)
        .select("doc_id", "text_hash", F.explode(F.concat("base", "weak")).alias("s"))
        .select("doc_id", "text_hash", "s", F.col("s.rank").isin([KINDS.index(k) for k in SECRETS]).alias("secret"))
        .distinct()
    )

    def over_cells(spans, reach):
        """Each span once for every cell that it touches when ``reach`` longer on both sides; first is the first of them."""
        cell = lambda at: F.floor(at / scope).cast("int")
        wide = spans.withColumn("first", cell(F.col("s.start") - reach))
        return wide.withColumn("cell", F.explode(F.sequence("first", cell(F.col("s.end") + reach))))

    left = over_cells(each.where("secret"), scope).alias("l")
    right = over_cells(each.where("NOT secret"), 0).alias("r")
    # two spans may share many cells, and meet in the first of those
    once = F.col("l.cell") == F.greatest("l.first", "r.first")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash")) & (F.col("l.cell") == F.col("r.cell")) & once
    # close to each other, and not one within the other
    close = (F.col("l.s.start") - F.col("r.s.end") <= scope) & (F.col("r.s.start") - F.col("l.s.end") <= scope)
    apart = (F.col("l.s.start") >= F.col("r.s.end")) | (F.col("r.s.start") >= F.col("l.s.end"))
    linked = (
        left.join(right, same & close & apart)
        .select(F.col("l.doc_id").alias("doc_id"), F.col("l.text_hash").alias("text_hash"), F.explode(F.array("l.s", "r.s")).alias("s"))
        .where(F.col("s.rank") >= len(STRONG))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("s").alias("added"))
    )
    on = parts["doc_id"].eqNullSafe(linked["doc_id"]) & (parts["text_hash"] == linked["text_hash"])
    none = F.expr(f"cast(array() as {_SPANS})")
    return parts.join(linked, on, "left").select(
        parts["doc_id"], parts["text_hash"], F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans")
    )


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact_secrets(docs: DataFrame, scope: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs, with secrets in the texts replaced; n_chars, if there is one, follows."""
    found = find_secrets(docs.select("doc_id", "text"), scope).where(F.size("spans") > 0)
    found = found.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("same")).agg(F.first("spans").alias("spans"))
    # the row goes in a struct, so that no name of docs meets one of these
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
    both = keyed.join(found, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("same")), "left")
    hit = F.col("spans").isNotNull()
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    text = columns["text"] = F.when(hit, _redacted(columns["text"], F.col("spans"), mark)).otherwise(columns["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(hit, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return both.select(*(c.alias(name) for name, c in columns.items()))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
