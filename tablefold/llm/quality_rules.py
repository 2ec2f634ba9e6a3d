"""Quality rules under weak supervision; SQL functions only.

Each rule votes good (1), bad (-1) or abstains (0) on counts of a text. The
votes of a document form a pattern, of which there are at most 3 ** rules, so
expectation-maximisation over the whole corpus runs on the pattern counts: in
turn the posterior of each pattern under the prior and the rules' accuracies,
and these from the posteriors. A document is kept by its posterior, not by
passing every rule.

Null and empty texts have no words; texts of any length are counted whole. Every
row gives one row, repeated rows equal ones. A posterior that ties with the
threshold is good. Only doc_id and text are read, so names of other columns don't
matter; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import checkpointed

SPACE = " \t\n\x0b\x0c\r"
WINDOW = 8

#: name: (votes bad if, votes good if), over the columns of ``text_counts``
RULES = {
    "length": ("n_words < 20", "n_words >= 40"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 14 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "letters": ("100 * n_marks > 12 * word_chars", "100 * n_marks <= 8 * word_chars"),
    "lines": ("n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 15 * n_words"),
    "capitals": ("10 * n_capitals > 3 * word_chars", "10 * n_capitals <= word_chars"),
    "runs": ("20 * n_doubled > n_words", "100 * n_doubled <= n_words"),
}


def _bound(value: Column, use) -> Column:
    """``use(value)`` with value computed once: inside lambda functions an expression would run for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(hashes: Column) -> Column:
    """How many words stand in windows of WINDOW words that occur twice or more."""

    def covered(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda s, i: (s["h"] == F.get(ordered, i - 1)["h"]) | (s["h"] == F.get(ordered, i + 1)["h"]))
        places = F.array_sort(F.transform(twice, lambda s: s["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(F.slice(h, i + 1, WINDOW)))

    def count(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_bound(ordered, covered))

    return F.when(F.size(hashes) <= WINDOW, 0).otherwise(_bound(_bound(hashes, windows), count))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at, for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    of_words = lambda w: F.struct(
        F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _bound(F.transform(w, lambda x: F.xxhash64(x)), of_hashes).alias("h")
    )
    of_hashes = lambda h: F.struct(
        _repeat_words(h).alias("repeat"),
        F.size(F.filter(h, lambda x, i: (i > 0) & (x == F.get(h, i - 1)))).alias("doubled"),
    )
    of_lines = lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
    counted = docs.select(
        "doc_id",
        _bound(words, of_words).alias("w"),
        _bound(lines, of_lines).alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("s"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("c"),
        F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]")).alias("m"),
    )
    long = lambda name: F.col(name).cast("long")
    return counted.select(
        "doc_id",
        long("w.n_words").alias("n_words"),
        long("w.word_chars").alias("word_chars"),
        long("s").alias("n_symbols"),
        long("l.n").alias("n_lines"),
        long("l.dup").alias("n_dup_lines"),
        long("w.h.repeat").alias("n_repeat_words"),
        long("w.h.doubled").alias("n_doubled"),
        long("c").alias("n_capitals"),
        long("m").alias("n_marks"),
    )


def _posterior(votes: str, state: str) -> str:
    """SQL for the probability of a good text, given its votes."""

    def part(good: str, bad: str) -> str:
        pairs = f"arrays_zip({votes}, {state}.keeps, {state}.finds)"
        return f"aggregate({pairs}, 1D, (t, z) -> t * CASE WHEN z.votes = 1 THEN {good} WHEN z.votes = -1 THEN {bad} ELSE 1D END)"

    good = f"({state}.prior * {part('z.keeps', '1 - z.keeps')})"
    return f"({good} / ({good} + (1 - {state}.prior) * {part('1 - z.finds', 'z.finds')}))"


#: What is known of rules and texts beforehand: how often a rule passes a good text, how often it fails a bad
#: one (bad texts break a rule or two of many), and the share of good texts; with the weight of that many of 100 texts.
KEEPS, FINDS, GOOD, WEIGHT = 0.99, 0.3, 0.85, 1


def posteriors(voted: DataFrame, rules: int, rounds: int = 50) -> DataFrame:
    """(votes, posterior, prior, keeps, finds) for each pattern of the column votes, by expectation-maximisation.

    A rule has two accuracies: how often its vote on a good text is good
    (keeps) and how often that on a bad one is bad (finds). They and the share
    of good texts (prior) have beta priors of WEIGHT hundredths of all texts, so
    that rules start in their own sense and differ by what the votes say. The
    priors' part is the same at every size; nothing else holds the estimates.
    """
    pattern = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    one = pattern.groupBy().agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))  # 3 ** rules rows at most
    one = one.withColumn("m", F.expr(f"1 + aggregate(p, 0D, (t, x) -> t + x.n) * {WEIGHT / 100}D"))
    q = f"transform(p, x -> named_struct('votes', x.votes, 'n', x.n, 'q', {_posterior('x.votes', 's')}))"
    inside = lambda x: f"least({1 - 1e-6}D, greatest(1e-6D, {x}))"

    def accuracy(start: float, share: str, vote: int) -> str:
        said = f"aggregate(w, m * {start}D, (t, x) -> t + x.n * {share} * CASE WHEN x.votes[j] = {vote} THEN 1 ELSE 0 END)"
        cast = f"aggregate(w, m, (t, x) -> t + x.n * {share} * abs(x.votes[j]))"
        return f"transform(sequence(0, {rules - 1}), j -> {inside(f'{said} / {cast}')})"

    keeps, finds = accuracy(KEEPS, "x.q", 1), accuracy(FINDS, "(1 - x.q)", -1)
    prior = inside(f"aggregate(w, m * {GOOD}D, (t, x) -> t + x.n * x.q) / aggregate(w, m, (t, x) -> t + x.n)")
    update = f"element_at(transform(array({q}), w -> named_struct('prior', {prior}, 'keeps', {keeps}, 'finds', {finds})), 1)"
    first = f"named_struct('prior', {GOOD}D, 'keeps', array_repeat({KEEPS}D, {rules}), 'finds', array_repeat({FINDS}D, {rules}))"
    learned = one.withColumn("s", F.expr(f"aggregate(sequence(1, {rounds}), {first}, (s, i) -> {update})"))
    return learned.select("s", F.explode("p").alias("x")).select(F.col("x.votes").alias("votes"), F.expr(_posterior("x.votes", "s")).alias("posterior"), "s.*")


def accuracies(voted: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """(rule, keeps, finds, overruled): each rule's estimated accuracies, and how many texts are good though it failed them."""
    learned = posteriors(voted, len(rules))
    both = voted.groupBy("votes").agg(F.count("*").alias("texts")).join(F.broadcast(learned), "votes")  # 3 ** rules rows at most
    names = F.array(*(F.lit(r) for r in rules))
    each = both.select("texts", "posterior", F.explode(F.arrays_zip(names.alias("rule"), "votes", "keeps", "finds")).alias("x")).select("texts", "posterior", "x.*")
    over = F.sum(F.when((F.col("votes") == -1) & (F.col("posterior") >= 0.5), F.col("texts")).otherwise(0))
    return each.groupBy("rule").agg(F.first("keeps").alias("keeps"), F.first("finds").alias("finds"), over.alias("overruled"))


def judge(docs: DataFrame, rules: dict[str, tuple[str, str]] = RULES, least: float = 0.5) -> DataFrame:
    """The counts of each row of docs, its votes, the posterior and the verdict good."""
    vote = [F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for bad, good in rules.values()]
    voted = checkpointed(text_counts(docs).withColumn("votes", F.array(*vote)))  # counts only; the texts are read once
    learned = posteriors(voted, len(rules))
    return voted.join(F.broadcast(learned), "votes").withColumn("good", F.col("posterior") >= least)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.col("good")).alias("kept"),
    )
