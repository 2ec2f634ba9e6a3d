"""From raw documents to a training mixture, stage by stage.

Each stage takes the rows that its predecessor kept, with the columns of
``documents``, and all but the last return those columns as they are, whatever
they are named; the last replaces columns named epoch, tokens_before and mix_order.

Nulls: a null or empty text has the score of a text without words and is judged by
it; it has no near copies, benchmark items or secrets. A null doc_id has no near
copies. A null source is a source of its own. Repeated rows are one document to
the join, which keeps the least, and ties elsewhere go row by row. Texts of any
length are read whole. An empty table gives an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefold.llm import decontamination, ngram_join, quality_classifier, secret_scan, source_mixing
from tablefold.llm.shipping import ship, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it is fitted on a sample of the labelled ones."""
    ship(spark)
    labels = quality_classifier.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    weights = quality_classifier.fit_quality(docs, labels)
    # the row goes in a struct, so that a column of docs named score stays what it is
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    return quality_classifier.score_quality(rows, weights).where("score >= 0.7").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that links of Jaccard similarity 0.8 on five-word n-grams make."""
    ship(spark)
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontamination.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark."""
    ship(spark)
    return secret_scan.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture draws them, with their place in it."""
    ship(spark)
    return source_mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
]

#: A fitted classifier and MinHash candidates are beyond SQL; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
