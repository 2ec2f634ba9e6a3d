"""Commit graphs as tables: edges (child, parent), walked by joins, for many starts at once.

Commits are laid out in chains, in which each continues one of its parents: what
leads to a commit leads to all of its chain below it. So a walk keeps one row
for each start and chain, with the highest place reached, and takes as many
rounds as a path changes chains, however long they are. Places are found by
doubling, in as many rounds as the longest chain's length has binary digits.
Each round writes what is new to the checkpoint folder. ``plans.graph`` does the
same for the few commits of one store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written


def _placed(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(sum, next, chain, place): each commit of both, the parent that it continues, its chain's first commit and the steps from there.

    A commit continues the least of its parents, and is continued by the
    greatest of those that chose it. Where this runs in a circle, which no
    history does, each commit is a chain of its own.
    """
    chosen = edges.where("child <> parent").groupBy("child").agg(F.min("parent").alias("next"))
    links = chosen.groupBy("next").agg(F.max("child").alias("sum")).select("sum", "next")
    every = edges.select(F.col("child").alias("sum")).unionAll(edges.select("parent")).unionAll(starts.select("sum")).withColumn("next", F.lit(None))
    linked = links.unionAll(every).groupBy("sum").agg(F.max("next").alias("next"))
    first = F.col("next").isNull()
    new = written(linked.select("sum", "next", F.coalesce("next", "sum").alias("chain"), F.when(first, 0).otherwise(1).cast("long").alias("place"), first.alias("done")))
    commits, length = new.count(), 1
    done, new = new.where("done"), new.where("NOT done")
    while length <= commits and not new.isEmpty():  # what is new is `length` steps above `chain`, and this not the first
        at = done.unionAll(new).select(F.col("sum").alias("chain"), F.col("chain").alias("far"), F.col("place").alias("more"), F.col("done").alias("there"))
        further = written(new.join(at, "chain").select("sum", "next", F.col("far").alias("chain"), (F.col("place") + F.col("more")).alias("place"), F.col("there").alias("done")))
        done, new, length = done.unionAll(further.where("done")), further.where("NOT done"), 2 * length
    circles = new.select("sum", F.lit(None).alias("next"), F.col("sum").alias("chain"), F.lit(0).cast("long").alias("place"))
    return done.select("sum", "next", "chain", "place").unionAll(circles)


def _walked(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, across, tops): the commits in their chains; edges (chain, below, to, to_place) that leave a chain
    at place ``below``; and (start, chain, top), the highest place of each chain that each start leads to."""
    edges = written(edges.select("child", "parent").distinct())
    starts = written(starts.select("start", "sum").distinct())
    placed = written(_placed(edges, starts))
    left = edges.join(placed, edges["child"] == placed["sum"]).where("NOT parent <=> next").select("parent", "chain", F.col("place").alias("below"))
    to = placed.select(F.col("sum").alias("parent"), F.col("chain").alias("to"), F.col("place").alias("to_place"))
    across = written(left.join(to, "parent").where("chain <> to OR below <= to_place").select("chain", "below", "to", "to_place"))
    tops = written(starts.join(placed, "sum").groupBy("start", "chain").agg(F.max("place").alias("top")).withColumn("before", F.lit(-1).cast("long")))
    while not (new := tops.where("before < top")).isEmpty():
        met = new.join(across, "chain").where("before < below AND below <= top").groupBy("start", F.col("to").alias("chain")).agg(F.max("to_place").alias("met"))
        both = tops.drop("before").join(met, ["start", "chain"], "full_outer")
        tops = written(both.select("start", "chain", F.greatest("top", "met").alias("top"), F.coalesce("top", F.lit(-1)).alias("before")))
    return placed, across, tops.drop("before")


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, sum): the commits that each start leads to, itself included."""
    placed, _, tops = _walked(edges, starts)
    return placed.join(tops, "chain").where("place <= top").select("start", "sum")


def ancestors(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """(sum): the commits that some head leads to, heads included."""
    return reach(edges, heads.select(F.lit(0).alias("start"), "sum")).select("sum")


def unreachable(commits: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """(sum): the commits that no ref leads to."""
    return commits.select("sum").join(ancestors(edges, refs), "sum", "left_anti")


def to_send(edges: DataFrame, wants: DataFrame, haves: DataFrame) -> DataFrame:
    """(sum): what a receiver with ``haves`` lacks of ``wants``."""
    ends = wants.select(F.lit("want").alias("start"), "sum").unionAll(haves.select(F.lit("have"), "sum"))
    placed, _, tops = _walked(edges, ends)
    top = lambda start: F.coalesce(F.max(F.when(F.col("start") == start, F.col("top"))), F.lit(-1))
    lacking = tops.groupBy("chain").agg(top("want").alias("want"), top("have").alias("have")).where("have < want")
    return placed.join(lacking, "chain").where("have < place AND place <= want").select("sum")


def merge_bases(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, base): for each pair the greatest of the common ancestors that no other common one descends from; null if there is none.

    Only a chain's highest common commit can be one, unless a common commit of another chain leads to it.
    """
    pairs = written(pairs.select("a", "b").distinct())
    heads = pairs.select(F.col("a").alias("h")).unionAll(pairs.select("b"))
    placed, across, tops = _walked(edges, heads.select(F.col("h").alias("start"), F.col("h").alias("sum")))
    one, two = tops.select(F.col("start").alias("a"), "chain", F.col("top").alias("one")), tops.select(F.col("start").alias("b"), "chain", F.col("top").alias("two"))
    common = written(pairs.join(one, "a").join(two, ["b", "chain"]).select("a", "b", "chain", F.least("one", "two").alias("place")))
    inner = common.join(across, "chain").where("below <= place").groupBy("a", "b", F.col("to").alias("chain")).agg(F.max("to_place").alias("place"))
    best = common.join(inner, ["a", "b", "chain", "place"], "left_anti").join(placed, ["chain", "place"]).groupBy("a", "b").agg(F.max("sum").alias("base"))
    return pairs.join(best, ["a", "b"], "left")
