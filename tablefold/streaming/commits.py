"""Versions from a stream: each micro-batch that changes anything becomes a commit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..plans.versions import VersionStore


def commit_stream(rows: DataFrame, store: VersionStore, branch: str, pk: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch of a stream into a branch by primary key.

    Rows of a batch replace the branch's rows of the same key. A batch that is
    run again leaves the same table, and so no second commit.
    """

    def apply(batch: DataFrame, number: int) -> None:
        new = ingest.one_per_key(batch, pk)
        if f"heads/{branch}" in store.refs:
            old, _ = store.table(branch)
            new = old.join(new.select(*pk), list(pk), "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)
        store.commit(branch, new, f"batch {number}", pk, if_changed=True)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of each kind in windows of event time, from a stream or a table; rows later than ``late`` are left out of a stream's."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("rows")).select("w.start", kind, "rows")
