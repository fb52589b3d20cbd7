"""Incremental sync: file events debounced per path, coalesced, and applied to the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Silence after which a path is settled, and how late an event may come (an extension).
QUIET, LATE = "600 milliseconds", "10 seconds"
KINDS = ("create", "modify", "remove")


def coalesced(kinds: Column) -> Column:
    """What a run of events of one path comes to: removed then created is a change, created then changed is new, created then
    removed is nothing (null), else the last."""

    def step(acc: Column, kind: Column) -> Column:
        return (
            F.when(acc == "", kind)
            .when((acc == "remove") & (kind == "create"), "modify")
            .when((acc == "create") & (kind == "modify"), "create")
            .when((acc == "create") & (kind == "remove"), "")
            .otherwise(kind)
        )

    out = F.aggregate(kinds, F.lit(""), step)
    return F.when(out != "", out)


def settled(events: DataFrame, quiet: str = QUIET, late: str | None = LATE) -> DataFrame:
    """path, start, end, n_events and action of each run of events (path, kind, ts) with no silence of `quiet` within; runs
    that come to nothing are left out. The same plan serves a stream (with a watermark) and a table (late=None)."""
    if events.isStreaming and late:
        events = events.withWatermark("ts", late)
    runs = events.groupBy("path", F.session_window("ts", quiet).alias("run")).agg(F.array_sort(F.collect_list(F.struct("ts", "kind"))).alias("events"))
    action = coalesced(F.transform("events", lambda e: e["kind"]))
    out = runs.select("path", F.col("run.start").alias("start"), F.col("run.end").alias("end"), F.size("events").cast("bigint").alias("n_events"), action.alias("action"))
    return out.filter("action is not null")


def sync(actions: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str):
    """Start the query that gives each batch's upserted and removed paths to apply(upserts, removals). A batch may come twice
    after a failure: apply must be idempotent, as table overwrites by document are."""

    def batch(df: DataFrame, _: int) -> None:
        df = df.select("path", "action").persist()
        try:
            apply(df.filter("action <> 'remove'").select("path"), df.filter("action = 'remove'").select("path"))
        finally:
            df.unpersist()

    return actions.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch).start()


def renames(events: DataFrame) -> DataFrame:
    """old_path and new_path of a removal and a creation with the same hash (path, kind, hash)."""
    old = events.filter("kind = 'remove'").select(F.col("path").alias("old_path"), "hash")
    new = events.filter("kind = 'create'").select(F.col("path").alias("new_path"), "hash")
    return old.join(new, "hash").select("old_path", "new_path").filter("old_path <> new_path")
