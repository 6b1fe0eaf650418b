"""Matching prewrites with commits: the events of a transactional store's change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.model import AFTER, DELETE, INSERT


def match(events: DataFrame, resolved_ts: DataFrame | Column | int) -> DataFrame:
    """Committed changes up to resolved_ts (a number, or a frame of one row like resolved_ts()), `_seq` being the commit timestamp.

    events: type (prewrite, commit, rollback), op (put, delete), handle, start_ts, commit_ts, value, old_value. A prewrite
    meets its commit by (handle, start_ts); a rollback undoes it. A put with an old value is an update, a delete without one
    keeps only its handle."""
    keys = ["handle", "start_ts"]
    prewrites = events.filter("type = 'prewrite'").select(*keys, "op", "value", "old_value")
    commits = events.filter("type = 'commit'").select(*keys, "commit_ts")
    undone = events.filter("type = 'rollback'").select(*keys)
    if isinstance(resolved_ts, DataFrame):
        due = commits.join(F.broadcast(resolved_ts), F.col("commit_ts") <= F.col("resolved_ts")).drop("resolved_ts")  # one row
    else:
        due = commits.filter(F.col("commit_ts") <= (F.lit(resolved_ts) if isinstance(resolved_ts, int) else resolved_ts))
    done = prewrites.join(undone, keys, "left_anti").join(due, keys)
    kind = F.when(F.col("op") == "delete", DELETE).when(F.col("old_value").isNotNull(), AFTER).otherwise(INSERT)
    return done.select(
        "handle", F.when(F.col("op") == "delete", F.col("old_value")).otherwise(F.col("value")).alias("value"), kind.alias("_kind"), F.lit(None).cast("string").alias("_origin"), F.col("commit_ts").alias("_seq")
    )


def resolved_ts(regions: DataFrame) -> DataFrame:
    """One row: the least over tables of the least over their regions."""
    by_table = regions.groupBy("table").agg(F.min("ts").alias("ts"))
    return by_table.agg(F.min("ts").alias("resolved_ts"))
