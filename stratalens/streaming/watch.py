"""Streams of file changes: debounced runs, and content that was seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bursts(events: DataFrame, gap: str = "1500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """repository_id, first, last, n: one row for a burst of changes, after a quiet gap. events: repository_id, path, op, ts.

    Mode changes and changes below .git are no changes. State is one open window for each repository.
    """
    e = events.where("op <> 'chmod'").where(~F.col("path").rlike(r"(^|/)\.git(/|$)"))
    w = F.session_window("ts", gap)
    return e.withWatermark("ts", late).groupBy("repository_id", w.alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).drop("w")


def fresh(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events whose (path, content_hash) did not come before within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "content_hash"])


def changes(events: DataFrame, cache: DataFrame) -> DataFrame:
    """Events with status: reused when the cache holds the same hash, else changed. The cache is a static table."""
    return events.join(cache.select("path", F.col("content_hash").alias("known")), "path", "left").withColumn("status", F.when(F.col("known") == F.col("content_hash"), "reused").otherwise("changed")).drop("known")
