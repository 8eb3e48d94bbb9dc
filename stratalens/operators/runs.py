"""Run bookkeeping, costs, set operations on stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: model prefix, price of a million tokens in, out (parameters of the example catalogue).
PRICES = (("vendor-model-large", 3.0, 15.0), ("vendor-model-large-2024", 2.5, 10.0), ("vendor-model-small", 0.2, 0.8))


def run_summary(jobs: DataFrame) -> DataFrame:
    """run_id, verdict, phases, updated_at: by the latest row of each phase, any failed fails, any unfinished runs."""
    last = jobs.groupBy("run_id", "phase").agg(F.max_by("state", F.struct("updated_at", "id")).alias("state"), F.max("updated_at").alias("updated_at"))
    g = last.groupBy("run_id").agg(F.bool_or(F.col("state") == "failed").alias("f"), F.bool_or(F.col("state").isin("pending", "running")).alias("r"), F.count(F.lit(1)).alias("phases"), F.max("updated_at").alias("updated_at"))
    return g.select("run_id", F.when(F.col("f"), "failed").when(F.col("r"), "running").otherwise("succeeded").alias("verdict"), "phases", "updated_at")


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """operation, calls, cost: each call at the price of the longest prefix of its model; unknown models cost nothing.

    Every prefix of a model name is a join key, so this is an equi-join.
    """
    models = calls.select("model").distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.length("model"))))
    models = models.withColumn("prefix", F.expr("substring(model, 1, n)")).join(prices, "prefix")
    best = models.groupBy("model").agg(F.max_by(F.struct("price_in", "price_out"), "n").alias("p"))
    j = calls.join(best, "model", "left")
    cost = (F.col("tokens_in") * F.coalesce("p.price_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("p.price_out", F.lit(0.0))) / 1e6
    return j.groupBy("operation").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(cost), 9).alias("cost"))


def debounce(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """key, first, last, n: bursts of events with less than a gap between neighbours."""
    w = F.session_window(F.col(ts), gap)
    return events.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("w")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys; the last of repeated new rows by all columns."""
    one = new.groupBy(*keys).agg(F.max(F.struct(*[c for c in new.columns if c not in keys])).alias("v")).select(*keys, "v.*") if len(new.columns) > len(keys) else new.distinct()
    return old.join(one.select(*keys), keys, "left_anti").unionByName(one)


def keep_newest(rows: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """The newest `keep` rows of each key, a retention rule."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep).drop("__r")


def replace_changed(old: DataFrame, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows of unchanged keys as they were, of changed keys as they are now; keys that are gone leave."""
    return old.join(changed, key, "left_anti").unionByName(new.join(changed, key, "left_semi"))


def versions(pages: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, history) of versioned pages after edits. pages: path, version, content; edits: path, content."""
    j = pages.join(edits.withColumnRenamed("content", "new"), "path", "full_outer")
    changed = F.col("new").isNotNull() & (F.col("version").isNull() | (F.col("new") != F.col("content")))
    current = j.select("path", F.when(changed, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).alias("version"), F.when(changed, F.col("new")).otherwise(F.col("content")).alias("content"))
    return current, j.where(changed & F.col("version").isNotNull()).select("path", "version", "content")
