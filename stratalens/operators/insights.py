"""Summaries over git signals, graph nodes and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators import gitstats as G
from stratalens.session import cut


def git_card(touches: DataFrame) -> DataFrame:
    """One row for a file: owner, bus factor, churn and activity.

    The log is read by several aggregates, so it is written once to the shared folder.
    """
    touches = cut(touches)
    own = G.owners(touches).select("path", "owner", "owner_share")
    per = G.per_file(touches).select("path", "total_commits", "commits_90d")
    return per.join(own, "path").join(G.bus_factor(touches), "path").join(G.churn(touches).select("path", "churn", "churn_pct", "is_hotspot"), "path")


def bus_split(bus: DataFrame) -> DataFrame:
    return bus.agg(F.count_if(F.col("bus_factor") >= 3).alias("safe"), F.count_if(F.col("bus_factor") == 2).alias("warning"), F.count_if(F.col("bus_factor") <= 1).alias("risk"), F.count(F.lit(1)).alias("total"))


def churn_histogram(churn: DataFrame) -> DataFrame:
    """bucket, n for five buckets of churn percentile, empty ones kept."""
    b = F.least(F.lit(4), F.greatest(F.lit(0), F.floor(F.col("churn_pct") * 5))).cast("long")
    n = churn.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return churn.sparkSession.range(5).withColumnRenamed("id", "bucket").join(F.broadcast(n), "bucket", "left").fillna(0, ["n"])


def top_contributors(authors: DataFrame, k: int = 8) -> DataFrame:
    return authors.groupBy("display").agg(F.sum("commits").alias("commits"), F.count_distinct("path").alias("files")).orderBy(F.desc("commits"), "display").limit(k)


def mode_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the smallest at a tie."""
    n = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(value))


def ownership(files: DataFrame) -> DataFrame:
    """Per top path segment: files, hotspots, mean churn and most frequent owner."""
    f = files.withColumn("top", F.substring_index("path", "/", 1))
    g = f.groupBy("top").agg(F.count(F.lit(1)).alias("files"), F.count_if("is_hotspot").alias("hotspots"), F.round(F.avg("churn_pct"), 6).alias("mean_churn"))
    return g.join(mode_of(f, "top", "owner"), "top", "left")


def coauthors(authors: DataFrame) -> DataFrame:
    """a < b, shared: authors and the number of files both are listed for (a file lists at most ten)."""
    a, b = authors.select("path", F.col("author").alias("a")), authors.select("path", F.col("author").alias("b"))
    return a.join(b, "path").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def network(authors: DataFrame, nodes: int = 40, edges: int = 200) -> DataFrame:
    """The heaviest edges among the most active contributors."""
    top = authors.groupBy("author").agg(F.sum("commits").alias("c")).orderBy(F.desc("c"), "author").limit(nodes).select("author")
    kept = authors.join(F.broadcast(top), "author")
    return coauthors(kept).withColumnRenamed("shared", "weight").orderBy(F.desc("weight"), "a", "b").limit(edges)


def headline(card: DataFrame) -> DataFrame:
    active = F.col("commits_90d") > 0
    return card.agg(F.count(F.lit(1)).alias("files"), F.count_if("is_hotspot").alias("hotspots"), F.count_if(F.col("bus_factor") <= 1).alias("bus_risk"), F.count_if((F.col("owner_share") > 0.8) & active).alias("silos"), F.count_if(active).alias("active"))


def hotspots(card: DataFrame) -> DataFrame:
    return card.where("is_hotspot").select("path", "owner", F.round("owner_share", 6).alias("owner_share"), "bus_factor", "churn", F.round("churn_pct", 6).alias("churn_pct"), "commits_90d")


def path_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst as paths."""
    n = nodes.select("id", "path")
    return edges.join(n.withColumnsRenamed({"id": "src", "path": "sp"}), "src").join(n.withColumnsRenamed({"id": "dst", "path": "dp"}), "dst").select(F.col("sp").alias("src"), F.col("dp").alias("dst"))


def hidden_coupling(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs changed together with no edge in either direction."""
    u = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.join(u, ["a", "b"], "left_anti").select("a", "b", "n", F.col("a").alias("file_path"), F.lit(1.5).alias("impact"))


def attention(card: DataFrame, k: int = 5) -> DataFrame:
    """section, path, place: k silos and k ungoverned hotspots."""

    def first(section: str, rows: DataFrame) -> DataFrame:
        top = rows.orderBy(F.desc("churn_pct"), "path").limit(k)
        w = Window.partitionBy(F.lit(0)).orderBy(F.desc("churn_pct"), "path")  # k rows
        return top.select(F.lit(section).alias("section"), "path", F.row_number().over(w).alias("place"))

    return first("knowledge_silo", card.where("bus_factor <= 1 and commits_90d > 0")).unionAll(first("ungoverned_hotspot", card.where("is_hotspot and bus_factor > 1")))


def risk(card: DataFrame, edges: DataFrame) -> DataFrame:
    """Risk level of each file from hotspot, dependents and bus factor, with reasons."""
    deps = edges.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("dependents"))
    r = card.join(deps, "path", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    hot = F.col("is_hotspot") | (F.col("churn_pct") >= 0.9)
    d, bus = F.col("dependents"), F.col("bus_factor") <= 1
    points = F.when(hot, 2).otherwise(0) + F.when(d >= 10, 2).when(d >= 3, 1).otherwise(0) + F.when(bus, 1).otherwise(0)
    return r.select(
        "path", "dependents", points.alias("points"), F.when(points >= 3, "high").when(points >= 1, "medium").otherwise("low").alias("level"),
        F.concat_ws(",", F.when(hot, F.lit("hotspot")), F.when(d >= 3, F.lit("dependents")), F.when(bus, F.lit("bus_factor"))).alias("reasons"),
    )
