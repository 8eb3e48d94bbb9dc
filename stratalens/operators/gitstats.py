"""Per-file and per-author aggregates of a commit log.

touches: commit_id, path, additions, deletions, ts, author (key), author_name, now; one row for a file in a non-merge commit.
All functions give empty results for empty input; rows with a null path are a path of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP, BUS_SHARE, MAX_FILES = 10, 0.80, 200
#: Conventional prefixes and keywords of commit categories (fixed values).
PREFIX = dict(feat="feature", feature="feature", fix="fix", bugfix="fix", refactor="refactor", perf="refactor", docs="docs", doc="docs", test="test", tests="test", build="dependency", deps="dependency", chore="chore", ci="chore", style="chore", revert="other")
WORDS = [("other", "revert"), ("dependency", "bump|upgrade|dependenc|dependabot|deps"), ("fix", "fix|bug|patch|hotfix"), ("refactor", "refactor|rename|cleanup|clean up|simplif"), ("test", "test|spec"), ("docs", "doc|readme|comment"), ("feature", "add|implement|introduce|support|feature|feat"), ("chore", "chore|ci|build|release")]


def recent(days: int) -> Column:
    """Strictly after the cutoff."""
    return F.col("ts") > F.col("now") - F.expr(f"interval {days} days")


def per_file(touches: DataFrame) -> DataFrame:
    """Commits in all, in 90 and 30 days, lines of 90 days, first and last commit, age in days, mean commit size."""
    g = touches.groupBy("path").agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.count_if(recent(90)).alias("commits_90d"),
        F.count_if(recent(30)).alias("commits_30d"),
        F.coalesce(F.sum(F.when(recent(90), F.col("additions"))), F.lit(0)).alias("added_90d"),
        F.coalesce(F.sum(F.when(recent(90), F.col("deletions"))), F.lit(0)).alias("deleted_90d"),
        F.min("ts").alias("first_commit"),
        F.max("ts").alias("last_commit"),
        F.max("now").alias("now"),
    )
    days = F.floor((F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("first_commit").cast("timestamp"))) / 86400)
    g = g.withColumn("age_days", F.greatest(F.lit(0), days).cast("long"))
    # lines of 90 days over commits of all time, as the signal is defined
    return g.withColumn("avg_commit_size", F.round((F.col("added_90d") + F.col("deleted_90d")) / F.col("total_commits"), 6)).drop("now")


def authors(touches: DataFrame) -> DataFrame:
    """path, author, display, commits, share, rank: the first TOP authors of each file."""
    a = touches.groupBy("path", "author").agg(F.count(F.lit(1)).alias("commits"), F.min("author_name").alias("display"))
    total = F.sum("commits").over(Window.partitionBy("path"))
    a = a.withColumn("share", F.col("commits") / total)
    order = Window.partitionBy("path").orderBy(F.desc("commits"), "author")
    return a.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def owners(touches: DataFrame) -> DataFrame:
    """Primary owner of each file, and the owner of its last 90 days."""
    first = authors(touches).where("rank = 1").select("path", F.col("author").alias("owner"), F.round("share", 6).alias("owner_share"))
    now = authors(touches.where(recent(90))).where("rank = 1").select("path", F.col("author").alias("recent_owner"))
    return first.join(now, "path", "left")


def bus_factor(touches: DataFrame) -> DataFrame:
    """path, bus_factor: the fewest authors with BUS_SHARE of the commits, over the listed authors; their number otherwise."""
    w = Window.partitionBy("path").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    a = authors(touches).withColumn("run", F.sum("share").over(w))
    return a.groupBy("path").agg(F.coalesce(F.min(F.when(F.col("run") >= BUS_SHARE - 1e-12, F.col("rank"))), F.count(F.lit(1))).cast("long").alias("bus_factor"))


def contributors(touches: DataFrame) -> DataFrame:
    return touches.groupBy("path").agg(F.count_distinct("author").alias("contributors"))


def churn(touches: DataFrame) -> DataFrame:
    """path, churn, churn_pct, is_hotspot, is_stable. The percentile is rank over n - 1, ties by path.

    A rank over all files needs one order of them. The files are range-partitioned by (churn, path); each partition numbers
    its own rows, and the sizes of the partitions (one number each) give the offsets. No task gets all files.
    """
    f = per_file(touches).select("path", (F.col("added_90d") + F.col("deleted_90d")).alias("churn"))
    return ranked(f, ["churn", "path"]).select(
        "path", "churn", F.when(F.col("n") <= 1, F.lit(1.0)).otherwise((F.col("rank") - 1) / (F.col("n") - 1)).alias("churn_pct")
    ).withColumn("is_hotspot", (F.col("churn") > 0) & (F.col("churn_pct") >= 0.9)).withColumn("is_stable", F.col("churn_pct") <= 0.1)


def ranked(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with rank (from 1, by keys ascending) and n, without a window over everything."""
    from stratalens.session import cut

    parts = df.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id())
    parts = cut(parts)  # so that the partition of a row is settled before it is counted
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__k"))
    # one row for each partition
    w = Window.partitionBy(F.lit(0)).orderBy("__p")
    offsets = sizes.withColumn("__before", F.sum("__k").over(w) - F.col("__k")).withColumn("n", F.sum("__k").over(Window.partitionBy(F.lit(0))))
    r = parts.join(F.broadcast(offsets.drop("__k")), "__p")
    inner = Window.partitionBy("__p").orderBy(*keys)
    return r.withColumn("rank", F.col("__before") + F.row_number().over(inner)).drop("__p", "__before")


def pairs(touches: DataFrame, least: int = 1) -> DataFrame:
    """a < b, n: files changed together, over commits of 2 to MAX_FILES files."""
    size = touches.groupBy("commit_id").agg(F.count(F.lit(1)).alias("k")).where(f"k between 2 and {MAX_FILES}").select("commit_id")
    t = touches.select("commit_id", "path").join(size, "commit_id")
    p = t.withColumnRenamed("path", "a").join(t.withColumnRenamed("path", "b"), "commit_id").where("a < b")
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def partners(touches: DataFrame, top: int = TOP) -> DataFrame:
    """path, partner, n, rank: the files changed together most."""
    p = pairs(touches)
    both = p.select(F.col("a").alias("path"), F.col("b").alias("partner"), "n").unionAll(p.select(F.col("b"), F.col("a"), "n"))
    w = Window.partitionBy("path").orderBy(F.desc("n"), "partner")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def category(message: Column) -> Column:
    """Category of a commit: by conventional prefix, else by the first keyword group that occurs."""
    s = F.lower(F.trim(F.regexp_extract(message, r"^([^\n]*)", 1)))
    kind = F.regexp_replace(F.trim(F.regexp_extract(s, r"^([^:(]*?)\s*(?:\([^:]*)?!?\s*:", 1)), "!$", "")
    out = F.when(s == "", F.lit("other"))
    for k, v in PREFIX.items():
        out = out.when(kind == k, F.lit(v))
    for name, pattern in WORDS:
        out = out.when(s.rlike(pattern), F.lit(name))
    return F.coalesce(out, F.lit("other"))


def categories(commits: DataFrame) -> DataFrame:
    """category, n of the non-merge commits, with the total of all."""
    g = commits.where("n_parents <= 1").groupBy(category(F.col("message")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    # at most as many rows as there are categories
    return g.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))


def signals(touches: DataFrame) -> DataFrame:
    """One row for a file with all its signals."""
    out = per_file(touches)
    for other in (owners(touches), bus_factor(touches), contributors(touches), churn(touches)):
        out = out.join(other, "path", "left")
    return out
