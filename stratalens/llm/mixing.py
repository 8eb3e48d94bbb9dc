"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected the same number of times c (its quota over its size in tokens). In a fixed order the
expected copies are prefix-summed, one random offset is added, and a copy is emitted for each integer that is crossed: a
document comes floor(c) or ceil(c) times. The order goes by size, so the tokens drawn differ from the quota by little more
than one document.

The prefix sums never need a source in one task: a source is cut into bins by logarithm of size and a hash of the id; the
bins' counts (at most BINS * PARTS for a source of the target table) are summed, and only inside a bin are rows numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.llm.tokens import VOCAB, token_counts
from stratalens.session import cut
from stratalens.sources.tables import table

#: Bins of size: eight for each doubling, up to 2**40 tokens.
BINS = 8 * 40
#: Parts of a bin, by hash of the id.
PARTS = 32
#: The random offset of the sample is drawn from this.
SEED = 20240229


def plain_source(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))


def quotas(have: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: share, cap, documents and tokens it has, and the tokens it is to give.

    The total is the tokens of all its documents. A source gives at most its tokens times max_repeats; what capped sources
    leave open is spread over the others in proportion to their shares. As many sources can be capped as there are target
    rows, so the level is found over the sorted bounds instead of by rounds: with k the sources ordered by how soon they
    are capped, level = (total - caps of the first k) / (shares of the rest), for the first k where it suffices.
    """
    t = targets.groupBy(plain_source(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("share"), F.max("max_repeats").cast("long").alias("max_repeats")
    ).where("source is not null and share > 0")
    j = t.join(have, "source", "left").fillna(0, ["n_docs", "n_tokens"])
    j = j.withColumn("cap", F.col("n_tokens") * F.greatest(F.col("max_repeats"), F.lit(0)).cast("double"))
    # The target table is a parameter of the operator (a few rows), so one window over it is one small task.
    every = Window.partitionBy(F.lit(0))
    soonest = every.orderBy(F.col("cap") / F.col("share"), "source")
    past = soonest.rowsBetween(Window.unboundedPreceding, -1)
    j = (
        j.withColumn("total", F.sum("n_tokens").over(every).cast("double"))
        .withColumn("given", F.coalesce(F.sum("cap").over(past), F.lit(0.0)))
        .withColumn("open", F.sum("share").over(every) - F.coalesce(F.sum("share").over(past), F.lit(0.0)))
        .withColumn("level", F.greatest(F.lit(0.0), (F.col("total") - F.col("given")) / F.col("open")))
        .withColumn("fits", F.col("level") * F.col("share") <= F.col("cap"))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct("given", "level"))).over(every)["level"])
        .withColumn("quota", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("share"), F.col("cap"))))
    )
    return j.select("source", "share", "max_repeats", "n_docs", "n_tokens", "quota")


def sizes(docs: DataFrame, path: str = VOCAB) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that are not empty; the source without case and outer blanks."""
    d = docs.select("doc_id", plain_source(F.col("source")).alias("source"), "text").where("text <> ''")
    return token_counts(d, ["doc_id", "source"], path=path).where("n_tokens > 0")


def mixture(sized: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(copies, quotas). copies: doc_id, source, n_tokens, n_copies of each document that is drawn.

    sized: doc_id, source, n_tokens. Documents of a null source or of one without a target are left out, and so are those
    without tokens. A source without documents gives nothing. Equal rows are different documents, ties in size are broken
    by id. Empty tables give empty results.
    """
    named = targets.select(plain_source(F.col("source")).alias("source")).distinct()
    rows = (
        sized.where("n_tokens > 0").join(named, "source")
        .withColumn("bin", F.floor(F.log2(F.col("n_tokens").cast("double")) * 8).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    )
    bins = cut(rows.groupBy("source", "bin", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")))
    q = quotas(bins.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum("t").alias("n_tokens")), targets)
    q = q.withColumn("each", F.when(F.col("n_tokens") > 0, F.col("quota") / F.col("n_tokens")).otherwise(0.0))
    q = q.withColumn("offset", F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    # Tables of a row for each target, and of a row for each bin and part of one: whether they are small enough to be sent to
    # all tasks is left to the planner, which looks at their size; else they join on keys that the window below needs anyway.
    ahead = Window.partitionBy("source").orderBy("bin", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n", "t")
    starts = starts.join(q.select("source", "each", "offset", "max_repeats"), "source")
    place = Window.partitionBy("source", "bin", "part").orderBy("n_tokens", "doc_id")
    rank = F.col("start") + F.row_number().over(place)
    upto = lambda r: F.floor(F.round(r * F.col("each") + F.col("offset"), 9))
    drawn = (
        rows.join(starts, ["source", "bin", "part"])
        .withColumn("rank", rank)
        .withColumn("n_copies", (upto(F.col("rank")) - upto(F.col("rank") - 1)).cast("long"))
        .withColumn("n_copies", F.least("n_copies", "max_repeats"))
        .where("n_copies > 0")
    )
    return drawn.select("doc_id", "source", "n_tokens", "n_copies"), q


def shares(copies: DataFrame, q: DataFrame) -> DataFrame:
    """Per source: target and actual share, tokens available and used, documents and copies drawn."""
    used = copies.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("n_copies")).alias("tokens_used"),
        F.count(F.lit(1)).alias("docs_used"),
        F.sum("n_copies").alias("copies"),
        F.max("n_copies").alias("most_copies"),
    )
    r = q.join(used, "source", "left").fillna(0, ["tokens_used", "docs_used", "copies", "most_copies"])
    total = F.sum("tokens_used").over(Window.partitionBy(F.lit(0)))
    return r.select(
        "source",
        F.col("share").alias("target_share"),
        F.when(total > 0, F.col("tokens_used") / total).otherwise(0.0).alias("actual_share"),
        F.col("n_tokens").alias("tokens_available"),
        "tokens_used",
        F.col("n_docs").alias("docs_available"),
        "docs_used",
        "copies",
        "most_copies",
        "max_repeats",
    )


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, n_tokens and n_copies of each document of the mixture."""
    sized = cut(sizes(table(spark, folder, "documents")))
    return mixture(sized, table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share, tokens available and used, per source."""
    sized = cut(sizes(table(spark, folder, "documents")))
    copies, q = mixture(sized, table(spark, folder, "mix_targets"))
    return shares(cut(copies), q)


def p8_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Per source of the targets: documents available, and whether any is drawn more often than it may be."""
    sized = cut(sizes(table(spark, folder, "documents")))
    copies, q = mixture(sized, table(spark, folder, "mix_targets"))
    return shares(cut(copies), q).select("source", "docs_available", (F.col("most_copies") > F.col("max_repeats")).alias("over_the_cap"), (F.col("docs_used") > F.col("docs_available")).alias("over_the_docs"))
