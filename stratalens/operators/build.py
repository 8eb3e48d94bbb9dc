"""Building the typed graph from files, symbols, imports and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def structure_edges(symbols: DataFrame) -> DataFrame:
    """repository_id, src, dst, edge_type, confidence: files define symbols, classes have methods and properties.

    A parent counts only when it stands in the same file before the child. symbols: repository_id, file_path, id, name, kind,
    parent_name, ordinal.
    """
    defines = symbols.select("repository_id", F.col("file_path").alias("src"), F.col("id").alias("dst"), F.lit("defines").alias("edge_type"))
    p = symbols.where("parent_name is null").select("repository_id", "file_path", F.col("name").alias("parent_name"), F.col("id").alias("pid"), F.col("ordinal").alias("po"))
    j = symbols.where("parent_name is not null").join(p, ["repository_id", "file_path", "parent_name"]).where("po < ordinal")
    kind = F.when(F.col("kind").isin("constant", "variable"), "has_property").otherwise("has_method")
    has = j.select("repository_id", F.col("pid").alias("src"), F.col("id").alias("dst"), kind.alias("edge_type"))
    return defines.unionAll(has).where("src <> dst").distinct().withColumn("confidence", F.lit(1.0))


def mermaid(edges: DataFrame) -> DataFrame:
    """One text of a diagram of edges (a, b, weight). The caller bounds the edges."""
    clean = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    line = F.concat(F.lit("  "), clean(F.col("a")), F.lit(" -->|"), F.col("weight").cast("string"), F.lit("| "), clean(F.col("b")))
    return edges.agg(F.concat_ws("\n", F.lit("graph LR"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text"))


def plan_pages(changed: DataFrame, removed: DataFrame) -> DataFrame:
    """path, kind of the pages to write again: changed files, and every folder above a changed or removed one."""
    f = changed.select("path", F.lit("file").alias("kind"))
    gone = changed.select("path").unionAll(removed.select("path")).withColumn("seg", F.split("path", "/")).where("size(seg) > 1")
    d = gone.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("seg") - 1), lambda k: F.array_join(F.slice("seg", F.lit(1), k), "/"))).alias("path"), F.lit("directory").alias("kind"))
    return f.unionAll(d).distinct()
