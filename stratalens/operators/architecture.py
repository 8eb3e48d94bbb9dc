"""Modules, communities, directories and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators.insights import mode_of


def module_key(path: Column) -> Column:
    """The first two path segments."""
    return F.substring_index(path, "/", 2)


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("id", "path")
    return edges.join(n.withColumnsRenamed({"id": "src", "path": "src_path"}), "src").join(n.withColumnsRenamed({"id": "dst", "path": "dst_path"}), "dst").select("src_path", "dst_path")


def module_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst of modules with an edge between their files."""
    e = named_edges(edges, nodes)
    return e.select(module_key(F.col("src_path")).alias("src"), module_key(F.col("dst_path")).alias("dst")).where("src <> dst").distinct()


def dependents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, dependents, first_dependent of every node that something points to."""
    e = named_edges(edges, nodes)
    return e.groupBy(F.col("dst_path").alias("path")).agg(F.count_distinct("src_path").alias("dependents"), F.min("src_path").alias("first_dependent"))


def cross_communities(edges: DataFrame, member: DataFrame) -> DataFrame:
    """a < b, weight: edges between different communities, direction ignored. member: id, community."""
    j = edges.join(member.withColumnsRenamed({"id": "src", "community": "x"}), "src").join(member.withColumnsRenamed({"id": "dst", "community": "y"}), "dst").where("x <> y")
    return j.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("weight"))


def matrix(edges: DataFrame, nodes: DataFrame, size: int = 16) -> DataFrame:
    """from_module, to_module, n for the modules of highest total degree, zeros kept."""
    e = named_edges(edges, nodes).select(module_key(F.col("src_path")).alias("f"), module_key(F.col("dst_path")).alias("t"))
    pairs = e.groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select(F.col("f").alias("m"), "n").unionAll(pairs.select("t", "n"))
    top = both.groupBy("m").agg(F.sum("n").alias("k")).orderBy(F.desc("k"), "m").limit(size).select("m")
    # size * size cells, by the report's definition
    listed = top.agg(F.sort_array(F.collect_list("m")).alias("ms"))
    cells = listed.select(F.explode("ms").alias("f"), "ms").select("f", F.explode("ms").alias("t"))
    return cells.join(pairs, ["f", "t"], "left").select(F.col("f").alias("from_module"), F.col("t").alias("to_module"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def modules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """module, files, symbols, outgoing cross-module edges."""
    n = nodes.select("id", module_key(F.col("path")).alias("module"), "symbol_count")
    g = n.groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.sum("symbol_count").alias("symbols"))
    m = n.select("id", "module")
    out = edges.join(m.withColumnsRenamed({"id": "src", "module": "f"}), "src").join(m.withColumnsRenamed({"id": "dst", "module": "t"}), "dst").where("f <> t")
    k = out.groupBy(F.col("f").alias("module")).agg(F.count(F.lit(1)).alias("outgoing"))
    return g.join(k, "module", "left").fillna(0, ["outgoing"])


def languages(files: DataFrame) -> DataFrame:
    return files.where("language <> ''").groupBy(F.lower("language").alias("language")).agg(F.count(F.lit(1)).alias("files"))


def community_survey(nodes: DataFrame, top: int = 20, members: int = 5) -> DataFrame:
    """The largest communities of each repository, with their most central members and most frequent directory."""
    f = nodes.where("node_type = 'file' and community_id is not null")
    size = f.groupBy("repository_id", "community_id").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("repository_id").orderBy(F.desc("size"), "community_id")
    big = size.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    by = Window.partitionBy("repository_id", "community_id").orderBy(F.desc(F.coalesce("pagerank", F.lit(0.0))), "node_id")
    m = f.withColumn("r", F.row_number().over(by)).where(F.col("r") <= members)
    m = m.groupBy("repository_id", "community_id").agg(F.sort_array(F.collect_list(F.struct("r", "node_id"))).alias("l")).select("repository_id", "community_id", F.concat_ws("|", F.col("l.node_id")).alias("members"))
    k = f.select("repository_id", "community_id", F.struct("repository_id", "community_id").alias("key"), F.substring_index("file_path", "/", 1).alias("label"))
    lab = mode_of(k, "key", "label").select("key.*", "label")
    return big.join(m, ["repository_id", "community_id"]).join(lab, ["repository_id", "community_id"])


def community_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.where("community_id is not null").groupBy("repository_id", "community_id").agg(F.count(F.lit(1)).alias("size"), F.round(F.sum(F.coalesce("pagerank", F.lit(0.0))), 6).alias("total_rank"))


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("repository_id").agg(F.count_if(F.col("node_type") == "file").alias("files"), F.count_if(F.col("node_type") == "symbol").alias("symbols"))


def entry_points(nodes: DataFrame, top: int = 100) -> DataFrame:
    rank = F.coalesce("pagerank", F.lit(0.0))
    w = Window.partitionBy("repository_id").orderBy(F.desc("pagerank"), "node_id")
    n = nodes.where("is_entry_point and node_type = 'file'").select("repository_id", "node_id", rank.alias("pagerank"))
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def page(nodes: DataFrame, limit: int = 50, offset: int = 20) -> DataFrame:
    """A page of file nodes by rank."""
    n = nodes.where("node_type = 'file'").select("repository_id", "node_id", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"))
    return n.orderBy(F.desc("pagerank"), "node_id", "repository_id").offset(offset).limit(limit)


def directories(files: DataFrame) -> DataFrame:
    """Per directory: direct files, direct subdirectories, all files below, most frequent language. The root is left out."""
    p = files.select("repository_id", "path", F.lower("language").alias("language")).distinct().withColumn("seg", F.split("path", "/")).where("size(seg) > 1")
    a = p.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("seg") - 1)))
    a = a.select("repository_id", F.concat_ws("/", F.slice("seg", F.lit(1), F.col("k"))).alias("dir"), (F.col("k") == F.size("seg") - 1).alias("direct"), F.when(F.col("k") < F.size("seg") - 1, F.get("seg", F.col("k"))).alias("sub"), "language")
    g = a.groupBy("repository_id", "dir").agg(F.count_if("direct").alias("files"), F.count_distinct("sub").alias("subdirs"), F.count(F.lit(1)).alias("all_files"))
    lang = mode_of(a.where("language is not null").select(F.struct("repository_id", "dir").alias("key"), "language"), "key", "language").select("key.*", "language")
    return g.join(lang, ["repository_id", "dir"], "left")


def packages(files: DataFrame) -> DataFrame:
    """Directories with a manifest, and whether their repository has several."""
    m = files.where(F.col("path").rlike(r"(^|/)package-lock\.json$")).select("repository_id", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), F.lit("npm").alias("ecosystem")).distinct()
    return m.withColumn("is_monorepo", F.count(F.lit(1)).over(Window.partitionBy("repository_id")) > 1)


def overview(nodes: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row for a repository."""
    n = nodes.groupBy("repository_id").agg(F.count(F.lit(1)).alias("nodes"))
    f = files.groupBy("repository_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    s = symbols.groupBy("repository_id").agg(F.count(F.lit(1)).alias("symbols"))
    return n.join(f, "repository_id", "left").join(s, "repository_id", "left").fillna(0, ["files", "bytes", "symbols"])


def lookup(repos: DataFrame, folders: DataFrame) -> DataFrame:
    """repository_id, cwd: the repository whose path is the longest ancestor of a folder.

    Every ancestor of a folder is a join key, so this is an equi-join and not a comparison of all with all.
    """
    a = folders.select("cwd").distinct().withColumn("seg", F.split("cwd", "/"))
    a = a.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("seg")))).select("cwd", "k", F.concat_ws("/", F.slice("seg", F.lit(1), F.col("k"))).alias("local_path"))
    j = a.join(repos.select(F.col("id").alias("repository_id"), "local_path"), "local_path")
    return j.groupBy("cwd").agg(F.min_by("repository_id", F.struct(-F.col("k"), "repository_id")).alias("repository_id"))
