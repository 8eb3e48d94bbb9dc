"""Imports to files and calls to symbols. All lookups are equi-joins on candidate paths, the first existing candidate wins.

imports: file, repository_id, raw; files: repository_id, path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidate suffixes by language (fixed values).
SUFFIXES = {"typescript": ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"), "python": (".py", "/__init__.py"), "java": (".java", ".kt"), "rust": (".rs", "/mod.rs")}
IMPORTS = {
    "typescript": r"""(?m)^\s*(?:import|export)\b[^'"\n]*from\s+['"]([^'"]+)['"]""", "javascript": r"""(?m)^\s*(?:import|export)\b[^'"\n]*from\s+['"]([^'"]+)['"]""",
    "python": r"(?m)^\s*(?:from|import)\s+([\w.]+)", "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;", "rust": r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", "go": r'(?m)^\s*(?:import\s+)?(?:\w+\s+)?"([^"\n]+)"\s*$',
}


def imports(files: DataFrame) -> DataFrame:
    """repository_id, path, language, raw of every import statement, in one scan. files: repository_id, path, language, content."""
    found = None
    for lang, pattern in IMPORTS.items():
        one = F.regexp_extract_all("content", F.lit(pattern), 1)
        found = F.when(F.col("language") == lang, one) if found is None else found.when(F.col("language") == lang, one)
    return files.select("repository_id", "path", "language", F.explode(found).alias("raw"))


def join_path(folder: Column, rel: Column) -> Column:
    """folder/rel with . and .. resolved."""
    seg = F.filter(F.split(F.concat_ws("/", folder, rel), "/"), lambda x: (x != "") & (x != "."))
    return F.array_join(F.aggregate(seg, F.array().cast("array<string>"), lambda a, x: F.when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1))).otherwise(F.concat(a, F.array(x)))), "/")


def candidates(imp: DataFrame) -> DataFrame:
    """The imports with `cand`, the paths they may mean, in order."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    ts = F.array(*[F.concat(join_path(folder, F.col("raw")), F.lit(s)) for s in SUFFIXES["typescript"]])
    py = F.array(*[F.concat(F.translate("raw", ".", "/"), F.lit(s)) for s in SUFFIXES["python"]])
    ja = F.array(*[F.concat(F.lit(root), F.translate("raw", ".", "/"), F.lit(s)) for root in ("src/main/java/", "src/", "") for s in SUFFIXES["java"]])
    mod = F.regexp_replace(F.regexp_replace("raw", r"^(crate|self)::", ""), "::", "/")
    segs = F.split(mod, "/")
    longest = F.transform(F.sequence(F.size(segs), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(segs, F.lit(1), k), "/"))
    rs = F.concat(F.flatten(F.transform(longest, lambda m: F.array(*[F.concat(F.lit("src/"), m, F.lit(s)) for s in SUFFIXES["rust"]]))), F.array(F.lit("src/lib.rs"), F.lit("src/main.rs")))
    lang, rel = F.col("language"), F.col("raw").startswith(".")
    skip = F.col("raw").rlike(r"^(java|javax|kotlin)\.")
    c = F.when(lang.isin("typescript", "javascript") & rel, ts).when(lang == "python", py).when((lang == "java") & ~skip, ja).when(lang == "rust", rs)
    return imp.withColumn("cand", F.coalesce(c, F.array().cast("array<string>")))


def resolve(imp: DataFrame, files: DataFrame) -> DataFrame:
    """repository_id, src, dst: imports resolved to files of the same repository; no file imports itself."""
    keyed = imp.select("repository_id", F.col("path").alias("src"), "raw", "cand").distinct()
    c = keyed.select("repository_id", "src", "raw", F.posexplode("cand").alias("pos", "path"))
    hit = c.join(files.select("repository_id", "path").distinct(), ["repository_id", "path"])
    first = hit.groupBy("repository_id", "src", "raw").agg(F.min_by("path", "pos").alias("dst"))
    return first.where("src <> dst").select("repository_id", "src", "dst").distinct()


def go_packages(imp: DataFrame, files: DataFrame, module: str) -> DataFrame:
    """src, dst: an import below the module means every Go file of that folder that is no test."""
    i = imp.where(F.col("raw").startswith(module + "/")).select("repository_id", F.col("path").alias("src"), F.expr(f"substring(raw, {len(module) + 2})").alias("dir"))
    g = files.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).select("repository_id", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), F.col("path").alias("dst"))
    return i.join(g, ["repository_id", "dir"]).where("src <> dst").select("repository_id", "src", "dst").distinct()


def by_suffix(imp: DataFrame, files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """src, dst: imports that match the end of a path, the smallest such path. Path tails are join keys, not patterns."""
    f = files.withColumn("seg", F.split("path", "/"))
    tails = f.select("repository_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("seg")), lambda k: F.array_join(F.slice("seg", k, F.size("seg")), "/"))).alias("tail"))
    c = imp.select("repository_id", F.col("path").alias("src"), "raw", F.explode(F.array(*[F.concat("raw", F.lit(s)) for s in suffixes])).alias("tail"))
    return c.join(tails, ["repository_id", "tail"]).groupBy("repository_id", "src", "raw").agg(F.min("path").alias("dst")).where("src <> dst").select("repository_id", "src", "dst").distinct()


def by_namespace(imp: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst: a namespace means every .cs file below a folder of its last name; framework namespaces are skipped."""
    i = imp.where(~F.col("raw").rlike(r"^(System|Microsoft|Mono)(\.|$)")).select("repository_id", F.col("path").alias("src"), F.substring_index("raw", ".", -1).alias("seg"))
    f = files.where(F.col("path").endswith(".cs")).select("repository_id", F.col("path").alias("dst"), F.explode(F.expr("slice(split(path, '/'), 1, greatest(0, size(split(path, '/')) - 1))")).alias("seg"))
    return i.join(f, ["repository_id", "seg"]).where("src <> dst").select("repository_id", "src", "dst").distinct()


def enclosing(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls with the id of the smallest symbol whose lines hold them. The file is always part of the join key."""
    s = symbols.select("file_path", "id", "start_line", "end_line")
    j = calls.join(s, (calls.file_path == s.file_path) & calls.line.between(s.start_line, s.end_line), "left").drop(s.file_path)
    keys = calls.columns
    return j.groupBy(*keys).agg(F.min_by("id", F.struct(F.col("end_line") - F.col("start_line"), "start_line", "id")).alias("caller"))


def call_edges(calls: DataFrame, symbols: DataFrame, imports_: DataFrame) -> DataFrame:
    """caller, callee, confidence: by name in the same file (1.0), in an imported file with a receiver (0.7), anywhere (0.3).

    calls: call_id, file_path, caller, target, receiver; symbols: id, file_path, name, ordinal; imports_: src, dst, ordinal.
    """
    c = calls.select("call_id", "file_path", "caller", "target", "receiver")
    s = symbols.select("id", F.col("file_path").alias("sf"), "name", "ordinal")
    same = c.join(s, (c.file_path == s.sf) & (c.target == s.name)).where("id <> caller").select("call_id", "caller", "id", F.lit(1).alias("tier"), F.struct(F.lit(0), "sf", "ordinal").alias("o"))
    imp = c.where("receiver is not null").join(imports_.select(F.col("src").alias("file_path"), "dst", F.col("ordinal").alias("io")), "file_path")
    imp = imp.join(s, (imp.dst == s.sf) & (imp.target == s.name)).select("call_id", "caller", "id", F.lit(2).alias("tier"), F.struct(F.col("io"), "sf", "ordinal").alias("o"))
    # a common name stands in many files: only its first symbol counts, so it is reduced before the join
    one = s.groupBy("name").agg(F.min_by("id", F.struct("sf", "ordinal")).alias("id"))
    far = c.join(one, c.target == one.name).select("call_id", "caller", "id", F.lit(3).alias("tier"), F.struct(F.lit(0), F.lit("").alias("sf"), F.lit(0).alias("ordinal")).alias("o"))
    best = same.unionAll(imp).unionAll(far).groupBy("call_id", "caller").agg(F.min_by(F.struct("id", "tier"), F.struct("tier", "o")).alias("b"))
    return best.select("call_id", "caller", F.col("b.id").alias("callee"), F.when(F.col("b.tier") == 1, 1.0).when(F.col("b.tier") == 2, 0.7).otherwise(0.3).alias("confidence"))
