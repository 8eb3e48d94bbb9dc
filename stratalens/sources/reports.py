"""Readers of coverage reports, manifests and ignore files; sinks for tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A report is one item: files below this many bytes are read whole.
MOST = 64 << 20


def coverage_format(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<coverage")), "cobertura").when(text.rlike(r"(?m)^SF:"), "lcov")


def lcov(lines: DataFrame) -> DataFrame:
    """path, line_pct, branch_pct, covered, coverable from the lines (report, line_no, line) of LCOV reports."""
    w = Window.partitionBy("report").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    l = lines.withColumn("path", F.last(F.when(F.col("line").startswith("SF:"), F.substring("line", 4, 4000)), ignorenulls=True).over(w)).where("path is not null")
    da = l.where(F.col("line").startswith("DA:")).select("path", F.regexp_extract("line", r"^DA:(\d+),", 1).cast("int").alias("n"), F.regexp_extract("line", r"^DA:\d+,(\d+)", 1).cast("long").alias("hits"))
    da = da.groupBy("path", "n").agg(F.max("hits").alias("hits"))
    g = da.groupBy("path").agg(F.count(F.lit(1)).alias("coverable"), F.count_if(F.col("hits") > 0).alias("covered"), F.sort_array(F.collect_list(F.when(F.col("hits") > 0, F.col("n")))).alias("covered_lines"))
    num = lambda k: F.sum(F.when(F.col("line").startswith(k + ":"), F.substring("line", len(k) + 2, 12).cast("double")))
    b = l.groupBy("path").agg(num("BRF").alias("f"), num("BRH").alias("h"))
    return g.join(b, "path").select("path", (F.col("covered") / F.col("coverable") * 100).alias("line_pct"), F.when(F.col("f") > 0, F.col("h") / F.col("f") * 100).alias("branch_pct"), "covered_lines", "coverable")


def cobertura(reports: DataFrame) -> DataFrame:
    """path, line_pct, branch_pct, coverable from Cobertura texts (text); classes of one file are merged."""
    cls = reports.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(<class\b.*?</class>)"), 1)).alias("c"))
    c = cls.select(F.regexp_extract("c", r'filename="([^"]*)"', 1).alias("path"), F.regexp_extract("c", r'^<class[^>]*branch-rate="([^"]*)"', 1).cast("double").alias("br"), F.regexp_extract_all("c", F.lit(r'(<line\b[^>]*>)'), 1).alias("ls"))
    hit = F.size(F.filter("ls", lambda x: F.regexp_extract(x, r'hits="(\d+)"', 1).cast("long") > 0))
    g = c.groupBy("path").agg(F.sum(F.size("ls")).alias("coverable"), F.sum(hit).alias("covered"), F.avg("br").alias("br"))
    return g.select("path", F.when(F.col("coverable") > 0, F.col("covered") / F.col("coverable") * 100).otherwise(0.0).alias("line_pct"), (F.col("br") * 100).alias("branch_pct"), "coverable")


def manifests(files: DataFrame) -> DataFrame:
    """path, ecosystem, name, version, is_dev of dependencies named in manifests. files: path, content."""
    b = F.regexp_extract("path", r"([^/]*)$", 1)
    kept = files.where(~F.col("path").rlike(r"(^|/)(testdata|fixtures|node_modules|vendor)/"))
    dep = "map<string,string>"
    npm = kept.where(b == "package.json").select("path", F.from_json("content", f"dependencies {dep}, devDependencies {dep}").alias("j"))
    npm = npm.select("path", F.explode("j.dependencies").alias("name", "version"), F.lit(False).alias("is_dev")).unionAll(npm.select("path", F.explode("j.devDependencies").alias("name", "version"), F.lit(True).alias("is_dev")))
    npm = npm.select("path", F.lit("npm").alias("ecosystem"), "name", "version", "is_dev")

    def by_line(name: str, eco: str, pattern: str) -> DataFrame:
        l = kept.where(b == name).select("path", F.explode(F.split("content", "\r?\n")).alias("l")).where(F.col("l").rlike(pattern))
        return l.select("path", F.lit(eco).alias("ecosystem"), F.regexp_extract("l", pattern, 1).alias("name"), F.nullif(F.regexp_extract("l", pattern, 2), F.lit("")).alias("version"), F.lit(False).alias("is_dev"))

    pip = by_line("requirements.txt", "pypi", r"^\s*([A-Za-z][\w.-]*)\s*(?:[=~<>!]=?\s*([\w.*]+))?")
    go = by_line("go.mod", "go", r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+(v\S+)")
    cargo = kept.where(b == "Cargo.toml").select("path", F.explode(F.split(F.regexp_extract("content", r"(?s)\[dependencies\]\s*\n(.*?)(?:\n\[|$)", 1), "\n")).alias("l")).where(F.col("l").rlike(r"^\s*[\w-]+\s*="))
    cargo = cargo.select("path", F.lit("cargo").alias("ecosystem"), F.regexp_extract("l", r"^\s*([\w-]+)", 1).alias("name"), F.nullif(F.regexp_extract("l", r'"([\d][^"]*)"', 1), F.lit("")).alias("version"), F.lit(False).alias("is_dev"))
    return npm.unionAll(pip).unionAll(go).unionAll(cargo).distinct()


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """(regular expression over paths, negated) of one ignore-file line; None for blanks and notes."""
    s = line.rstrip()
    if not s or s.startswith("#"):
        return None
    neg = s.startswith("!")
    s = s[1:] if neg else s
    anchored = "/" in s.rstrip("/")
    folder = s.endswith("/")
    s = s.strip("/")
    rx = re.escape(s).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "/.*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if anchored else "(?:^|/)") + rx + ("/" if folder else "(?:/|$)"), neg


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether a path is ignored; the last rule that matches decides."""
    out = F.lit(False)
    for line in lines:
        p = ignore_pattern(line)
        if p:
            out = F.when(path.rlike(p[0]), F.lit(not p[1])).otherwise(out)
    return out


def replace_partition(rows: DataFrame, path: str, key: str = "repository_id") -> None:
    """Overwrites the partitions of the keys in rows, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
