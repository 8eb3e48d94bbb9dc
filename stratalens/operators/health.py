"""Code-health findings over a symbol table, scores per file, comparison and incremental upkeep.

symbols: file, id, name, kind, parent_name, signature, ccn, nesting, start_line, end_line. Null measures hit nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds (fixed values): warning, high, critical.
CCN, LINES, NESTING, METHODS, PARAMS, TOP_LEVEL = (10, 20, 50), (60, 120), (4, 6), (15, 25), (5, 8), (20, 40)
WINDOW, SITES, SIGNAL = 6, (2, 8), 3
CLASS_KINDS = ("class", "struct", "interface", "trait", "impl")
COLUMNS = ("file", "biomarker", "severity", "name", "start_line", "end_line", "impact")


def ramp(v: Column, low: float, high: float, at_low: float, at_high: float) -> Column:
    """Zero under low, then linear from at_low to at_high at high and beyond."""
    line = at_low + (v - low) / (high - low) * (at_high - at_low)
    return F.when(v < low, 0.0).when(v >= high, at_high).otherwise(line)


def _finding(df: DataFrame, name: str, severity: Column, impact: Column, sym: str = "name") -> DataFrame:
    return df.select("file", F.lit(name).alias("biomarker"), severity.alias("severity"), F.col(sym).alias("name"), "start_line", "end_line", F.round(impact.cast("double"), 6).alias("impact"))


def level(v: Column, medium: int, high: int, critical: int | None = None) -> Column:
    c = F.when(v >= critical, "critical").when(v >= high, "high") if critical else F.when(v >= high, "high")
    return c.when(v >= medium, "medium")


def param_count(signature: Column) -> Column:
    """Top-level commas in the first balanced group plus one; 0 for none or an empty group."""
    inner = F.regexp_extract(signature, r"\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", 1)
    flat = F.regexp_replace(F.regexp_replace(inner, r"\((?:[^()]|\([^()]*\))*\)|\[[^\[\]]*\]|\{[^{}]*\}", ""), r"<[^<>]*>", "")
    return F.when(F.trim(inner) == "", 0).otherwise(F.length(flat) - F.length(F.regexp_replace(flat, ",", "")) + 1)


def local_findings(symbols: DataFrame) -> DataFrame:
    """Findings that need only the symbol's own file."""
    n = F.col("end_line") - F.col("start_line") + 1
    ccn, nest = F.col("ccn"), F.col("nesting")
    s = symbols.withColumn("n_lines", n).withColumn("p", F.when(F.col("kind").isin("function", "method"), param_count(F.col("signature"))))
    p = F.col("p")
    rules = (
        (ccn >= CCN[0], "high_complexity", level(ccn, *CCN), ramp(ccn, CCN[0], CCN[2], 1, 5)),
        (n >= LINES[0], "long_function", level(n, *LINES), ramp(n, *LINES, 1, 3)),
        (nest >= NESTING[0], "deep_nesting", level(nest, *NESTING), ramp(nest, *NESTING, 1, 2)),
        ((ccn >= 10) & (nest >= 3) & (n >= 50), "brain_method", F.lit("high"), F.lit(4.0)),
        (p >= PARAMS[0], "long_parameter_list", level(p, *PARAMS), F.least(F.lit(3.0), 0.5 + 0.4 * (p - 5))),
    )
    # all that a symbol says of itself, in one pass over the table
    hits = [F.when(hit, F.struct(F.lit(name).alias("biomarker"), severity.alias("severity"), F.round(impact.cast("double"), 6).alias("impact"))) for hit, name, severity, impact in rules]
    own = s.select("file", "name", "start_line", "end_line", F.explode(F.array_compact(F.array(*hits))).alias("f"))
    out = own.select("file", "f.biomarker", "f.severity", "name", "start_line", "end_line", "f.impact")
    methods = s.where("kind = 'method' and parent_name is not null").groupBy("file", F.col("parent_name").alias("name")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= METHODS[0])
    g = s.where(F.col("kind").isin(*CLASS_KINDS)).join(methods, ["file", "name"])
    out = out.unionAll(_finding(g, "god_class", level(F.col("k"), *METHODS), ramp(F.col("k"), *METHODS, 1, 2)))
    top = s.where("parent_name is null and kind not in ('constant', 'variable')").groupBy("file").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= TOP_LEVEL[0])
    top = top.withColumn("name", F.lit(None).cast("string")).withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(1))
    return out.unionAll(_finding(top, "god_file", level(F.col("k"), *TOP_LEVEL), ramp(F.col("k"), *TOP_LEVEL, 1, 2)))


def untested_hotspots(hot: DataFrame, coverage: DataFrame, tested: DataFrame) -> DataFrame:
    """file, severity, impact of hotspots under 50 % coverage, or without a test where coverage is unknown."""
    j = hot.select("file").join(coverage.select("file", "line_pct"), "file", "left").join(tested.select("file").distinct().withColumn("t", F.lit(True)), "file", "left")
    impact = F.when(F.col("line_pct") < 50, 2 + (50 - F.col("line_pct")) / 50 * 2).when(F.col("line_pct").isNull() & F.col("t").isNull(), 3.0)
    return j.select("file", F.lit("high").alias("severity"), F.round(impact, 6).alias("impact")).where("impact is not null")


def shotgun(partners: DataFrame, least: int = 8, shared: int = 3) -> DataFrame:
    """path, partners, impact of files with many distinct partners, of those with at least `shared` common commits."""
    g = partners.where(F.col("n") >= shared).groupBy("path").agg(F.count_distinct("partner").alias("partners")).where(F.col("partners") >= least)
    return g.withColumn("impact", F.round(F.least(F.lit(3.0), 1 + 0.25 * (F.col("partners") - 8)), 6))


def scores(findings: DataFrame, files: DataFrame) -> DataFrame:
    """file, score: 10 less all impacts, within 1 and 10."""
    s = findings.groupBy("file").agg(F.sum("impact").alias("i"))
    return files.select("file").distinct().join(s, "file", "left").select("file", F.round(F.greatest(F.lit(1.0), F.least(F.lit(10.0), 10 - F.coalesce("i", F.lit(0.0)))), 4).alias("score"))


def metrics(symbols: DataFrame, score: DataFrame) -> DataFrame:
    """max_ccn, max_nesting, nloc and score per file."""
    g = symbols.groupBy("file").agg(F.max("ccn").alias("max_ccn"), F.max("nesting").alias("max_nesting"), F.max("end_line").alias("nloc"), F.count(F.lit(1)).alias("n_symbols"))
    return g.join(score, "file", "left")


def compare(base: DataFrame, head: DataFrame, eps: float = 0.01) -> DataFrame:
    """file, base, head, delta, status of two score tables (file, score)."""
    j = base.select("file", F.col("score").alias("base")).join(head.select("file", F.col("score").alias("head")), "file", "full_outer")
    d = F.round(F.col("head") - F.col("base"), 2)
    st = F.when(F.col("base").isNull(), "new").when(F.col("head").isNull(), "removed").when(d < -eps, "regressed").when(d > eps, "improved").otherwise("same")
    return j.select("file", "base", "head", d.alias("delta"), st.alias("status"))


def exclude(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Without the findings a rule names. rules: prefix, biomarker ('*' for all); a handful of rows, sent to all tasks."""
    r = F.broadcast(rules.select("prefix", F.col("biomarker").alias("b")))
    hit = findings.join(r, F.col("file").startswith(F.col("prefix")) & ((F.col("b") == "*") | (F.col("b") == F.col("biomarker"))), "left_anti")
    return hit


def incremental(old: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings of a full run, from old findings of unchanged files and new ones of the changed (file)."""
    keep = old.join(changed, "file", "left_anti").join(symbols.select("file").distinct(), "file", "left_semi")
    return keep.unionByName(local_findings(symbols.join(changed, "file", "left_semi")))


def normal_line(line: Column) -> Column:
    """A line for comparison: comments cut, blanks collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"(//|#).*$", ""), r"[ \t\r]+", " "))


def lines(files: DataFrame) -> DataFrame:
    """file, line_no, norm of the lines that are not blank after normalising; line_no is the original one."""
    f = files.where("content <> ''").select("file", F.posexplode(F.split("content", "\n")).alias("p", "line"))
    return f.select("file", (F.col("p") + 1).alias("line_no"), normal_line(F.col("line")).alias("norm")).where("norm <> ''")


def duplication(files: DataFrame, window: int = WINDOW) -> DataFrame:
    """file, start_line, end_line, sites: windows of normalised lines that occur at 2 to 8 sites, overlapping ones joined.

    The window slides within a file; a digest of more than SITES[1] sites is boilerplate by definition and leaves as a whole.
    """
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(0, window - 1)
    l = lines(files).groupBy("file", "line_no").agg(F.first("norm").alias("norm"))  # a repeated delivery counts once
    l = l.withColumn("w", F.collect_list(F.struct("line_no", "norm")).over(w)).where(F.size("w") == window)
    signal = F.size(F.filter("w", lambda x: F.length(x["norm"]) >= 3))
    l = l.where(signal >= window * 6 // 10).select("file", F.col("line_no").alias("start_line"), F.element_at("w", -1)["line_no"].alias("end_line"), F.xxhash64(F.concat_ws("\n", F.col("w.norm"))).alias("h"))
    k = l.groupBy("h").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites").between(*SITES))
    hit = l.join(k, "h")
    before = Window.partitionBy("file").orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy("file").orderBy("start_line", "end_line")
    isl = hit.withColumn("new", (F.col("start_line") > F.coalesce(F.max("end_line").over(before), F.lit(-1)) + 1).cast("int")).withColumn("g", F.sum("new").over(run))
    out = isl.groupBy("file", "g").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("sites").alias("sites")).drop("g")
    return out.withColumn("severity", F.when(F.col("sites") >= 6, "high").when(F.col("sites") >= 3, "medium").otherwise("low"))


#: name, default severity of every finding (fixed values).
CATALOG = (("high_complexity", "medium"), ("long_function", "medium"), ("deep_nesting", "medium"), ("brain_method", "high"), ("god_class", "medium"), ("long_parameter_list", "medium"), ("feature_envy", "medium"), ("god_file", "medium"), ("untested_hotspot", "high"), ("shotgun_surgery", "medium"), ("hidden_coupling", "medium"), ("duplication", "low"), ("deep_inheritance", "medium"))


def feature_envy(calls: DataFrame, other: tuple[str, ...], least: int = 4) -> DataFrame:
    """method, receiver, n, impact: methods that call one external receiver most. calls: method, own, receiver."""
    q = calls.where("receiver is not null").where(~F.lower("receiver").isin("self", "this", *other)).where(F.lower("receiver") != F.lower(F.substring("own", 1, 1))).where(F.lower("receiver") != F.lower("own"))
    g = q.groupBy("method", "receiver").agg(F.count(F.lit(1)).alias("n"))
    t = g.groupBy("method").agg(F.sum("n").alias("total"), F.min_by(F.struct("receiver", "n"), F.struct(-F.col("n"), F.col("receiver"))).alias("m"))
    return t.select("method", "m.receiver", "m.n", "total").where((F.col("n") >= least) & (F.col("n") * 2 >= F.col("total"))).withColumn("impact", F.least(F.lit(3.0), 1 + 0.3 * (F.col("n") - 4)))
