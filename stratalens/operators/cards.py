"""Lists, pages, counts and cards over stored rows: what a surface asks the tables for.

Every operator is a plan of built-in expressions; lookups are equi-joins on keys that are made from the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a run, in the order of a report (fixed values).
STATES = ("pending", "running", "failed", "completed", "cancelled")
#: Severities from the worst on (fixed values).
SEVERITIES = ("critical", "high", "medium", "low", "info")


def optional(rows: DataFrame, **wanted: object) -> DataFrame:
    """The rows that equal every value given; a value of None asks for nothing. An unknown column is an error."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


def clamped(limit: int | None, offset: int | None, default: int = 50, most: int = 200) -> tuple[int, int]:
    """A page as asked for, within what is allowed: no limit or one under 1 means the default, a negative offset none."""
    size = default if limit is None or limit < 1 else min(limit, most)
    return size, max(0, offset or 0)


def page(rows: DataFrame, order: list, limit: int | None = None, offset: int | None = None, default: int = 50, most: int = 200) -> DataFrame:
    size, skip = clamped(limit, offset, default, most)
    return rows.orderBy(*order).offset(skip).limit(size)


def sorted_by(rows: DataFrame, choices: dict[str, list[Column]], choice: str | None, default: str) -> DataFrame:
    """Rows in an order chosen by name; an unknown name means the default."""
    return rows.orderBy(*choices.get(choice or default, choices[default]))


def severity_rank(severity: Column) -> Column:
    """0 for the worst; what is no severity comes last."""
    out = F.lit(len(SEVERITIES))
    for i, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(F.lower(severity) == s, i).otherwise(out)
    return out


def by_severity(findings: DataFrame, limit: int = 100) -> DataFrame:
    """Findings from the worst on; equal ones by file, line and id."""
    return findings.orderBy(severity_rank(F.col("severity")), "file_path", "line", "finding_id").limit(limit)


def dead_first(dead: DataFrame, limit: int = 100) -> DataFrame:
    """Dead code, the surest first, then by path."""
    return dead.orderBy(F.desc("confidence"), "path", "id").limit(limit)


def prefer_exact(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """repository_id, wanted, node_id: a node that is called as wanted, else one whose last path segment is; the smallest of equals.

    nodes: repository_id, node_id; wanted: repository_id, wanted. Each node has two keys, so this is an equi-join.
    """
    last = F.element_at(F.split("node_id", "/"), -1)
    keys = nodes.select("repository_id", "node_id", F.explode(F.array_distinct(F.array(F.col("node_id"), last))).alias("wanted")).distinct()
    hit = wanted.select("repository_id", "wanted").distinct().join(keys, ["repository_id", "wanted"])
    return hit.groupBy("repository_id", "wanted").agg(F.min_by("node_id", F.struct(F.col("node_id") != F.col("wanted"), "node_id")).alias("node_id"))


def rescue(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """token, symbol_id, name: for a name as somebody wrote it, the symbol meant.

    Case and underscores are ignored in the match; the exact spelling comes first, then the shorter name, then the file path.
    """
    plain = lambda c: F.lower(F.translate(c, "_", ""))
    t = tokens.select("token").distinct().withColumn("k", plain(F.col("token"))).where("k <> ''")
    s = symbols.select("symbol_id", "name", "file_path", plain(F.col("name")).alias("k"))
    best = F.min_by(F.struct("symbol_id", "name"), F.struct(F.col("name") != F.col("token"), F.length("name"), "file_path", "symbol_id"))
    return t.join(s, "k").groupBy("token").agg(best.alias("b")).select("token", "b.*")


def counts(facets: dict[str, tuple[DataFrame, str]], fixed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """facet, value, n: rows by value of several columns; the values of `fixed` facets are listed even without rows."""
    out = None
    for name, (rows, column) in facets.items():
        one = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        for v in (fixed or {}).get(name, ()):
            one = one.unionAll(rows.sparkSession.range(1).select(F.lit(v).alias("value"), F.lit(0).cast("long").alias("n")))
        one = one.groupBy("value").agg(F.sum("n").alias("n")).select(F.lit(name).alias("facet"), "value", "n")
        out = one if out is None else out.unionAll(one)
    return out


def status_card(repositories: DataFrame, nodes: DataFrame, symbols: DataFrame, findings: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each repository: graph, entry points, symbols and their complexity, findings, pages; zeros where there is nothing."""
    n = nodes.groupBy("repository_id").agg(F.count_if(F.col("node_type") == "file").alias("files"), F.count(F.lit(1)).alias("nodes"), F.sum("out_degree").alias("edges"), F.count_if("is_entry_point").alias("entry_points"))
    s = symbols.groupBy("repository_id").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("complexity") >= 10).alias("complex_symbols"), F.round(F.avg("complexity"), 4).alias("average_complexity"))
    f = findings.groupBy("repository_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.lower("severity").isin("critical", "high")).alias("grave_findings"))
    d = documents.where("repository_id is not null").groupBy("repository_id").agg(F.count(F.lit(1)).alias("pages"))
    card = repositories.select(F.col("id").alias("repository_id"), "name")
    for side in (n, s, f, d):
        card = card.join(side, "repository_id", "left")
    return card.fillna(0, ["files", "nodes", "edges", "entry_points", "symbols", "complex_symbols", "findings", "grave_findings", "pages"])


def first_wins(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the records of a key the first by `order`, whole."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object a row; null fields are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def latest_run(jobs: DataFrame) -> DataFrame:
    """The run with the newest update; of equal ones the greatest name."""
    r = jobs.groupBy("run_id").agg(F.max("updated_at").alias("updated_at"), F.count(F.lit(1)).alias("jobs"))
    return r.orderBy(F.desc("updated_at"), F.desc("run_id")).limit(1)


def plan_runs(stored: DataFrame, heads: DataFrame, force: bool = False) -> DataFrame:
    """repository_id, action: 'new' for an unknown repository, 'skip' when the head is the stored one, else 'run'; forced ones run.

    stored: repository_id, head; heads: repository_id, head. An unknown head is never equal.
    """
    s = stored.select("repository_id", F.col("head").alias("old"), F.lit(True).alias("known"))
    j = heads.select("repository_id", "head").join(s, "repository_id", "left")
    act = F.when(F.col("known").isNull(), "new").when(F.lit(force), "run").when(F.col("old") == F.col("head"), "skip").otherwise("run")
    return j.select("repository_id", act.alias("action"))


def registry_after(repositories: DataFrame, untracked: DataFrame, keep_ephemeral: bool = False) -> DataFrame:
    """Repositories that stay: tracked ones but those given up; ephemeral ones go unless they are tracked or kept."""
    stay = repositories.join(untracked.select("id"), "id", "left_anti")
    return stay if keep_ephemeral else stay.where("tracked or not ephemeral")


class Tasks:
    """Tasks that follow a run, in order; each says itself whether it is needed, and a failure stops none of the others."""

    def __init__(self) -> None:
        self.tasks: list[tuple[str, Callable[[dict], bool], Callable[[dict], None]]] = []

    def add(self, name: str, needed: Callable[[dict], bool], run: Callable[[dict], None]) -> None:
        self.tasks.append((name, needed, run))

    def run(self, context: dict) -> list[tuple[str, str]]:
        """(name, 'done', 'skipped' or 'failed: ...') of each."""
        out = []
        for name, needed, run in self.tasks:
            try:
                if not needed(context):
                    out.append((name, "skipped"))
                    continue
                run(context)
                out.append((name, "done"))
            except Exception as e:  # noqa: BLE001 - reported, not hidden
                out.append((name, f"failed: {e}"))
        return out
