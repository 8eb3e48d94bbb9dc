"""Queries of lists, pages, counts and cards, over the stored tables; their SQL states its values by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import cards as C
from stratalens.operators import graph as G
from stratalens.sources.proxy import view, with_views
from stratalens.sources.tables import table


def _findings(s, d):
    return table(s, d, "security_findings").dropDuplicates(["finding_id"])


def _metrics(s, d):
    v = view(s, d, "symbols1").where("complexity is not null")
    return v.groupBy("repository_id", "file_path").agg(F.max("complexity").alias("max_ccn"), F.count(F.lit(1)).alias("symbols"))


_SORTS = {"max_ccn": [F.desc, "max_ccn"], "-symbols": [F.desc, "symbols"], "symbols": [F.asc, "symbols"]}


def _choices():
    return {k: [f(c), F.col("repository_id"), F.col("file_path")] for k, (f, c) in _SORTS.items()}


def _counts(s, d):
    f = _findings(s, d)
    sides = {"severity": (f, "severity"), "node_type": (view(s, d, "nodes1"), "node_type"), "symbol_kind": (view(s, d, "symbols1"), "kind"), "job_state": (view(s, d, "jobs"), "state")}
    return C.counts(sides, {"job_state": C.STATES, "severity": C.SEVERITIES})


def _wanted(s, d):
    return view(s, d, "files1").select("repository_id", F.element_at(F.split("path", "/"), -1).alias("wanted")).unionAll(view(s, d, "files1").select("repository_id", F.col("path")))


def _repos(s, d):
    return table(s, d, "repositories")


QUERIES = {
    "prj2_optional_filters": lambda s, d: C.optional(_findings(s, d), severity="high", kind=None, repository_id=None).select("finding_id", "file_path", "line"),
    "prj3_clamped_page": lambda s, d: C.page(view(s, d, "symbols1").select("symbol_id", "name"), ["name", "symbol_id"], limit=100_000, offset=-3),
    "srt3_chosen_sort": lambda s, d: C.sorted_by(_metrics(s, d), _choices(), "max_ccn", "symbols").limit(100),
    "srt3_default_sort": lambda s, d: C.sorted_by(_metrics(s, d), _choices(), "no such order", "-symbols").limit(100),
    "srt4_dead_order": lambda s, d: C.dead_first(G.surest_dead(view(s, d, "g_nodes"), view(s, d, "g_edges"), 100), 100),
    "jn12_prefer_exact": lambda s, d: C.prefer_exact(view(s, d, "nodes1").where("node_type = 'file'").select("repository_id", "node_id"), _wanted(s, d)),
    "srt7_rescue_ranking": lambda s, d: C.rescue(view(s, d, "symbols1").select(F.lower("name").alias("token")), view(s, d, "symbols1").where("name is not null")),
    "agg24_counts": _counts,
    "agg30_status_card": lambda s, d: C.status_card(_repos(s, d), view(s, d, "nodes1"), view(s, d, "symbols1"), _findings(s, d), table(s, d, "documents")),
    "set5_first_wins": lambda s, d: C.first_wins(_findings(s, d).select("repository_id", "file_path", "line", "finding_id", "severity"), ["repository_id", "file_path", "line"], "finding_id"),
    "snk6_json": lambda s, d: C.as_json(_repos(s, d).select("id", "name", "tracked")),
    "sec2_listing": lambda s, d: C.by_severity(_findings(s, d)).select("finding_id", "severity", "file_path", "line"),
    "agg28_latest_run": lambda s, d: C.latest_run(view(s, d, "jobs")),
    "st4_plan_runs": lambda s, d: C.plan_runs(_repos(s, d).where("tracked").select(F.col("id").alias("repository_id"), F.col("head_commit").alias("head")), _repos(s, d).select(F.col("id").alias("repository_id"), F.when(F.col("name") < "m", F.col("head_commit")).otherwise("0").alias("head"))),
    "st5_registry": lambda s, d: C.registry_after(_repos(s, d), _repos(s, d).where("name >= 'm'").select("id")).select("id", "name"),
}

_F1 = "f as (select finding_id, any_value(repository_id) as repository_id, any_value(file_path) as file_path, any_value(kind) as kind, any_value(severity) as severity, any_value(line) as line from security_findings group by 1)"
_REACH = "reach as (select p_partkey as id from part where p_partkey % 397 = 1 union select e.dst from reach r join g_edges e on e.src = r.id)"
ORACLE = {
    "prj2_optional_filters": f"with {_F1} select finding_id, file_path, line from f where severity = 'high'",
    "prj3_clamped_page": with_views("select symbol_id, name from symbols1 order by name, symbol_id limit 200", "symbols1"),
    "srt3_chosen_sort": with_views("select repository_id, file_path, max(complexity) as max_ccn, count(*) as symbols from symbols1 where complexity is not null group by 1, 2 order by max_ccn desc, repository_id, file_path limit 100", "symbols1"),
    "srt3_default_sort": with_views("select repository_id, file_path, max(complexity) as max_ccn, count(*) as symbols from symbols1 where complexity is not null group by 1, 2 order by symbols desc, repository_id, file_path limit 100", "symbols1"),
    "srt4_dead_order": with_views(f"""with {_REACH}, i as (select dst as id, count(*) as n from g_edges group by 1)
        select n.id, n.path, coalesce(i.n, 0) as in_degree, cast(case when i.n is null then 1.0 else 0.6 end as double) as confidence, i.n is null as safe_to_delete from g_nodes n left join i on i.id = n.id
        where not is_entry and not is_test and n.id not in (select id from reach) order by confidence desc, n.path, n.id limit 100""", "g_nodes", "g_edges"),
    "jn12_prefer_exact": with_views("""with w as (select distinct repository_id, wanted from (select repository_id, path as wanted from files1 union all select repository_id, string_split(path, '/')[-1] from files1)),
        n as (select repository_id, node_id from nodes1 where node_type = 'file')
        select w.repository_id, w.wanted, n.node_id from w join n on n.repository_id = w.repository_id and (n.node_id = w.wanted or string_split(n.node_id, '/')[-1] = w.wanted)
        qualify row_number() over (partition by w.repository_id, w.wanted order by case when n.node_id = w.wanted then 0 else 1 end, n.node_id) = 1""", "files1", "nodes1"),
    "srt7_rescue_ranking": with_views("""with t as (select distinct lower(name) as token from symbols1 where replace(name, '_', '') <> '')
        select t.token, s.symbol_id, s.name from t join symbols1 s on lower(replace(s.name, '_', '')) = replace(t.token, '_', '')
        qualify row_number() over (partition by t.token order by case when s.name = t.token then 0 else 1 end, length(s.name), s.file_path, s.symbol_id) = 1""", "symbols1"),
    "agg24_counts": with_views(f"""with {_F1}, x as (
          select 'severity' as facet, severity as value, 1 as k from f union all select 'node_type', node_type, 1 from nodes1 union all select 'symbol_kind', kind, 1 from symbols1 union all select 'job_state', state, 1 from jobs
          union all select 'job_state', unnest(['pending', 'running', 'failed', 'completed', 'cancelled']), 0 union all select 'severity', unnest(['critical', 'high', 'medium', 'low', 'info']), 0)
        select facet, value, cast(sum(k) as bigint) as n from x where value is not null group by 1, 2""", "nodes1", "symbols1", "jobs"),
    "agg30_status_card": with_views(f"""with {_F1},
        n as (select repository_id, count(*) filter (node_type = 'file') as files, count(*) as nodes, cast(sum(out_degree) as bigint) as edges, count(*) filter (is_entry_point) as entry_points from nodes1 group by 1),
        s as (select repository_id, count(*) as symbols, count(*) filter (complexity >= 10) as complex_symbols, round(avg(complexity), 4) as average_complexity from symbols1 group by 1),
        g as (select repository_id, count(*) as findings, count(*) filter (lower(severity) in ('critical', 'high')) as grave_findings from f group by 1),
        p as (select repository_id, count(*) as pages from documents where repository_id is not null group by 1)
        select r.id as repository_id, r.name, coalesce(files, 0) as files, coalesce(nodes, 0) as nodes, coalesce(edges, 0) as edges, coalesce(entry_points, 0) as entry_points, coalesce(symbols, 0) as symbols,
               coalesce(complex_symbols, 0) as complex_symbols, average_complexity, coalesce(findings, 0) as findings, coalesce(grave_findings, 0) as grave_findings, coalesce(pages, 0) as pages
        from repositories r left join n on n.repository_id = r.id left join s on s.repository_id = r.id left join g on g.repository_id = r.id left join p on p.repository_id = r.id""", "nodes1", "symbols1"),
    "set5_first_wins": f"with {_F1} select repository_id, file_path, line, finding_id, severity from f qualify row_number() over (partition by repository_id, file_path, line order by finding_id) = 1",
    "snk6_json": "select '{\"id\":\"' || id || '\",\"name\":\"' || name || '\",\"tracked\":' || tracked::varchar || '}' as json from repositories",
    "sec2_listing": f"with {_F1} select finding_id, severity, file_path, line from f order by case lower(severity) when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'info' then 4 else 5 end, file_path, line, finding_id limit 100",
    "agg28_latest_run": with_views("select run_id, max(updated_at) as updated_at, count(*) as jobs from jobs group by 1 order by updated_at desc, run_id desc limit 1", "jobs"),
    "st4_plan_runs": "select id as repository_id, case when not coalesce(tracked, false) then 'new' when case when name < 'm' then head_commit else '0' end = head_commit then 'skip' else 'run' end as action from repositories",
    "st5_registry": "select id, name from repositories where not (name >= 'm') and (tracked or not ephemeral)",
}
