"""Queries of runs, costs, sets, imports and stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import architecture as A
from stratalens.operators import build as B
from stratalens.operators import resolve as R
from stratalens.operators import runs as U
from stratalens.sources import parse as P
from stratalens.sources.proxy import view, with_views
from stratalens.sources.tables import table


def _files(s, d):
    from stratalens.functions.text import language

    return view(s, d, "files1").select("repository_id", "path", language(F.col("path")).alias("language"), "content")


def _imports(s, d):
    f = _files(s, d)
    return R.resolve(R.candidates(R.imports(f)), f)


def _old_new(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return o.where("o_orderstatus <> 'P'"), o.where("o_orderstatus in ('P', 'F')").withColumn("o_totalprice", F.col("o_totalprice") + 1)


QUERIES = {
    "agg28_run_summary": lambda s, d: U.run_summary(view(s, d, "jobs")),
    "agg24_jobs_by_state": lambda s, d: view(s, d, "jobs").groupBy("state").agg(F.count(F.lit(1)).alias("n")),
    "agg25_costs": lambda s, d: U.costs(view(s, d, "costs"), s.createDataFrame(list(U.PRICES), "prefix string, price_in double, price_out double")),
    "st1_debounce": lambda s, d: U.debounce(table(s, d, "events"), "user_id", "ts", "1 hour"),
    "agg27_branches": lambda s, d: view(s, d, "jobs").groupBy(F.col("phase").alias("branch")).agg(F.max("updated_at").alias("last"), F.count(F.lit(1)).alias("n")),
    "jsn1_props": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
    "jn13_keep_newest": lambda s, d: U.keep_newest(view(s, d, "jobs").select("run_id", "id"), "run_id", "id", 5),
    "srt6_newest_chronological": lambda s, d: table(s, d, "events").select("event_id", "ts").orderBy(F.desc("event_id")).limit(30).orderBy("event_id"),
    "snk2_upsert": lambda s, d: U.upsert(*_old_new(s, d), ["o_orderkey"]),
    "set6_replace_changed": lambda s, d: U.replace_changed(*_old_new(s, d), table(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey"),
    "set4_prune": lambda s, d: table(s, d, "nodes").where("node_type = 'file'").select("repository_id", F.col("node_id").alias("path")).distinct().join(view(s, d, "files1").select("repository_id", "path"), ["repository_id", "path"], "left_anti"),
    "res_import_edges": _imports,
    "src9_symbols": lambda s, d: P.symbols(_files(s, d)).groupBy("language", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("complexity").alias("max_complexity")),
    "gr1_structure_edges": lambda s, d: B.structure_edges(view(s, d, "symbols1")),
    "str16_mermaid": lambda s, d: B.mermaid(A.cross_communities(view(s, d, "g_edges"), view(s, d, "g_nodes").select("id", F.col("language").alias("community")))),
    "wk3_page_plan": lambda s, d: B.plan_pages(_files(s, d).where("language = 'go'").select("path").distinct(), _files(s, d).where("language = 'rust'").select("path").distinct()),
    "src9_imports": lambda s, d: R.imports(_files(s, d)).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("raw").alias("modules")),
}

#: The import statements by language (fixed values), in the other engine's dialect.
_IMPORT_SQL = {
    "typescript": r"""(?m)^\s*(?:import|export)\b[^'"\n]*from\s+['"]([^'"]+)['"]""", "javascript": r"""(?m)^\s*(?:import|export)\b[^'"\n]*from\s+['"]([^'"]+)['"]""", "python": r"(?m)^\s*(?:from|import)\s+([\w.]+)",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;", "rust": r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", "go": r'(?m)^\s*(?:import\s+)?(?:\w+\s+)?"([^"\n]+)"\s*$',
}
_EXT = "case lower(regexp_extract(path, '\\.([^./]+)$', 1)) when 'ts' then 'typescript' when 'js' then 'javascript' when 'py' then 'python' when 'java' then 'java' when 'rs' then 'rust' when 'go' then 'go' end"
_IMPORTED = " union all ".join("select '%s' as language, unnest(regexp_extract_all(content, '%s', 1)) as raw from x where lang = '%s'" % (k, v.replace("'", "''"), k) for k, v in _IMPORT_SQL.items())

_RUN = "last as (select run_id, phase, arg_max(state, (updated_at, id)) as state, max(updated_at) as updated_at from jobs group by 1, 2)"
ORACLE = {
    "src9_imports": with_views(f"with x as (select {_EXT} as lang, content from files1), i as ({_IMPORTED}) select language, count(*) as n, count(distinct raw) as modules from i group by 1", "files1"),
    "str16_mermaid": with_views("""with w as (select least(a.language, b.language) as a, greatest(a.language, b.language) as b, count(*) as weight from g_edges e join g_nodes a on a.id = e.src join g_nodes b on b.id = e.dst where a.language <> b.language group by 1, 2),
        l as (select '  ' || regexp_replace(a, '[^A-Za-z0-9_]', '_', 'g') || ' -->|' || weight::varchar || '| ' || regexp_replace(b, '[^A-Za-z0-9_]', '_', 'g') as line from w) select 'graph LR' || chr(10) || string_agg(line, chr(10) order by line) as text from l""", "g_nodes", "g_edges"),
    "agg28_run_summary": with_views(f"with {_RUN} select run_id, case when bool_or(state = 'failed') then 'failed' when bool_or(state in ('pending', 'running')) then 'running' else 'succeeded' end as verdict, count(*) as phases, max(updated_at) as updated_at from last group by 1", "jobs"),
    "agg24_jobs_by_state": with_views("select state, count(*) as n from jobs group by 1", "jobs"),
    "agg25_costs": with_views("select operation, count(*) as calls, round(sum((tokens_in * case when starts_with(model, 'vendor-model-large-2024') then 2.5 when starts_with(model, 'vendor-model-large') then 3.0 else 0.2 end + tokens_out * case when starts_with(model, 'vendor-model-large-2024') then 10.0 when starts_with(model, 'vendor-model-large') then 15.0 else 0.8 end) / cast(1000000 as double)), 9) as cost from costs group by 1", "costs"),
    "st1_debounce": "select user_id, count(*) as n, min(ts) as first, max(ts) as last from (select *, sum(nw) over (partition by user_id order by ts, event_id) as g from (select *, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 1 hour then 1 else 0 end as nw from events) x) y group by user_id, g",
    "agg27_branches": with_views("select phase as branch, max(updated_at) as last, count(*) as n from jobs group by 1", "jobs"),
    "jsn1_props": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "jn13_keep_newest": with_views("select run_id, id from jobs qualify row_number() over (partition by run_id order by id desc) <= 5", "jobs"),
    "srt6_newest_chronological": "select event_id, ts from (select event_id, ts from events order by event_id desc limit 30) order by event_id",
    "snk2_upsert": "select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderstatus not in ('P', 'F') union all select o_orderkey, o_totalprice + 1, o_orderstatus from orders where o_orderstatus in ('P', 'F')",
    "set6_replace_changed": "select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderstatus not in ('P', 'F') union all select o_orderkey, o_totalprice + 1, o_orderstatus from orders where o_orderstatus = 'F'",
    "set4_prune": with_views("select distinct repository_id, node_id as path from nodes n where node_type = 'file' and not exists (select 1 from files1 f where f.repository_id = n.repository_id and f.path = n.node_id)", "files1"),
    "gr1_structure_edges": with_views("""select distinct repository_id, src, dst, edge_type, cast(1.0 as double) as confidence from (
        select repository_id, file_path as src, id as dst, 'defines' as edge_type from symbols1
        union all select c.repository_id, p.id, c.id, case when c.kind in ('constant', 'variable') then 'has_property' else 'has_method' end from symbols1 c join symbols1 p
          on p.repository_id = c.repository_id and p.file_path = c.file_path and p.name = c.parent_name and p.parent_name is null and p.ordinal < c.ordinal) e where src <> dst""", "symbols1"),
    "wk3_page_plan": with_views("""with p as (select distinct path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) as ext from files1 where lower(regexp_extract(path, '\\.([^./]+)$', 1)) in ('go', 'rs'))
        select path, 'file' as kind from p where ext = 'go' union select array_to_string(string_split(path, '/')[1:k], '/'), 'directory' from (select path, unnest(range(1, len(string_split(path, '/')))) as k from p) q""", "files1"),
}
