"""Queries over the dependency graph and graph nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import architecture as A
from stratalens.operators import graph as G
from stratalens.sources.proxy import view, with_views
from stratalens.sources.tables import table


def _n(s, d):
    return view(s, d, "g_nodes")


def _e(s, d):
    return view(s, d, "g_edges")


def _path(s, d):
    rows = G.shortest_path(_e(s, d), 1, 12)
    return s.createDataFrame([(i, v) for i, v in enumerate(rows)], "step long, id long")


_REACH = """reach as (
  select p_partkey as id from part where p_partkey % 397 = 1
  union
  select e.dst from reach r join g_edges e on e.src = r.id)"""
_IN = "indeg as (select dst as id, count(*) as n from g_edges group by dst)"

QUERIES = {
    "gr4_degrees": lambda s, d: G.degrees(_n(s, d), _e(s, d)),
    "gr5_pagerank": lambda s, d: G.pagerank(_n(s, d), _e(s, d), tol=1e-12).withColumn("rank", F.round("rank", 9)),
    "gr6_communities": lambda s, d: G.communities(_n(s, d), _e(s, d)),
    "gr7_betweenness": lambda s, d: G.betweenness(A.module_edges(_e(s, d), _n(s, d))).withColumn("betweenness", F.round("betweenness", 6)),
    "gr8_reachable": lambda s, d: G.reachable(_e(s, d), _n(s, d).where("is_entry")).select("id"),
    "gr9_shortest_path": _path,
    "gr10_flow_trees": lambda s, d: G.flow_trees(_e(s, d), _n(s, d).where("is_entry")),
    "gr11_dependents": lambda s, d: A.dependents(_e(s, d), _n(s, d)),
    "gr13_architecture_map": lambda s, d: A.cross_communities(_e(s, d), _n(s, d).select("id", F.col("language").alias("community"))),
    "jn1_edge_names": lambda s, d: A.named_edges(_e(s, d), _n(s, d)),
    "agg16_dependency_matrix": lambda s, d: A.matrix(_e(s, d), _n(s, d)),
    "agg17_modules": lambda s, d: A.modules(_n(s, d), _e(s, d)),
    "dc1_dead_files": lambda s, d: G.dead_files(_n(s, d), _e(s, d)),
    "agg14_languages": lambda s, d: A.languages(view(s, d, "files1")),
    "agg15_communities": lambda s, d: A.community_survey(view(s, d, "nodes1")),
    "agg22_node_counts": lambda s, d: A.node_counts(view(s, d, "nodes1")),
    "gr12_community_of": lambda s, d: A.community_sizes(view(s, d, "nodes1")),
    "gr15_entry_points": lambda s, d: A.entry_points(view(s, d, "nodes1")),
    "srt1_nodes_page": lambda s, d: A.page(view(s, d, "nodes1")),
    "agg26_directories": lambda s, d: A.directories(view(s, d, "files1")),
    "agg18_packages": lambda s, d: A.packages(view(s, d, "files1")),
    "agg31_repository_overview": lambda s, d: A.overview(view(s, d, "nodes1"), view(s, d, "files1"), view(s, d, "symbols1")),
    "dst1_distinct_paths": lambda s, d: view(s, d, "nodes1").select("repository_id", "file_path").distinct(),
    "src18_repository_lookup": lambda s, d: A.lookup(table(s, d, "repositories"), table(s, d, "repositories").select(F.concat("local_path", F.lit("/src/deep")).alias("cwd"))),
}


def _g(sql):
    return with_views(sql, "g_nodes", "g_edges")


ORACLE = {
    "gr5_pagerank": _g("""with k as (select src, 0.85 / count(*) as w from g_edges group by 1), l as (select e.dst, e.src, k.w from g_edges e join k on k.src = e.src),
        y as (select 0 as i, id, cast(1.0 as double) as v from g_nodes
              union all
              select (select any_value(i) from y) + 1, n.id, 1.0 + coalesce((m.s), 0.0) from g_nodes n left join (select l.dst, sum(y.v * l.w) as s from l join y on y.id = l.src group by 1) m on m.dst = n.id where (select any_value(i) from y) < 150)
        select id, round(v / (select sum(v) from y where i = 150), 9) as rank from y where i = 150"""),
    "gr7_betweenness": _g("""with e as (select distinct split_part(a.path, '/', 1) || '/' || split_part(a.path, '/', 2) as src, split_part(b.path, '/', 1) || '/' || split_part(b.path, '/', 2) as dst from g_edges x join g_nodes a on a.id = x.src join g_nodes b on b.id = x.dst),
        l as (select * from e where src <> dst),
        walk as (select distinct src as s, src as v, 0 as d from l union select w.s, l.dst, w.d + 1 from walk w join l on l.src = w.v where w.d < 12),
        dist as (select s, v, min(d) as d from walk group by 1, 2),
        sig as (select s, v, d, cast(1.0 as double) as n from dist where d = 0
                union all select g.s, l.dst, g.d + 1, sum(g.n) from sig g join l on l.src = g.v join dist t on t.s = g.s and t.v = l.dst and t.d = g.d + 1 group by 1, 2, 3)
        select a.v as id, round(sum(a.n * b.n / c.n), 6) as betweenness from sig a join sig b on b.s = a.v join sig c on c.s = a.s and c.v = b.v and c.d = a.d + b.d
        where a.v <> a.s and b.v <> b.s and a.s <> b.v group by 1"""),
    "gr9_shortest_path": _g("""with walk as (select 1 as id, 0 as depth union select e.dst, w.depth + 1 from walk w join g_edges e on e.src = w.id where w.depth < 60),
        m as (select id, min(depth) as depth from walk group by 1),
        p as (select e.dst as id, min(e.src) as pred from g_edges e join m a on a.id = e.src join m b on b.id = e.dst where b.depth = a.depth + 1 group by 1),
        back as (select id, cast(depth as bigint) as step from m where id = 12 union all select p.pred, b.step - 1 from back b join p on p.id = b.id where b.step > 0)
        select step, id from back"""),
    "gr10_flow_trees": _g("""with e as (select src, dst from g_edges where src <> dst qualify row_number() over (partition by src order by dst) <= 8),
        top as (select p_partkey as root from part where p_partkey % 397 = 1 order by 1 limit 8),
        a as (select t.root, e.dst, min(e.src) as src from top t join e on e.src = t.root where e.dst <> t.root group by 1, 2),
        b as (select a.root, e.dst, min(e.src) as src from a join e on e.src = a.dst where e.dst <> a.root and not exists (select 1 from a x where x.root = a.root and x.dst = e.dst) group by 1, 2),
        c as (select b.root, e.dst, min(e.src) as src from b join e on e.src = b.dst where e.dst <> b.root and not exists (select 1 from a x where x.root = b.root and x.dst = e.dst) and not exists (select 1 from b x where x.root = b.root and x.dst = e.dst) group by 1, 2)
        select root, 1 as depth, src, dst from a union all select root, 2, src, dst from b union all select root, 3, src, dst from c"""),
    "gr4_degrees": _g("select id, (select count(*) from g_edges where dst = id) as in_degree, (select count(*) from g_edges where src = id) as out_degree from g_nodes"),
    "gr8_reachable": _g(f"with {_REACH} select id from reach"),
    "gr11_dependents": _g("select n.path, count(distinct e.src) as dependents, min(m.path) as first_dependent from g_edges e join g_nodes n on n.id = e.dst join g_nodes m on m.id = e.src group by n.path"),
    "gr13_architecture_map": _g("select least(a.language, b.language) as a, greatest(a.language, b.language) as b, count(*) as weight from g_edges e join g_nodes a on a.id = e.src join g_nodes b on b.id = e.dst where a.language <> b.language group by 1, 2"),
    "jn1_edge_names": _g("select a.path as src_path, b.path as dst_path from g_edges e join g_nodes a on a.id = e.src join g_nodes b on b.id = e.dst"),
    "agg16_dependency_matrix": _g("""with me as (select split_part(a.path, '/', 1) || '/' || split_part(a.path, '/', 2) as f, split_part(b.path, '/', 1) || '/' || split_part(b.path, '/', 2) as t from g_edges e join g_nodes a on a.id = e.src join g_nodes b on b.id = e.dst),
        top as (select m from (select f as m from me union all select t from me) group by m order by count(*) desc, m limit 16)
        select x.m as from_module, y.m as to_module, (select count(*) from me where f = x.m and t = y.m) as n from top x, top y"""),
    "agg17_modules": _g("""with n as (select id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as module, symbol_count from g_nodes)
        select n.module, count(*) as files, cast(sum(symbol_count) as bigint) as symbols, coalesce(max(o.k), 0) as outgoing from n
        left join (select a.module, count(*) as k from g_edges e join n a on a.id = e.src join n b on b.id = e.dst where a.module <> b.module group by a.module) o on o.module = n.module group by n.module"""),
    "dc1_dead_files": _g(f"with {_REACH}, {_IN} select n.id, n.path, coalesce(i.n, 0) as in_degree, cast(case when i.n is null then 1.0 else 0.6 end as double) as confidence, i.n is null as safe_to_delete from g_nodes n left join indeg i on i.id = n.id where not is_entry and not is_test and n.id not in (select id from reach)"),
    "agg14_languages": with_views("select lower(language) as language, count(*) as files from files1 where language is not null and language <> '' group by 1", "files1"),
    "agg15_communities": with_views("""with f as (select * from nodes1 where node_type = 'file' and community_id is not null),
        c as (select repository_id, community_id, count(*) as size from f group by 1, 2),
        k as (select *, row_number() over (partition by repository_id order by size desc, community_id) as place from c),
        m as (select repository_id, community_id, node_id, row_number() over (partition by repository_id, community_id order by coalesce(pagerank, 0) desc, node_id) as r from f),
        dd as (select repository_id, community_id, split_part(file_path, '/', 1) as dir, row_number() over (partition by repository_id, community_id order by count(*) desc, split_part(file_path, '/', 1)) as r from f group by 1, 2, 3)
        select k.repository_id, k.community_id, k.size, cast(k.place as int) as place, dd.dir as label, string_agg(m.node_id, '|' order by m.r) as members from k join m using (repository_id, community_id) join dd using (repository_id, community_id)
        where k.place <= 20 and m.r <= 5 and dd.r = 1 group by all""", "nodes1"),
    "agg22_node_counts": with_views("select repository_id, count(*) filter (node_type = 'file') as files, count(*) filter (node_type = 'symbol') as symbols from nodes1 group by 1", "nodes1"),
    "gr12_community_of": with_views("select repository_id, community_id, count(*) as size, round(sum(coalesce(pagerank, 0)), 6) as total_rank from nodes1 where community_id is not null group by 1, 2", "nodes1"),
    "gr15_entry_points": with_views("select repository_id, node_id, coalesce(pagerank, 0) as pagerank, cast(row_number() over (partition by repository_id order by coalesce(pagerank, 0) desc, node_id) as int) as place from nodes1 where is_entry_point and node_type = 'file' qualify place <= 100", "nodes1"),
    "srt1_nodes_page": with_views("select repository_id, node_id, coalesce(pagerank, 0) as pagerank from nodes1 where node_type = 'file' order by coalesce(pagerank, 0) desc, node_id, repository_id limit 50 offset 20", "nodes1"),
    "agg26_directories": with_views("""with p as (select distinct repository_id, path, lower(language) as language from files1),
        a as (select repository_id, path, language, unnest(range(1, len(string_split(path, '/')))) as k from p),
        b as (select repository_id, array_to_string(string_split(path, '/')[1:k], '/') as dir, k = len(string_split(path, '/')) - 1 as direct, case when k < len(string_split(path, '/')) - 1 then string_split(path, '/')[k + 1] end as sub, language from a),
        l as (select repository_id, dir, language, row_number() over (partition by repository_id, dir order by count(*) desc, language) as r from b where language is not null group by 1, 2, 3)
        select b.repository_id, b.dir, count(*) filter (direct) as files, count(distinct sub) as subdirs, count(*) as all_files, max(l.language) as language from b left join l on l.repository_id = b.repository_id and l.dir = b.dir and l.r = 1 group by 1, 2""", "files1"),
    "agg18_packages": with_views("""select repository_id, regexp_replace(path, '/?[^/]*$', '') as dir, 'npm' as ecosystem, count(*) over (partition by repository_id) > 1 as is_monorepo from (select distinct repository_id, path from files1 where regexp_matches(path, '(^|/)package-lock\\.json$')) p""", "files1"),
    "agg31_repository_overview": with_views("""select r.repository_id, r.nodes, coalesce(f.files, 0) as files, coalesce(s.symbols, 0) as symbols, coalesce(f.bytes, 0) as bytes from (select repository_id, count(*) as nodes from nodes1 group by 1) r
        left join (select repository_id, count(*) as files, cast(sum(size_bytes) as bigint) as bytes from files1 group by 1) f using (repository_id) left join (select repository_id, count(*) as symbols from symbols1 group by 1) s using (repository_id)""", "nodes1", "files1", "symbols1"),
    "dst1_distinct_paths": with_views("select distinct repository_id, file_path from nodes1", "nodes1"),
    "src18_repository_lookup": "select r.id as repository_id, c.cwd from (select id, local_path from repositories) r join (select distinct local_path || '/' || 'src/deep' as cwd from repositories) c on c.cwd = r.local_path or starts_with(c.cwd, r.local_path || '/') qualify row_number() over (partition by c.cwd order by length(r.local_path) desc, r.id) = 1",
}
