"""Queries over the commit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import gitstats as G
from stratalens.operators import insights as I
from stratalens.sources.proxy import view, with_views


def _t(s, d):
    return view(s, d, "touches")


_AUTHORS = """
authors0 as (select path, author, count(*) as commits, min(author_name) as display from touches group by path, author),
authors as (select *, commits / sum(commits) over (partition by path) as share,
  row_number() over (partition by path order by commits desc, author) as rank from authors0)"""
_PER = """
per as (select path, count(*) as total_commits, count(*) filter (ts > now - interval 90 days) as commits_90d, count(*) filter (ts > now - interval 30 days) as commits_30d,
  cast(coalesce(sum(additions) filter (ts > now - interval 90 days), 0) as bigint) as added_90d, cast(coalesce(sum(deletions) filter (ts > now - interval 90 days), 0) as bigint) as deleted_90d,
  min(ts) as first_commit, max(ts) as last_commit, max(now) as now from touches group by path)"""
_CHURN = _PER + """,
churn as (select path, added_90d + deleted_90d as churn, case when count(*) over () = 1 then 1.0 else cast(row_number() over (order by added_90d + deleted_90d, path) - 1 as double) / (count(*) over () - 1) end as churn_pct from per)"""
_BUS = _AUTHORS + """,
bus as (select path, cast(coalesce(min(rank) filter (run >= 0.8 - 1e-12), count(*)) as bigint) as bus_factor
  from (select *, sum(share) over (partition by path order by rank rows unbounded preceding) as run from authors where rank <= 10) group by path)"""
_PAIRS = """
small as (select commit_id from touches group by commit_id having count(*) between 2 and 200),
pairs as (select a.path as a, b.path as b, count(*) as n from touches a join touches b on a.commit_id = b.commit_id and a.path < b.path
  where a.commit_id in (select commit_id from small) group by a.path, b.path)"""

QUERIES = {
    "agg1_git_rollup": lambda s, d: G.per_file(_t(s, d)),
    "agg2_top_authors": lambda s, d: G.authors(_t(s, d)).withColumn("share", F.round("share", 6)),
    "agg3_owners": lambda s, d: G.owners(_t(s, d)),
    "agg4_bus_factor": lambda s, d: G.bus_factor(_t(s, d)),
    "agg5_contributors": lambda s, d: G.contributors(_t(s, d)),
    "agg7_churn": lambda s, d: G.churn(_t(s, d)).withColumn("churn_pct", F.round("churn_pct", 6)),
    "agg8_partners": lambda s, d: G.partners(_t(s, d)),
    "agg9_commit_categories": lambda s, d: G.categories(view(s, d, "commits")),
    "agg11_bus_split": lambda s, d: I.bus_split(G.bus_factor(_t(s, d))),
    "agg12_churn_histogram": lambda s, d: I.churn_histogram(G.churn(_t(s, d))),
    "agg13_top_contributors": lambda s, d: I.top_contributors(G.authors(_t(s, d))),
    "agg19_ownership_treemap": lambda s, d: I.ownership(G.churn(_t(s, d)).join(G.owners(_t(s, d)), "path")),
    "agg20_contributor_network": lambda s, d: I.network(G.authors(_t(s, d))),
    "agg21_risk_headline": lambda s, d: I.headline(I.git_card(_t(s, d))),
    "hs1_hotspots": lambda s, d: I.hotspots(I.git_card(_t(s, d))),
    "jn6_hidden_coupling": lambda s, d: I.hidden_coupling(G.pairs(_t(s, d), 3), I.path_edges(view(s, d, "g_edges"), view(s, d, "g_nodes"))),
    "jn8_cochange_pairs": lambda s, d: G.pairs(_t(s, d)),
    "jn9_coauthors": lambda s, d: I.coauthors(G.authors(_t(s, d))),
    "at1_attention": lambda s, d: I.attention(I.git_card(_t(s, d))),
    "rk1_risk": lambda s, d: I.risk(I.git_card(_t(s, d)), I.path_edges(view(s, d, "g_edges"), view(s, d, "g_nodes"))),
}

_CARD = _BUS + "," + _CHURN + """,
card as (select p.path, p.total_commits, p.commits_90d, o.author as owner, o.share as owner_share, b.bus_factor, c.churn, c.churn_pct, c.churn > 0 and c.churn_pct >= 0.9 as is_hotspot
  from per p join (select * from authors where rank = 1) o on o.path = p.path join bus b on b.path = p.path join churn c on c.path = p.path)"""
_EDGES = "edges as (select a.path as src, b.path as dst from g_edges e join g_nodes a on a.id = e.src join g_nodes b on b.id = e.dst)"


def _o(sql, *views):
    return with_views(sql, "touches", *views)


ORACLE = {
    "agg1_git_rollup": _o(f"with {_PER} select path, total_commits, commits_90d, commits_30d, added_90d, deleted_90d, first_commit, last_commit, greatest(0, cast(floor(epoch(now - first_commit) / 86400) as bigint)) as age_days, round((added_90d + deleted_90d) / total_commits, 6) as avg_commit_size from per"),
    "agg2_top_authors": _o(f"with {_AUTHORS} select path, author, commits, display, round(share, 6) as share, cast(rank as int) as rank from authors where rank <= 10"),
    "agg3_owners": _o(f"with {_AUTHORS}, ra as (select path, author, row_number() over (partition by path order by count(*) desc, author) as rank from touches where ts > now - interval 90 days group by path, author) select a.path, a.author as owner, round(a.share, 6) as owner_share, r.author as recent_owner from authors a left join ra r on r.path = a.path and r.rank = 1 where a.rank = 1"),
    "agg4_bus_factor": _o(f"with {_BUS} select * from bus"),
    "agg5_contributors": _o("select path, count(distinct author) as contributors from touches group by path"),
    "agg7_churn": _o(f"with {_CHURN} select path, churn, round(churn_pct, 6) as churn_pct, churn > 0 and churn_pct >= 0.9 as is_hotspot, churn_pct <= 0.1 as is_stable from churn"),
    "agg8_partners": _o(f"with {_PAIRS}, both_ as (select a as path, b as partner, n from pairs union all select b, a, n from pairs) select path, partner, n, cast(row_number() over (partition by path order by n desc, partner) as int) as rank from both_ qualify rank <= 10"),
    "agg9_commit_categories": with_views("""
        select category, count(*) as n, cast(sum(count(*)) over () as bigint) as total from (select case commit_id % 12 when 0 then 'feature' when 1 then 'fix' when 2 then 'dependency' when 3 then 'refactor' when 4 then 'docs'
          when 5 then 'other' when 6 then 'feature' when 7 then 'refactor' when 8 then 'chore' when 9 then 'refactor' when 10 then 'chore' else 'test' end as category from commits where n_parents <= 1) group by category""", "commits"),
    "agg11_bus_split": _o(f"with {_BUS} select count(*) filter (bus_factor >= 3) as safe, count(*) filter (bus_factor = 2) as warning, count(*) filter (bus_factor <= 1) as risk, count(*) as total from bus"),
    "agg12_churn_histogram": _o(f"with {_CHURN} select b as bucket, count(path) as n from range(5) r(b) left join churn on least(4, greatest(0, cast(floor(churn_pct * 5) as bigint))) = b group by b"),
    "agg13_top_contributors": _o(f"with {_AUTHORS} select display, cast(sum(commits) as bigint) as commits, count(distinct path) as files from authors where rank <= 10 group by display order by commits desc, display limit 8"),
    "agg19_ownership_treemap": _o(f"with {_CARD}, m as (select split_part(path, '/', 1) as top, owner, count(*) as k, row_number() over (partition by split_part(path, '/', 1) order by count(*) desc, owner) as r from card group by 1, 2) select split_part(path, '/', 1) as top, count(*) as files, count(*) filter (is_hotspot) as hotspots, round(avg(churn_pct), 6) as mean_churn, max(m.owner) as owner from card left join m on m.top = split_part(path, '/', 1) and m.r = 1 group by 1"),
    "agg20_contributor_network": _o(f"with {_AUTHORS}, n as (select author, sum(commits) as c from authors where rank <= 10 group by author order by c desc, author limit 40), k as (select path, author from authors where rank <= 10 and author in (select author from n)) select a.author as a, b.author as b, count(*) as weight from k a join k b on a.path = b.path and a.author < b.author group by 1, 2 order by weight desc, a, b limit 200"),
    "agg21_risk_headline": _o(f"with {_CARD} select count(*) as files, count(*) filter (is_hotspot) as hotspots, count(*) filter (bus_factor <= 1) as bus_risk, count(*) filter (owner_share > 0.8 and commits_90d > 0) as silos, count(*) filter (commits_90d > 0) as active from card"),
    "hs1_hotspots": _o(f"with {_CARD} select path, owner, round(owner_share, 6) as owner_share, bus_factor, churn, round(churn_pct, 6) as churn_pct, commits_90d from card where is_hotspot"),
    "jn6_hidden_coupling": _o(f"with {_PAIRS}, {_EDGES}, u as (select least(src, dst) as a, greatest(src, dst) as b from edges) select a, b, n, a as file_path, 1.5 as impact from pairs p where n >= 3 and not exists (select 1 from u where u.a = p.a and u.b = p.b)", "g_nodes", "g_edges").replace("1.5 as", "cast(1.5 as double) as"),
    "jn8_cochange_pairs": _o(f"with {_PAIRS} select a, b, n from pairs"),
    "jn9_coauthors": _o(f"with {_AUTHORS} select a.author as a, b.author as b, count(*) as shared from authors a join authors b on a.path = b.path and a.author < b.author and a.rank <= 10 and b.rank <= 10 group by 1, 2"),
    "at1_attention": _o(f"with {_CARD} select * from (select 'knowledge_silo' as section, path, cast(row_number() over (order by churn_pct desc, path) as int) as place from card where bus_factor <= 1 and commits_90d > 0 qualify place <= 5) union all select * from (select 'ungoverned_hotspot', path, cast(row_number() over (order by churn_pct desc, path) as int) as place from card where is_hotspot and bus_factor > 1 qualify place <= 5)"),
    "rk1_risk": _o(f"with {_CARD}, {_EDGES}, deps as (select dst as path, count(distinct src) as dependents from edges group by dst), r as (select c.path, coalesce(dependents, 0) as dependents, case when is_hotspot or churn_pct >= 0.9 then 2 else 0 end + case when coalesce(dependents, 0) >= 10 then 2 when coalesce(dependents, 0) >= 3 then 1 else 0 end + case when bus_factor <= 1 then 1 else 0 end as points, concat_ws(',', case when is_hotspot or churn_pct >= 0.9 then 'hotspot' end, case when coalesce(dependents, 0) >= 3 then 'dependents' end, case when bus_factor <= 1 then 'bus_factor' end) as reasons from card c left join deps d on d.path = c.path) select path, dependents, cast(points as int) as points, case when points >= 3 then 'high' when points >= 1 then 'medium' else 'low' end as level, reasons from r", "g_nodes", "g_edges"),
}
