"""Queries of code health."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import gitstats as G
from stratalens.operators import health as H
from stratalens.sources.proxy import view, with_views
from stratalens.sources.tables import table


def _s(s, d):
    v = view(s, d, "symbols1")
    return v.select(F.concat_ws("|", "repository_id", "file_path").alias("file"), "id", "name", "kind", "parent_name", "signature", F.col("complexity").alias("ccn"), "nesting", "start_line", "end_line")


def _h(s, d):
    return view(s, d, "h_symbols").select(F.col("file_id").cast("string").alias("file"), "id", F.col("id").alias("name"), F.lit("function").alias("kind"), F.lit(None).cast("string").alias("parent_name"), F.lit("f()").alias("signature"), "ccn", "nesting", F.lit(1).alias("start_line"), F.col("n_lines").alias("end_line"), "flag")


def _snap(s, d, flags):
    x = _h(s, d).where(F.col("flag").isin(*flags)).drop("flag")
    return H.scores(H.local_findings(x), x)


def _incremental(s, d):
    x = _h(s, d).drop("flag")
    old = H.local_findings(_h(s, d).where("flag <> 'R'").drop("flag"))
    changed = _h(s, d).where("flag = 'R'").select("file").distinct()
    return H.incremental(old, x, changed)


def _files(s, d):
    """Every delivery; the operator counts repeated ones once."""
    return table(s, d, "files").select(F.col("file_id").cast("string").alias("file"), "content")


QUERIES = {
    "bm_local_findings": lambda s, d: H.local_findings(_s(s, d)),
    "bm_local_findings_dense": lambda s, d: H.local_findings(_h(s, d).drop("flag")).groupBy("biomarker", "severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("impact"), 4).alias("impact")),
    "bm15_file_metrics": lambda s, d: H.metrics(_h(s, d), H.scores(H.local_findings(_h(s, d).drop("flag")), _h(s, d))),
    "bm16_incremental": _incremental,
    "bm17_health_diff": lambda s, d: H.compare(_snap(s, d, "AN"), _snap(s, d, "AR")),
    "bm9_untested_hotspots": lambda s, d: H.untested_hotspots(_hot(s, d), view(s, d, "h_coverage").select(F.col("file_id").cast("string").alias("file"), "line_pct"), _hot(s, d).where("file % 4 = 0")),
    "bm10_shotgun_surgery": lambda s, d: H.shotgun(G.partners(view(s, d, "touches"))),
    "bm10_shotgun_loose": lambda s, d: H.shotgun(G.partners(view(s, d, "touches")), shared=1),
    "bm12_duplication": lambda s, d: H.duplication(_files(s, d)),
    "bm14_catalog": lambda s, d: s.createDataFrame(list(H.CATALOG), "biomarker string, severity string"),
    "agg23_average_health": lambda s, d: _snap(s, d, "ANR").agg(F.round(F.coalesce(F.avg("score"), F.lit(10.0)), 6).alias("average_health"), F.count(F.lit(1)).alias("files")),
    "agg29_snapshot": lambda s, d: _snap(s, d, "ANR").agg(F.round(F.avg("score"), 6).alias("average"), F.min_by("file", F.struct("score", "file")).alias("worst_file"), F.min("score").alias("worst_score")),
    "srt2_findings_by_severity": lambda s, d: H.local_findings(_s(s, d)).orderBy(F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).otherwise(2), F.desc("impact"), "file", "biomarker", "name", "start_line").limit(200),
    "flt5_excluded_findings": lambda s, d: H.exclude(H.local_findings(_h(s, d).drop("flag")), s.createDataFrame([("1", "*"), ("2", "long_function")], "prefix string, biomarker string")).groupBy("biomarker").agg(F.count(F.lit(1)).alias("n")),
    "str6_param_count": lambda s, d: view(s, d, "symbols1").where("signature is not null").select("symbol_id", H.param_count(F.col("signature")).cast("long").alias("params")),
}


def _hot(s, d):
    return view(s, d, "g_nodes").where("not is_test").select(F.col("id").cast("string").alias("file"))


def _ramp(v, lo, hi, a, b):
    return f"case when {v} < {lo} then 0.0 when {v} >= {hi} then {b} else {a} + ({v} - {lo}) / cast({hi - lo} as double) * ({b} - {a}) end"


def _rule(src, name, sev, impact, where, nm="name", st="start_line", en="end_line"):
    return f"select file, '{name}' as biomarker, {sev} as severity, {nm} as name, {st} as start_line, {en} as end_line, round(cast({impact} as double), 6) as impact from {src} where {where}"


def _local(src):
    n = "(end_line - start_line + 1)"
    return f"""lf as (
    {_rule(src, 'high_complexity', "case when ccn >= 50 then 'critical' when ccn >= 20 then 'high' else 'medium' end", _ramp('ccn', 10, 50, 1, 5), 'ccn >= 10')}
    union all {_rule(src, 'long_function', f"case when {n} >= 120 then 'high' else 'medium' end", _ramp(n, 60, 120, 1, 3), f'{n} >= 60')}
    union all {_rule(src, 'deep_nesting', "case when nesting >= 6 then 'high' else 'medium' end", _ramp('nesting', 4, 6, 1, 2), 'nesting >= 4')}
    union all {_rule(src, 'brain_method', "'high'", '4.0', f'ccn >= 10 and nesting >= 3 and {n} >= 50')}
    union all {_rule(f"(select *, {_PC} as p from {src} where kind in ('function', 'method')) q", 'long_parameter_list', "case when p >= 8 then 'high' else 'medium' end", 'least(3.0, 0.5 + 0.4 * (p - 5))', 'p >= 5')}
    union all select c.file, 'god_class', case when k >= 25 then 'high' else 'medium' end, c.name, start_line, end_line, round(cast({_ramp('k', 15, 25, 1, 2)} as double), 6) from {src} c join (select file, parent_name, count(*) as k from {src} where kind = 'method' and parent_name is not null group by 1, 2 having count(*) >= 15) m on m.file = c.file and m.parent_name = c.name where c.kind in ('class', 'struct', 'interface', 'trait', 'impl')
    union all select file, 'god_file', case when k >= 40 then 'high' else 'medium' end, null, 1, 1, round(cast({_ramp('k', 20, 40, 1, 2)} as double), 6) from (select file, count(*) as k from {src} where parent_name is null and kind not in ('constant', 'variable') group by 1 having count(*) >= 20) f)"""


_INNER = r"regexp_extract(signature, '\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)', 1)"
_FLAT = rf"regexp_replace(regexp_replace({_INNER}, '\((?:[^()]|\([^()]*\))*\)|\[[^\[\]]*\]|\{{[^{{}}]*\}}', '', 'g'), '<[^<>]*>', '', 'g')"
_PC = f"case when trim({_INNER}) = '' then 0 else length({_FLAT}) - length(replace({_FLAT}, ',', '')) + 1 end"
_SYM = "sy as (select repository_id || '|' || file_path as file, id, name, kind, parent_name, signature, complexity as ccn, nesting, start_line, end_line from symbols1)"
_DEN = "hs as (select cast(file_id as string) as file, id, id as name, 'function' as kind, cast(null as string) as parent_name, 'f()' as signature, ccn, nesting, 1 as start_line, n_lines as end_line, flag from h_symbols)"


def _score(src, name):
    return f"{name} as (select f.file, round(greatest(1.0, least(10.0, 10 - coalesce(i, 0.0))), 4) as score from (select distinct file from {src}) f left join (select file, sum(impact) as i from lf_{name} group by 1) l on l.file = f.file)"


def _snapsql(name, flags):
    return f"src_{name} as (select * from hs where flag in ({flags})), {_local(f'src_{name}').replace('lf as', f'lf_{name} as', 1)}, {_score(f'src_{name}', name)}"


ORACLE = {
    "bm_local_findings": with_views(f"with {_SYM}, {_local('sy')} select * from lf", "symbols1"),
    "bm_local_findings_dense": with_views(f"with {_DEN}, {_local('hs')} select biomarker, severity, count(*) as n, round(sum(impact), 4) as impact from lf group by 1, 2", "h_symbols"),
    "bm15_file_metrics": with_views(f"with {_DEN}, {_snapsql('x', chr(39) + 'A' + chr(39) + ',' + chr(39) + 'N' + chr(39) + ',' + chr(39) + 'R' + chr(39))} select h.file, max(ccn) as max_ccn, max(nesting) as max_nesting, max(end_line) as nloc, count(*) as n_symbols, max(x.score) as score from hs h join x on x.file = h.file group by 1", "h_symbols"),
    "bm16_incremental": with_views(f"with {_DEN}, {_local('hs')} select * from lf", "h_symbols"),
    "bm17_health_diff": with_views(f"with {_DEN}, {_snapsql('b', chr(39) + 'A' + chr(39) + ',' + chr(39) + 'N' + chr(39))}, {_snapsql('h', chr(39) + 'A' + chr(39) + ',' + chr(39) + 'R' + chr(39))} select coalesce(b.file, h.file) as file, b.score as base, h.score as head, round(h.score - b.score, 2) as delta, case when b.score is null then 'new' when h.score is null then 'removed' when round(h.score - b.score, 2) < -0.01 then 'regressed' when round(h.score - b.score, 2) > 0.01 then 'improved' else 'same' end as status from b full outer join h on b.file = h.file", "h_symbols"),
    "bm9_untested_hotspots": with_views("select * from (select cast(n.id as string) as file, 'high' as severity, round(case when line_pct < 50 then 2 + (50 - line_pct) / 50 * 2 when line_pct is null and n.id % 4 <> 0 then 3.0 end, 6) as impact from g_nodes n left join h_coverage c on c.file_id = n.id where not is_test) where impact is not null", "g_nodes", "h_coverage"),
    "bm10_shotgun_surgery": with_views("""with small as (select commit_id from touches group by commit_id having count(*) between 2 and 200),
        p as (select a.path, b.path as partner, count(*) as n from touches a join touches b on a.commit_id = b.commit_id and a.path <> b.path where a.commit_id in (select commit_id from small) group by 1, 2),
        t as (select * from p qualify row_number() over (partition by path order by n desc, partner) <= 10) select path, count(*) as partners, round(least(3.0, 1 + 0.25 * (count(*) - 8)), 6) as impact from t where n >= 3 group by 1 having count(*) >= 8""", "touches").replace("round(least(3.0, 1 + 0.25 * (count(*) - 8)), 6)", "round(cast(least(3.0, 1 + 0.25 * (count(*) - 8)) as double), 6)"),
    "bm10_shotgun_loose": with_views("""with small as (select commit_id from touches group by commit_id having count(*) between 2 and 200),
        p as (select a.path, b.path as partner, count(*) as n from touches a join touches b on a.commit_id = b.commit_id and a.path <> b.path where a.commit_id in (select commit_id from small) group by 1, 2),
        t as (select * from p qualify row_number() over (partition by path order by n desc, partner) <= 10) select path, count(*) as partners, round(least(3.0, 1 + 0.25 * (count(*) - 8)), 6) as impact from t group by 1 having count(*) >= 8""", "touches").replace("round(least(3.0, 1 + 0.25 * (count(*) - 8)), 6)", "round(cast(least(3.0, 1 + 0.25 * (count(*) - 8)) as double), 6)"),
    "bm14_catalog": """select * from (values ('high_complexity', 'medium'), ('long_function', 'medium'), ('deep_nesting', 'medium'), ('brain_method', 'high'), ('god_class', 'medium'), ('long_parameter_list', 'medium'), ('feature_envy', 'medium'),
        ('god_file', 'medium'), ('untested_hotspot', 'high'), ('shotgun_surgery', 'medium'), ('hidden_coupling', 'medium'), ('duplication', 'low'), ('deep_inheritance', 'medium')) t(biomarker, severity)""",
    "bm12_duplication": with_views(r"""with l as (select cast(file_id as string) as file, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as line_no from files1 where content <> ''),
        m as (select file, line_no, trim(regexp_replace(regexp_replace(line, '(//|#).*$', ''), '[ \t\r]+', ' ', 'g')) as norm from l),
        q as (select * from m where norm <> ''),
        w as (select file, line_no as start_line, max(line_no) over x as end_line, count(*) over x as k, count(*) filter (length(norm) >= 3) over x as sig, string_agg(norm, chr(10)) over x as body from q window x as (partition by file order by line_no rows between current row and 5 following)),
        v as (select * from w where k = 6 and sig >= 3), c as (select body, count(*) as sites from v group by 1 having count(*) between 2 and 8),
        h as (select file, start_line, end_line, sites from v join c using (body)),
        i as (select *, case when start_line > coalesce(max(end_line) over (partition by file order by start_line, end_line rows between unbounded preceding and 1 preceding), -1) + 1 then 1 else 0 end as nw from h),
        g as (select *, sum(nw) over (partition by file order by start_line, end_line) as g from i)
        select file, cast(min(start_line) as int) as start_line, cast(max(end_line) as int) as end_line, max(sites) as sites, case when max(sites) >= 6 then 'high' when max(sites) >= 3 then 'medium' else 'low' end as severity from g group by file, g.g""", "files1"),
    "agg23_average_health": with_views(f"with {_DEN}, {_snapsql('x', chr(39) + 'A' + chr(39) + ',' + chr(39) + 'N' + chr(39) + ',' + chr(39) + 'R' + chr(39))} select round(avg(score), 6) as average_health, count(*) as files from x", "h_symbols"),
    "agg29_snapshot": with_views(f"with {_DEN}, {_snapsql('x', chr(39) + 'A' + chr(39) + ',' + chr(39) + 'N' + chr(39) + ',' + chr(39) + 'R' + chr(39))} select round(avg(score), 6) as average, (select file from x order by score, file limit 1) as worst_file, min(score) as worst_score from x", "h_symbols"),
    "srt2_findings_by_severity": with_views(f"with {_SYM}, {_local('sy')} select * from lf order by case severity when 'critical' then 0 when 'high' then 1 else 2 end, impact desc, file, biomarker, name nulls first, start_line limit 200", "symbols1"),
    "flt5_excluded_findings": with_views(f"with {_DEN}, {_local('hs')} select biomarker, count(*) as n from lf where not starts_with(file, '1') and not (starts_with(file, '2') and biomarker = 'long_function') group by 1", "h_symbols"),
    "str6_param_count": with_views(f"select symbol_id, cast({_PC} as bigint) as params from symbols1 where signature is not null", "symbols1"),
}
