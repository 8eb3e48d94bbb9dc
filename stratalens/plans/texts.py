"""Queries over texts: security, decisions, search, strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import text as T
from stratalens.operators import mining as M
from stratalens.sources.proxy import view, with_views
from stratalens.sources.tables import table


def _f(s, d):
    """Every delivery of a file; callers count equal results once, so that no text is shuffled."""
    return table(s, d, "files").select(F.col("file_id").alias("id"), "path", F.col("content").alias("text"))


def _d(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _nearest(s, d):
    v = table(s, d, "embeddings")
    q = v.where("vec_id = 0").first()
    if q is None:  # as in its SQL, where the cosine with a missing row is null
        return v.select("vec_id", F.lit(None).cast("double").alias("cosine")).orderBy("vec_id").limit(10)
    return M.nearest(v, list(q.embedding))


def _nearest_each(s, d):
    v = table(s, d, "embeddings")
    return M.nearest_each(v, v.where("vec_id % 20 = 0"))


def _files(s, d, *cols):
    return view(s, d, "files1").select("file_id", *cols)


QUERIES = {
    "sec1_security": lambda s, d: M.security(_f(s, d)).distinct(),
    "sec2_by_severity": lambda s, d: table(s, d, "security_findings").dropDuplicates(["finding_id"]).groupBy("severity").agg(F.count(F.lit(1)).alias("n")),
    "dm1_inline_decisions": lambda s, d: M.inline_decisions(_f(s, d)).distinct(),
    "dm2_adr": lambda s, d: M.adr(_d(s, d)).select("id", "title", "status"),
    "dm3_changelog": lambda s, d: M.changelog(_d(s, d)),
    "dm4_commit_decisions": lambda s, d: M.commit_decisions(view(s, d, "commits")),
    "sr1_symbol_search": lambda s, d: view(s, d, "symbols1").where(F.contains(F.lower("name"), F.lit("cache"))).select("symbol_id", "name").orderBy("name", "symbol_id").limit(50),
    "sr3_lexical_search": lambda s, d: M.lexical(M.postings(_d(s, d)), ["cache", "parser", "node", "rows"]),
    "sr3_postings": lambda s, d: M.postings(_d(s, d)).groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")),
    "sr4_rescue": lambda s, d: view(s, d, "symbols1").where(F.lower("name").isin("parse_cache", "parsecache")).select("symbol_id", "name").orderBy(F.length("name"), "name", "symbol_id").limit(20),
    "sr5_triage": lambda s, d: M.triage(
        view(s, d, "symbols1").select("repository_id", F.col("file_path").alias("path"), "name"), view(s, d, "files1").select("repository_id", "path"),
        view(s, d, "nodes1").where("node_type = 'file'").select("repository_id", F.col("file_path").alias("path"), F.coalesce("pagerank", F.lit(0.0)).alias("pagerank")), "cache"),
    "jn3_first_quote": lambda s, d: M.first_quote(table(s, d, "security_findings")),
    "jn14_context_card": lambda s, d: M.context_card(view(s, d, "files1"), view(s, d, "nodes1"), view(s, d, "symbols1"), table(s, d, "security_findings")),
    "srt5_nearest": _nearest,
    "srt5_nearest_each": _nearest_each,
    "mth4_cosine": lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(T.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm2")),
    "emb1_embed": lambda s, d: M.embed(_d(s, d)).select("id", "content_hash", F.size("vector").alias("dim")),
    "hsh1_content_hash": lambda s, d: _f(s, d).where("text is not null").select("id", F.sha2("text", 256).alias("content_hash")).distinct(),
    "src1_skip_reason": lambda s, d: _files(s, d, "path", T.skip_reason(F.col("path"), F.col("size_bytes"), F.col("content")).alias("skip_reason")),
    "src4_flags": lambda s, d: _files(s, d, T.is_test(F.col("path")).alias("is_test"), T.is_entry(F.col("path")).alias("is_entry"), T.is_contract(F.col("path")).alias("is_contract")),
    "src7_language": lambda s, d: _files(s, d, T.language(F.col("path")).alias("language")),
    "src8_walk_stats": lambda s, d: _files(s, d, F.coalesce(T.skip_reason(F.col("path"), F.col("size_bytes"), F.col("content")), F.lit("included")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
    "src16_parse_cache": lambda s, d: _changed(s, d),
    "str_paths": lambda s, d: _files(s, d, F.substring_index("path", "/", 2).alias("module"), T.top_segment(F.col("path")).alias("top"), T.stem(F.col("path")).alias("stem")),
    "str8_test_targets": lambda s, d: _files(s, d, F.explode(T.test_targets(F.col("path"))).alias("target")),
    "jn7_tested_files": lambda s, d: view(s, d, "files1").select("file_id", "repository_id", "path").join(view(s, d, "files1").select("repository_id", F.explode(T.test_targets(F.col("path"))).alias("path")), ["repository_id", "path"], "left_semi").select("file_id"),
    "str9_slug": lambda s, d: _slugs(s, d),
    "str10_variants": lambda s, d: view(s, d, "symbols1").select("name").distinct().select("name", F.array_join(T.variants(F.col("name")), "|").alias("variants")),
    "str11_terms": lambda s, d: _d(s, d).where("text is not null").select("id", F.size(T.terms(F.col("text"))).cast("long").alias("n_terms")),
    "str12_ellipsis": lambda s, d: _d(s, d).select("id", T.ellipsis(F.col("text"), 40).alias("short")),
    "str14_line_slice": lambda s, d: _f(s, d).where("text <> ''").select("id", T.line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("slice")).distinct(),
    "str15_title": lambda s, d: _d(s, d).where("text is not null").select("id", T.title(F.col("text")).alias("title")),
}


def _changed(s, d):
    f = view(s, d, "files1").select("file_id", F.sha2("content", 256).alias("h"))
    cache = table(s, d, "files").where("source_hash is not null").groupBy("file_id").agg(F.max("source_hash").alias("h"))
    return f.where("h is not null").join(cache, ["file_id", "h"], "left_anti").select("file_id")


def _slugs(s, d):
    from pyspark.sql import Window

    r = table(s, d, "repositories").select("id", T.slug(F.col("name")).alias("slug"))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("id"))
    return r.select("id", F.when(n == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.substring("id", 1, 6))).alias("slug"))


_L = "l as (select file_id as id, path, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as line_no from files1 where content <> '')"
_DL = "l as (select doc_id as id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents where text <> '')"


def _q(x):
    return x.replace("'", "''")


def _sec():
    out = []
    for kind, sev, pat, concat, redact in M.RULES:
        shown = f"regexp_replace(line, '{_q(pat)}', '[redacted]', 'g')" if redact else "line"
        also = f" and regexp_matches(line, '{_q(M.CONCAT)}')" if concat else ""
        out.append(f"select id, cast(line_no as int) as line_no, '{kind}' as kind, '{sev}' as severity, substr(trim({shown}, ' '), 1, 160) as snippet from l where regexp_matches(line, '{_q(pat)}'){also}")
    return with_views(f"with {_L} " + " union all ".join(out), "files1")


_EXT = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"
_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_STEM = f"regexp_replace({_BASE}, '\\.[^.]*$', '')"
_LANG = "case " + " ".join(f"when {_EXT} = '{k}' then '{v}'" for k, v in T.LANGUAGES.items()) + " end"
_SKIP = f"""case when len(list_intersect(string_split(path, '/')[:-2], [{', '.join(repr(x) for x in T.BLOCKED_DIRS)}])) > 0 then 'directory' when {_EXT} in ({', '.join(repr(x) for x in T.BLOCKED_EXT)}) then 'extension'
    when regexp_matches({_BASE}, '\\.min\\.(js|css)$|\\.lock$|^(package-lock\\.json|pnpm-lock\\.yaml|go\\.sum)$') then 'filename' when size_bytes > 512000 then 'size' when ({_LANG}) is null then 'language' when contains(substr(content, 1, 8192), chr(0)) then 'binary'
    when {' or '.join(f"contains(substr(content, 1, 512), '{g}')" for g in T.GENERATED)} or regexp_matches({_BASE}, '(_pb2|_pb2_grpc)\\.py$|_pb\\.[jt]s$|\\.pb\\.go$') then 'generated' end"""
_TT = f"""tt as (select file_id, repository_id, regexp_replace(path, '[^/]*$', '') || unnest(list_filter([case when regexp_matches({_BASE}, '_test\\.go$') then regexp_replace({_BASE}, '_test\\.go$', '.go') end, case when regexp_matches({_BASE}, '^test_.*\\.py$') then regexp_replace({_BASE}, '^test_', '') end,
    case when regexp_matches({_BASE}, '_test\\.py$') then regexp_replace({_BASE}, '_test\\.py$', '.py') end, case when regexp_matches({_BASE}, '\\.(test|spec)\\.\\w+$') then regexp_replace({_BASE}, '\\.(test|spec)(\\.\\w+)$', '\\2') end, case when regexp_matches({_BASE}, 'Test\\.java$') then regexp_replace({_BASE}, 'Test\\.java$', '.java') end], lambda x: x is not null)) as target from files1)"""
_TERMS = f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)), lambda x: length(x) >= 3 and x not in ({', '.join(repr(w) for w in T.STOPWORDS)}))"
_POST = f"po as (select doc_id as id, unnest({_TERMS}) as term from documents where text is not null)"

ORACLE = {
    "dm2_adr": r"""select doc_id as id, trim(regexp_extract(text, '(?m)^#{1,6}[ \t]+(.+)$', 1)) as title,
        case when regexp_extract(text, '(?im)^(?:status\s*:\s*|##\s*status\s*\n+\s*)(\w+)', 1) = '' then 'accepted' else lower(regexp_extract(text, '(?im)^(?:status\s*:\s*|##\s*status\s*\n+\s*)(\w+)', 1)) end as status
        from documents where regexp_matches(text, '(?m)^#\s+\S')""",
    "str10_variants": with_views(r"""with n as (select distinct name from symbols1 where name is not null),
        p as (select name, list_filter(string_split(name, '_'), lambda x: x <> '') as parts from n),
        q as (select name, parts, list_transform(parts, lambda x: upper(x[1:1]) || lower(x[2:201])) as cap from p),
        v as (select name, unnest(list_value(name, lower(name), lower(regexp_replace(name, '(.)([A-Z])', '\1_\2', 'g')), case when contains(name, '_') then array_to_string(cap, '') end,
              case when contains(name, '_') then lower(parts[1]) || array_to_string(cap[2:51], '') end)) as w from q)
        select name, string_agg(w, '|' order by w) as variants from (select distinct name, w from v where w is not null) group by 1""", "symbols1"),
    "sec1_security": _sec(),
    "sec2_by_severity": "select severity, count(*) as n from (select distinct on (finding_id) * from security_findings) group by 1",
    "dm1_inline_decisions": with_views(f"with {_L} select id, cast(line_no as int) as line_no, case upper(regexp_extract(line, '(?i)\\b(DECISION|WHY|TRADEOFF|RATIONALE)\\s*:\\s*(.+?)\\s*$', 1)) when 'RATIONALE' then 'WHY' else upper(regexp_extract(line, '(?i)\\b(DECISION|WHY|TRADEOFF|RATIONALE)\\s*:\\s*(.+?)\\s*$', 1)) end as marker, regexp_extract(line, '(?i)\\b(DECISION|WHY|TRADEOFF|RATIONALE)\\s*:\\s*(.+?)\\s*$', 2) as title from l where regexp_matches(line, '(?i)\\b(DECISION|WHY|TRADEOFF|RATIONALE)\\s*:\\s*(.+?)\\s*$') and id in (select file_id from files1 where regexp_matches(content, 'DECISION|WHY|TRADEOFF|RATIONALE'))", "files1"),
    "dm3_changelog": f"with {_DL}, v as (select *, last_value(case when regexp_matches(line, '{_q(M.VERSION)}') then regexp_extract(line, '{_q(M.VERSION)}', 1) end ignore nulls) over (partition by id order by line_no) as version from l) select id, cast(line_no as int) as line_no, version, trim(regexp_extract(line, '^\\s*[-*+]\\s+(.*)$', 1)) as entry from v where regexp_matches(line, '^\\s*[-*+]\\s+(.*)$') and regexp_matches(line, '{_q(M.BREAKING)}') and version is not null",
    "dm4_commit_decisions": with_views("select commit_id, lower(regexp_extract(message, '^([a-zA-Z]+)(\\([^)]+\\))?!:\\s+(.+)', 1)) as kind, regexp_extract(message, '^([a-zA-Z]+)(\\([^)]+\\))?!:\\s+(.+)', 3) as title from commits where regexp_matches(message, '^([a-zA-Z]+)(\\([^)]+\\))?!:\\s+(.+)')", "commits"),
    "sr1_symbol_search": with_views("select symbol_id, name from symbols1 where contains(lower(name), 'cache') order by name, symbol_id limit 50", "symbols1"),
    "sr3_lexical_search": f"with {_POST}, k as (select id, term, count(*) as n from po where term in ('cache', 'parser', 'node', 'rows') group by 1, 2) select id, count(*) as matched, cast(sum(n) as bigint) as hits from k group by 1 order by matched desc, hits desc, id limit 12",
    "sr3_postings": f"with {_POST} select term, count(distinct id) as docs, count(*) as n from po group by 1",
    "sr4_rescue": with_views("select symbol_id, name from symbols1 where lower(name) in ('parse_cache', 'parsecache') order by length(name), name, symbol_id limit 20", "symbols1"),
    "sr5_triage": with_views("""with h as (select * from (select distinct repository_id, file_path as path from symbols1 where contains(lower(name), 'cache') order by 1, 2 limit 100)
        union select * from (select distinct repository_id, path from files1 where contains(lower(path), 'cache') order by 1, 2 limit 100))
        select n.repository_id, n.file_path as path, coalesce(pagerank, 0) as pagerank from nodes1 n join h on h.repository_id = n.repository_id and h.path = n.file_path where node_type = 'file' order by 3 desc, 1, 2 limit 20""", "symbols1", "files1", "nodes1"),
    "jn3_first_quote": "select repository_id, file_path, arg_min(snippet, finding_id) as snippet from security_findings where snippet is not null group by 1, 2",
    "jn14_context_card": with_views("""select f.path, f.file_id, n.pagerank, coalesce(n.in_degree, 0) as in_degree, coalesce(n.out_degree, 0) as out_degree, coalesce(s.symbols, 0) as symbols, s.max_complexity, coalesce(g.findings, 0) as findings from files1 f
        left join (select * from nodes1 where node_type = 'file') n on n.repository_id = f.repository_id and n.file_path = f.path
        left join (select repository_id, file_path, count(*) as symbols, max(complexity) as max_complexity from symbols1 group by 1, 2) s on s.repository_id = f.repository_id and s.file_path = f.path
        left join (select repository_id, file_path, count(distinct finding_id) as findings from security_findings group by 1, 2) g on g.repository_id = f.repository_id and g.file_path = f.path""", "files1", "nodes1", "symbols1"),
    "srt5_nearest_each": """select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])), 6) as cosine from embeddings q, embeddings v where q.vec_id % 20 = 0
        qualify row_number() over (partition by q.vec_id order by round(list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])), 6) desc, v.vec_id) <= 10""",
    "srt5_nearest": "select vec_id, round(list_cosine_similarity(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 0)), 6) as cosine from embeddings order by 2 desc, 1 limit 10",
    "mth4_cosine": "select vec_id, round(list_dot_product(cast(embedding as double[]), cast(embedding as double[])), 4) as norm2 from embeddings",
    "emb1_embed": "select doc_id as id, sha256(substr(coalesce(text, ''), 1, 6000)) as content_hash, 32 as dim from documents",
    "hsh1_content_hash": with_views("select file_id as id, sha256(content) as content_hash from files1 where content is not null", "files1"),
    "src1_skip_reason": with_views(f"select file_id, path, {_SKIP} as skip_reason from files1", "files1"),
    "src4_flags": with_views(f"select file_id, regexp_matches(lower({_STEM}), '^(test_|spec_)|(_test|_spec|\\.test|\\.spec)$') or regexp_matches('/' || path, '/(tests?|specs?|__tests__)/') as is_test, lower({_STEM}) in ({', '.join(repr(x) for x in T.ENTRY_STEMS)}) as is_entry, regexp_matches(lower({_BASE}), 'openapi|swagger|schema\\.graphql|api\\.yaml|api\\.json') as is_contract from files1", "files1"),
    "src7_language": with_views(f"select file_id, {_LANG} as language from files1", "files1"),
    "src8_walk_stats": with_views(f"select coalesce({_SKIP}, 'included') as reason, count(*) as n from files1 group by 1", "files1"),
    "src16_parse_cache": with_views("select f.file_id from files1 f where content is not null and not exists (select 1 from (select file_id, max(source_hash) as h from files where source_hash is not null group by 1) c where c.file_id = f.file_id and c.h = sha256(f.content))", "files1"),
    "str_paths": with_views(f"select file_id, array_to_string(string_split(path, '/')[:2], '/') as module, case when contains(path, '/') then split_part(path, '/', 1) else '(root)' end as top, {_STEM} as stem from files1", "files1"),
    "str8_test_targets": with_views(f"with {_TT} select file_id, target from tt", "files1"),
    "jn7_tested_files": with_views(f"with {_TT} select file_id from files1 f where exists (select 1 from tt where tt.repository_id = f.repository_id and tt.target = f.path)", "files1"),
    "str9_slug": "select id, case when row_number() over (partition by sl order by id) = 1 then sl else sl || '-' || substr(id, 1, 6) end as slug from (select id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as sl from repositories) r",
    "str11_terms": f"select doc_id as id, cast(len({_TERMS}) as bigint) as n_terms from documents where text is not null",
    "str12_ellipsis": "select doc_id as id, case when length(text) > 40 then substr(text, 1, 40) || '…' else text end as short from documents",
    "str14_line_slice": with_views("select file_id as id, array_to_string(string_split(content, chr(10))[2:4], chr(10)) as slice from files1 where content <> ''", "files1"),
    "str15_title": "select doc_id as id, trim(regexp_extract(text, '(?m)^#{1,6}[ \\t]+(.+)$', 1)) as title from documents where text is not null",
}
