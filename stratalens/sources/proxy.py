"""Domain views over the driver's tables, as SQL both engines read.

Commits, their files, a dependency graph, coverage, jobs and costs have no tables of their own in the test data; they are
deterministic views of the star schema. Files, symbols, graph nodes, findings and documents are tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalens.sources.tables import table

#: (tables, SQL) by view; a view may use other views.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "commits": (("orders",), """
        select o_orderkey as commit_id, o_orderdate as ts,
               case when o_orderpriority like '5%' then 2 else 1 end as n_parents,
               case when o_custkey % 100 < 70 then 'Dev0' when o_custkey % 100 < 85 then 'Dev1' when o_custkey % 100 < 93 then 'dev2'
                    else concat('dev', cast(3 + o_custkey % 9 as string)) end as author_name,
               case when o_custkey % 100 < 70 then 'dev0@x' when o_custkey % 100 < 85 then 'dev1@x' else 'team@x' end as author_email,
               case o_orderkey % 12 when 0 then 'feat(core): add scan' when 1 then 'fix: wrong offset' when 2 then 'Bump deps to 2.1' when 3 then 'refactor!: split module'
                    when 4 then 'docs: readme' when 5 then 'Revert the patch' when 6 then 'add support for joins' when 7 then 'rename the reader'
                    when 8 then 'chore(ci): cache' when 9 then 'perf: faster merge' when 10 then 'Release notes' else 'tests for window' end as message
        from orders"""),
    "commit_files": (("orders", "lineitem", "part"), """
        select l_orderkey as commit_id, concat(p_type, '/', p_brand, '/part_', cast(p_partkey as string)) as path,
               sum(cast(l_quantity as bigint)) as additions, sum(cast(round(l_tax * 100) as bigint)) as deletions
        from lineitem join part on l_partkey = p_partkey join orders on o_orderkey = l_orderkey
        where o_orderpriority not like '5%'
        group by l_orderkey, p_type, p_brand, p_partkey"""),
    "touches": ((), """
        select f.commit_id, f.path, cast(f.additions as bigint) as additions, cast(f.deletions as bigint) as deletions, c.ts,
               c.author_name, concat(lower(c.author_name), '|', lower(c.author_email)) as author,
               (select max(o_orderdate) from orders) as now
        from commit_files f join commits c on f.commit_id = c.commit_id where c.n_parents <= 1"""),
    "g_nodes": (("part",), """
        select p_partkey as id, concat(p_type, '/', p_brand, '/part_', cast(p_partkey as string)) as path, p_type as language,
               p_size % 10 = 0 as is_test, p_partkey % 397 = 1 as is_entry, cast(p_size as bigint) as symbol_count
        from part"""),
    "g_edges": (("part",), """
        select distinct s as src, t as dst from (
          select p_partkey as s, (p_partkey * 7 + 3) % (select count(*) from part) as t from part
          union all
          select p_partkey as s, (p_partkey * 13 + 5) % (select count(*) from part) as t from part) e
        where s <> t and s % 5 <> 0 and (s + t) % 3 <> 0 and t > 0"""),
    "h_symbols": (("lineitem",), """
        select concat(cast(l_orderkey as string), ':', cast(l_linenumber as string), ':', cast(l_partkey as string), ':', cast(l_suppkey as string)) as id,
               l_partkey as file_id, cast(l_suppkey % 3 as bigint) as parent, l_returnflag as flag,
               case when (l_orderkey + l_linenumber) % 29 = 0 then cast(l_quantity as int) else cast(l_quantity as int) % 9 end as ccn,
               case when (l_orderkey + l_linenumber) % 29 = 0 then l_linenumber else l_linenumber % 3 end as nesting,
               case when (l_orderkey + l_linenumber) % 29 = 0 then cast(floor(l_extendedprice / 500) as int) else cast(l_quantity as int) end as n_lines
        from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity, l_extendedprice from lineitem) l"""),
    "h_coverage": (("part",), """
        select p_partkey as file_id, cast(cast(floor(p_retailprice) as bigint) % 100 as double) as line_pct from part where p_partkey % 3 = 0"""),
    "jobs": (("events",), """
        select event_id as id, concat('run', cast(user_id % 40 as string)) as run_id, event_type as phase, ts as updated_at,
               case when value < 10 then 'failed' when value < 14 then 'running' when value < 16 then 'pending' else 'completed' end as state
        from events"""),
    "costs": (("events",), """
        select event_id as id, event_type as operation, concat('vendor-model-', case when user_id % 3 = 0 then 'large-2024' when user_id % 3 = 1 then 'large' else 'small-v2' end) as model,
               cast(event_id % 900 as bigint) as tokens_in, cast(event_id % 77 as bigint) as tokens_out
        from events"""),
    "files1": (("files",), """
        select file_id, repository_id, path, max(language) as language, max(size_bytes) as size_bytes, max(is_test) as is_test, max(is_config) as is_config,
               max(is_entry_point) as is_entry_point, max(content) as content
        from files group by file_id, repository_id, path"""),
    "symbols1": (("symbols",), """
        select symbol_id, max(repository_id) as repository_id, max(id) as id, max(file_path) as file_path, max(name) as name, max(kind) as kind, max(signature) as signature,
               max(start_line) as start_line, max(end_line) as end_line, max(visibility) as visibility, max(complexity) as complexity, max(nesting) as nesting,
               max(language) as language, max(parent_name) as parent_name, max(ordinal) as ordinal
        from symbols group by symbol_id"""),
    "nodes1": (("nodes",), """
        select repository_id, node_id, node_type, coalesce(path, node_id) as file_path, language, is_test, is_entry_point, symbol_count,
               case when isnan(pagerank) then null else pagerank end as pagerank, community_id, in_degree, out_degree
        from (select *, row_number() over (partition by repository_id, node_id order by indexed_at desc nulls last, in_degree desc nulls last, out_degree desc nulls last) as rn from nodes) n where rn = 1"""),
}
USES = {"touches": ("commits", "commit_files")}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One view of a data folder."""
    tables, sql = VIEWS[name]
    for used in USES.get(name, ()):
        view(spark, folder, used).createOrReplaceTempView(used)
        tables = (*tables, *VIEWS[used][0])
    for t in tables:
        table(spark, folder, t).createOrReplaceTempView(t)
    if name == "nodes1":
        # max_by aggregates before the shuffle, where a window would sort every version
        n = table(spark, folder, "nodes")
        from pyspark.sql import functions as F

        keep = ["node_type", "path", "language", "is_test", "is_entry_point", "symbol_count", "pagerank", "community_id", "in_degree", "out_degree"]
        v = n.groupBy("repository_id", "node_id").agg(F.max_by(F.struct(*keep), F.struct("indexed_at", "in_degree", "out_degree")).alias("v"))
        v = v.select("repository_id", "node_id", "v.*").withColumn("file_path", F.coalesce("path", "node_id"))
        return v.withColumn("pagerank", F.when(~F.isnan("pagerank"), F.col("pagerank"))).drop("path")
    return spark.sql(sql)


def with_views(sql: str, *names: str) -> str:
    """The same query for an engine without these views."""
    todo: list[str] = []
    for n in names:
        for u in (*USES.get(n, ()), n):
            if u not in todo:
                todo.append(u)
    heads = ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in todo)
    return f"with recursive {heads}\n{sql}" if not sql.lstrip().lower().startswith("with ") else f"with recursive {heads},\n{sql.lstrip()[5:]}"
