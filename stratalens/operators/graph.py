"""Graph algorithms as loops over DataFrames. edges: src, dst. Self-loops and parallel edges are dropped where said.

Loops cut their lineage with a checkpoint in the shared folder each round, so a lost executor costs a re-read and no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators import alone
from stratalens.session import cut


def simple(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src <> dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree of every node, typed multi-edges counted."""
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    return nodes.select("id").join(i, "id", "left").join(o, "id", "left").fillna(0, ["in_degree", "out_degree"])


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tol: float = 1e-6, rounds: int = 120, chunk: int = 5) -> DataFrame:
    """id, rank; the mass of nodes without links out is spread over all, and ranks sum to 1.

    With uniform teleport and uniform spreading the ranks are proportional to y = 1 + damping * A y, so rounds need no global
    sum; it is taken once, to normalise. `chunk` rounds make one job. Stops when the relative change is under tol.
    """
    e = simple(edges)
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    links = cut(e.join(out, "src").select("src", "dst", (F.lit(damping) / F.col("k")).alias("w")))
    r = cut(nodes.select("id").distinct().withColumn("rank", F.lit(1.0)))
    for _ in range(0, rounds, chunk):
        nxt = r.select("id", "rank", F.col("rank").alias("old"))
        for _ in range(chunk):
            got = links.join(nxt.select(F.col("id").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("m"))
            nxt = nxt.select("id", F.col("rank").alias("old")).join(got.withColumnRenamed("dst", "id"), "id", "left").select("id", "old", (1.0 + F.coalesce("m", F.lit(0.0))).alias("rank"))
        nxt = cut(nxt)
        s = nxt.agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d"), F.sum("rank").alias("t")).first()
        r = nxt.select("id", "rank")
        if not s.t or s.d / s.t < tol:
            break
    total = s.t or 1.0
    return r.select("id", (F.col("rank") / total).alias("rank"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id, depth of every node reachable from the roots (id).

    Frontier rounds, in which links to reached nodes are dropped from time to time; as soon as what is left is no more than
    `alone.WALKED` links, one task walks all of it, since a graph may be hundreds of links deep.
    """
    e = cut(simple(edges))
    front = state = cut(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while e.count() > alone.WALKED:
        for _ in range(8):
            step = front.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
            depth += 1
            front = cut(step.join(state.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
            if not front.limit(1).count():
                return state
            state = state.unionAll(front)
        state = cut(state.repartition("id"))
        e = cut(e.join(state.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    return state.unionAll(alone.walked(e, front, depth))


def shortest_path(edges: DataFrame, start: object, goal: object) -> list:
    """Nodes from start to goal on a shortest path, smallest predecessors first; empty without one, [start] when equal."""
    if start == goal:
        return [start]
    e = cut(simple(edges))
    kind = dict(edges.dtypes)["src"]
    state = e.sparkSession.createDataFrame([(start, [start], 0)], f"id {kind}, path array<{kind}>, depth int")
    depth = 0
    while True:
        step = state.where(F.col("depth") == depth).join(e, F.col("id") == F.col("src")).groupBy("dst").agg(F.min_by("path", "src").alias("path"))
        depth += 1
        new = step.withColumnRenamed("dst", "id").join(state.select("id"), "id", "left_anti")
        new = new.select("id", F.concat("path", F.array("id")).alias("path"), F.lit(depth).alias("depth"))
        state = cut(state.unionAll(new).repartition("id"))
        found = state.where((F.col("depth") == depth)).agg(F.max(F.when(F.col("id") == F.lit(goal), F.col("path"))).alias("path"), F.count(F.lit(1)).alias("n")).first()
        if found.path or not found.n:
            return list(found.path or [])


def betweenness(edges: DataFrame) -> DataFrame:
    """id, betweenness of the nodes that lie on shortest paths (directed, endpoints not counted).

    Brandes from all sources at once: rounds give distance and number of shortest paths of each (source, node), and the
    dependencies are summed back level by level. The state has a row for each reachable pair.
    """
    e = cut(simple(edges))
    ids = e.select(F.col("src").alias("s")).distinct()
    front = cut(ids.select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")).withColumn("d", F.lit(0)))
    seen, levels = front, [front]
    while True:
        step = front.join(e, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        front = cut(step.join(seen.select("s", "v"), ["s", "v"], "left_anti").withColumn("d", F.lit(len(levels))))
        if not front.limit(1).count():
            break
        levels.append(front)
        seen = seen.unionAll(front.select("s", "v", "paths", "d"))
    total, deps = None, None
    for k in range(len(levels) - 1, 0, -1):
        low = levels[k]
        low = low.join(deps, ["s", "v"], "left").fillna(0.0, ["dep"]) if deps is not None else low.withColumn("dep", F.lit(0.0))
        inner = low.select("v", "dep")
        total = inner if total is None else total.unionAll(inner)
        up = levels[k - 1].select("s", F.col("v").alias("u"), F.col("paths").alias("pu"))
        back = low.select("s", "v", "paths", "dep").join(e.withColumnsRenamed({"dst": "v", "src": "u"}), "v").join(up, ["s", "u"])
        deps = cut(back.groupBy("s", "u").agg(F.sum(F.col("pu") / F.col("paths") * (1 + F.col("dep"))).alias("dep")).withColumnRenamed("u", "v"))
    if total is None:
        return ids.select(F.col("s").alias("id"), F.lit(0.0).alias("betweenness")).limit(0)
    return total.groupBy(F.col("v").alias("id")).agg(F.sum("dep").alias("betweenness")).where("betweenness > 0")


def _modularity(both: DataFrame, own: DataFrame, m2: float) -> float:
    """Modularity of communities (x, c, k) over links in both directions (x, y, w)."""
    c = own.select("x", "c")
    inner = both.join(c, "x").join(c.select(F.col("x").alias("y"), F.col("c").alias("t")), "y").where("c = t").agg(F.sum("w").alias("s")).first().s
    square = own.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("s")).first().s
    return (inner or 0.0) / m2 - square / m2**2


def communities(nodes: DataFrame, edges: DataFrame, rounds: int | None = None, levels: int | None = None) -> DataFrame:
    """id, community_id by Louvain moves of modularity, undirected, weights = number of parallel and reverse edges.

    Every round moves a part of the nodes (by hash; half of them at first) to the neighbouring community of highest gain, so
    that a sweep of rounds gives each node its turn. A level ends when a sweep moves nothing; a sweep that does not raise
    modularity, because nodes moved at once, is undone and repeated in twice as many parts, up to 64. Between levels
    communities become nodes, until a level merges nothing. A level of no more than `alone.DIVIDED` links is finished in one
    task with all levels above it, moving one node at a time. rounds and levels, if given, bound both. Ids run from 1 by size
    descending, then by smallest member. Isolated nodes are communities of one.
    """
    und = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))
    both = cut(und.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").unionAll(und.select("b", "a", "w")))
    member = cut(nodes.select("id").distinct().withColumn("c", F.col("id")))
    m2 = both.agg(F.sum("w").alias("m")).first().m
    if m2:
        level = 0
        while levels is None or level < levels:
            level += 1
            if both.count() <= 2 * alone.DIVIDED:
                left = None if levels is None else levels - level + 1
                own = alone.grouped(both, lambda g: alone.louvain(g, rounds, left))
                member = cut(member.join(own.select(F.col("x").alias("c"), F.col("c").alias("n")), "c", "left").select("id", F.coalesce("n", "c").alias("c")))
                break
            deg = cut(both.groupBy("x").agg(F.sum("w").alias("k")))
            own = cut(deg.select("x", F.col("x").alias("c"), "k"))
            best_own, best_q, moved_any = own, _modularity(both, own, m2), False
            r, sweep, part, parts, moved = 0, 0, 0, 2, 0
            while rounds is None or r < rounds:
                tot = own.groupBy("c").agg(F.sum("k").alias("tot"))
                links = both.where("x <> y").join(own.select(F.col("x").alias("y"), F.col("c").alias("t")), "y").groupBy("x", "t").agg(F.sum("w").alias("win"))
                cand = links.unionByName(own.select("x", F.col("c").alias("t"), F.lit(0.0).alias("win"))).groupBy("x", "t").agg(F.sum("win").alias("win"))
                cand = cand.join(own, "x").join(tot.withColumnRenamed("c", "t"), "t")
                gain = F.col("win") - F.col("k") * (F.col("tot") - F.when(F.col("t") == F.col("c"), F.col("k")).otherwise(0.0)) / m2
                best = cand.groupBy("x").agg(F.max_by("t", F.struct(F.round(gain, 9), F.col("t") == F.col("c"), F.hash("t"))).alias("t"))
                turn = F.pmod(F.xxhash64("x", F.lit(sweep)), F.lit(parts)) == part
                nxt = cut(own.join(best, "x").withColumn("new", F.when(turn, F.col("t")).otherwise(F.col("c"))).select("x", "c", "new", "k"))
                n = nxt.where("c <> new").count()
                own = nxt.select("x", F.col("new").alias("c"), "k")
                r, part, moved = r + 1, part + 1, moved + n
                if part < parts and r != rounds:
                    continue
                if not moved:
                    break
                q = _modularity(both, own, m2)
                if q > best_q + 1e-9:
                    best_own, best_q, moved_any = own, q, True
                else:
                    own, parts = best_own, parts * 2
                    if parts > 64:
                        break
                sweep, part, moved = sweep + 1, 0, 0
            own = best_own
            if not moved_any:
                break
            member = cut(member.join(own.select(F.col("x").alias("c"), F.col("c").alias("n")), "c", "left").select("id", F.coalesce("n", "c").alias("c")))
            up = own.select("x", "c")
            both = cut(both.join(up, "x").drop("x").withColumnRenamed("c", "p").join(up.withColumnRenamed("x", "y"), "y").groupBy(F.col("p").alias("x"), F.col("c").alias("y")).agg(F.sum("w").alias("w")))
    size = member.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    from stratalens.operators.gitstats import ranked

    order = ranked(size.select("c", (-F.col("n")).alias("size"), "low"), ["size", "low"]).select("c", F.col("rank").alias("community_id"))
    return member.join(order, "c").select("id", "community_id")


def flow_trees(edges: DataFrame, roots: DataFrame, depth: int = 3, children: int = 8, limit: int = 8) -> DataFrame:
    """root, depth, src, dst: the calls under each of the first roots, by rounds, each node once under its root.

    children bounds the listed calls of a node (a feature of the report), by name; a node first reached in a round keeps its
    smallest caller.
    """
    w = Window.partitionBy("src").orderBy("dst")
    e = simple(edges).withColumn("k", F.row_number().over(w)).where(F.col("k") <= children).select("src", "dst")
    top = roots.select("id").orderBy("id").limit(limit)
    front = top.select(F.col("id").alias("root"), F.col("id").alias("at"))
    seen, out = front, None
    for d in range(1, depth + 1):
        step = front.join(e, F.col("at") == F.col("src")).groupBy("root", "dst").agg(F.min("src").alias("src"))
        step = cut(step.join(seen.select("root", F.col("at").alias("dst")), ["root", "dst"], "left_anti"))
        rows = step.select("root", F.lit(d).alias("depth"), "src", "dst")
        out = rows if out is None else out.unionAll(rows)
        front = step.select("root", F.col("dst").alias("at"))
        seen = seen.unionAll(front)
    return out


def inheritance_depth(heritage: DataFrame, most: int = 50) -> DataFrame:
    """child, depth: the longest chain of parents, up to `most` (cycles stop there)."""
    h = cut(heritage.select("child", "parent").where("child <> parent").distinct())
    best = cut(h.groupBy("child").agg(F.lit(1).alias("depth")))
    for _ in range(most):
        up = h.join(best.select(F.col("child").alias("parent"), "depth"), "parent", "left").groupBy("child").agg((1 + F.max(F.coalesce("depth", F.lit(0)))).alias("depth"))
        nxt = cut(up)
        same = nxt.join(best, ["child", "depth"], "left_anti").limit(1).count() == 0
        best = nxt
        if same:
            break
    return best


def dead_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Unreachable files that are no entry points and no tests: confidence 1.0 without inbound edges, else 0.6."""
    live = reachable(edges, nodes.where("is_entry").select("id")).select("id")
    n = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    d = nodes.where("not is_entry and not is_test").join(live, "id", "left_anti").join(n, "id", "left").fillna(0, ["in_degree"])
    conf = F.when(F.col("in_degree") == 0, 1.0).otherwise(0.6)
    return d.select("id", "path", "in_degree", conf.alias("confidence"), (conf >= 0.9).alias("safe_to_delete"))


def unlinked_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The dead files of confidence 1.0. No edge leads to them and they are no entry points, so that nothing has to be walked."""
    met = edges.select(F.col("dst").alias("id")).unionAll(nodes.where("is_entry").select("id"))
    d = nodes.where("not is_entry and not is_test").join(met, "id", "left_anti")
    return d.select("id", "path", F.lit(0).cast("long").alias("in_degree"), F.lit(1.0).alias("confidence"), F.lit(True).alias("safe_to_delete"))


def surest_dead(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Dead files that hold the first `limit` of them by confidence, path and id.

    Those of confidence 1.0 come first; only where they are too few, the graph is walked for all.
    """
    first = cut(unlinked_files(nodes, edges).orderBy("path", "id").limit(limit))
    return first if first.count() == limit else dead_files(nodes, edges)


def dead_symbols(symbols: DataFrame, edges: DataFrame, roots: DataFrame, floor: float = 0.5) -> DataFrame:
    """Unreachable symbols: 0.8 without inbound edges other than `defines`, else 0.5. symbols: id; edges: src, dst, edge_type."""
    live = reachable(edges, roots).select("id")
    inbound = edges.where("edge_type <> 'defines'").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    d = symbols.join(live, "id", "left_anti").join(inbound, "id", "left")
    return d.withColumn("confidence", F.when(F.coalesce("n", F.lit(0)) == 0, 0.8).otherwise(0.5)).drop("n").where(F.col("confidence") >= floor)


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, edge_type): highest confidence, imported names in order without repeats."""
    names = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "imported_names"))), lambda x: x["imported_names"]))
    return edges.groupBy("src", "dst", "edge_type").agg(F.max("confidence").alias("confidence"), F.array_distinct(names).alias("imported_names"))
