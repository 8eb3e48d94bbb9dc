"""Top N rows of every group by sorted runs and a loser-tree merge.

Each partition of the input sorts its rows by group, score and key, so it holds one sorted run; in a run, a group's rows
past the N-th can never be in the result, so the run seeks to the next group after N rows (at most N rows of a group leave a
partition, however large the group). The shortened runs are stored in buckets by group and merged in each bucket by a
loser tree, which again seeks to the next group after N outputs. A group of a third of all rows is thus spread over all
partitions of the first step and arrives in its bucket as N rows from each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.sources.tables import table

N = 5


class LoserTree:
    """Merges sorted runs: replay from one leaf costs one comparison for each level."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * len(runs)
        self.tree = [0] * self.k
        self.tree[0] = self._build(1)

    def _key(self, i: int) -> tuple:
        run = self.runs[i] if i < len(self.runs) else ()
        return (0, run[self.at[i]]) if i < len(self.runs) and self.at[i] < len(run) else (1,)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._key(a) <= self._key(b) else (b, a)
        self.tree[node] = lose
        return win

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.tree[node]
            if self._key(other) < self._key(i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def top(self) -> tuple | None:
        key = self._key(self.tree[0])
        return key[1] if len(key) == 2 else None

    def pop(self) -> None:
        i = self.tree[0]
        self.at[i] += 1
        self._replay(i)

    def seek(self, group: object) -> None:
        """Past the rest of a group, in every run."""
        while (row := self.top()) is not None and row[0] == group:
            i = self.tree[0]
            run, p = self.runs[i], self.at[i]
            while p < len(run) and run[p][0] == group:
                p += 1
            self.at[i] = p
            self._replay(i)


def merge_top(runs: list[list[tuple]], n: int) -> Iterator[tuple[int, tuple]]:
    """(rank, row) of the first n rows of each group; rows are tuples that begin with their group and sort ascending."""
    tree = LoserTree(runs)
    while (row := tree.top()) is not None:
        group, rank, last = row[0], 0, None
        while row is not None and row[0] == group and rank < n:
            if row != last:  # the same row again, from another run
                rank += 1
                yield rank, row
            last = row
            tree.pop()
            row = tree.top()
        tree.seek(group)


def top_n(rows: DataFrame, group: list[str], score: str, key: str, n: int = N, buckets: int | None = None) -> DataFrame:
    """group columns, rank_no, key: the n rows of highest score of each group, ties by key ascending (by code point).

    group: columns of type string or integer; score: double; key: string. Rows with a null in one of them, or with a NaN
    score, are left out. Equal rows count once. -0.0 equals 0.0. Groups under n rows come out in full; an empty table gives
    an empty result.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    r = rows.select(*group, (-F.col(score).cast("double") + F.lit(0.0)).alias("low"), F.col(key).alias("key"))
    r = r.where(" and ".join(f"`{c}` is not null" for c in [*group, "low", "key"]) + " and not isnan(low)")
    r = r.sortWithinPartitions(*group, "low", "key")
    names = [*group, "low", "key"]
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in group) + ", low double, key string"

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tail, seen = None, 0  # the group at the end of the batch before, and its rows so far
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            new = np.zeros(m, bool)
            new[0] = True
            for c in range(len(group)):
                a = b.column(c)
                new[1:] |= pc.not_equal(a.slice(1), a.slice(0, m - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            rank = np.arange(m) - np.repeat(starts, np.diff(np.append(starts, m)))
            first = tuple(b.column(c)[0].as_py() for c in range(len(group)))
            if first == tail:
                rank[: starts[1] if len(starts) > 1 else m] += seen
            tail = tuple(b.column(c)[m - 1].as_py() for c in range(len(group)))
            seen = int(rank[-1]) + 1
            yield b.filter(pa.array(rank < n))

    short = r.mapInArrow(shorten, shape)
    # Each run is told apart by the partition it comes from.
    short = short.withColumn("run", F.spark_partition_id())
    short = short.repartition(*([buckets] if buckets else []), *group).sortWithinPartitions(*group, "run", "low", "key")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One group at a time: its runs follow each other, at most n rows of each, so a task holds the runs of one group."""
        at, runs, out = None, {}, []

        def finish() -> None:
            out.extend((*g, rank, k) for rank, (g, _, k) in merge_top(list(runs.values()), n))

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for run, g, low, k in zip(cols[-1], zip(*cols[: len(group)]), cols[-3], cols[-2]):
                if g != at:
                    finish()
                    at, runs = g, {}
                # Python orders strings by code point.
                runs.setdefault(run, []).append((g, low, k))
            if len(out) >= 10_000:
                yield _batch(out)
                out.clear()
        finish()
        if out:
            yield _batch(out)

    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kind = [*(types[kinds[c]] for c in group), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kind)], names=[*group, "rank_no", key])

    return short.mapInArrow(merge, ", ".join(f"`{c}` {kinds[c]}" for c in group) + f", rank_no int, `{key}` string")


def latest(nodes: DataFrame) -> DataFrame:
    """Each node's row of latest indexed_at (null counts as earliest), pre-aggregated before the shuffle."""
    pick = F.struct("indexed_at", "pagerank", "community_id", "node_type")
    return nodes.groupBy("repository_id", "node_id").agg(F.max(pick).alias("v")).select("repository_id", "node_id", "v.*")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The five file nodes of highest pagerank of every community of every repository."""
    nodes = latest(table(spark, folder, "nodes")).where("node_type = 'file' and community_id is not null and pagerank is not null and not isnan(pagerank)")
    top = top_n(nodes, ["repository_id", "community_id"], "pagerank", "node_id")
    return top.select("repository_id", "community_id", "rank_no", "node_id")
