"""Graph algorithms that finish a graph of bounded size in one task, where rounds over DataFrames would each cost a job.

Nodes are numbered by a dictionary of their ids, links are arrays; a graph of more links stays with the rounds of `graph`.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Links up to which a graph is walked, or divided into communities, in one task; its Python takes about 0.6 KB a link for the latter.
WALKED, DIVIDED = 4_000_000, 2_000_000
_ROWS = 100_000


def numbered(columns: list[list[pa.Array]]) -> tuple[list[np.ndarray], pa.Array]:
    """The columns with values as numbers in order of first appearance, and the values."""
    whole = pa.chunked_array([x for c in columns for x in c]).dictionary_encode().combine_chunks()
    whole = whole if isinstance(whole, pa.DictionaryArray) else whole.chunk(0)
    codes, ends = whole.indices.to_numpy(zero_copy_only=False), np.cumsum([sum(map(len, c)) for c in columns])
    return np.split(codes, ends[:-1]), whole.dictionary


def starts(x: np.ndarray, n: int) -> np.ndarray:
    """Where the links of each of n nodes begin, when links are in order of x."""
    return np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n))])


def depths(n: int, src: np.ndarray, dst: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """The least number of links from the roots to each of n nodes, -1 where none lead to it."""
    to, at = dst[np.argsort(src, kind="stable")], starts(src, n)
    depth = np.full(n, -1, dtype=np.int32)
    front = np.unique(roots)
    d = 0
    while len(front):
        depth[front] = d
        many = at[front + 1] - at[front]
        near = to[np.repeat(at[front] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        front, d = np.unique(near[depth[near] < 0]), d + 1
    return depth


def walked(edges: DataFrame, front: DataFrame, depth: int) -> DataFrame:
    """id, depth of the nodes that edges (src, dst; neither null) lead to from the front (id), but not those in it. front is at `depth`."""
    kind = front.select("id").unionAll(edges.select("src")).schema["id"].dataType
    rows = edges.select(F.col("src").cast(kind), F.col("dst").cast(kind)).unionAll(front.where("id is not null").select(F.col("id").cast(kind), F.lit(None).cast(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, roots = [], [], []
        for b in batches:
            links = pc.is_valid(b.column(1))
            for into, col in zip((src, dst), b.filter(links).columns):
                into.append(col)
            roots.append(b.filter(pc.invert(links)).column(0))
        if not src:
            return
        (s, t, r), ids = numbered([src, dst, roots])
        got = depths(len(ids), s, t, r)
        new = np.flatnonzero(got > 0)
        for i in range(0, len(new), _ROWS):
            k = new[i : i + _ROWS]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(got[k] + np.int32(depth), pa.int32())], names=["id", "depth"])

    return rows.repartition(1).mapInArrow(run, f"id {kind.simpleString()}, depth int")


def _merged(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links with a <= b, one for each pair."""
    key, back = np.unique(np.minimum(a, b).astype(np.int64) * n + np.maximum(a, b), return_inverse=True)
    return key // n, key % n, np.bincount(back, weights=w, minlength=len(key)).astype(np.int64)


class Graph:
    """Links in both directions by node; k: the weight at each node, to which a loop (a = b) counts twice."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        self.n, self.a, self.b, self.w = n, *_merged(n, a, b, w)
        apart = self.a != self.b
        x, y = np.concatenate([self.a[apart], self.b[apart]]), np.concatenate([self.b[apart], self.a[apart]])
        order = np.lexsort((y, x))
        self.x, self.y, self.z = x[order], y[order], np.concatenate([self.w[apart]] * 2)[order]
        self.to, self.by, self.at = self.y.tolist(), self.z.tolist(), starts(x, n).tolist()
        k = np.bincount(self.a, weights=self.w, minlength=n) + np.bincount(self.b, weights=self.w, minlength=n)
        self.k = k.astype(np.int64).tolist()
        self.m2 = sum(self.k)

    def gainers(self, c: list[int]) -> list[int]:
        """The nodes whose move alone would raise modularity; all nodes where the numbers are too large for 64 bits."""
        if self.m2 >= 2**31:
            return list(range(self.n))
        of, k = np.array(c), np.array(self.k)
        tot, size = np.zeros(self.n, dtype=np.int64), np.bincount(of, minlength=self.n)
        np.add.at(tot, of, k)
        key, back = np.unique(self.x * self.n + of[self.y], return_inverse=True)
        win = np.zeros(len(key), dtype=np.int64)
        np.add.at(win, back, self.z)
        x, t = key // self.n, key % self.n
        stay = -k * (tot[of] - k)
        inner = t == of[x]
        stay[x[inner]] += win[inner] * self.m2
        gains = (stay < 0) & (size[of] > 1)
        gains[x[~inner & (win * self.m2 - k[x] * tot[t] > stay[x])]] = True
        return np.flatnonzero(gains).tolist()

    def move(self, c: list[int], sweeps: int | None = None) -> bool:
        """Moves nodes between the communities c, one at a time, until no move raises modularity; whether any moved.

        Gains are whole numbers (times m2), so each move raises modularity and the moves end. A node whose neighbours moved is
        looked at again; as a move also changes the gains of others, all are searched for gains until there are none.
        """
        at, to, by, k, m2 = self.at, self.to, self.by, self.k, self.m2
        tot, size = [0] * self.n, [0] * self.n
        for x, t in enumerate(c):
            tot[t] += k[x]
            size[t] += 1
        free = [t for t in range(self.n) if not size[t]]
        ever, sweep = False, 0
        while sweeps is None or sweep < sweeps:
            sweep += 1
            queue, waits, moved = deque(self.gainers(c)), bytearray(self.n), False
            for x in queue:
                waits[x] = 1
            while queue:
                x = queue.popleft()
                waits[x] = 0
                own, kx, win = c[x], k[x], {c[x]: 0}
                for i in range(at[x], at[x + 1]):
                    t = c[to[i]]
                    win[t] = win.get(t, 0) + by[i]
                tot[own] -= kx
                new, best = own, win[own] * m2 - kx * tot[own]
                for t, s in win.items():
                    gain = s * m2 - kx * tot[t]
                    if gain > best:
                        new, best = t, gain
                if best < 0 and size[own] > 1:
                    new = free.pop()
                tot[new] += kx
                if new != own:
                    c[x], moved = new, True
                    size[own] -= 1
                    size[new] += 1
                    if not size[own]:
                        free.append(own)
                    for y in to[at[x] : at[x + 1]]:
                        if not waits[y] and c[y] != new and sweeps is None:
                            waits[y] = 1
                            queue.append(y)
            ever |= moved
            if not moved:
                break
        return ever

    def over(self, c: np.ndarray) -> Graph:
        """The graph of communities 0 to max(c)."""
        return Graph(int(c.max()) + 1, c[self.a], c[self.b], self.w)


def louvain(g: Graph, sweeps: int | None = None, levels: int | None = None) -> np.ndarray:
    """The community of each node, such that no move of a node and none of a whole community raises modularity.

    Communities become nodes level by level; then nodes move again, until neither gains. sweeps and levels, if given, bound both.
    """
    c = list(range(g.n))
    while True:
        g.move(c, sweeps)
        of = own = np.unique(c, return_inverse=True)[1]
        up, level, merged = g, 1, False
        while levels is None or level < levels:
            up, level = up.over(own), level + 1
            if not up.move(c := list(range(up.n)), sweeps):
                break
            own, merged = np.unique(c, return_inverse=True)[1], True
            of = own[of]
        if not merged or levels is not None:
            return of
        c = of.tolist()


def grouped(both: DataFrame, find: Callable[[Graph], np.ndarray]) -> DataFrame:
    """x, c: the community of each node, named by a member, that `find` gives for links in both directions (x, y, w; whole weights)."""
    kind = both.schema["x"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, ws = [], [], []
        for b in batches:
            for into, col in zip((xs, ys, ws), b.columns):
                into.append(col)
        if not xs:
            return
        (a, b), ids = numbered([xs, ys])
        w = np.concatenate([x.to_numpy(zero_copy_only=False) for x in ws])
        c = find(Graph(len(ids), a, b, np.where(a == b, w / 2, w)))  # a loop has both directions in its weight
        name = np.full(int(c.max()) + 1, -1)
        name[c[::-1]] = np.arange(len(c))[::-1]
        for i in range(0, len(c), _ROWS):
            yield pa.RecordBatch.from_arrays([ids.slice(i, _ROWS), ids.take(pa.array(name[c[i : i + _ROWS]]))], names=["x", "c"])

    # in order, so that numbers and with them the result are the same in each run
    one = both.where("x <= y").repartition(1).sortWithinPartitions("x", "y")
    return one.mapInArrow(run, f"x {kind.simpleString()}, c {kind.simpleString()}")
