"""Long exact spans shared between records.

Two operators:

* `repeated` hashes lines: lines are normalised (white space at their ends left out), every run of whole lines that holds at
  least LENGTH code points gets a digest, digests are grouped over all records, the earliest occurrence (lowest id, then
  offset) is kept and the rest is removed, with original offsets retained. This cannot see a span that begins and ends inside
  lines, nor one in a file that is a single line.

* `Shared` gives all pairs with a common span of LENGTH code points, compared exactly. Its unit is the content-defined anchor:
  the GRAM code points of lowest hash in each window, chosen so that any common span of at least LENGTH code points holds an
  anchor that both records chose. The rest is as with lines: digests are grouped over all records, only digests of more than
  one record are kept with their offsets, and of equal spans the one of lowest id counts as the original.

Anchors are then compared exactly, by the code points around them that a span of LENGTH through the anchor can reach (its
context). Records with the same anchor and context form a class, so copies are compared once. Classes of one anchor are
compared pairwise while there are few; beyond CLASSES they are grouped by the windows of LENGTH code points through the
anchor instead, which is linear in their number and as exact. Pairs of records are made last, from classes, each distinct
pair of member sets once; a class of more than BLOCK members is split over SALTS tasks before it is joined, and its pairs are
made in blocks. `memberships` gives the classes themselves, which grow with the records and not with their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.session import cut
from stratalens.sources.tables import table

LENGTH = 300
GRAM = 100
#: Classes of an anchor that are compared pairwise; more are grouped by windows.
CLASSES = 48
#: Members of a class in one block of pairs, and parts in which a class of more members is joined.
BLOCK, SALTS = 512, 64
_BASE = 1099511628211
_MULT = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(which: int, base: int, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        p = np.full(max(n, 2 * len(have)), base, np.uint64)
        p[0] = 1
        have = _powers[which] = np.multiply.accumulate(p)
    return have[:n]


def gram_hashes(text: str, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k code points."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(a)
    if n < k:
        return np.zeros(0, np.uint64)
    a = (a + np.uint64(1)) * _MULT
    a ^= a >> np.uint64(29)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(a * _power(0, _BASE, n), out=s[1:])
    h = (s[k:] - s[:-k]) * _power(1, pow(_BASE, -1, 1 << 64), n - k + 1)
    h ^= h >> np.uint64(32)
    h *= _MULT
    return h ^ (h >> np.uint64(29))


def _window_min(h: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """The least of each w neighbours, in linear time (runs of w from both sides)."""
    n = len(h)
    fill = np.uint64(0xFFFFFFFFFFFFFFFF) if op is np.minimum else np.uint64(0)
    m = -(-n // w) * w
    p = np.full(m, fill, np.uint64)
    p[:n] = h
    b = p.reshape(-1, w)
    left = op.accumulate(b, axis=1).ravel()
    right = op.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - w + 1], left[w - 1 : n])


def anchors(text: str, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the chosen grams: every span of `length` code points holds one, chosen by its content alone."""
    h = gram_hashes(text, k)
    w = length - k + 1
    if len(h) < w:
        return np.zeros(0, np.int64), h[:0]
    low = _window_min(h, w)
    # a gram is chosen when it is the least of some window that holds it
    pad = np.zeros(len(h) + w - 1, np.uint64)
    pad[w - 1 : w - 1 + len(low)] = low
    pos = np.flatnonzero(_window_min(pad, w, np.maximum) == h)
    return pos, h[pos]


def _context(text: str, pos: int, length: int, k: int) -> tuple[str, int]:
    lo = max(0, pos - (length - k))
    return text[lo : pos + length], pos - lo


def _common(a: str, i: int, b: str, j: int, k: int) -> tuple[int, int]:
    """How far a and b agree before their anchors at i and j, and from there on."""
    m = min(i, j)
    x, y = a[i - m : i], b[j - m : j]
    if x != y:
        lo, hi = 0, m  # the last lo code points agree, the last hi do not
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if x[m - mid :] == y[m - mid :]:
                lo = mid
            else:
                hi = mid
        m = lo
    x, y = a[i:], b[j:]
    n = min(len(x), len(y))
    if x[:n] != y[:n]:
        lo, hi = 0, n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if x[:mid] == y[:mid]:
                lo = mid
            else:
                hi = mid
        n = lo
    return m, n


class Shared:
    """What the records of a table share. docs: id (bigint), text. Null and short texts share nothing; the same id counts once."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, k: int = GRAM):
        long = docs.select(F.col("id").cast("long").alias("id"), "text").where(F.length("text") >= length)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, pos, hs = [], [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    p, h = anchors(t, length, k)
                    _, first = np.unique(h, return_index=True)
                    ids.append(np.full(len(first), i, np.int64))
                    hs.append(h[first].view(np.int64))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, hs)], names=["id", "h"])

        marks = long.mapInArrow(mark, "id long, h long")
        both = marks.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("h")
        wanted = marks.join(both, "h").groupBy("id").agg(F.collect_set("h").alias("hs"))
        texts = long.dropDuplicates(["id"]).join(wanted, "id").select("id", "text", "hs")

        def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, t, hs in zip(*(c.to_pylist() for c in b.columns)):
                    p, h = anchors(t, length, k)
                    keep = np.isin(h.view(np.int64), np.array(hs, np.int64))
                    found: dict[tuple, list[int]] = {}
                    for at, x in zip(p[keep].tolist(), h[keep].view(np.int64).tolist()):
                        found.setdefault((x, *_context(t, at, length, k)), []).append(at)
                    if found:
                        keys = list(found)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x[0] for x in keys]), pa.array([i] * len(keys)), pa.array([x[1] for x in keys]), pa.array([x[2] for x in keys], pa.int32()), pa.array([found[x] for x in keys], pa.list_(pa.int32()))],
                            names=["h", "id", "ctx", "lead", "at"],
                        )

        near = texts.mapInArrow(around, "h long, id long, ctx string, lead int, at array<int>")
        # the class of a context: two hashes of it, 128 bits
        near = near.withColumn("c", F.struct(F.xxhash64("ctx", "lead").alias("x"), F.xxhash64(F.lit(7), "ctx", "lead").alias("y")))
        self.members = cut(near)
        self.length, self.k = length, k
        self.classes = self.members.groupBy("h", "c").agg(
            F.first("ctx").alias("ctx"), F.first("lead").alias("lead"), F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.min("id").alias("low"), F.max("id").alias("high"),
        )

    def class_pairs(self) -> DataFrame:
        """h, c, d, before, from_: classes of one anchor that share a span of LENGTH, and how far they agree."""
        length, k = self.length, self.k
        per = self.classes.groupBy("h").agg(F.count(F.lit(1)).alias("nc")).where("nc > 1")
        cls = self.classes.select("h", "c", "ctx", "lead").join(per, "h")
        a, b = cls.where(F.col("nc") <= CLASSES), cls.where(F.col("nc") <= CLASSES)
        few = a.select("h", "c", F.col("ctx").alias("ca"), F.col("lead").alias("la")).join(
            b.select("h", F.col("c").alias("d"), F.col("ctx").alias("cb"), F.col("lead").alias("lb")), "h"
        ).where("c < d")

        many = cls.where(F.col("nc") > CLASSES)
        win = self._windows(many)
        # windows of the same classes repeat for neighbouring offsets: keep one of each set of classes
        kept = self._kept(win)
        linked = kept.select("h", "w", "off", "c").join(kept.select("h", "w", "off", F.col("c").alias("d")), ["h", "w", "off"]).where("c < d")
        linked = linked.select("h", "c", "d").distinct()
        more = linked.join(many.select("h", "c", F.col("ctx").alias("ca"), F.col("lead").alias("la")), ["h", "c"]).join(
            many.select("h", F.col("c").alias("d"), F.col("ctx").alias("cb"), F.col("lead").alias("lb")), ["h", "d"]
        )
        cols = ["h", "c", "d", "ca", "la", "cb", "lb"]

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ca, la, cb, lb = (b.column(i).to_pylist() for i in range(3, 7))
                m = [_common(x, i, y, j, k) for x, i, y, j in zip(ca, la, cb, lb)]
                before, after = pa.array([x[0] for x in m], pa.int32()), pa.array([x[1] for x in m], pa.int32())
                ok = pa.array([x[0] + x[1] >= length and x[1] >= k for x in m], pa.bool_())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], before, after], names=["h", "c", "d", "before", "after"]).filter(ok)

        pair = "h long, c struct<x: bigint, y: bigint>, d struct<x: bigint, y: bigint>, before int, after int"
        return few.select(*cols).unionAll(more.select(*cols)).mapInArrow(compare, pair)

    def _windows(self, classes: DataFrame) -> DataFrame:
        """h, c, w, off: every window of LENGTH code points through the anchor, of each class."""
        length = self.length

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for h, c, ctx, lead in zip(*(x.to_pylist() for x in b.columns)):
                    w = gram_hashes(ctx, length).view(np.int64)
                    n = len(w)
                    yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.int64()), pa.array([c] * n, b.column(1).type), pa.array(w), pa.array((lead - np.arange(n)).astype(np.int32))], names=["h", "c", "w", "off"])

        return classes.select("h", "c", "ctx", "lead").mapInArrow(windows, "h long, c struct<x: bigint, y: bigint>, w long, off int")

    @staticmethod
    def _kept(win: DataFrame) -> DataFrame:
        """Of the windows of several classes those that are needed: one for each set of classes."""
        sets = win.groupBy("h", "w", "off").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("s")).where("n > 1")
        sets = sets.groupBy("h", "n", "s").agg(F.min(F.struct("w", "off")).alias("m")).select("h", "m.w", "m.off")
        return win.join(sets, ["h", "w", "off"])

    def pairs(self) -> DataFrame:
        """id_a < id_b of all records that share a span."""
        size = self.classes.select("h", "c", "n", "s")
        across = self.class_pairs().select("h", "c", "d")
        across = across.join(size.withColumnsRenamed({"n": "na", "s": "sa"}), ["h", "c"]).join(size.withColumnsRenamed({"c": "d", "n": "nb", "s": "sb"}), ["h", "d"])
        within = size.where("n > 1").select("h", "c", F.col("c").alias("d"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("n").alias("nb"), F.col("s").alias("sb"))
        sets = across.select("h", "c", "d", "na", "sa", "nb", "sb").unionAll(within.select("h", "c", "d", "na", "sa", "nb", "sb"))
        one = sets.groupBy("na", "sa", "nb", "sb").agg(F.min(F.struct("h", "c", "d")).alias("m")).select("m.*", "na", "nb")
        one = one.withColumn("blocks", F.ceil(F.col("nb") / BLOCK).cast("int"))
        a = self._of(one, "c").withColumnRenamed("id", "i").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        b = self._of(one, "d").withColumnRenamed("id", "j").withColumn("block", F.pmod(F.xxhash64("j"), F.col("blocks")).cast("int")).select("h", "c", "d", "block", "j")
        p = a.select("h", "c", "d", "block", "i").join(b, ["h", "c", "d", "block"]).where("i <> j")
        return p.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()

    def _of(self, pairs: DataFrame, side: str) -> DataFrame:
        """Pairs of classes with the members of one side; large classes are split before the join."""
        large = F.col("na" if side == "c" else "nb") > BLOCK
        parts = F.when(large, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
        salted = pairs.withColumn("salt", F.explode(parts))
        ids = self.members.select("h", F.col("c").alias(side), "id")
        both = F.explode(F.array(F.lit(-1), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")))
        return salted.join(ids.withColumn("salt", both), ["h", side, "salt"]).drop("salt")

    def memberships(self) -> DataFrame:
        """id, class_id, n_members: a class is all records that hold one and the same span of LENGTH, each distinct set of records once.

        Two records are a pair exactly if some class holds both, so this is the whole result, without making the pairs.
        """
        per = self.classes.groupBy("h").agg(F.count(F.lit(1)).alias("nc"))
        cls = self.classes.join(per, "h")
        kept = self._kept(self._windows(cls.where("nc > 1"))).select("h", "c", F.xxhash64("h", "w", "off").alias("span"))
        alone = cls.where("n > 1").select("h", "c", F.xxhash64("h", "c").alias("span"))
        held = kept.unionAll(alone).join(self.members.select("h", "c", "id"), ["h", "c"]).select("span", "id").distinct()
        held = cut(held)
        sets = held.groupBy("span").agg(F.count(F.lit(1)).alias("n_members"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s")).where("n_members > 1")
        sets = sets.groupBy("n_members", "s").agg(F.min("span").alias("span")).select("span", "n_members", F.xxhash64("n_members", "s").alias("class_id"))
        return held.join(sets, "span").select("id", "class_id", "n_members")

    def coverage(self) -> DataFrame:
        """id, n_shared, n_repeated: code points that occur in a span of another record, and of one with a lower id."""
        cp = cut(self.class_pairs())
        ends = self.classes.select("h", "c", "low", "high")
        ab = cp.join(ends.withColumnRenamed("c", "d"), ["h", "d"]).select("h", "c", "before", "after", "low", "high")
        ba = cp.join(ends, ["h", "c"]).select("h", F.col("d").alias("c"), "before", "after", "low", "high")
        own = self.members.select("h", "c", "id", "at", "lead", F.length("ctx").alias("len"))
        same = self.classes.where("low < high").select("h", "c", "low", "high")
        m0 = own.join(same, ["h", "c"]).select("id", "at", F.col("lead").alias("before"), (F.col("len") - F.col("lead")).alias("after"), F.when(F.col("id") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other"))
        # a span that one record holds twice is not shared
        other = F.when(F.col("id") == F.col("low"), F.col("high")).otherwise(F.col("low"))
        m1 = own.join(ab.unionAll(ba), ["h", "c"]).select("id", "at", "before", "after", other.alias("other")).where("id <> other")
        ivs = m0.unionAll(m1).withColumn("p", F.explode("at")).select("id", (F.col("p") - F.col("before")).alias("lo"), (F.col("p") + F.col("after")).alias("hi"), (F.col("other") < F.col("id")).alias("later"))
        # an interval inside a file counts what reaches past all that begin before it; a file's intervals are at most its length
        ivs = ivs.groupBy("id", "lo").agg(F.max("hi").alias("hi"), F.max(F.when(F.col("later"), F.col("hi"))).alias("hi2"))
        w = Window.partitionBy("id").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
        new = lambda end: F.greatest(F.lit(0), F.col(end) - F.greatest("lo", F.coalesce(F.max(end).over(w), F.lit(0))))
        return ivs.withColumn("x", new("hi")).withColumn("y", F.coalesce(new("hi2"), F.lit(0))).groupBy("id").agg(F.sum("x").cast("long").alias("n_shared"), F.sum(F.when(F.col("hi2").isNotNull(), F.col("y")).otherwise(0)).cast("long").alias("n_repeated"))


def line_runs(text: str, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, digests): from each line, the shortest run of whole lines with at least `length` code points, normalised."""
    lines = text.split("\n")
    n = len(lines)
    cut = [x.rstrip() for x in lines]
    starts = np.zeros(n + 1, np.int64)
    np.cumsum([len(x) + 1 for x in lines], out=starts[1:])
    body = np.zeros(n + 1, np.int64)
    np.cumsum([len(x) + 1 for x in cut], out=body[1:])
    last = np.searchsorted(body, body[:-1] + length, "left")  # the run of i ends before line last[i]
    i = np.flatnonzero(last <= n)
    if not len(i):
        return (np.zeros(0, np.int64),) * 3
    one = np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in cut], np.uint64)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum((one | np.uint64(1)) * _power(0, _BASE, n), out=s[1:])
    h = (s[last[i]] - s[i]) * _power(1, pow(_BASE, -1, 1 << 64), n)[i]
    h ^= h >> np.uint64(32)
    h *= _MULT
    ends = starts[last[i] - 1] + np.array([len(cut[k - 1]) for k in last[i]])
    return starts[i], ends, (h ^ (h >> np.uint64(29))).view(np.int64)


def repeated(docs: DataFrame, length: int | None = None) -> DataFrame:
    """id, start, end: the spans of each record (id, text) to remove, those of line runs that an earlier record or place has.

    Null and short texts have none; the same id counts once. Digests shared by many records are joined in SALTS parts.
    """
    length = length or LENGTH
    kind = "h long, id long, start long, end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lo, hi, h = line_runs(t, length)
                for c, x in zip(cols, (h, np.full(len(lo), i, np.int64), lo, hi)):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], names=["h", "id", "start", "end"])

    rows = docs.select(F.col("id").cast("long").alias("id"), "text").where(F.length("text") >= length).mapInArrow(run, kind).distinct()
    rows = cut(rows)
    first = rows.groupBy("h").agg(F.min(F.struct("id", "start")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    salt = F.pmod(F.xxhash64("id", "start"), F.lit(SALTS)).cast("int")
    parts = F.when(F.col("n") > BLOCK, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    first = first.withColumn("salt", F.explode(parts))
    later = rows.withColumn("salt", F.explode(F.array(F.lit(-1), salt))).join(first, ["h", "salt"]).where(F.struct("id", "start") > F.col("f"))
    # overlapping runs of a record to spans; a record has no more runs than lines
    w = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = later.select("id", "start", "end").withColumn("new", F.coalesce((F.col("start") > reach + 1).cast("int"), F.lit(1))).withColumn("k", F.sum("new").over(w))
    return spans.groupBy("id", "k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("k")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "files").select(F.col("file_id").alias("id"), F.col("content").alias("text"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of files with a common span of at least LENGTH code points."""
    return Shared(_files(spark, folder)).pairs().withColumnsRenamed({"id_a": "file_id_a", "id_b": "file_id_b"})


def p6_files(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, path, n_chars, n_shared and n_repeated of each file that shares a span."""
    f = table(spark, folder, "files").select("file_id", "path", F.length("content").cast("long").alias("n_chars")).groupBy("file_id", "path").agg(F.max("n_chars").alias("n_chars"))
    return Shared(_files(spark, folder)).coverage().withColumnRenamed("id", "file_id").join(f, "file_id").select("file_id", "path", "n_chars", "n_shared", "n_repeated")


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, class_id and n_members: a class is all files that hold one and the same span; two files are a pair exactly if a class holds both."""
    return Shared(_files(spark, folder)).memberships().withColumnRenamed("id", "file_id")


def p6_removed(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, start_char, end_char of the line runs that an earlier file (or place) has, in original code point offsets."""
    return repeated(_files(spark, folder)).select(F.col("id").alias("file_id"), F.col("start").alias("start_char"), F.col("end").alias("end_char"))


def p6_kept(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, start_char, end_char and text of what is left of each file from which something is removed, in original offsets."""
    gone = repeated(_files(spark, folder)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))
    f = _files(spark, folder).where("text is not null").dropDuplicates(["id"]).join(gone, "id").withColumn("n", F.length("text").cast("long"))
    zero, end = F.array(F.lit(0).cast("long")), F.array("n")
    left = f.withColumn("span", F.explode(F.arrays_zip(F.concat(zero, F.col("gone.end")).alias("lo"), F.concat(F.col("gone.start"), end).alias("hi"))))
    left = left.select(F.col("id").alias("file_id"), F.col("span.lo").alias("start_char"), F.col("span.hi").alias("end_char"), "text").where("end_char > start_char")
    return left.withColumn("text", F.substring("text", F.col("start_char").cast("int") + 1, (F.col("end_char") - F.col("start_char")).cast("int")))
