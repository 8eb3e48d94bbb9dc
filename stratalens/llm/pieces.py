"""Splitting oversized items at natural boundaries, by byte ranges.

An item over the limit is cut into ranges of RANGE bytes, each read with a halo on both sides. A worker sees one range: it
finds the block ends, line ends and character starts in it and keeps, for each cell of CELL bytes, the last of every kind
(a bounded table: three offsets for a cell). The tables of an item are stitched in order of their ranges by a stream that
holds only the current window, pieces are laid out by offset, and the text of a piece is put together from the one or two
ranges it touches. No step holds a whole item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.sources.tables import table

LIMIT = 8_000
OVERLAP = (200, 600)
RANGE = 1 << 16
HALO = 512
CELL = 100

_LINE = re.compile(rb"\n")
#: A block ends after a line that is blank, that follows one, or that closes a bracket at the margin.
_BLOCK = re.compile(rb"(?:\n[ \t\r]*(?=\n)|\n[}\])][^\n]*(?=\n)|\n(?=[ \t\r]*\n))")


def oversized(items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """kind, id, data (bytes) of the items over the limit. Null and short items stay in the scan."""
    return items.where(F.octet_length("text") > limit).select("kind", "id", F.col("text").cast("binary").alias("data"))


def ranges(big: DataFrame, size: int = RANGE, halo: int = HALO) -> DataFrame:
    """kind, id, n_bytes, range_no, lead (bytes of the halo before), chunk."""
    n = F.octet_length("data")
    r = big.select("kind", "id", "data", n.cast("long").alias("n_bytes"))
    r = r.withColumn("range_no", F.explode(F.sequence(F.lit(0), ((F.col("n_bytes") - 1) / size).cast("int"))))
    start = F.greatest(F.lit(0), F.col("range_no") * size - halo)
    return r.select(
        "kind", "id", "n_bytes", "range_no",
        (F.col("range_no") * size - start).cast("int").alias("lead"),
        F.substring("data", start + 1, F.lit(size + 2 * halo)).alias("chunk"),
    )


def _last_of_cells(found: list[int], cell: int) -> list[int]:
    keep: dict[int, int] = {}
    for f in found:
        keep[f // cell] = f
    return list(keep.values())


def boundaries(chunk: bytes, lead: int, start: int, size: int, last: bool, cell: int = CELL) -> tuple[list[int], ...]:
    """Offsets in the item, in (start, start + size], of block ends, line ends and character starts."""
    lo, hi, off = start, start + size, start - lead
    lines = [p for m in _LINE.finditer(chunk) if lo < (p := m.end() + off) <= hi]
    at = set()
    for m in _BLOCK.finditer(chunk):
        p = m.end() + 1 + off  # after the line end that follows
        if lo < p <= hi:
            at.add(p)
    chars = []
    for c in range((lo // cell) * cell, hi + cell, cell):
        p = min(c + cell - 1, hi)
        while p > max(lo, c - 1) and p - off < len(chunk) and chunk[p - off] & 0xC0 == 0x80:
            p -= 1
        if lo < p <= hi and p - off <= len(chunk):
            chars.append(p)
    end = off + len(chunk)
    if last and lo < end <= hi:
        lines.append(end)
        at.add(end)
    return tuple(_last_of_cells(sorted(x), cell) for x in (at, lines, chars))


class Layout:
    """Lays out the pieces of one item from boundary tables that come in order."""

    def __init__(self, n_bytes: int, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP):
        self.n, self.limit, self.overlap = n_bytes, limit, overlap
        self.start, self.end, self.no = 0, 0, 0
        self.tables: list[list[int]] = [[], [], []]

    def add(self, *tables: list[int]) -> Iterator[tuple[int, int, int]]:
        for have, new in zip(self.tables, tables):
            have.extend(new)
        upto = max((t[-1] for t in self.tables if t), default=0)
        while self.end < self.n and (upto >= min(self.n, self.start + self.limit)):
            yield self.cut()

    def cut(self) -> tuple[int, int, int]:
        lo, hi = self.start, min(self.n, self.start + self.limit)
        after = max(self.end, lo + self.overlap[1])  # a piece always gains on the one before
        if hi < self.n:
            hi = self.best(after, hi)
        piece = (self.no, lo, hi)
        self.no, self.end = self.no + 1, hi
        if hi < self.n:
            a, b = hi - self.overlap[1], hi - self.overlap[0]
            line = [x for x in self.tables[1] if a <= x <= b]
            char = [x for x in self.tables[2] if a <= x <= b]
            self.start = line[0] if line else char[-1]
            for t in self.tables:
                t[:] = [x for x in t if x >= self.start]
        return piece

    def best(self, after: int, hi: int) -> int:
        """The last block end in the later half, else the last line end, else the last character start."""
        half = (after + hi) // 2
        for t, least in ((self.tables[0], half), (self.tables[1], after), (self.tables[2], after)):
            good = [x for x in t if least < x <= hi]
            if good:
                return good[-1]
        raise ValueError("a range holds no character start: it is not UTF-8")


def layout(parts: DataFrame, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP, size: int = RANGE, cell: int = CELL) -> DataFrame:
    """kind, id, n_bytes, piece_no, start, end of every piece; from the ranges, repeated deliveries of an item once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            out: list[list] = [[], [], []]
            for n, k, lead, chunk in zip(d["n_bytes"], d["range_no"], d["lead"], d["chunk"]):
                found = boundaries(chunk, lead, k * size, size, (k + 1) * size >= n, cell)
                for o, f in zip(out, found):
                    o.append(f)
            arrays = [pa.array(o, pa.list_(pa.int64())) for o in out]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *arrays], names=["kind", "id", "n_bytes", "range_no", "blocks", "lines", "chars"])

    tables = parts.mapInArrow(scan, "kind string, id long, n_bytes long, range_no int, blocks array<long>, lines array<long>, chars array<long>")
    tables = tables.repartition("kind", "id").sortWithinPartitions("kind", "id", "range_no")

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, -1
        for b in batches:
            d = b.to_pydict()
            rows = []
            for kind, i, n, k, *found in zip(*(d[c] for c in ("kind", "id", "n_bytes", "range_no", "blocks", "lines", "chars"))):
                if at != (kind, i):
                    at, state, done = (kind, i), Layout(n, limit, overlap), -1
                if k == done:
                    continue
                done = k
                rows += [(kind, i, n, *p) for p in state.add(*found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["kind", "id", "n_bytes", "piece_no", "start", "end"])

    return tables.mapInArrow(stitch, "kind string, id long, n_bytes long, piece_no long, start long, end long")


def emit(parts: DataFrame, laid: DataFrame, size: int = RANGE) -> DataFrame:
    """The pieces with their text and with n_overlap, the bytes a piece shares with the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("kind", "id").orderBy("piece_no")
    p = laid.withColumn("n_overlap", F.coalesce(F.lag("end").over(w) - F.col("start"), F.lit(0)))
    touched = F.sequence(F.floor(F.col("start") / size).cast("int"), F.floor((F.col("end") - 1) / size).cast("int"))
    p = p.withColumn("range_no", F.explode(touched))
    body = parts.dropDuplicates(["kind", "id", "range_no"]).select("kind", "id", "range_no", "lead", "chunk")
    j = p.join(body, ["kind", "id", "range_no"])
    lo = F.greatest(F.col("start"), F.col("range_no").cast("long") * size)
    hi = F.least(F.col("end"), (F.col("range_no").cast("long") + 1) * size)
    cut = F.substring("chunk", (lo - F.col("range_no").cast("long") * size + F.col("lead") + 1).cast("int"), (hi - lo).cast("int"))
    j = j.withColumn("part", F.struct("range_no", cut.alias("bytes")))
    g = j.groupBy("kind", "id", "piece_no", "start", "end", "n_overlap").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["bytes"]))
    return g.select(
        F.col("kind").alias("item_kind"), F.col("id").alias("item_id"), "piece_no",
        F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "n_overlap",
        F.decode(joined, "UTF-8").alias("text"),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files").select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), F.col("content").alias("text"))
    spans = table(spark, folder, "symbols").select(F.lit("symbol").alias("kind"), F.col("symbol_id").alias("id"), F.col("source_span").alias("text"))
    return files.unionAll(spans)


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every oversized file and symbol, with its text.

    Items of at most LIMIT bytes, null and empty ones give no rows; repeated deliveries count once; an empty table gives
    an empty result. Pieces of an item rebuild it: drop the first n_overlap bytes of each and concatenate.
    """
    parts = ranges(oversized(items(spark, folder)))
    return emit(parts, layout(parts))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """item_kind, item_id of the items that the layout cuts."""
    parts = ranges(oversized(items(spark, folder)))
    return layout(parts).where("piece_no = 1").select(F.col("kind").alias("item_kind"), F.col("id").alias("item_id"))


def p1_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """item_kind, item_id, n_pieces and the digest of the text that the pieces of an item rebuild."""
    p = p1_pieces(spark, folder).withColumn("own", F.expr("substring(encode(text, 'UTF-8'), cast(n_overlap as int) + 1)"))
    g = p.groupBy("item_kind", "item_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", "own"))).alias("parts"), F.count(F.lit(1)).alias("n_pieces"), F.max(F.octet_length("text")).alias("longest"))
    whole = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["own"]))
    return g.select("item_kind", "item_id", F.sha2(whole, 256).alias("digest"), (F.col("longest") <= LIMIT).alias("within_limit"), (F.col("n_pieces") > 1).alias("cut"))
