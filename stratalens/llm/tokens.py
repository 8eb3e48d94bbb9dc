"""Encoding texts with a public byte-level BPE vocabulary.

Method: every pre-token is merged on a segment tree over the ranks of its adjacent pairs. The root holds the leftmost
pair of lowest rank; a merge changes three leaves, so an update is logarithmic and a pre-token of n bytes (scripts without
spaces give very long ones) costs n log n instead of n squared. Pre-tokens already seen by a worker are looked up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.sources.tables import table

#: Where the vocabulary lies on every machine; it is a parameter of all functions here.
VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split into pre-tokens that belongs to this vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens a worker remembers; the memory is emptied when full, which changes no result.
REMEMBERED = 200_000
_NONE = 1 << 62


class Encoder:
    """Ids of texts. Special tokens do not exist here: text that looks like one is plain text."""

    def __init__(self, path: str = VOCAB):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(PATTERN).findall
        self.seen: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by lowest-rank, leftmost merges."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n == 1:
            return [ranks[piece]]
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        get = ranks.get
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r << 40 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        ends = list(range(1, n + 1))  # where the part that starts here ends
        before = list(range(-1, n - 1))  # where the part before this one starts

        def put(i: int, key: int) -> None:
            i += size
            tree[i] = key
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                key = a if a < b else b
                if tree[i] == key:
                    return
                tree[i] = key

        while (low := tree[1]) != _NONE:
            i = low & 0xFFFFFFFFFF
            j = ends[i]
            k = ends[i] = ends[j]
            put(j, _NONE)
            if k < n:
                before[k] = i
                r = get(piece[i : ends[k]])
                put(i, _NONE if r is None else r << 40 | i)
            else:
                put(i, _NONE)
            h = before[i]
            if h >= 0:
                r = get(piece[h:k])
                put(h, _NONE if r is None else r << 40 | h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        seen, out = self.seen, []
        for word in self.split(text):
            ids = seen.get(word)
            if ids is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                ids = self.merge(word.encode("utf-8", "replace"))
                if len(word) <= 64:
                    seen[word] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str = VOCAB) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCAB) -> DataFrame:
    """(id, ids) of every row, without a shuffle.

    Null and empty texts give an empty list. Repeated rows each give a row; other columns are ignored, whatever they are
    called; an empty table gives an empty table. A text of any length is encoded whole.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path).encode
        for b in batches:
            values = pa.array([enc(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), values], names=["id", "ids"])

    return src.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, keys: list[str], text_col: str = "text", path: str = VOCAB) -> DataFrame:
    """The key columns and n_tokens of every row; the ids themselves stay in the worker."""
    src = docs.select(*keys, F.col(text_col).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path).encode
        for b in batches:
            n = pa.array([len(enc(t)) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keys, "n_tokens"])

    return src.mapInArrow(run, f"{kinds}, n_tokens long")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids of every document."""
    return encode(table(spark, folder, "documents"))


def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and the digest of the text that its ids stand for; null and empty texts give the digest of nothing."""
    ids = encode(table(spark, folder, "documents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = {i: t for t, i in encoder().ranks.items()}
        for b in batches:
            texts = [b"".join(back[i] for i in row) for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], names=["doc_id", "raw"])

    return ids.mapInArrow(run, "doc_id long, raw binary").select("doc_id", F.sha2("raw", 256).alias("digest"))
