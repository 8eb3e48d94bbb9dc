"""Findings and records mined from text: security rules, decisions, search, embeddings, documents."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import text as T

#: kind, severity, pattern, needs concatenation, redact (fixed values).
RULES = (
    ("private_key", "critical", r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----", False, True),
    ("aws_access_key", "high", r"\bAKIA[0-9A-Z]{16}\b", False, True),
    ("hardcoded_secret", "high", r"(?i)(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|password|passwd)\s*[:=]\s*[\"'][^\"'\s]{8,}[\"']", False, True),
    ("weak_hash", "medium", r"(?i)hashlib\.(?:md5|sha1)\s*\(|MessageDigest\.getInstance\(\s*[\"'](?:MD5|SHA-?1)|crypto/(?:md5|sha1)|CryptoJS\.(?:MD5|SHA1)\b", False, False),
    ("weak_cipher", "medium", r"(?i)Cipher\.getInstance\(\s*[\"'](?:DES|RC4|[A-Z0-9/]*ECB)|\bcrypto/des\b", False, False),
    ("sql_injection", "high", r"(?i)\b(?:SELECT\s+[\w*]|INSERT\s+INTO\s+\w|UPDATE\s+\w+\s+SET\b|DELETE\s+FROM\s+\w)", True, False),
    ("command_injection", "high", r"(?i)os\.system|subprocess\.(?:call|run|Popen)|exec\.Command|Runtime\.getRuntime\(\)\.exec|child_process\.exec(?:Sync)?", True, False),
)
CONCAT = r"\+\s*\w|\$\{|%s|%d|\bformat\b|f[\"']|\.format\(|`"
DOCS = r"(?i)\.(md|markdown|mdx|txt|rst|adoc|org)$"
VERSION = r"^##\s*\[?(v?\d+\.\d+\.\d+(?:[-+][\w.\-]+)?|Unreleased|UNRELEASED)\]?(?:\s*[-–—]\s*(.*))?$"
BREAKING = r"(?i)\b(BREAKING|BC[\s-]?BREAK|BREAKS|INCOMPATIBLE)\b"


def lines(texts: DataFrame) -> DataFrame:
    """id, line_no (from 1), line."""
    return texts.where("text <> ''").select("id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("id", (F.col("p") + 1).alias("line_no"), "line")


def security(texts: DataFrame) -> DataFrame:
    """id, line_no, kind, severity, snippet: every rule on every line, one pass. texts: id, path, text."""
    l = lines(texts.where(~F.col("path").rlike(DOCS)))
    hits = []
    for kind, severity, pattern, concat, redact in RULES:
        hit = F.col("line").rlike(pattern)
        if concat:
            hit = hit & F.col("line").rlike(CONCAT)
        shown = F.regexp_replace("line", pattern, "[redacted]") if redact else F.col("line")
        hits.append(F.when(hit, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.substring(F.trim(shown), 1, 160).alias("snippet"))))
    return l.select("id", "line_no", F.explode(F.array_compact(F.array(*hits))).alias("f")).select("id", "line_no", "f.*")


def inline_decisions(texts: DataFrame) -> DataFrame:
    """id, line_no, marker, title of DECISION, WHY, TRADEOFF and RATIONALE notes (RATIONALE counts as WHY)."""
    pattern = r"(?i)\b(DECISION|WHY|TRADEOFF|RATIONALE)\s*:\s*(.+?)\s*$"
    l = lines(texts.where(F.col("text").rlike("DECISION|WHY|TRADEOFF|RATIONALE"))).where(F.col("line").rlike(pattern))
    m = F.upper(F.regexp_extract("line", pattern, 1))
    return l.select("id", "line_no", F.when(m == "RATIONALE", "WHY").otherwise(m).alias("marker"), T.ellipsis(F.regexp_extract("line", pattern, 2), 80).alias("title"))


def changelog(texts: DataFrame) -> DataFrame:
    """id, line_no, version, entry of breaking bullets, under the version heading above them."""
    l = lines(texts)
    v = F.when(F.col("line").rlike(VERSION), F.regexp_extract("line", VERSION, 1))
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("version", F.last(v, ignorenulls=True).over(w))
    bullet = r"^\s*[-*+]\s+(.*)$"
    return l.where(F.col("line").rlike(bullet) & F.col("line").rlike(BREAKING) & F.col("version").isNotNull()).select("id", "line_no", "version", F.trim(F.regexp_extract("line", bullet, 1)).alias("entry"))


def commit_decisions(commits: DataFrame) -> DataFrame:
    """commit_id, kind, title of breaking commits."""
    bang = r"^([a-zA-Z]+)(\([^)]+\))?!:\s+(.+)"
    foot = r"(?im)^BREAKING[-\s]CHANGE:\s*(.+)$"
    c = commits.where(F.col("message").rlike(bang) | F.col("message").rlike(foot))
    return c.select("commit_id", F.lower(F.regexp_extract("message", bang, 1)).alias("kind"), F.coalesce(F.nullif(F.regexp_extract("message", bang, 3), F.lit("")), F.regexp_extract("message", foot, 1)).alias("title"))


def adr(texts: DataFrame) -> DataFrame:
    """id, title, status and body of decision documents: first heading, a status line or section, first paragraph."""
    t = texts.where(F.col("text").rlike(r"(?m)^#\s+\S"))
    status = F.lower(F.regexp_extract("text", r"(?im)^(?:status\s*:\s*|##\s*status\s*\n+\s*)(\w+)", 1))
    body = F.trim(F.regexp_extract("text", r"(?s)^#[^\n]*\n+(.*?)(?:\n\s*\n|$)", 1))
    return t.select("id", T.title(F.col("text")).alias("title"), F.when(status == "", "accepted").otherwise(status).alias("status"), T.ellipsis(body, 500).alias("body"))


def first_records(records: DataFrame) -> DataFrame:
    """One record for each (source, file, line, title): the first by `seq` where there is such a column, else the smallest of the rest."""
    keys = ["source", "file", "line_no", "title"]
    rest = [c for c in records.columns if c not in keys]
    if not rest:
        return records.distinct()
    order = F.col("seq") if "seq" in rest else F.struct(*rest)
    return records.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*records.columns)


def postings(texts: DataFrame) -> DataFrame:
    """term, id, n: an inverted index."""
    return texts.select("id", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("n"))


def lexical(index: DataFrame, query: list[str], limit: int = 12) -> DataFrame:
    """id, matched, hits: documents by number of query terms they have."""
    return index.where(F.col("term").isin(query)).groupBy("id").agg(F.count(F.lit(1)).alias("matched"), F.sum("n").alias("hits")).orderBy(F.desc("matched"), F.desc("hits"), "id").limit(limit)


def nearest(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k vectors of highest cosine (vec_id, cosine); top k without a full sort. Rows of another length score 0."""
    q = F.array(*[F.lit(float(x)) for x in query])
    c = F.when(F.size("embedding") == len(query), T.cosine(F.col("embedding"), q)).otherwise(0.0)
    return vectors.select("vec_id", F.round(c, 6).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(k)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int = 10, rows: int = 20_000, asked: int = 1_000) -> DataFrame:
    """query_id, vec_id, cosine: the k vectors of highest cosine of each query row. vectors, queries: vec_id, embedding.

    Blocks of about `asked` queries meet blocks of about `rows` vectors; each pair of blocks gives its own k best, and these
    are merged a query. Vectors of another length than the query, and null ones, score 0.
    """
    nq, nv = max(1, -(-queries.count() // asked)), max(1, -(-vectors.count() // rows))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    q = queries.where("embedding is not null").select("vec_id", "embedding", block(nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("vb"))
    v = vectors.select("vec_id", "embedding", block(nv).alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, ids = [], b["vec_id"].to_numpy()
        size = np.array([-1 if e is None else len(e) for e in b["embedding"]])
        for n in {len(e) for e in a["embedding"]}:
            mine = a[[len(e) == n for e in a["embedding"]]]
            fit = np.flatnonzero(size == n)
            m = np.array([b["embedding"].iloc[i] for i in fit], dtype=float).reshape(len(fit), n)
            norms = np.sqrt((m * m).sum(1))
            for qid, e in zip(mine["vec_id"], mine["embedding"]):
                e = np.asarray(e, dtype=float)
                d = norms * np.sqrt((e * e).sum())
                c = np.zeros(len(ids))
                c[fit] = np.divide(m @ e, d, out=np.zeros(len(fit)), where=d != 0)
                c = np.sign(c) * np.floor(np.abs(c) * 1e6 + 0.5) / 1e6
                top = np.lexsort((ids, -c))[:k]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[top], "cosine": c[top]}))
        return pd.concat(out) if out and len(ids) else pd.DataFrame({"query_id": [], "vec_id": [], "cosine": []})

    kind = dict(vectors.dtypes)["vec_id"]
    near = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(best, f"query_id {kind}, vec_id {kind}, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def mock_vector(text: str, dim: int = 32) -> list[float]:
    """A deterministic stand-in for an embedding: digest words mapped to [-1, 1), rehashed to length."""
    out, d = [], hashlib.sha256(text.encode()).digest()
    while len(out) < dim:
        out += [x / 2147483648.0 - 1.0 for x in struct.unpack("<8I", d)]
        d = hashlib.sha256(d).digest()
    return out[:dim]


def embed(texts: DataFrame, known: DataFrame | None = None, dim: int = 32) -> DataFrame:
    """id, content_hash, vector of texts whose hash is not known. texts: id, text; known: id, content_hash."""
    t = texts.select("id", F.substring(F.coalesce("text", F.lit("")), 1, 6000).alias("text")).withColumn("content_hash", F.sha2("text", 256))
    if known is not None:
        t = t.join(known.select("id", "content_hash"), ["id", "content_hash"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "content_hash": b["content_hash"], "vector": [mock_vector(x, dim) for x in b["text"]]})

    kind = dict(t.dtypes)["id"]
    return t.select("id", "content_hash", "text").mapInPandas(run, f"id {kind}, content_hash string, vector array<double>")


def triage(names: DataFrame, paths: DataFrame, ranks: DataFrame, term: str, each: int = 100, limit: int = 20) -> DataFrame:
    """repository_id, path, pagerank: the most central of up to `each` symbol hits and `each` path hits for a term.

    names: repository_id, path, name; paths: repository_id, path; ranks: repository_id, path, pagerank.
    """
    t = F.lit(term.lower())
    a = names.where(F.contains(F.lower("name"), t)).select("repository_id", "path").distinct().orderBy("repository_id", "path").limit(each)
    b = paths.where(F.contains(F.lower("path"), t)).select("repository_id", "path").distinct().orderBy("repository_id", "path").limit(each)
    hits = a.union(b).distinct()
    return ranks.join(F.broadcast(hits), ["repository_id", "path"]).orderBy(F.desc("pagerank"), "repository_id", "path").limit(limit)


def decision_star(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, evidence, links) of records: title, source, file, line_no, quote, affected (array of paths)."""
    key = F.sha2(F.concat_ws("|", "title", "source", "file"), 256).alias("decision_id")
    r = records.select(key, "*")
    decisions = r.groupBy("decision_id").agg(F.first("title").alias("title"), F.first("source").alias("source"))
    evidence = r.select("decision_id", "file", "line_no", "quote").distinct()
    return decisions, evidence, r.select("decision_id", F.explode("affected").alias("path")).distinct()


def match_decisions(records: DataFrame, text: str, path: str, limit: int = 12) -> DataFrame:
    """Records whose title has the text or whose affected paths hold the path, the surest first."""
    hit = F.contains(F.lower("title"), F.lit(text.lower())) | F.array_contains("affected", path)
    return records.where(hit).orderBy(F.desc("confidence"), "title").limit(limit)


def first_quote(findings: DataFrame) -> DataFrame:
    """repository_id, file_path, snippet: one finding for each file, the smallest id with a snippet."""
    return findings.where("snippet is not null").groupBy("repository_id", "file_path").agg(F.min_by("snippet", "finding_id").alias("snippet"))


def context_card(files: DataFrame, nodes: DataFrame, symbols: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for a file: rank, degrees, symbols and findings; each side is aggregated to the file before its join."""
    key = ["repository_id", "path"]
    n = nodes.where("node_type = 'file'").select("repository_id", F.col("file_path").alias("path"), "pagerank", "in_degree", "out_degree")
    s = symbols.groupBy("repository_id", F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("symbols"), F.max("complexity").alias("max_complexity"))
    f = findings.groupBy("repository_id", F.col("file_path").alias("path")).agg(F.count_distinct("finding_id").alias("findings"))
    return files.select(*key, "file_id").join(n, key, "left").join(s, key, "left").join(f, key, "left").fillna(0, ["symbols", "findings", "in_degree", "out_degree"]).drop("repository_id")


def head_tail(text, n: int):  # noqa: ANN001, ANN201
    """The first and last n/2 characters of a long text, cut at line ends, with a mark between."""
    half = n // 2
    head = F.regexp_replace(F.substring(text, 1, half), r"\n[^\n]*$", "\n")
    tail = F.regexp_replace(F.right(text, F.lit(half)), r"^[^\n]*\n", "\n")
    return F.when(F.length(text) > n, F.concat(head, F.lit("…"), tail)).otherwise(text)
