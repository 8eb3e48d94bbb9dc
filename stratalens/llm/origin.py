"""Files nobody on the team wrote by hand: made by tools, compressed for delivery, third-party copies, data payloads.

Per language a character trigram model of identifiers is trained on all files. Three measures come of it and
of the names themselves: mangled names have a high cross-entropy against the model, template-like code has a low
diversity (the same line shapes again and again), and names written in another style than the language's
are foreign. These find what is compressed, filled from a template or payload. A copy of a foreign project in the same style,
or a short generated file, has no such trait; there the opening comment and the path decide, by fixed phrases and folders.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.syntax import language_of
from stratalens.sources.tables import table

#: Bits a character above the language's own mean from which a name counts as mangled.
MANGLED_BITS = 1.6
#: Literal characters from which a file of literals is a payload and not a small table.
PAYLOAD = 1_000

#: Share of repeated line shapes from which a file, or one of under 20 lines of code, counts as filled from a template.
TEMPLATE, TEMPLATE_SHORT = 0.42, 0.3

# What tools and copies say of themselves, and where they are put.
MADE_BY_TOOL = re.compile(
    r"(?i)code generated (?:by|from)|auto-?generated (?:by|from|file|code)|<auto-?generated|@generated\b|generated (?:by|from|with) (?:the |protoc|[\w-]+ ?(?:compiler|codegen|gen\b|[\w-]*\d))|this file (?:is|was) (?:auto-?)?generated|generated code|generated file|machine[- ](?:made|generated)|do not edit (?:this file|by hand|manually)|\bdo not (?:edit|modify|touch)\W*$|manual edits are lost|(?:changes|edits) (?:will be|are) (?:lost|overwritten)|regenerate with|automatisch (?:erzeugt|generiert)|自动生成|自動生成|сгенерирован|généré automatiquement|generado automáticamente|gerado automaticamente|자동 생성|wygenerowan|autogenerat|signedsource"
)
NOT_THIS_FILE = re.compile(r"(?i)\b(?:skips?|handles?|both|hand-?written|written by hand|reads?|parses?|detects?|checks?|looks? for|order of|without the owners|that carry|unless|emits?|writes?|prints?|our own)\b")
THIRD_PARTY = re.compile(
    r"(?i)vendored (?:from|copy|in)|bundled (?:third-party|[\w.-]+) code|imported unchanged|unmodified copy|this is a copy of|copied (?:verbatim )?from (?:https?:|the [\w-]+ project)|report bugs upstream|local changes: none|\(c\) (?:\d{4}[-, ]*)+(?:the )?[\w.-]+ (?:contributors|authors|project)|licen[cs]e of that project|from upstream [\w.-]+|third[- ]party code"
)
VENDOR_DIR = re.compile(r"(?:^|/)(?:third[_-]?party|external|extern|contrib|godeps/_workspace|vendor|vendored|deps|node_modules|site-packages|bower_components|static/libs|jspm_packages|\.?yarn/cache|pods)/(?:[\w.@-]+/)+", re.I)
TOOL_PATH = re.compile(r"(?:^|/)(?:gen|generated|generated-sources|__generated__|autogen)/|(?:_pb2(?:_grpc)?\.py|\.pb\.(?:go|h|cc)|_pb\.js|\.(?:gen|generated|g)\.\w+|_mock\.go|_generated\.\w+|\.designer\.cs|_pb\.d\.ts)$", re.I)
MIN_PATH = re.compile(r"[.-]min\.\w+$|\.bundle\.js$|(?:^|/)dist/", re.I)
LOCK = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|composer\.lock|poetry\.lock|cargo\.lock|go\.sum|pipfile\.lock|gemfile\.lock|[\w.-]*[.-]lock(?:file)?(?:\.\w+)?)$", re.I)
#: The style of ordinary names of a language: _ for snake case, A for camel case.
STYLE = {"python": "_", "rust": "_", "go": "A", "java": "A", "javascript": "A", "typescript": "A"}
_WORDS = re.compile(r"[A-Za-z_$][\w$]*")
_STRINGS = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`')
_FRAME = re.compile(r"(?:import|from|use|package|#include|using)\b|(?:export )?const \w+ = \d+;?$|[A-Z_]+ = \d+$|private static final int|log = |const \w+: i64")
_COMMENTS = re.compile(r"/\*[\s\S]*?\*/|(?m:(?:^|(?<=\s))(?://|#(?!\[)).*$)|^\s*\"\"\"[\s\S]*?\"\"\"")
#: The same for a text that does not begin with a doc string: beginning with a set of characters, it is searched for faster.
_MARKED = re.compile(r"[/#](?:(?<=/)\*[\s\S]*?\*/|(?m:(?<=^[/#])|(?<=\s[/#]))(?:(?<=/)/|(?<=#)(?!\[)).*(?m:$))")
_KEYWORDS = frozenset(
    "and as assert async await break case catch class const continue def default defer del do else elif enum except export extends false final finally fn for from func function go if impl implements import in interface is lambda let loop map match mod mut new nil none not null or package pass private protected pub public raise range return select self static str string struct super switch this throw true try type typeof use var void where while with yield int i64 u32 bool number any log info".split()
)

_NAME = re.compile(r"(?<![\w$])(?!(?:" + "|".join(sorted(_KEYWORDS)) + r")(?![\w$.:]))[A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*")
_NUMBER = re.compile(r"(?<![\w$])\d[\w.]*")
_ODD, _CAMEL = re.compile(r"\d|_"), re.compile(r"[a-z][A-Z]")
_LITERALS = re.compile(r"""\"[^\"\n]*\"|'[^'\n]*'|(?<![\w.])-?\d[\d.xXa-fA-F]*""")
_LOGIC = re.compile(r"\b(?:if|for|while|return|switch|match|func|function|def|fn)\b")


def trigrams(words: dict[str, int]) -> dict[str, list[float]]:
    """How often each trigram occurs in names that occur so often, and the same with a name's number shared among its trigrams."""
    out: dict[str, list[float]] = {}
    for w, k in words.items():
        w = "^^" + w + "$"
        for i in range(2, len(w)):
            got = out.setdefault(w[i - 2 : i + 1], [0, 0.0])
            got[0] += k
            got[1] += k / (len(w) - 2)
    return out


class Names:
    """A character trigram model of identifiers, from how often each occurs, or from their trigrams."""

    def __init__(self, words: dict[str, int], grams: dict[str, list[float]] | None = None):
        grams = trigrams(words) if grams is None else grams
        self.n, self.d, self.memo = {g: k for g, (k, _) in grams.items()}, Counter(), {}
        for g, k in self.n.items():
            self.d[g[:2]] += k
        # rounded, as sums of fractions depend on their order
        total = sum(share for _, share in grams.values())
        self.mean = round(-sum(share * math.log2((k + 0.1) / (self.d[g[:2]] + 6.0)) for g, (k, share) in grams.items()) / total, 9) if total else 0.0

    def bits(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            w = "^^" + word + "$"
            got = -sum(math.log2((self.n.get(w[i - 2 : i + 1], 0) + 0.1) / (self.d.get(w[i - 2 : i], 0) + 6.0)) for i in range(2, len(w))) / (len(w) - 2)
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[word] = got
        return got


def uncommented(text: str) -> str:
    return (_COMMENTS if text.lstrip().startswith('"""') else _MARKED).sub(" ", text)


def identifiers(text: str) -> list[str]:
    body = _STRINGS.sub('""', uncommented(text))
    return [w for w in _WORDS.findall(body) if w.lower() not in _KEYWORDS]


def opening(text: str) -> str:
    """The comments a file opens with: everything before its first line of code."""
    out, block, quote = [], False, ""
    for line in text.lstrip("﻿").split("\n"):
        s = line.strip()
        if block:
            out.append(s)
            if (quote or "*/") in s:
                block = False
        elif s.startswith("/*"):
            out.append(s)
            block, quote = "*/" not in s, ""
        elif s.startswith(('"""', "'''")):
            out.append(s)
            block, quote = s.count(s[:3]) < 2, s[:3]
        elif not s or s.startswith(("//", "#", "--", "<!--", ";")):
            out.append(s)
        else:
            break
    return "\n".join(out)


def _says(head: str, what: re.Pattern) -> bool:
    return any(what.search(line) and not NOT_THIS_FILE.search(line) for line in re.split(r"\n", head))


def measures(text: str, lang: str, models: dict[str, Names]) -> dict[str, float]:
    """mangled and foreign (shares of names), again (share of repeated line shapes), payload (share of literals), and sizes."""
    body = uncommented(text)
    plain = _STRINGS.sub('""', body)
    words = [w for w in _WORDS.findall(plain) if w.lower() not in _KEYWORDS]
    model = models.get(lang)
    counts = Counter(w for w in words if len(w) > 1)
    n_names = sum(counts.values())
    mangled = 0.0
    if n_names and model and model.mean:
        high, short = model.mean + MANGLED_BITS, model.mean + MANGLED_BITS - 1.0
        mangled = sum(k for w, k in counts.items() if model.bits(w) > (short if len(w) <= 6 and (len(w) <= 2 or _ODD.search(w)) else high)) / n_names
        mangled = max(mangled, sum(1 for w in words if len(w) <= 2) / len(words))
    # the share of lines whose shape, with the three before it, came earlier in the file: high where a template was filled in
    shapes = []
    for raw, s in zip(plain.split("\n"), _NUMBER.sub("0", _NAME.sub("x", plain)).split("\n")):
        raw = raw.strip()
        if len(raw) > 1 and not _FRAME.match(raw):
            shapes.append(s.strip())
    grams, again = set(), 0
    for i in range(3, len(shapes)):
        gram = tuple(shapes[i - 3 : i + 1])
        again += gram in grams
        grams.add(gram)
    again = again / max(1, len(shapes) - 3) if len(shapes) >= 7 else 0.0
    style = STYLE.get(lang)
    foreign = 0.0
    if style and n_names:
        snake = sum(k for w, k in counts.items() if "_" in w.strip("_") and not w.isupper())
        camel = sum(k for w, k in counts.items() if _CAMEL.search(w))
        foreign = (camel if style == "_" else snake) / max(1, snake + camel)
    solid = sum(map(len, body.split())) or 1
    literal = sum(map(len, _LITERALS.findall(body))) + body.count(",")
    return {
        "mangled": mangled, "foreign": foreign, "payload": literal / solid, "literal": literal, "n_names": n_names, "again": again, "body": len(shapes),
        "space": 1 - sum(map(len, text.split())) / max(1, len(text)), "longest": max(map(len, text.split("\n"))), "logic": len(_LOGIC.findall(body)) / max(1, text.count("\n") + 1),
    }


def classify(text: str, path: str, lang: str, models: dict[str, Names]) -> str | None:
    """'lock', 'vendored', 'generated', 'minified', 'payload', or None for hand-written source."""
    path = (path or "").replace("\\", "/")
    if LOCK.search(path) or lang in ("json", "yaml") and (re.search(r'^\s*"lockfileVersion"\s*:', text, re.M) or len(re.findall(r'"integrity"\s*:', text)) > 3):
        return "lock"
    head = opening(text)
    if VENDOR_DIR.search(path):
        return "vendored"
    if _says(head, THIRD_PARTY) and not re.search(r"(?i)our own|internal use", head):
        return "vendored"
    if _says(head, MADE_BY_TOOL):
        return "generated"
    if lang in ("json", "yaml"):
        return None
    m = measures(text, lang, models)
    if TOOL_PATH.search(path):
        return "generated"
    if m["foreign"] > 0.8 and m["n_names"] > 30 and re.search(r"(?i)copyright|licen[cs]e", head) and re.search(r"(?i)contributors|upstream|https?://", head):
        return "vendored"
    if m["space"] < 0.12 and m["mangled"] > 0.25 and m["longest"] > 150 and not re.match(r"\s*<[!\w]", text) or MIN_PATH.search(path) and (m["space"] < 0.15 or m["mangled"] > 0.3):
        return "minified"
    if m["payload"] > 0.8 and m["literal"] >= PAYLOAD and m["logic"] < 0.05:
        return "payload"
    if m["again"] > (TEMPLATE if m["body"] >= 20 else TEMPLATE_SHORT) and m["body"] >= 11:
        return "generated"
    return None


def train(rows: DataFrame) -> dict[str, Names]:
    """Identifier models per language, on all names of all files.

    Names are counted by file, and brought together by file so that a repeated delivery counts once; the sums that come to the
    driver have a row for each language and trigram, and texts stay where they are read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, lang, digest, text in zip(*(c.to_pylist() for c in b.columns)):
                # names a tool mangled are not what the model is of
                if max(map(len, text.split("\n"))) < 300 and not _says(opening(text), MADE_BY_TOOL) and (c := Counter(identifiers(text))):
                    out.append((i, lang, digest, " ".join(c), list(c.values())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64())))], names=["file_id", "language", "digest", "words", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sums = set(), {}
        for b in batches:
            words: dict[str, Counter] = {}
            for i, lang, digest, names, n in zip(*(c.to_pylist() for c in b.columns)):
                if (i, lang, digest) not in seen:
                    seen.add((i, lang, digest))
                    c = words.setdefault(lang, Counter())
                    for w, k in zip(names.split(" "), n):
                        c[w] += k
            for lang, c in words.items():
                for gram, (k, share) in trigrams(c).items():
                    got = sums.setdefault((lang, gram), [0, 0.0])
                    got[0] += k
                    got[1] += share
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in sums]), pa.array([g[1] for g in sums]), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.float64())], names=["language", "gram", "n", "share"])

    own = rows.where("content <> ''").where(F.col("language").isin(*STYLE)).select("file_id", "language", F.xxhash64("content").alias("digest"), "content")
    names = own.mapInArrow(count, "file_id long, language string, digest long, words string, n array<long>").repartition("file_id")
    sums = names.mapInArrow(add, "language string, gram string, n long, share double").groupBy("language", "gram").agg(F.sum("n").alias("n"), F.sum("share").alias("share"))
    grams: dict[str, dict[str, list[float]]] = {}
    for r in sums.collect():
        grams.setdefault(r.language, {})[r.gram] = [r.n, r.share]
    return {k: Names({}, v) for k, v in sorted(grams.items())}


def labelled(rows: DataFrame, models: dict[str, Names]) -> DataFrame:
    """file_id, origin ('hand' for hand-written source) of each row with content. No text is shuffled.

    Null and empty contents give no row; repeated deliveries repeat; a language without a model is judged by path and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = [classify(t, p, k, models) or "hand" for p, k, t in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kind, pa.string())], names=["file_id", "origin"])

    return rows.select("file_id", "path", "language", "content").where("content <> ''").mapInArrow(run, "file_id long, origin string")


def files(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "files")
    return f.select("file_id", "path", language_of(F.col("language"), F.col("path")).alias("language"), "content").where("content <> ''")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """file_id of the files nobody on the team wrote by hand."""
    rows = files(spark, folder)
    return labelled(rows, train(rows)).where("origin <> 'hand'").select("file_id").distinct()


def p2_origin(spark: SparkSession, folder: str) -> DataFrame:
    """file_id and origin of every file with content: hand, lock, vendored, generated, minified or payload."""
    rows = files(spark, folder)
    return labelled(rows, train(rows)).distinct()
