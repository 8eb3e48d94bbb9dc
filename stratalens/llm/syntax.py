"""Source files that do not parse: edit cost, place and kind per file, rates per repository and language.

A file is parsed by the error-correcting chart parser of its language (chart, grammars, lexers, repair); a nonzero edit cost
flags it, in every language. The edits of the least repair say what is wrong: a lost tail or head is a truncation, marker
lines taken out are a merge conflict, another label is a mismatch; anything else is a plain error.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import lexers
from stratalens.llm.chart import NOTHING
from stratalens.llm.repair import Other, Search, least
from stratalens.sources.tables import table

#: Other spellings of the languages, and their extensions (fixed values).
NAMES = {"py": "python", "python3": "python", "pyi": "python", "golang": "go", "ts": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "rs": "rust", "yml": "yaml"}
_MARK = re.compile(r"(?m)^(?:<{7}|={7}|>{7}|\|{7})(?:[ \t].*)?\r?$\n?")
_SIDE = re.compile(r"(?m)^(?:<{7}|>{7})(?:\s|$)")


def language_of(language: Column, path: Column) -> Column:
    """The language in its usual spelling; if it is null or blank, the one of the extension."""
    raw = F.lower(F.trim(language))
    raw = F.when(raw.isNull() | (raw == ""), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))).otherwise(raw)
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.coalesce(names[raw], raw)


def prepared(text: str, lang: str) -> str:
    """Without a byte order mark and a first #! line, which are allowed."""
    if text.startswith("﻿"):
        text = text[1:]
    if text.startswith("#!") and lang != "rust" or lang == "rust" and re.match(r"#!(?!\s*\[)", text):
        text = "\n" + text.partition("\n")[2]
    return text


def cost_is_nonzero(text: str, lang: str) -> bool | None:
    """Whether a repair costs anything: the search has nothing left at cost zero. None for a language without a grammar."""
    if lang not in lexers.MAKERS:
        return None
    one = lexers.language(lang)
    return one.run(one.codes(prepared(text, lang))) >= 0


def searches(text: str, lang: str) -> Iterator[Search | Other]:
    """The ways to read a broken text: as it stands, without merge markers, as another language."""

    def search(text: str, lang: str, base: int, first: tuple) -> Search:
        one = lexers.language(lang)
        codes, at = one.placed(text)
        begins = [0, *(m.end() for m in re.finditer("\n", text))]
        lines = [bisect_right(begins, i) for i in at]
        # a literal or comment that is not closed is one token, up to the end of its line or of the text
        drop, end = set(), -1
        for i, c in enumerate(codes):
            if at[i] < end and c not in one.layout and text[at[i]] != "\n":
                drop.add(i)
            elif c == NOTHING and text[at[i] : at[i] + 1] in ('"', "'", "`", "/"):
                end = -1 if text.startswith("/*", at[i]) else text.find("\n", at[i])
                end = len(text) if end < 0 else end
        if drop:
            keep = [i for i in range(len(codes)) if i not in drop]
            codes, lines = "".join(codes[i] for i in keep), [lines[i] for i in keep]
        return Search(one.chart, codes, lines, one.semi, one.newline, one.layout, one.trail, base, whole=first[:1] == (("label", 1),), first=first)

    plain = prepared(text, lang)
    yield search(plain, lang, 0, ())
    if _SIDE.search(plain):
        line = plain.count("\n", 0, _MARK.search(plain).start()) + 1
        yield search(_MARK.sub("", plain), lang, 1, (("markers", line),))
    if lang == "python":
        for line, t in lexers.closed_early(plain):
            yield search(t, lang, 1, (("insert", line),))
    for other in lexers.MAKERS:
        # any few words are YAML, and any JavaScript is TypeScript
        if other != lang and not (lang == "typescript" and other == "javascript"):
            t = prepared(text, other)
            if other == "yaml" and not re.search(r"(?m)^\s*(?:- |[\w\"'-]+:(?:\s|$))", t):
                continue
            first = (("label", 1),)
            yield Other(lambda t=t, k=other: not cost_is_nonzero(t, k), lambda t=t, k=other: search(t, k, 1, first), first)


def diagnose(text: str, lang: str) -> tuple[int, int, str, str]:
    """(cost, line of the first edit, kind, edits) of the least repair of a text."""
    if not cost_is_nonzero(text, lang):
        return 0, 0, "none", ""
    cost, edits = least(searches(text, lang))
    if not cost:
        return 0, 0, "none", ""
    names = {e for e, _ in edits}
    lines = text.split("\n")
    marked = "markers" in names or any(_MARK.match(x) for e, n in edits if e in ("line", "lines") for x in lines[n - 1 : n])
    kind = "conflict" if marked else "mismatch" if "label" in names else "truncation" if names <= {"tail", "head"} else "error"
    return cost, edits[0][1], kind, " ".join(f"{e}:{n}" for e, n in edits)


def files(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "files")
    return f.select("file_id", "repository_id", language_of(F.col("language"), F.col("path")).alias("language"), "content")


def repairs(src: DataFrame) -> DataFrame:
    """file_id, repository_id, language, edit_cost, line, kind and edits of each row that has content and a language with a grammar.

    edit_cost is the least under the edits of `repair`, 0 for a valid file; line is that of the first edit, edits lists each as
    edit:line. Null and empty contents give no row, blank ones are valid where the grammar takes them. Repeated deliveries give
    repeated rows, for the caller to count once. No content is shuffled.
    """
    names = ["file_id", "repository_id", "language"]
    rows = src.where("content <> ''").where(F.col("language").isin(list(lexers.MAKERS))).select(*names, "content")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [diagnose(t, k) for k, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            cols = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, t) for c, t in zip(cols, types))], names=[*names, "edit_cost", "line", "kind", "edits"])

    return rows.mapInArrow(run, "file_id long, repository_id string, language string, edit_cost long, line long, kind string, edits string")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """file_id of the files that are not valid in their language: those whose edit cost is not zero."""
    return repairs(files(spark, folder)).where("edit_cost > 0").select("file_id").distinct()


def p5_files(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, repository_id, language, edit_cost, line, kind and edits of each broken file."""
    return repairs(files(spark, folder)).where("edit_cost > 0").distinct()


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Files with content, broken files and their rate, per repository and language."""
    once = repairs(files(spark, folder)).groupBy("file_id", "repository_id", "language").agg(F.max(F.col("edit_cost") > 0).alias("b"))
    g = once.groupBy("repository_id", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count_if("b").alias("n_broken"))
    return g.withColumn("broken_rate", F.round(F.col("n_broken") / F.col("n_files"), 6))
