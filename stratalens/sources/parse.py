"""Source texts to symbol rows: exact for Python (its own parser), by declaration patterns and bracket depth elsewhere."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "repository_id string, file_path string, id string, name string, kind string, signature string, start_line int, end_line int, visibility string, complexity int, nesting int, language string, parent_name string, ordinal int"
_FIELDS = [f.rsplit(" ", 1) for f in SCHEMA.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32()}

#: Declarations (kind, pattern with name) and branch words by language (fixed values).
DECLARATIONS = {
    "go": [("method", r"^func\s+\(\s*\w+\s+\*?(?P<parent>\w+)[^)]*\)\s*(?P<name>\w+)\s*\([^\n]*"), ("function", r"^func\s+(?P<name>\w+)\s*[\[(][^\n]*"), ("class", r"^type\s+(?P<name>\w+)\s+(?:struct|interface)\b[^\n]*")],
    "java": [("class", r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*class\s+(?P<name>\w+)[^\n]*"), ("interface", r"^\s*(?:(?:public|private|protected)\s+)*interface\s+(?P<name>\w+)[^\n]*"), ("method", r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?]+\s+(?P<name>\w+)\s*\([^\n;]*\{")],
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(?P<name>\w+)[^\n]*"), ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)[^\n]*"), ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)[^\n]*"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)[^\n]*")],
    "typescript": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)[^\n]*"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)[^\n]*"), ("interface", r"^\s*(?:export\s+)?interface\s+(?P<name>\w+)[^\n]*")],
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"][:2]
BRANCH = {"go": r"\b(?:if|for|select|case)\b", "java": r"\b(?:if|for|while|do|case|catch)\b|\?(?!\s*>)", "rust": r"\b(?:if|while|for|loop)\b|=>", "typescript": r"\b(?:if|for|while|do|case|catch|else)\b|\?(?![.:?])"}
BRANCH["javascript"] = BRANCH["typescript"]
_PY_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.match_case, ast.IfExp)
_QUIET = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`|//[^\n]*|/\*[\s\S]*?\*/')


def _python(text: str) -> list[tuple]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    lines, out = text.split("\n"), []

    def depth(node: ast.AST, k: int = 0) -> int:
        return max([k, *(depth(c, k + isinstance(c, _PY_BRANCH)) for c in ast.iter_child_nodes(node))])

    def walk(node: ast.AST, parent: str | None) -> None:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = isinstance(c, ast.ClassDef)
                n = c.name
                vis = "public" if n.startswith("__") and n.endswith("__") else "private" if n.startswith("__") else "protected" if n.startswith("_") else "public"
                ccn = 1 + sum(isinstance(x, _PY_BRANCH) for x in ast.walk(c))
                out.append((n, "class" if cls else "method" if parent else "function", lines[c.lineno - 1].strip(), c.lineno, c.end_lineno, vis, ccn, depth(c), parent))
                walk(c, n if cls else parent)
            else:
                walk(c, parent)

    walk(tree, None)
    return out


def _brackets(text: str, lang: str) -> list[tuple]:
    plain = _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out = []
    for kind, pattern in DECLARATIONS[lang]:
        for m in re.finditer(pattern, plain, re.M):
            i, depth, branch_depth, most = plain.find("{", m.start()), 0, 0, 0
            stop = len(plain) if i >= 0 else m.end()
            if i < 0 or "\n" in plain[m.end() : i].strip():
                i, stop = m.end(), m.end()
            stack: list[bool] = []
            for t in re.finditer(r"[{}]", plain[i:]):
                if t[0] == "{":
                    line = plain[plain.rfind("\n", 0, i + t.start()) + 1 : i + t.start()]
                    b = bool(stack) and re.search(BRANCH[lang], line) is not None
                    stack.append(b)
                    branch_depth += b
                    most = max(most, branch_depth)
                else:
                    branch_depth -= stack.pop() if stack else 0
                    if not stack:
                        stop = i + t.end()
                        break
            body = plain[m.start() : stop]
            name = m["name"]
            d = m.groupdict()
            vis = ("public" if name[:1].isupper() else "private") if lang == "go" else "public" if lang == "javascript" or re.search(r"\b(?:pub|public|export)\b", m[0]) else "private" if re.search(r"\bprivate\b", m[0]) or lang == "rust" else "internal"
            start = plain.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1
            out.append((name, kind, text[m.start() : m.end()].strip().rstrip("{").strip(), start, plain.count("\n", 0, max(m.start(), stop - 1)) + 1, vis, 1 + len(re.findall(BRANCH[lang], body)), most, d.get("parent")))
    return sorted(out, key=lambda r: (r[3], r[4]))


def symbols_of(text: str, lang: str) -> list[tuple]:
    """(name, kind, signature, start, end, visibility, complexity, nesting, parent) in order; nothing for what does not parse."""
    try:
        rows = _python(text) if lang == "python" else _brackets(text, lang) if lang in DECLARATIONS else []
    except (SyntaxError, ValueError, RecursionError):
        return []
    if lang in ("java", "rust", "typescript"):  # the smallest class that holds a declaration is its parent
        cls = [r for r in rows if r[1] in ("class", "interface", "impl", "trait")]
        fixed = []
        for r in rows:
            own = [c for c in cls if c[3] <= r[3] and r[4] <= c[4] and c is not r]
            fixed.append((*r[:8], min(own, key=lambda c: c[4] - c[3])[0] if own else r[8]))
        rows = fixed
    return rows


def symbols(files: DataFrame) -> DataFrame:
    """Symbol rows of files (repository_id, path, language, content); null and empty contents give none. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for repo, path, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                for k, (name, kind, sig, lo, hi, vis, ccn, nest, parent) in enumerate(symbols_of(text, lang)):
                    ident = f"{path}::{parent}::{name}" if parent else f"{path}::{name}"
                    out.append((repo, path, ident, name, kind, sig, lo, hi, vis, ccn, nest, lang, parent, k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*out), _FIELDS)], names=[n for n, _ in _FIELDS])

    return files.select("repository_id", "path", "language", "content").where("content <> ''").mapInArrow(run, SCHEMA)
