"""String, hash and vector expressions. All take and give columns; null in, null out unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a search, entry file stems, contract names, test folders.
STOPWORDS = "the and for how does why what where when are this that with from into use used using can you".split()
ENTRY_STEMS = ("main", "index", "app", "run", "server", "start", "wsgi", "asgi")
CONTRACTS = ("openapi", "swagger", "schema.graphql", "api.yaml", "api.json")
BLOCKED_DIRS = ".git .hg .svn node_modules .venv venv __pycache__ .pytest_cache .mypy_cache .ruff_cache .tox dist build .next target .gradle vendor coverage htmlcov .eggs site-packages .cache .idea .vscode e2e fixtures conftest".split()
BLOCKED_EXT = "pyc pyo pyd so dll dylib exe o a wasm".split()
GENERATED = ("Code generated", "DO NOT EDIT", "This file was automatically generated", "GENERATED CODE", "AUTO-GENERATED", "@generated")
LANGUAGES = dict(py="python", pyi="python", ts="typescript", tsx="typescript", js="javascript", jsx="javascript", mjs="javascript", cjs="javascript", go="go", rs="rust", java="java", cpp="cpp", cc="cpp", cxx="cpp", hpp="cpp", hxx="cpp", c="c", h="c", cs="csharp", rb="ruby", php="php", swift="swift", kt="kotlin", kts="kotlin", scala="scala", lua="luau", luau="luau", sh="shell", bash="shell", zsh="shell", yaml="yaml", yml="yaml", json="json", toml="toml", proto="proto", graphql="graphql", gql="graphql", tf="terraform", hcl="terraform", md="markdown", mdx="markdown", sql="sql", xaml="xaml", axaml="xaml")
SPECIAL = dict(Dockerfile="dockerfile", dockerfile="dockerfile", Makefile="makefile", makefile="makefile", GNUmakefile="makefile")


def base(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base(path), r"\.[^.]*$", "")


def top_segment(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("(root)"))


def file_of(node: Column) -> Column:
    return F.substring_index(node, "::", 1)


def language(path: Column) -> Column:
    b, ext = base(path), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.when(b.startswith("Dockerfile."), "dockerfile")
    for k, v in SPECIAL.items():
        out = out.when(b == k, v)
    m = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(out, m[ext])


def is_test(path: Column) -> Column:
    s = F.lower(stem(path))
    return s.rlike(r"^(test_|spec_)|(_test|_spec|\.test|\.spec)$") | F.concat(F.lit("/"), path).rlike(r"/(tests?|specs?|__tests__)/")


def is_entry(path: Column) -> Column:
    return F.lower(stem(path)).isin(*ENTRY_STEMS)


def is_contract(path: Column) -> Column:
    return F.lower(base(path)).rlike("|".join(c.replace(".", r"\.") for c in CONTRACTS))


def skip_reason(path: Column, size: Column, content: Column) -> Column:
    """Why a file is left out of an index, by the first rule that holds; null when it is kept."""
    b = base(path)
    dirs = F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1)), F.array(*[F.lit(x) for x in BLOCKED_DIRS]))
    head = F.substring(content, 1, 512)
    gen = F.lit(False)
    for g in GENERATED:
        gen = gen | F.contains(head, F.lit(g))
    gen = gen | b.rlike(r"(_pb2|_pb2_grpc)\.py$|_pb\.[jt]s$|\.pb\.go$")
    r = F.when(dirs, "directory").when(F.lower(F.regexp_extract(b, r"\.([^.]+)$", 1)).isin(*BLOCKED_EXT), "extension")
    r = r.when(b.rlike(r"\.min\.(js|css)$|\.lock$|^(package-lock\.json|pnpm-lock\.yaml|go\.sum)$"), "filename").when(size > 500 * 1024, "size")
    return r.when(language(path).isNull(), "language").when(F.contains(F.substring(content, 1, 8192), F.lit("\0")), "binary").when(gen, "generated")


def test_targets(path: Column) -> Column:
    """Production files a test file may stand for."""
    d, b = F.regexp_replace(path, r"[^/]*$", ""), base(path)
    cand = F.array(
        F.when(b.rlike(r"_test\.go$"), F.regexp_replace(b, r"_test\.go$", ".go")),
        F.when(b.rlike(r"^test_.*\.py$"), F.regexp_replace(b, r"^test_", "")),
        F.when(b.rlike(r"_test\.py$"), F.regexp_replace(b, r"_test\.py$", ".py")),
        F.when(b.rlike(r"\.(test|spec)\.\w+$"), F.regexp_replace(b, r"\.(test|spec)(\.\w+)$", "$2")),
        F.when(b.rlike(r"Test\.java$"), F.regexp_replace(b, r"Test\.java$", ".java")),
    )
    return F.transform(F.array_compact(cand), lambda x: F.concat(d, x))


def terms(query: Column) -> Column:
    """Significant lower-case terms, in order."""
    t = F.transform(F.regexp_extract_all(query, F.lit(r"([A-Za-z0-9_]+)"), 1), F.lower)
    return F.filter(t, lambda x: (F.length(x) >= 3) & ~x.isin(*STOPWORDS))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def variants(token: Column) -> Column:
    """The token, in lower case, snake, camel and Pascal case, sorted."""
    parts = F.filter(F.split(token, "_"), lambda x: x != "")
    cap = F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 200))))
    pascal = F.array_join(cap, "")
    camel = F.concat(F.lower(F.element_at(parts, 1)), F.array_join(F.slice(cap, 2, 50), ""))
    snake = F.lower(F.regexp_replace(token, r"(.)([A-Z])", "$1_$2"))
    joined = F.contains(token, F.lit("_"))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(token, F.lower(token), snake, F.when(joined, pascal), F.when(joined, camel)))))


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1), clamped."""
    lines = F.split(text, "\n")
    lo = F.greatest(F.lit(1), start)
    return F.array_join(F.slice(lines, lo, F.greatest(F.lit(0), F.least(end, F.size(lines)) - lo + 1)), "\n")


def title(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(?m)^#{1,6}[ \t]+(.+)$", 1))


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)
