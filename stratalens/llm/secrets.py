"""Credentials embedded in source code and in findings: where they are, and the text with only them replaced.

A text gives candidates: quoted strings of any length and what stands inside them, escapes undone (user info of a URL, query
parameters, authorization schemes, command line options), assignments without quotes, tokens in comments, private key blocks.

A logistic regression scores each. Its features are character Markov log likelihoods (of the value, of the identifier it is
given to, and of the text before it, each under a chain of ordinary ones and a chain of secret ones), what the value is made
of, the words around it and in the path (hashed), and the place it stands in. No pattern is a feature. Patterns only give the
weak labels of the fit, on a bounded sample; candidates on which they are not sure stay unlabelled. Chains are counted on one
part of the sample, weights are fitted on another, and the score is calibrated (Platt) on a third; a calibrated score of at
least one half counts. An exact check follows: values that cannot be used (masked, empty, looked up, paths, digests with the
name of their algorithm) are left out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.sources.tables import table

#: Files and findings, of each, whose candidates the model is fitted on.
SAMPLE = 5_000
#: Buckets of hashed words: of the identifier, of the text before, of marks before, of the path, of the kind of a finding.
BUCKETS = (160, 32, 32, 16, 16)
MASK = "[REDACTED]"

# Words in names of secrets, in names of other things, and of values that stand for no secret.
SECRET_NAME = re.compile(r"(?i)passw|passphrase|passcode|(?:^|[_\W])pass(?:$|[_\W])|(?-i:Pass)(?:$|[_\W])|pwd|(?:^|[_\W])pw(?:$|[_\W])|(?-i:Pw)$|secret|token|api[_-]?key|access[_-]?key|signing[_-]?key|private[_-]?key|auth(?!or)|credential|kennwort|passwort|contrase|mot[_-]?de[_-]?passe|motdepasse|senha|parol|salt[_-]?key|hmac|encryption|webhook|bearer|login|\bkey\b|access for|пароль|密码|パスワード")
OTHER_NAME = re.compile(r"(?i)(?:sha[_-]?\d*|md5|digest|checksum|hash|commit|request[_-]?id|uuid|guid|integrity|revision|etag|fingerprint|public[_-]?key|cert(?:ificate)?|verify|logo|image|icon|pattern|regex|path|hint|help|label|type|kind|primary[_-]?key|placeholder|version|resolved|file|name|prefix|header|url|uri|wire|json|[_-]id|(?-i:Id))$")
OTHER_NEAR = re.compile(r"(?i)signedsource|vendored|integrity|\bcommit\b|\bsha\d*\b|checksum|revision|\bsee\b|upstream|\bat\s*$")
EMPTY = re.compile(r"(?i)^(?:$|\W+$|change[-_ ]?me|replace[-_ ]?(?:me|this|with)|your[-_ ]|insert[-_ ]|example$|todo|fixme|dummy|placeholder|redacted|masked$|hidden$|secret$|password$|none$|null$|undefined|fill[-_ ](?:in|me)|set[-_ ]me|x{3,}|\*+|\.{3}|test(?:ing)?$|unset|not[-_ ]set|n/?a$|\d+(?:[,|]\w+)+$)|goes[-_]?here|[-_]here\b|\bredacted\b|\*{3,}|x{6,}|^<.*>$|^\[.*\]$")
LOOKUP = re.compile(r"^\$(?:[A-Za-z_]\w*$|\()|\$\{|\{\{|^\{|^%[({\w]|%s|#\{|<%|(?i:^(?:vault|env|ssm|secret|file|arn|op|gcp|aws|kms|ref|keyring|urn):[^/]?)|(?i:\benv\(|getenv|environ|process\.env|secretsmanager)")
_DIGEST = re.compile(r"^(?i:sha(?:1|256|384|512)|md5)[:-](?:[0-9a-fA-F]{32,128}|[A-Za-z0-9+/]{22,88}={0,2})$")
_PATH = re.compile(r"(?:~|\.{1,2})?/?[\w.@-]+(?:/[\w.@-]+)+/?|(?:~|\.{1,2})?/[\w.@-]+/?")
_KNOWN = re.compile(r"^(?:AKIA[0-9A-Z]{16}$|ASIA[0-9A-Z]{16}$|eyJ[\w-]{6,}\.[\w-]+\.[\w-]+|gh[pousr]_\w{20,}|xox[abprs]-|AIza[\w-]{20,}|[a-z]{2,4}[_-](?:live|prod|test|sk|pk|pat|key)[_-]\w{10,}|sk[_-]\w{16,})")
_PHRASE = re.compile(r"^[a-z]+(?:[-_.][a-z]+){2,}[-_.]\d{1,4}$")
_STRONG = re.compile(r"^(?=.*[A-Za-z])(?=.*\d)(?=.*[^\w\s])\S{7,40}$")
_URLISH = re.compile(r"^\w+://|^data:|^[a-z][\w-]*(?:\.[a-z][\w-]*)+(?:/|$)|^@|/.*/")
_BLOB = re.compile(r"[A-Za-z0-9+/=]{24,}")
_HOST = re.compile(r"[\w-]\.(?:invalid|example|local|com|net|io|org|internal)[\"'], *[\"'][\w.@-]+[\"'], *$")
_UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
_PATTERN = re.compile(r"\[[^\]]*-[^\]]*\]|\(\?|\\[dws]|\{\d+,?\d*\}|\.\*")

_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
#: A piece of a key block between line ends, real or escaped: base64 in whatever quotes and marks surround it, or a header.
_BREAK = re.compile(r"\r?\n|\\+[nr]")
_KEY_LINE = re.compile(r"""[\s"'`+,;.()>#*/\\|-]*(?:\w+ *\+?= *["'`])?[\s"'`+,]*[A-Za-z0-9+/]*={0,2}[\s"'`+,;.()\\]*|[\s"'`>#*/|]*[A-Z][A-Za-z]*(?:-[A-Za-z]+)*: [^\n]*""")
_KEY_PART = re.compile(r"(\\+[nr])|-----[^\n-]*-----|[A-Z][A-Za-z]*(?:-[A-Za-z]+)*: [^\n\\]*|([A-Za-z0-9+/=]+)")
_QUOTED = re.compile(r"""-----BEGIN|"(?![a-z' .,]*\d*")((?:[^"\\\n]|\\.){4,})"|'(?![a-z .,]*\d*')((?:[^'\\\n"]|\\.){4,})'|`(?![a-z' .,]*\d*`)((?:[^`\\\n"]|\\.){4,})`""")
_INNER = re.compile(r"""://[^\s:/@"'`]*:(?P<user>[^\s@"'`/]{3,})@|[?&](?P<par>[\w-]+)=(?P<query>[^&\s"'`#]{6,})|(?i:\b(?P<scheme>bearer|basic|token)\s+)(?P<auth>[\w.~+/=-]{8,})|\s-u\s*['"]?[^\s:]+:(?P<cli>[^\s"'`]{4,})|(?<![\w-])-p(?P<flag>(?=[^\s"'`]*\d)[^\s"'`]{6,})|(?<![\w-])--?(?P<opt>[A-Za-z][\w-]*)[= ](?P<optval>[^\s"'`]{6,})|(?i:\bidentified\s+by|\bpassword)\s+'(?P<sql>[^'\n]{4,})'""")
_BARE = re.compile(r"""(?m)^[ \t]*(?:-[ \t]+)?(?:(?:set|export|ARG|ENV|setx)[ \t]+)?(?P<name>--?[A-Za-z][\w-]*|[A-Za-z_][\w.-]*)(?:=|:[ \t]+|[ \t]+=[ \t]+)(?P<val>[^\s"'`#(){};,\[\]][^\s"'`(){};,]{5,})[ \t]*(?:#.*)?$""")
_COMMENT = re.compile(r"""(?m)(?:(?:^|[ \t;{}])(?://|#)|^[ \t]*\*|<!--)[ \t]?(?P<body>[^\n]{8,})$""")
_TOKEN = re.compile(r"""[^\s"'`,;()<>]{8,}""")
_LOOKS = re.compile(r"^(?=\S*[a-zA-Z])(?=\S*\d)\S+$")
_PLACES = {"user": "user", "query": "query", "auth": "auth", "cli": "cli", "flag": "cli", "optval": "option", "sql": "sql"}
FORMS = ("pem", "user", "query", "auth", "cli", "option", "sql", "string", "bare", "comment")


def _name_before(text: str, at: int) -> tuple[str, str]:
    """(nearest name, the line) before an offset."""
    lo = text.rfind("\n", 0, at) + 1
    lead = _BLOB.sub("", text[max(lo, at - 160) : at])
    bare = re.sub(r":\s*(?:&\s*)?(?:'static\s+)?(?:string|str|String|any)\b(?=\s*=?)", "", lead)  # a type is no name
    names = re.findall(r"[\w$-]*[A-Za-z_][\w$-]*", bare)
    return (names[-1] if names else ""), lead


def block_end(text: str, at: int, label: str) -> int:
    """Where the content of a key block ends: at the END mark of its label, however far; without one, after its last key line."""
    end = text.find(f"-----END {label}-----", at)
    if end >= 0 and text.find("-----BEGIN", at, end) < 0:
        if sum(len(m[0]) for m in _BLOB.finditer(text, at, end)) * 2 >= end - at or end - at <= 12_000:
            return end
    last = lo = at
    while lo < len(text):
        m = _BREAK.search(text, lo)
        hi = m.start() if m else len(text)
        mark = text.find("-----", lo, hi)
        line = text[lo : mark if mark >= 0 else hi]
        if not _KEY_LINE.fullmatch(line):
            break
        if re.search(r"[A-Za-z0-9+/]", line):
            if not re.search(r"[A-Za-z0-9+/]{24,}|: ", line) and lo > at:  # a short line is the last; a word or keyword is code
                return lo + len(line) if re.fullmatch(r"""[\s"'`+]*(?=\S*[\d=+/A-Z])[A-Za-z0-9+/=]+[\s"'`+,;\\]*""", line) else last
            last = lo + len(line)
        if mark >= 0 or not m:
            break
        lo = m.end()
    return last


_ESCAPED = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|([\s\S]))")
_SIMPLE = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "0": "\0"}


def unescaped(v: str) -> tuple[str, list[int]]:
    """What a literal stands for, and where in it each character, and the end, lies."""
    out, at, i = [], [], 0
    for m in _ESCAPED.finditer(v):
        out.append(v[i : m.start()])
        at += range(i, m.start() + 1)
        out.append(chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SIMPLE.get(m[3], m[3]))
        i = m.end()
    return "".join([*out, v[i:]]), [*at, *range(i, len(v) + 1)]


def candidates(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, form, name, context) of whatever could be a credential."""
    out: dict[int, tuple[int, int, str, str, str]] = {}

    def add(lo: int, hi: int, form: str, name: str, lead: str) -> None:
        if lo not in out or FORMS.index(form) < FORMS.index(out[lo][2]):
            out[lo] = (lo, hi, form, name, lead)

    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            body = text[m.end() : block_end(text, m.end(), m[1])]
            if re.search(r"[A-Za-z0-9+/=]{24,}", body):
                add(m.start(), m.end() + len(body), "pem", *_name_before(text, m.start()))
    spans = []
    for m in _QUOTED.finditer(text):
        k = m.lastindex
        if not k:
            continue
        lo, hi = m.span(k)
        spans.append((lo, hi))
        name, lead = _name_before(text, lo - 1)
        found = False
        v, at = m.group(k), None
        if "\\" in v:
            v, at = unescaped(v)
            if re.search("[\"'`]|PRIVATE KEY", v):  # a text of its own, such as JSON
                for a, b, form, label, near in candidates(v):
                    add(lo + at[a], lo + at[b], form, label or name, lead + near)
                    found = True
        place = lambda i: lo + (at[i] if at else i)
        if not found and (":" in v or " " in v or "=" in v or v[0] == "-"):
            for n in _INNER.finditer(v):
                g = n.lastgroup
                val = n.group(g) if g not in ("par", "scheme", "opt") else ""
                if val:
                    form = _PLACES[g]
                    label = n.group("par") or n.group("opt") or name
                    add(place(n.start(g)), place(n.end(g)), form, label, lead)
                    found = True
        if not found and not re.search(r"\s", v.strip(" ")) and " " not in v.strip():
            add(lo, hi, "string", name, lead)
        elif not found:
            whole = len(v) <= 600 and not at  # of a short literal all is context, of a long one what stands before
            if whole and (not SECRET_NAME.search(v) or re.search(r"[;()]", v)):
                continue
            for n in _TOKEN.finditer(v):
                if (_LOOKS.match(n.group()) or _KNOWN.match(n.group())) and not _urlish(n.group()):
                    named = None if whole else re.match(r"[A-Za-z_][\w.-]*[=:](?=.{8})", n.group())
                    first = n.start() + (named.end() if named else 0)
                    near = v[max(0, first - 60) : first]
                    if whole or SECRET_NAME.search(near) and not re.search(r"[;()]", near):
                        add(place(first), place(n.end()), "comment", "", lead + near)
    for m in _BARE.finditer(text):
        name = m["name"]
        if SECRET_NAME.search(name) or _KNOWN.match(m["val"]):
            add(m.start("val"), m.end("val"), "option" if name[0] == "-" else "bare", name, text[m.start() : m.start("val")])
    for m in _COMMENT.finditer(text):
        base, body = m.start("body"), m["body"]
        for n in _INNER.finditer(" " + body):
            g = n.lastgroup
            if g in _PLACES and n.group(g):
                form = _PLACES[g]
                if form != "auth" or _LOOKS.match(n.group(g)):
                    add(base + n.start(g) - 1, base + n.end(g) - 1, form, n.group("par") or n.group("opt") or "", body[max(0, n.start(g) - 601) : max(0, n.start(g) - 1)])
        for n in _TOKEN.finditer(body):
            v = n.group()
            if (_LOOKS.match(v) or _KNOWN.match(v)) and not (_URLISH.match(v) and _urlish(v)):
                line = text.rfind("\n", 0, base) + 1
                add(base + n.start(), base + n.end(), "comment", "", _BLOB.sub("", text[max(line, base + n.start() - 600) : base + n.start()]))
    return sorted(out.values())


_JOINED = re.compile(r"""["'`]\s*(?:\+|\\)\s*["'`]$""")


def begins(text: str, lo: int) -> int:
    """Where the string that holds an offset begins, over pieces that are joined by +."""
    while m := _JOINED.search(text, max(0, lo - 120), lo):
        line = text.rfind("\n", 0, m.start()) + 1
        start = max(text.rfind(q, line, m.start()) for q in "\"'`")
        if start < 0:
            break
        lo = start + 1
    return lo


class Chain:
    """A character Markov chain of order two."""

    def __init__(self, words: list[str]):
        self.n, self.d = Counter(), Counter()
        for w in words:
            w = "^^" + w + "$"
            for i in range(2, len(w)):
                self.n[w[i - 2 : i + 1]] += 1
                self.d[w[i - 2 : i]] += 1
        self.n, self.d = dict(self.n), dict(self.d)

    def bits(self, v: str) -> float:
        """Mean bits a character."""
        w = "^^" + v + "$"
        n, d, s = self.n.get, self.d.get, 0.0
        for i in range(2, len(w)):
            s += math.log2((n(w[i - 2 : i + 1], 0) + 0.05) / (d(w[i - 2 : i], 0) + 2.5))
        return -s / (len(w) - 2)


#: Vowels, other small letters, capitals and digits as one character each: random values differ from words in this.
_SHAPE = str.maketrans({**dict.fromkeys("aeiouy", "v"), **dict.fromkeys("bcdfghjklmnpqrstvwxz", "c"), **dict.fromkeys("0123456789", "0"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "u")})


def _is_path(v: str) -> bool:
    """Several short segments, none of which has upper and lower case and digits, as random ones have."""
    return _PATH.fullmatch(v) is not None and all(len(x) <= 32 and not _mixed(x) for x in v.split("/"))


def _mixed(v: str) -> bool:
    return re.search(r"[a-z]", v) is not None and re.search(r"[A-Z]", v) is not None and re.search(r"\d", v) is not None


def _urlish(v: str) -> bool:
    """Whether a value looks like an address; base64 with slashes does not."""
    return _URLISH.search(v) is not None and not (re.fullmatch(r"[A-Za-z0-9+/]{16,}={0,2}", v) is not None and _mixed(v) and not _is_path(v))


def _entropy(v: str) -> float:
    n = len(v)
    return -sum(k / n * math.log2(k / n) for k in Counter(v).values())


def facts(c: tuple, text: str, kind: str) -> dict[str, float]:
    """What patterns say about a candidate; used by features and by weak labels."""
    lo, hi, form, name, lead = c
    v = text[lo:hi]
    if "\\" in v and form not in ("pem", "bare", "comment"):
        v = unescaped(v)[0]
    hexa = re.fullmatch(r"[0-9a-fA-F]{16,}", v) is not None
    host = _HOST.search(lead) is not None
    placed = host or form in ("user", "query", "auth", "cli", "sql")  # there the place says it, not the name
    other = not placed and OTHER_NAME.search(name) is not None
    return {
        "form": form, "v": v, "hex": hexa, "known": _KNOWN.match(v) is not None, "phrase": _PHRASE.match(v) is not None,
        "strong": _STRONG.match(v) is not None and not _urlish(v), "uuid": _UUID.match(v) is not None,
        "empty": EMPTY.search(v) is not None if form != "pem" else False, "lookup": (LOOKUP.search(v) is not None or _is_path(v)) if form != "pem" else False,
        "digest": _DIGEST.match(v) is not None, "slash": v[:1] in ("/", "."), "seed": re.fullmatch(r"(?=[A-Z]*\d)[A-Z0-9]{16,}=*", v) is not None,
        "pattern": _PATTERN.search(v) is not None, "url": _urlish(v) if form == "string" else False,
        "random": re.fullmatch(r"[A-Za-z0-9+/_=-]{16,}", v) is not None and _mixed(v),
        "secret_name": not placed and not other and SECRET_NAME.search(name) is not None or form == "query" and SECRET_NAME.search(name) is not None, "secret_near": SECRET_NAME.search(lead) is not None,
        "other_name": other, "other_near": form in ("comment", "string") and OTHER_NEAR.search(lead) is not None,
        "words": re.fullmatch(r"[A-Za-z]*(?:[-_. ][A-Za-z]+)*", v) is not None, "const": re.fullmatch(r"[A-Z][A-Z0-9_]*", v) is not None and not v.startswith(("AKIA", "ASIA")),
        "ident": re.fullmatch(r"[A-Za-z_]\w*", v) is not None and re.search(r"\d{3}", v) is None,
        "header": re.search(r"(?i)\bx-[\w-]+[\"']?\s*:\s*[\"']?$", lead) is not None, "host": host,
        "bare_row": form == "string" and re.search(r"[=:(]", lead) is None, "fallback": re.search(r"(?i)(?:\?\?|\|\||default\(|get\(|env\w*!?\()", lead) is not None,
        "arrow": re.search(r"(?i)(?:->|=>|\bis|\bwas|:|/|=|\bpw|\bkey)\s*$", lead) is not None, "kind": kind,
    }


_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\x00-\x7f]+")
_NOT_MARKS = re.compile(r"[\w ]+")
_PATH_PARTS = re.compile(r"[/._-]")
_KEY_MARK = re.compile(r"-----[^\n-]*-----")


def value_of(c: tuple, text: str) -> str:
    """What a candidate stands for: escapes undone, of a key block what is between its marks."""
    lo, hi, form, _, _ = c
    v = text[lo:hi]
    if form == "pem":
        return _KEY_MARK.sub("", v) or v
    return unescaped(v)[0] if "\\" in v and form not in ("bare", "comment") else v


def words_of(name: str, lead: str, path: str, kind: str) -> list[int]:
    """The buckets of the words around a candidate."""
    out, at = [], 0
    groups = (
        {w.lower() for w in _WORD.findall(name)}, {w.lower() for w in _WORD.findall(lead)[-8:]}, {_NOT_MARKS.sub("", lead)[-2:]},
        set(_PATH_PARTS.split(path.lower())[-4:]), {kind},
    )
    for n, group in zip(BUCKETS, groups):
        out += {at + zlib.crc32(w.encode("utf-8", "surrogatepass")) % n for w in group}
        at += n
    return out


def features(form: str, v: str, name: str, lead: str, chains: tuple[Chain, ...]) -> list[float]:
    """Numbers about a candidate: likelihoods, what it is made of, its place. chains: of each pair the ordinary, then the secret one."""
    n = max(1, len(v))
    word, near, shape = v.lower(), lead[-40:].lower(), v.translate(_SHAPE)
    plain, secret = chains[1].bits(shape), chains[2].bits(shape)
    by_name = chains[3].bits(name.lower()) - chains[4].bits(name.lower())
    by_lead = chains[5].bits(near) - chains[6].bits(near)
    lower = lambda x: max(-2.0, min(2.0, x))
    kinds = ["a" if ch.islower() else "A" if ch.isupper() else "0" if ch.isdigit() else "." for ch in v]
    return [
        1.0, *[float(form == k) for k in FORMS],
        chains[0].bits(word) / 8, plain / 8, secret / 8, (plain - secret) / 2, lower((plain - secret) * n / 60),
        by_name / 2, lower(by_name * len(name) / 20), by_lead / 2, lower(by_lead * len(near) / 40),
        min(n, 80) / 40, math.log(n) / 3, _entropy(v) / 5 if v else 0.0, kinds.count("0") / n, kinds.count("A") / n, sum(not ch.isalnum() for ch in v) / n,
        sum(p != q for p, q in zip(kinds, kinds[1:])) / n, float(" " in v),
    ]


def weak_label(f: dict) -> int | None:
    """1 or 0 where patterns are sure, None elsewhere."""
    good = f["known"] or f["phrase"] or f["strong"] or f["random"] or f["hex"] or f["seed"]
    if f["form"] == "pem":
        return 1
    if f["empty"] or f["lookup"] or f["digest"]:
        return 0
    if f["pattern"] or f["uuid"] or f["const"] and not f["seed"]:  # a password may look like these, under its name
        return None if f["secret_name"] and (f["strong"] or f["uuid"] or f["hex"]) else 0
    if f["known"] and not f["other_name"]:
        return 1
    if f["form"] in ("user", "auth", "cli", "sql"):
        return 1 if good else None
    if f["form"] == "query":
        return 1 if good and f["secret_name"] else None
    if f["url"] or f["words"] and not f["phrase"]:
        return 0
    if f["other_name"] or f["other_near"] and not f["secret_name"]:
        return 0
    if re.fullmatch(r"v?\d+(?:\.\d+)+", f["v"]):
        return 0
    if good and (f["secret_name"] or f["header"] or f["host"] or f["secret_near"] and f["arrow"] and f["form"] == "comment"):
        return 1
    if not good and not f["secret_name"] and not f["secret_near"]:
        return 0
    if f["bare_row"] or not (f["secret_name"] or f["secret_near"] or f["arrow"]):
        return 0 if not f["strong"] and not f["phrase"] else None
    return None


class Model:
    """Chains, weights and calibration, from labelled candidates."""

    def __init__(self, rows: list[tuple]):
        """rows: (part of the sample from 0 to 5, form, value, name, lead, path, kind, label) of labelled candidates."""
        first, rest = [r for r in rows if r[0] < 2], [r for r in rows if r[0] >= 2]
        of = lambda k, y, f: [f(r[k]) for r in first if r[7] == y]
        shape, low, near = lambda v: v.translate(_SHAPE), str.lower, lambda x: x[-40:].lower()
        ordinary = [w.lower() for r in first if not r[7] for w in re.findall(r"[A-Za-z][A-Za-z_-]{2,}", r[2] + " " + r[4])]
        self.chains = (Chain(ordinary), Chain(of(2, 0, shape)), Chain(of(2, 1, shape)), Chain(of(3, 0, low)), Chain(of(3, 1, low)), Chain(of(4, 0, near)), Chain(of(4, 1, near)))
        self.w: np.ndarray | None = None
        y = np.array([r[7] for r in rest], float)
        part = np.array([r[0] for r in rest])
        if not all(len(set(y[part == k])) == 2 for k in (2, 3)) or len(set(y[part > 3])) != 2 or len({r[7] for r in first}) != 2:
            return
        x = np.zeros((len(rest), len(FORMS) + 18 + sum(BUCKETS)))
        for i, (_, form, v, name, lead, path, kind, _) in enumerate(rest):
            f = features(form, v, name, lead, self.chains)
            x[i, : len(f)] = f
            x[i, [len(f) + j for j in words_of(name, lead, path, kind)]] = 1.0
        held = part == 2
        z = x[held] @ _fit(x[~held], y[~held])
        self.platt = _fit(np.c_[np.ones(len(z)), z], y[held], 1e-3)
        self.w = _fit(x, y)

    def score(self, form: str, v: str, name: str, lead: str, path: str, kind: str) -> float:
        f = features(form, v, name, lead, self.chains)
        n, w = len(f), self.w
        z = float(np.dot(f, w[:n])) + sum(float(w[n + j]) for j in words_of(name, lead, path, kind))
        return float(_sigmoid(self.platt[0] + self.platt[1] * z))

    def found(self, text: str, path: str, kind: str) -> list[tuple[int, int, str, float]]:
        """(start, end, form, score) of the credentials of a text."""
        out = []
        for c in candidates(text):
            f = facts(c, text, kind)
            if f["empty"] or f["lookup"] or f["digest"]:
                continue
            # a sample without both labels in each of its parts: patterns alone
            p = float(weak_label(f) == 1) if self.w is None else self.score(c[2], value_of(c, text), c[3], c[4], path, kind)
            if p >= 0.5:
                out.append((c[0], c[1], c[2], p))
        return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """Only the secrets replaced; of a key block the base64 runs, so that quotes and line ends around them stay."""
    out, at = [], 0
    for lo, hi, form, _ in spans:
        if lo < at:
            continue
        out.append(text[at:lo])
        out.append(_redact_block(text[lo:hi]) if form == "pem" else MASK)
        at = hi
    return "".join([*out, text[at:]])


def _redact_block(block: str) -> str:
    """A key block with its base64 masked: runs of 16 and more, and after one also shorter ones that stand alone."""
    began = False

    def mask(m: re.Match) -> str:
        nonlocal began
        run = m[2]
        if run is None:
            return m[0]
        before, after = block[m.start() - 1 : m.start()], block[m.end() : m.end() + 1]
        if "-" in (before, after):
            return run
        if len(run) >= 16 or began and (before in "\n\r\"'`" or re.search(r"\\[nr]$|\n[ \t>#*/]+$", block[max(0, m.start() - 20) : m.start()])) and after in "\n\r\"'`\\":
            began = True
            return MASK
        return run

    return _KEY_PART.sub(mask, block)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """record_kind, record_id, path, kind, text of all files and findings that have a text."""
    f = table(spark, folder, "files").select(F.lit("file").alias("record_kind"), F.col("file_id").alias("record_id"), "path", F.lit("").alias("kind"), F.col("content").alias("text"))
    s = table(spark, folder, "security_findings").select(
        F.lit("finding").alias("record_kind"), F.col("finding_id").alias("record_id"), F.col("file_path").alias("path"), F.lower(F.regexp_replace(F.coalesce("kind", F.lit("")), "[- ]", "_")).alias("kind"), F.col("snippet").alias("text")
    )
    return f.unionAll(s).where("text <> ''")


def labelled(rk: str, rid: int, path: str | None, kind: str, text: str) -> list[tuple]:
    """The candidates of a record that patterns are sure about; the part of the sample goes by the record."""
    part = zlib.crc32(f"{rk}{rid}".encode()) % 6
    got = ((c, weak_label(facts(c, text, kind))) for c in candidates(text))
    return [(rk, rid, c[0], part, c[2], value_of(c, text), c[3], c[4], path or "", kind, y) for c, y in got if y is not None]


def fit(rows: DataFrame, size: int = SAMPLE) -> Model:
    """A model on `size` records of each kind, those whose ids have the lowest hashes.

    Whole texts are searched, in the executors; only labelled candidates come to the driver, not texts.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                out += labelled(*row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _LABELLED.values())], names=list(_LABELLED))

    got = set()
    for kind in ("file", "finding"):
        of = rows.where(F.col("record_kind") == kind)
        ids = of.select("record_id").distinct().orderBy(F.xxhash64("record_id"), "record_id").limit(size)
        own = of.join(F.broadcast(ids), "record_id").select("record_kind", "record_id", "path", "kind", "text")
        got |= {tuple(r) for r in own.mapInArrow(label, _LABELLED_SHAPE).collect()}
    return Model([r[3:] for r in sorted(got)])


_LABELLED = {"rk": pa.string(), "rid": pa.int64(), "lo": pa.int64(), "part": pa.int64(), "form": pa.string(), "v": pa.string(), "name": pa.string(), "lead": pa.string(), "path": pa.string(), "kind": pa.string(), "y": pa.int64()}
_LABELLED_SHAPE = "rk string, rid long, lo long, part long, form string, v string, name string, lead string, path string, kind string, y long"


def scan(rows: DataFrame, model: Model) -> DataFrame:
    """record_kind, record_id, line_no, form, score: one row for a line with a credential. No text is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rk, rid, path, kind, text in zip(*(c.to_pylist() for c in b.columns)):
                seen = set()
                for lo, _, form, p in model.found(text, path or "", kind):
                    line = text.count("\n", 0, begins(text, lo)) + 1 if rk == "file" else 1
                    if line not in seen:
                        seen.add(line)
                        out.append((rk, rid, line, form, round(p, 6)))
            if out:
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["record_kind", "record_id", "line_no", "form", "score"])

    return rows.select("record_kind", "record_id", "path", "kind", "text").mapInArrow(run, "record_kind string, record_id long, line_no int, form string, score double")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """record_kind, record_id, line_no of each line on which a usable credential begins.

    Null and empty texts give no row; repeated rows count once; a table without any candidate gives an empty result.
    """
    rows = records(spark, folder)
    return scan(rows, fit(rows)).select("record_kind", "record_id", "line_no").distinct()


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """record_kind, record_id, n_secrets and text of the records that hold credentials, with only those replaced."""
    rows = records(spark, folder)
    model = fit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rk, rid, path, kind, text in zip(*(c.to_pylist() for c in b.columns)):
                hits = model.found(text, path or "", kind)
                if hits:
                    out.append((rk, rid, len(hits), redact(text, hits)))
            if out:
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["record_kind", "record_id", "n_secrets", "text"])

    found = rows.select("record_kind", "record_id", "path", "kind", "text").mapInArrow(run, "record_kind string, record_id long, n_secrets long, text string")
    return found.dropDuplicates(["record_kind", "record_id"])
