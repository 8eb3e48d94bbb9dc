"""Sentences of texts in any script, as code point offsets.

A text is cut into blocks first: a heading line, a fenced code block and the first line of a commit are one sentence each; a
list item begins one; blank lines end one. In a block the Sentence_Break properties of the Unicode character database decide:
which marks end a sentence in any script (STerm, ATerm), which close a quotation or bracket (Close), which marks say that it
goes on (SContinue). Abbreviations of the document's language suppress a break, and nothing breaks inside a quotation or
bracket that stands in a larger sentence.

The language of a document is its label, in whatever spelling. Where that is missing, or the common words of the text speak
clearly for another language of the same script, those words decide; where they say nothing either, the abbreviations of all
languages hold. Abbreviations in other scripts than Latin cannot be mistaken and always hold.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.sources.tables import table

# Character properties, from the character database.
_ALL = "".join(chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)


def _having(what: str) -> str:
    return "".join(regex.findall(rf"[{what}]", _ALL))


_STERM = _having(r"\p{Sentence_Break=STerm}")
_FULL = _having(r"\p{Sentence_Break=ATerm}")
_DOTS = _FULL + "…‥"
_OPENING = frozenset(_having(r"\p{Ps}"))
_CLOSE = frozenset(_having(r"\p{Sentence_Break=Close}")) - _OPENING
_GOES_ON = frozenset(_having(r"\p{Sentence_Break=SContinue}")) - {"-"}
#: Full-width and ideographic marks, after which no space stands.
_WIDE = "".join(c for c in _STERM + _FULL if unicodedata.east_asian_width(c) in "WFH" or c == "﹒")
del _ALL


def _pairs() -> dict[str, str]:
    """Opening marks and what closes them: brackets by their names, quotation marks as languages use them."""
    out = {}
    for c in _OPENING:
        name = unicodedata.name(c, "")
        for a, b in (("LEFT", "RIGHT"), ("OPENING", "CLOSING"), ("GUG RTAGS GYON", "GUG RTAGS GYAS"), ("ANG KHANG GYON", "ANG KHANG GYAS")):
            try:
                if a in name:
                    out[c] = unicodedata.lookup(name.replace(a, b))
            except KeyError:
                pass
    return out | {"“": "”", "„": "“”", "«": "»", "‹": "›", "‘": "’", "‚": "‘’"}


_OPEN = _pairs()
_ROUND = "([（［【"

# Abbreviations by language (fixed values). The first group never ends a sentence, the second only stands before a number,
# the third may end one before a capital.
NEVER = {
    "en": "mr mrs ms dr prof messrs e.g i.e cf approx avg dept vs viz resp incl excl Mon Tue Tues Wed Thu Thur Thurs Fri Jan Feb Apr Jun Jul Aug Sept Oct Nov Dec",
    "de": "z b d h i r u a ca bzw ggf evtl inkl exkl vgl Hr Fr Mo Di Mi Do Sa Nr Abb Abs Bd Tel Str Mio Mrd max min mind sog o ä s Kap Tab geb Jh zzgl",
    "fr": "m mm mme mlle mm env p pp ex chap fig cf av apr vol réf tél éd c.-à-d",
    "es": "sr sra srta sres dr dra d dña ud uds ee uu pág págs aprox núm ej p cap fig tel av máx mín vol",
    "ru": "т е г гг рис стр см ср тыс млн млрд руб напр им ул табл гл вып ред н э проф акад сек мин ч коп кв",
    "hi": "उदा डॉ श्री सं पृ क्र रु ई प्रो कृ",
    "ar": "ص د م أ ق هـ ج ط ت",
    "th": "พ.ศ ค.ศ น ดร ต.ค ม.ค ก.พ มี.ค เม.ย พ.ค มิ.ย ก.ค ส.ค ก.ย พ.ย ธ.ค รศ ผศ ศ",
}
NUMBERED = set("no nos p pp fig figs art arts sec secs ch chap vol ref eq nr pos line ln par abs bd kap ziff №".split())
MAY_END = set("etc usw a.m p.m al др д п т.д т.п т.п. u.s ff bzw etc..".split())
#: Common words (fixed values) that tell the languages of Latin script apart, and other spellings of the labels.
COMMON = {
    "en": "the of and to in is it that for was with as on be at by this are or not from but then he she they we has one",
    "de": "der die das und ist nicht ein eine mit für auf den von zu im des dem wird sich auch nach bei aus",
    "fr": "le la les des et est dans pour une un que qui sur pas du au ce il elle avec ne",
    "es": "el la los las y es en que un una por con para no se del lo su al como",
}
LABELS = {"eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "fra": "fr", "fre": "fr", "french": "fr", "spa": "es", "spanish": "es"}
_COMMON = {w: [k for k, v in COMMON.items() if w in v.split()] for v in COMMON.values() for w in v.split()}


class Rules:
    """What of abbreviations holds in a text: those never at an end, and whether a number with a full stop may be an ordinal."""

    def __init__(self, langs: tuple[str, ...]):
        words = [w for k, v in NEVER.items() if k in langs or k not in COMMON for w in v.split()]
        self.never, self.ordinals = frozenset(words), "de" in langs
        self.lower = frozenset(w for w in words if w == w.lower())


_RULES = {k: Rules((k,)) for k in COMMON} | {"": Rules(tuple(COMMON))}


def language_of(text: str, label: str | None) -> str:
    """en, de, fr, es, or '' where nothing speaks for one of them; texts in other scripts count as en."""
    code = re.split(r"[-_\s]", (label or "").strip().lower())[0]
    code = LABELS.get(code, code)
    n = dict.fromkeys(COMMON, 0)
    for w in filter(_COMMON.__contains__, text.lower().split()):
        for k in _COMMON[w]:
            n[k] += 1
    order = sorted(n, key=lambda k: -n[k])
    seen = order[0] if n[order[0]] >= n[order[1]] + 2 else ""
    if code in COMMON:
        return seen if seen and n[seen] >= 2 * n[code] + 3 else code
    return seen or ("en" if code else "")


_UNITS = set("s h m d g l t".split())
_DETERMINERS = set("der die das dem den des am vom zum zur im beim ab bis seit ein einen einem einer jeder jedem ihr sein kein".split())

_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|\r?$)")
_ITEM = re.compile(r"[ \t]*(?:([-*+•‣◦])|(\d{1,9})[.)])[ \t]+(?=\S)")
_MARK = re.compile(f"[{re.escape(_STERM)}]+[{re.escape(_STERM + _DOTS)}]*|[{re.escape(_DOTS)}]+[{re.escape(_STERM + _DOTS)}]*")
_THAI = re.compile(r"(?<=[\u0e01-\u0e3a\u0e40-\u0e4e])\s+(?=[\u0e01-\u0e3a\u0e40-\u0e4e])")
_CODE = re.compile(r"[^\s]*(?:[_/()=\\`]|[a-z][A-Z]|\w[.:]\w|\w\d)[^\s]*")


def blocks(text: str, commit: bool) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole): runs of text; whole ones are one sentence."""
    pos, run, fence, number, first = 0, None, "", -1, commit
    for line in text.splitlines(keepends=True) if "\x0b" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
        lo, pos = pos, pos + len(line)
        if fence:
            m = _FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line[m.end() :].strip():
                yield run, pos, True
                run, fence = None, ""
            continue
        if not line.strip():
            if run is not None:
                yield run, lo, False
            run, number = None, -1
            continue
        if first:
            first = False
            yield lo, pos, True
            continue
        m = _FENCE.match(line)
        if m:
            if run is not None:
                yield run, lo, False
            run, fence, number = lo, m[1], -1
            continue
        if _HEADING.match(line):
            if run is not None:
                yield run, lo, False
            yield lo, pos, True
            run, number = None, -1
            continue
        m = _ITEM.match(line)
        if m and (m[1] or run is None or int(m[2]) == 1 or int(m[2]) == number + 1 and number >= 0):
            if run is not None:
                yield run, lo, False
            run = lo
            number = int(m[2]) if m[2] else 0
            continue
        if run is None:
            run = lo
    if run is not None:
        yield run, len(text), bool(fence)


def _enclosed(s: str) -> list[tuple[int, int]]:
    """Spans of quotations and brackets that close again."""
    out, stack = [], []
    straight = [i for i, ch in enumerate(s) if ch == '"']
    if len(straight) % 2 == 0:
        out += [(a, b) for a, b in zip(straight[::2], straight[1::2])]
    for i, ch in enumerate(s):
        if stack and ch in stack[-1][1]:
            if ch not in "’" or not (i + 1 < len(s) and s[i + 1].isalpha() and s[i - 1].isalpha()):
                out.append((stack.pop()[0], i))
        elif ch in _OPEN and not (ch in "‘" and i and s[i - 1].isalnum()):
            stack.append((i, _OPEN[ch]))
    return out


def _breaks(s: str, rules: Rules) -> list[int]:
    """Offsets where a sentence of a block ends (without the last)."""
    spans = _enclosed(s)
    cuts: list[int] = []
    begin = re.match(_ITEM, s)
    start = begin.end() if begin else 0
    thai = [m.start() for m in _THAI.finditer(s)]
    marks = list(_MARK.finditer(s, start))
    inside = lambda i: [(a, b) for a, b in spans if a < i < b]
    events = sorted([(m.start(), m.end(), m.group()) for m in marks] + [(t, t, " ") for t in thai])
    last = start
    for lo, hi, mark in events:
        if lo < last:
            continue
        if mark == " ":
            if not inside(lo):
                cuts.append(lo)
                last = lo
            continue
        end = hi
        around = inside(lo)
        # closing marks belong to the sentence
        while end < len(s) and s[end] in _CLOSE and (any(b == end for _, b in spans) or not _opens(s, end, spans)):
            end += 1
        still = [(a, b) for a, b in around if b >= end]
        if still:
            continue
        closed = [(a, b) for a, b in around if b < end]
        rest = s[end:]
        nxt = rest.lstrip()
        if not nxt:
            break
        gap = len(rest) != len(nxt)
        if _ends(s, lo, mark, nxt, gap, closed, last, rules):
            cuts.append(end)
            last = end
    return cuts


def _opens(s: str, i: int, spans: list[tuple[int, int]]) -> bool:
    return any(a == i for a, _ in spans) or s[i] in "\"'" and (i == 0 or s[i - 1].isspace())


def _wide(ch: str) -> bool:
    return unicodedata.east_asian_width(ch) in "WF"


def _ends(s: str, lo: int, mark: str, nxt: str, gap: bool, closed: list, last: int, rules: Rules) -> bool:
    ch = nxt[0]
    wide = any(m in _WIDE for m in mark)
    if closed:
        first = min(a for a, _ in closed)
        alone = not s[last:first].strip()
        if s[first] in _ROUND and alone:
            return True  # a bracket that is a sentence of its own
        if s[first] in _ROUND:
            return False if not gap or not _starts(nxt) else ch.isupper()
        # a quotation: the sentence goes on unless something new clearly begins
        if not gap:
            return False
        return ch.isupper() or ch in "\"“„«¿¡(" or ch.isdigit() and alone or _CODE.match(nxt) is not None and ch.islower() and alone
    if wide:
        return True
    if not gap:
        return mark[-1] in _STERM and mark[-1] not in "!?" or mark[-1] in "!?" and _wide(ch)
    if set(mark) <= set(_DOTS) and (len(mark) > 1 or mark in "…‥"):
        return ch.isupper() or ch in "\"“„«¿¡" and nxt[1:2].isupper() or ch.islower() and _CODE.match(nxt) is not None and not _plain_hyphen(nxt)
    if mark[-1] in _STERM:
        return ch not in _GOES_ON
    # a single full stop
    if ch in _GOES_ON or ch == ")" or ch == "-" and nxt[1:2] == " ":
        return False
    word = re.search(r"[^\s(\[{\"“„«»“'’/]*$", s[max(last, lo - 40) : lo])[0]
    if _suppressed(s, lo, word, nxt, rules):
        return False
    if ch.islower():
        return _CODE.match(nxt) is not None and not _plain_hyphen(nxt)
    return True


def _plain_hyphen(nxt: str) -> bool:
    return re.match(r"[a-zà-ÿ]+-[a-zà-ÿ-]+(?:\s|$)", nxt) is not None


def _starts(nxt: str) -> bool:
    return nxt[0].isupper() or nxt[0] in "\"“„«¿¡("


def _suppressed(s: str, lo: int, word: str, nxt: str, rules: Rules) -> bool:
    """Whether the full stop after word belongs to an abbreviation or ordinal."""
    low = word.lower()
    ch = nxt[0]
    before = s[:lo - len(word)].rstrip()
    if not word:
        return False
    if low in MAY_END or word in MAY_END:
        if low in ("д", "п") and not re.search(r"т\.$", before):
            return True
        return not (ch.isupper() or ch in "\"“„«¿¡(" or unicodedata.category(ch) == "Lo" or ch.islower() and _CODE.match(nxt) is not None and low not in ("a.m", "p.m"))
    if low in _UNITS and re.search(r"\d$", before):
        return False
    if "\u0e00" <= word[-1] <= "\u0e7f":  # no spaces before it, so the run ends with it
        return any(word.endswith(w) for w in NEVER["th"].split())
    if word in rules.never or low in rules.never:
        if len(low) == 1 and low.isascii() and word.islower() and re.search(r"\d$", before):
            return False
        if word[:1].islower() and low not in rules.lower and word not in rules.never:
            return False
        return True
    if low in NUMBERED:
        return ch.isdigit()
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word):
        return not ch.isupper() or len(word) <= 3
    if len(word) == 1 and word.isupper() and ch.isupper() and word.isascii():
        return True
    if rules.ordinals and word.isdigit() and len(word) <= 2 and ch.isupper():
        prev = re.search(r"(\w+)$", before)
        return prev is not None and prev[1].lower() in _DETERMINERS
    return False


def sentences(text: str, commit: bool = False, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence of a text; lang: its label."""
    out, rules = [], _RULES[language_of(text, lang)]
    for lo, hi, whole in blocks(text, commit):
        s = text[lo:hi]
        at = 0
        for cut in [*([] if whole else _breaks(s, rules)), len(s)]:
            part = s[at:cut]
            body = part.strip()
            if body:
                a = lo + at + len(part) - len(part.lstrip())
                out.append((a, a + len(body)))
            at = cut
    return out


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start_char, end_char of every sentence of every document.

    Null, empty and blank texts give no rows. Each document stays in its scan task; there is no shuffle.
    """
    d = table(spark, folder, "documents").select("doc_id", "text", "lang", F.lower(F.trim(F.regexp_replace("source", r"^\s+|\s+$", ""))).alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, los, his = [], [], []
            for i, t, lang, src in zip(*(c.to_pylist() for c in b.columns)):
                for lo, hi in sentences(t, src == "commit_message", lang):
                    ids.append(i)
                    los.append(lo)
                    his.append(hi)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, los, his)], names=["doc_id", "start_char", "end_char"])

    return d.where("text <> ''").mapInArrow(run, "doc_id long, start_char long, end_char long")
