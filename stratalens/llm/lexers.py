"""Texts to strings of terminal codes, one character a token, for the grammars of this package.

A language is one regular expression, applied in one call for a whole text, and a table from token text to code that fills
itself. A token that is none of the language's (an open string, a stray character, a bad number or escape) gets the code
NOTHING, which no rule takes.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable

from stratalens.llm import grammars
from stratalens.llm.chart import NOTHING, Chart, Grammar

#: Token texts a table remembers.
REMEMBERED = 100_000


class Table(dict):
    """Codes by token text."""

    def __init__(self, make: Callable[[str], str]):
        super().__init__()
        self.make = make

    def __missing__(self, tok: str) -> str:
        if len(self) > REMEMBERED:
            self.clear()
        c = self.make(tok)
        if len(tok) < 80:
            self[tok] = c
        return c


class Language:
    """Lexer and chart of one language. codes(text) gives its terminals."""

    semi = newline = ""
    #: Codes of indentation, and of all that the end of a text supplies.
    layout = trail = frozenset()

    def __init__(self, name: str, grammar: str):
        self.name = name
        self.grammar = Grammar(grammar, "file")
        self.known = dict(self.grammar.codes)
        self.c = lambda t: self.known.get(t, NOTHING)
        self.chart = Chart(self.grammar)
        self.table = Table(self.make)
        rx = re.compile(self.pattern())
        self.find, self.scan = rx.findall, rx.finditer

    def pattern(self) -> str:
        raise NotImplementedError

    def make(self, tok: str) -> str:
        raise NotImplementedError

    def codes(self, text: str) -> str:
        return "".join(map(self.table.__getitem__, self.find(text)))

    def run(self, codes: str, into: list | None = None) -> int:
        return self.chart.run(codes, self.semi, self.newline, into)

    def placed(self, text: str) -> tuple[str, list[int]]:
        """The codes of a text, and the offset each comes from."""
        out, at = [], []
        for m in self.scan(text):
            c = self.table[m.group(1)]
            out.append(c)
            at += [m.start(1)] * len(c)
        return "".join(out), at


def _groups(*alts: str) -> str:
    return "|".join(alts)


_ID = r"[^\W\d]\w*"


class Json(Language):
    def pattern(self) -> str:
        return r'[ \t\r\n]*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[A-Za-z]+|[\s\S])'

    def make(self, tok: str) -> str:
        if tok in "{}[]:,":
            return self.c(tok)
        if tok[0] == '"' and len(tok) > 1:
            return self.c("STR")
        if tok in ("true", "false", "null"):
            return self.c(tok)
        if tok[0] in "-0123456789" and tok[-1].isdigit():
            return self.c("NUM")
        return "" if tok in " \t\r\n" else NOTHING


def _classes(text: str) -> dict[str, str]:
    out = {}
    for line in text.strip().splitlines():
        name, *words = line.split()
        out.update(dict.fromkeys(words, name))
    return out


class CLike(Language):
    """What Go, Java, TypeScript, JavaScript and Rust have in common."""

    words: dict[str, str] = {}
    ops: dict[str, str] = {}
    number = re.compile(r"(?!)")
    escape = re.compile(r"(?!)")

    def make(self, tok: str) -> str:
        a = tok[0]
        if a.isalpha() or a in "_$":
            w = self.words.get(tok, tok)
            return self.known.get(w) or self.c("ID")
        if a.isdigit() or a == "." and tok[1:2].isdigit():
            return self.c("LIT") if self.number.fullmatch(tok) else NOTHING
        if a == "\n":
            return self.newline
        if tok.startswith(("//", "/*")) and len(tok) > 1:
            if tok == "/*":
                return NOTHING
            return self.newline if "\n" in tok else ""
        if tok in " \t\r\f\v ﻿":
            return ""
        if a in "\"'`":
            return self.quoted(tok)
        if tok == "{%":  # the tag of a template
            return NOTHING
        return self.c(self.ops.get(tok, tok))

    def quoted(self, tok: str) -> str:
        if len(tok) < 2:
            return NOTHING
        if "\\" in tok and self.escape.search(tok):
            return NOTHING
        return self.c("STR")


class Go(CLike):
    words = {}
    ops = _classes("""
ASSIGN += -= *= /= %= &= |= ^= <<= >>= &^=
INC ++ --
BIN || && == != < <= > >= / % << >> &^
UN + - ^ &
""")
    number = re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])*(?:\.(?:_?[0-9a-fA-F])*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO]?(?:_?[0-7])+|\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d+)?|\.\d(?:_?\d)*(?:[eE][+-]?\d+)?)i?")
    escape = re.compile(r"""^["'](?:[^\\]|\\(?:[abfnrtv\\'"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*(?:\\(?![abfnrtv\\'"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))""")

    def __init__(self):
        super().__init__("go", grammars.GO)
        self.newline = "\n"
        k = self.known
        ends = "".join(k[x] for x in ("ID", "LIT", "STR", "INC", "break", "continue", "fallthrough", "return")) + "".join(k[x] for x in ")]}")
        self.last = frozenset(ends)
        self.supply = re.compile(f"(?<=[{re.escape(ends)}])\n+")

    def pattern(self) -> str:
        return r"[ \t\r]*(" + _groups(
            r"\n\s*", _ID, r"\.?\d(?:[eEpP][+-]|[\w.])*", r'"(?:[^"\\\n]|\\.)*"', r"`[^`]*`", r"'(?:[^'\\\n]|\\[^\n](?:[0-9a-fA-F]{0,8}))'",
            r"//[^\n]*", r"/\*[\s\S]*?\*/", r"/\*", r"\{%", r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|[-+*/%&|^<>=!:]=|<<|>>|&\^", r"[\s\S]",
        ) + ")"

    def make(self, tok: str) -> str:
        if tok == "+" or tok == "-" or tok == "^" or tok == "&":
            return self.c("UN")
        if tok[0] == "`":
            return self.c("STR") if len(tok) > 1 else NOTHING
        if tok[0] == "'":
            return self.c("LIT") if len(tok) > 2 and not ("\\" in tok and self.escape.search(tok)) else NOTHING
        if tok == "$":
            return NOTHING
        return super().make(tok)

    def codes(self, text: str) -> str:
        raw = super().codes(text) + "\n"
        return self.supply.sub(self.c(";"), raw).replace("\n", "")

    def placed(self, text: str) -> tuple[str, list[int]]:
        raw, at = super().placed(text)
        out, where = [], []
        before = ""
        for c, i in zip(raw + "\n", [*at, len(text)]):
            if c != "\n" or before in self.last:
                out.append(c if c != "\n" else self.c(";"))
                where.append(i)
            before = c
        return "".join(out), where


class Java(CLike):
    words = _classes("""
MOD public protected private abstract native transient volatile strictfp
PRIM int long short byte char boolean float double
LIT true false null
ID goto_
""")
    ops = _classes("""
ASSIGN += -= *= /= %= &= |= ^= <<=
INC ++ --
BIN || && == != <= / % << ^
UN ! ~
""")
    number = re.compile(r"0[xX](?:[0-9a-fA-F](?:[\da-fA-F_]*[\da-fA-F])?)?(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|\d(?:[\d_]*\d)?(?:\.(?:\d(?:[\d_]*\d)?)?)?(?:[eE][+-]?\d+)?[lLfFdD]?|\.\d(?:[\d_]*\d)?(?:[eE][+-]?\d+)?[fFdD]?")
    escape = re.compile(r"""^["'](?:[^\\]|\\(?:[btnfrs0-7"'\\\n]|u+[0-9a-fA-F]{4}))*\\(?![btnfrs0-7"'\\\n]|u+[0-9a-fA-F]{4})""")

    def __init__(self):
        super().__init__("java", grammars.JAVA)

    def pattern(self) -> str:
        return r"\s*(" + _groups(
            r"(?:[^\W\d]|\$)[\w$]*", r"\.?\d(?:[eEpP][+-](?=\d)|[\w.])*", r'"""[ \t]*\r?\n(?:[^\\]|\\[\s\S])*?"""', r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\[^\n](?:[0-9a-fA-Fu]{0,8}))'",
            r"//[^\n]*", r"/\*[\s\S]*?\*/", r"/\*", r"\{%", r"\.\.\.|->|::|<<=|&&|\|\||\+\+|--|[-+*/%&|^<>=!]=|<<", r"[\s\S]",
        ) + ")"

    def make(self, tok: str) -> str:
        if tok[0] == "'":
            return self.c("LIT") if len(tok) > 2 and not ("\\" in tok and self.escape.search(tok)) else NOTHING
        if tok[:1].isspace() or tok.startswith(("//", "/*")) and tok != "/*":
            return ""
        if tok in ("#", "`", "\\"):
            return NOTHING
        if tok == "const" or tok == "goto" or tok == "_":
            return NOTHING if tok != "_" else self.c("ID")
        return super().make(tok)


class TypeScript(CLike):
    words = _classes("""
LIT true false
WORD with
CTX let_
TSACC public private protected override
NEVERWORD enum_
""")
    ops = _classes("""
ASSIGN += -= *= /= %= &= |= ^= <<= **= &&= ||= ??=
INC ++ --
BIN || && ?? == != === !== <= / % << ^ **
UN ~
""")
    number = re.compile(r"(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*|0[bB][01](?:_?[01])*|0[oO][0-7](?:_?[0-7])*|(?:0|[1-9](?:_?\d)*))n?|(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d+)?|\.\d(?:_?\d)*(?:[eE][+-]?\d+)?")
    escape = re.compile(r"""^["'](?:[^\\]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|[^xu]))*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{))""")
    typed = True

    def __init__(self):
        super().__init__("typescript" if self.typed else "javascript", grammars.TYPESCRIPT if self.typed else grammars.JAVASCRIPT)
        self.semi, self.newline = self.c(";"), "\n"
        k = self.known
        stop = "".join(k[x] for x in ("return", "break", "continue", "throw", "yield") if x in k)
        self.ends = re.compile(f"(?<=[{stop}])\n+")
        operand = "".join(re.escape(k[x]) for x in ("ID", "CTX", "LIT", "STR", "this", ")", "]"))
        self.incs = re.compile(f"(?<=[{operand}])\n+(?={k['INC']})")

    def pattern(self) -> str:
        sub = r"\$\{(?:[^{}`\"'/]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|/|\{(?:[^{}`]|`(?:[^`\\]|\\[\s\S])*`|\{[^{}]*\})*\})*\}"
        rx = r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
        return r"[^\S\n]*(" + _groups(
            r"\n\s*", r"(?:return|typeof|case|in|of|void|delete|throw|await|yield)[ \t]*" + rx, r"#?(?:[^\W\d]|\$)[\w$]*", r"\.?\d(?:[eE][+-](?=\d)|[\w.])*",
            r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'", r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|" + sub + r")*`",
            r"//[^\n]*", r"/\*[\s\S]*?\*/", r"/\*", r"(?:=>|&&|\|\||\?\?|[-(,=:\[!&|?{};+*%~^<>])[^\S\n]*" + rx, r"\A\s*" + rx + r"|(?<=\n)" + rx, r"\{%",
            r"\.\.\.|=>|\?\.(?!\d)|===|!==|<<=|\*\*=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\*\*|\+\+|--|[-+*/%&|^<>=!]=|<<", r"[\s\S]",
        ) + ")"

    def make(self, tok: str) -> str:
        if tok[0] == "#":
            return self.c("PRIVATE") if len(tok) > 1 else NOTHING
        if "/" in tok and tok[-1] not in "\"'`" and (m := re.fullmatch(r"(return|typeof|case|in|of|void|delete|throw|await|yield|=>|&&|\|\||\?\?|[-(,=:\[!&|?{};+*%~^<>])?\s*(/(?![*/=]?$)(?![*/]).+)", tok)) and "\n" not in tok:
            if re.fullmatch(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[dgimsuvy]*", m[2]):
                return (self.table[m[1]] if m[1] else "") + self.c("REGEX")
        if tok[0] == "`":
            if len(tok) < 2:
                return NOTHING
            for part in self.parts(tok):
                inner = self.codes(part)
                if not inner.strip("\n") or self.chart.run(self.c("(") + inner + self.c(")") + self.semi, self.semi, self.newline) >= 0:
                    return NOTHING
            return self.c("TEMPLATE")
        if tok in ("@", "\\"):
            return self.c(tok) if tok == "@" else NOTHING
        if tok in ("public", "private", "protected", "override") and not self.typed:
            return self.c("CTX")
        return super().make(tok)

    @staticmethod
    def parts(tok: str) -> list[str]:
        out, i = [], 1
        while (i := tok.find("${", i)) >= 0:
            k = i - 1
            while tok[k] == "\\":
                k -= 1
            if (i - 1 - k) % 2:
                i += 2
                continue
            depth, j, quote = 1, i + 2, ""
            while j < len(tok) and depth:
                ch = tok[j]
                if quote:
                    j += ch == "\\"
                    quote = "" if ch == quote else quote
                elif ch in "\"'`":
                    quote = ch
                elif ch in "{}":
                    depth += 1 if ch == "{" else -1
                j += 1
            out.append(tok[i + 2 : j - 1])
            i = j
        return out

    def codes(self, text: str) -> str:
        raw = super().codes(text)
        return self.incs.sub(self.semi, self.ends.sub(self.semi, raw)) if "\n" in raw else raw

    def placed(self, text: str) -> tuple[str, list[int]]:
        raw, at = super().placed(text)
        for rx in (self.ends, self.incs):
            out, where, i = [], [], 0
            for m in rx.finditer(raw):
                out += [raw[i : m.start()], self.semi]
                where += [*at[i : m.start()], at[m.start()]]
                i = m.end()
            raw, at = "".join([*out, raw[i:]]), [*where, *at[i:]]
        return raw, at


class JavaScript(TypeScript):
    typed = False


class Rust(CLike):
    words = _classes("LIT true false")
    ops = _classes("""
ASSIGN += -= *= /= %= &= |= ^=
BIN == != / % ^ +_
""")
    number = re.compile(r"(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*)(?:[ui](?:8|16|32|64|128|size))?|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:f32|f64)?|\d[\d_]*\.")
    escape = re.compile(r"""^b?["'](?:[^\\]|\\(?:[nrt0"'\\\n\r]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))*\\(?![nrt0"'\\\n\r]|x[0-9a-fA-F]{2}|u\{)""")

    def __init__(self):
        super().__init__("rust", grammars.RUST)

    def pattern(self) -> str:
        return r"\s*(" + _groups(
            r"[bc]?r(?P<h>#*)\"[\s\S]*?\"(?P=h)", r"[bc]?\"(?:[^\"\\]|\\[\s\S])*\"", r"b?'(?:[^'\\\n]|\\(?:u\{[^}\n]*\}|x..|.))'", r"'(?:[^\W\d]\w*)", r"r#[^\W\d]\w*", _ID,
            r"\d[\d_]*\.(?![.\w])|\d[\d_]*\.\d(?:[eE][+-](?=\d)|\w)*|\d(?:[eE][+-](?=\d)|\w)*",
            r"//[^\n]*", r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/", r"/\*",
            r"\.\.\.|\.\.=|\.\.|->|=>|::|&&|\|\||[-+*/%&|^<>=!]=", r"[\s\S]",
        ) + ")"

    def placed(self, text: str) -> tuple[str, list[int]]:
        """As codes() gives them, but a line that is the tag of a template is one stray token, though a token tree could hold it."""
        return super().placed(re.sub(r"(?m)^[ \t]*\{%[^\n{}]*%\}[ \t\r]*$", lambda m: "\\".ljust(len(m[0])), text))

    def find_all(self, text: str) -> list[str]:
        return [a[0] for a in self.find(text)]

    def codes(self, text: str) -> str:
        return "".join(map(self.table.__getitem__, self.find_all(text)))

    def make(self, tok: str) -> str:
        if tok.startswith(("//", "/*")) and tok != "/*" or tok.isspace():
            return ""
        if tok.startswith("'") and not tok.endswith("'") or tok == "'_":
            return self.c("LIFE") if len(tok) > 1 else NOTHING
        if tok[0] == "'":
            return self.c("LIT") if len(tok) > 2 and not self.escape.search(tok) else NOTHING
        if tok[-1] in "\"'#" and len(tok) > 2 and tok[0] in "bcr\"":
            if tok[0] in "b\"c" and tok[:2] not in ("br", "cr") and "\\" in tok and self.escape.search(tok.lstrip("c")):
                return NOTHING
            return self.c("STR")
        if tok == '""':
            return self.c("STR")
        if tok.startswith("r#"):
            return self.c("ID")
        if tok in ("`", "\\", "$", '"', "'") or tok == "abstract":
            return self.c("ANY") if tok == "$" else NOTHING
        if tok == "_":
            return self.c("_")
        return super().make(tok)


_ESCAPE = re.compile(r"\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|N\{[^}]*\}|[\s\S])")
_FSKIP = re.compile(r"""[rRbBuUfF]{0,2}(?:\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')""")


def _named(name: str) -> bool:
    try:
        unicodedata.lookup(name)
    except KeyError:
        return False
    return True


class Python(Language):
    words = _classes("LIT True False None")
    ops = _classes("""
AUG += -= *= /= //= %= @= &= |= ^= >>= <<= **=
BIN + // % & | ^ << >> < > <= >= == !=
UN ~
DOTS .
""")
    number = re.compile(r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:0(?:_?0)*|[1-9](?:_?\d)*)|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ])")

    def __init__(self):
        super().__init__("python", grammars.PYTHON)
        self.layout = frozenset([self.c("INDENT"), self.c("DEDENT")])
        self.trail = self.layout | {self.c("NEWLINE")}

    def pattern(self) -> str:
        q = r"[rRbBuUfF]{0,2}"
        return r"(?:[ \t\f]|\\\r?\n)*(" + _groups(
            r"\r?\n(?:[ \t\f]*(?:#[^\n]*)?\r?\n)*[ \t\f]*(?:#[^\n]*\Z)?", q + r'"""(?:[^\\]|\\[\s\S])*?"""', q + r"'''(?:[^\\]|\\[\s\S])*?'''", q + r'"(?!"")(?:[^"\\\n]|\\[\s\S])*"', q + r"'(?!'')(?:[^'\\\n]|\\[\s\S])*'",
            _ID, r"\.?\d(?:[eE][+-](?=\d)|[\w.])*", r"#[^\n]*", r"\{%", r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|[-+*/%@&|^<>=!]=", r"[\s\S]",
        ) + ")"

    def make(self, tok: str) -> str:
        a = tok[0]
        if tok[-1] in "\"'" and len(tok) > 1 and a != "#":
            return self.string(tok)
        if a.isalpha() or a == "_":
            w = self.words.get(tok, tok)
            return self.known.get(w) or self.c("ID")
        if a.isdigit() or a == "." and tok[1:2].isdigit():
            return self.c("LIT") if self.number.fullmatch(tok) else NOTHING
        if a in "\r\n" and "\n" in tok:
            return "\n"
        if a == "#" or tok in " \t\f\r":
            return ""
        if tok == "{%":
            return NOTHING
        if tok == "+" or tok == "|":
            return self.c(tok)
        if tok == ".":
            return self.c(".")
        return self.c(self.ops.get(tok, tok)) if tok not in "$?!`\\" else NOTHING

    def string(self, tok: str) -> str:
        """The code of a string literal; of one with a bad escape or replacement field, no code."""
        at = min(i for i in (tok.find('"'), tok.find("'")) if i >= 0)
        kind = tok[:at].lower()
        if kind not in ("", "r", "b", "u", "f", "br", "rb", "fr", "rf"):
            return NOTHING
        n = 3 if len(tok) - at >= 6 and tok[at : at + 3] in ('"""', "'''") else 1
        body = tok[at + n : len(tok) - n]
        if "b" in kind and not body.isascii():
            return NOTHING
        if "r" not in kind and "\\" in body:
            for m in _ESCAPE.finditer(body):
                e = m[0]
                if e in ("\\x", "\\u", "\\U", "\\N") and (e == "\\x" or "b" not in kind):
                    return NOTHING
                if e[1] == "N" and "b" not in kind and not _named(e[3:-1]) or e[1] == "U" and len(e) == 10 and "b" not in kind and int(e[2:], 16) > 0x10FFFF:
                    return NOTHING
        if "f" in kind and ("{" in body or "}" in body) and self.fields(body, 0, False, "r" in kind) != len(body):
            return NOTHING
        return self.c("BYTES" if "b" in kind else "STR")

    def fields(self, body: str, i: int, spec: bool, raw: bool) -> int:
        """Where the text of an f-string, or of a format specification, ends; -1 where a replacement field is no expression."""
        while i < len(body):
            if not raw and body.startswith("\\N{", i):
                i = body.find("}", i) + 1
                continue
            c = body[i]
            if c == "}":
                if spec:
                    return i
                if not body.startswith("}}", i):
                    return -1
                i += 2
                continue
            if c != "{":
                i += 1
                continue
            if body.startswith("{{", i) and not spec:
                i += 2
                continue
            lo, depth, i = i + 1, 0, i + 1
            while i < len(body):
                m = _FSKIP.match(body, i)
                if m:
                    i = m.end()
                    continue
                c = body[i]
                if depth == 0 and (c in "}:" or c == "!" and body[i + 1 : i + 2] != "="):
                    break
                depth += (c in "([{") - (c in ")]}")
                i += 1
            if i >= len(body):
                return -1
            expr = body[lo:i].strip()
            if expr.endswith("=") and expr[-2:-1] not in ("=", "!", "<", ">"):
                expr = expr[:-1]
            inner = "(" + expr + "\n)" if expr.startswith(("yield", "*")) is False else "x = " + expr
            if not expr.strip() or self.run(self.codes(inner)) >= 0:
                return -1
            if body[i] == "!":
                if body[i + 1 : i + 2] not in ("r", "s", "a"):
                    return -1
                i += 2
            if body[i : i + 1] == ":":
                i = self.fields(body, i + 1, True, raw)
                if i < 0:
                    return -1
            if body[i : i + 1] != "}":
                return -1
            i += 1
        return -1 if spec else i

    def codes(self, text: str) -> str:
        return self.laid(self.find("\n" + text + "\n"))

    def placed(self, text: str) -> tuple[str, list[int]]:
        found = list(self.scan("\n" + text + "\n"))
        origin: list[int] = []
        codes = self.laid([m.group(1) for m in found], origin)
        at = []
        for k in origin:
            m = found[min(k, len(found) - 1)]
            # indentation belongs to the line it begins, all else to the place where the token stands
            at.append(max(0, min(len(text), (m.end(1) if codes[len(at)] in self.layout else m.start(1)) - 1)))
        return codes, at

    def laid(self, toks: list[str], origin: list[int] | None = None) -> str:
        """Codes of tokens, with indentation as brackets; origin: gets the token each code comes from."""
        table, out, depth, stack = self.table, [], 0, [(0, 0)]
        up, down, nl = self.c("INDENT"), self.c("DEDENT"), self.c("NEWLINE")
        opens, closes = {self.c(x) for x in "([{"}, {self.c(x) for x in ")]}"}
        for k, tok in enumerate(toks):
            if origin is not None:
                origin += [k - 1] * (len(out) - len(origin))
            c = table[tok]
            if c == "\n":
                if depth > 0:
                    continue
                if out and out[-1] not in (nl, up, down):
                    out.append(nl)
                lead = tok[tok.rfind("\n") + 1 :]
                if "#" in lead:
                    continue
                lead = lead.rpartition("\f")[2]
                at = (len(lead.expandtabs(8)), len(lead))
                if at == stack[-1] or k + 1 < len(toks) and table[toks[k + 1]] == NOTHING:
                    continue  # a line that begins with no token of the language says nothing about indentation
                pend = at
                if pend[0] > stack[-1][0] and pend[1] > stack[-1][1]:
                    stack.append(pend)
                    out.append(up)
                else:
                    while len(stack) > 1 and stack[-1][0] > pend[0]:
                        stack.pop()
                        out.append(down)
                    if stack[-1] != pend:
                        out.append(NOTHING)
                continue
            if c in opens:
                depth += 1
            elif c in closes:
                depth = max(0, depth - 1)
            if c:
                out.append(c)
        if depth <= 0:
            if out and out[-1] not in (nl, up, down):
                out.append(nl)
            while len(stack) > 1:
                stack.pop()
                out.append(down)
        if origin is not None:
            origin += [len(toks) - 1] * (len(out) - len(origin))
        return "".join(out)


def closed_early(text: str) -> list[tuple[int, str]]:
    """(line, text): a Python text with a bracket that stays open, closed at the end of a line from its own to where the parse fails.

    Inside a bracket lines are not told apart, so this cannot be left to edits of tokens.
    """
    one = language("python")
    codes, at = one.placed(text)
    opened: list[tuple[int, str]] = []
    pairs = {one.c(o): c for o, c in ("()", "[]", "{}")}
    closers = {one.c(c): o for o, c in ("()", "[]", "{}")}
    for c, i in zip(codes, at):
        if c in pairs:
            opened.append((i, pairs[c]))
        elif c in closers and opened:
            opened.pop()
    fails = one.run(codes)
    if not opened or fails < 0:
        return []
    out = []
    stop = at[fails] if fails < len(at) else len(text)
    for place, closer in opened[:1]:
        end = place
        while end < stop:
            end = text.find("\n", end + 1)
            end = len(text) if end < 0 else end
            out.append((text.count("\n", 0, end) + 1, text[:end] + closer + text[end:]))
    return out


class Yaml(Language):
    """Lines to keys, dashes, scalars and flow marks; depth of indentation becomes brackets."""

    _key = re.compile(r"""(?P<q>"(?:[^"\\]|\\.)*"|'(?:[^']|'')*')[ \t]*:(?=\s|$)|(?P<p>(?:[^\s\-?:,\[\]{}#&*!|>'"%@`]|[-?:](?=\S))(?:[^:#\n]|:(?=\S)|(?<=\S)#)*?)[ \t]*:(?=\s|$)|(?P<e>\?)(?=\s|$)""")
    _props = re.compile(r"(?:(&[^\s,\[\]{}]+)|(![^\s]*))(?=\s|$)[ \t]*")
    _flow = re.compile(r"""\s*("(?:[^"\\]|\\[\s\S])*"|'(?:[^']|'')*'|[\[\]{},]|:(?=[\s,\[\]{}])|#[^\n]*|&[^\s,\[\]{}]+|\*[^\s,\[\]{}]+|![^\s,\[\]{}]*|(?:[^\s\[\]{},:#"'&*!|>%@`]|:(?=[^\s,\[\]{}]))(?:[^\[\]{},:#\n]|:(?=[^\s,\[\]{}])|(?<=\S)#)*|[\s\S])""")

    _goes_on = re.compile(r"[ \t]*\n[ \t]*[^\s\[\]{},:#\"'&*!|>%@`]")
    _whole = re.compile(r""""(?:[^"\\]|\\[\s\S])*"|'(?:[^']|'')*'""")

    def __init__(self):
        super().__init__("yaml", grammars.YAML)
        self.layout = frozenset([self.c("INDENT"), self.c("DEDENT")])
        self.trail = self.layout | {self.c("NEWLINE")}

    def pattern(self) -> str:
        return r"(\Z)"

    def make(self, tok: str) -> str:
        return NOTHING

    def placed(self, text: str) -> tuple[str, list[int]]:
        codes, lines = self.lex(text)
        begins = [0, *(m.end() for m in re.finditer("\n", text))]
        return codes, [begins[min(n, len(begins)) - 1] for n in lines]

    def codes(self, text: str) -> str:
        return self.lex(text)[0]

    def lex(self, text: str) -> tuple[str, list[int]]:
        c, out, where = self.c, [], []
        text = text.replace("\r\n", "\n")
        lines = text.split("\n")
        begins = [0, *(m.end() for m in re.finditer("\n", text))]
        stack, i = [0], 0

        def put(code: str) -> None:
            out.append(code)
            where.append(i + 1)

        def flow(line_no: int, col: int) -> tuple[int, int]:
            """Puts the tokens of a flow collection; gives the line and column after it."""
            base = pos = begins[line_no] + col
            depth = 0
            for m in self._flow.finditer(text, base):
                t = m[1]
                pos = m.end()
                if t.isspace() or t.startswith("#") and (m.start(1) == base or text[m.start(1) - 1].isspace()):
                    continue
                if t in "[{":
                    depth += 1
                    put(c(t))
                elif t in "]}":
                    depth -= 1
                    put(c(t))
                elif t == ",":
                    put(c(","))
                elif t == ":":
                    put(c(":"))
                elif t[0] in "\"'" and len(t) > 1:
                    put(c("FQUOTED"))
                elif t[0] in "&":
                    put(c("ANCHOR"))
                elif t[0] == "*":
                    put(c("ALIAS") if len(t) > 1 else NOTHING)
                elif t[0] == "!":
                    put(c("TAG"))
                elif len(t) == 1 and t in "\"'|>%@`#&*":
                    put(NOTHING)
                else:
                    put(c("FPLAIN"))
                    if self._goes_on.match(text, pos):
                        out.pop()
                        where.pop()
                if depth <= 0:
                    break
            n = text.count("\n", base, pos)
            return line_no + n, pos - begins[line_no + n]

        def after(line: str, col: int) -> None:
            """What follows a value on its line."""
            rest = line[col:]
            if rest.strip() and not re.match(r"\s+#|\s*$", rest):
                put(NOTHING)
            put(c("NEWLINE"))

        def block(indent: int) -> None:
            nonlocal i
            while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) > indent):
                i += 1

        started = False
        while i < len(lines):
            line = lines[i]
            body = line.lstrip(" ")
            if not body.strip() or body.lstrip().startswith("#"):
                i += 1
                continue
            if re.match(r"(?:---|\.\.\.)(?:\s|$)", line):
                while len(stack) > 1:
                    stack.pop()
                    put(c("DEDENT"))
                put(c("MARK"))
                started = True
                if line[3:].strip() and not line[3:].strip().startswith("#"):
                    lines[i] = line = "   " + line[3:]
                    body = line.lstrip(" ")
                else:
                    i += 1
                    continue
            if line.startswith("%") and not started:
                i += 1
                continue
            col = len(line) - len(body)
            if body[0] == "\t":
                put(NOTHING)
                i += 1
                continue
            if col > stack[-1]:
                stack.append(col)
                put(c("INDENT"))
            else:
                while stack[-1] > col:
                    stack.pop()
                    put(c("DEDENT"))
                if stack[-1] != col:
                    put(NOTHING)
                    stack.append(col)
            here = i
            # the line's content: dashes, then a key, then a value
            while True:
                rest = line[col:]
                if re.match(r"-(?:\s|$)", rest):
                    put(c("DASH"))
                    tail = rest[1:].lstrip(" ")
                    if not tail.strip() or tail.startswith("#"):
                        put(c("NEWLINE"))
                        i += 1
                        break
                    col += len(rest) - len(tail)
                    stack.append(col)
                    put(c("INDENT"))
                    continue
                props = 0
                while (m := self._props.match(line, col)) and m.end() > col:
                    put(c("ANCHOR") if m[1] else c("TAG"))
                    col = m.end()
                    props += 1
                rest = line[col:]
                if not rest.strip() or rest.startswith("#"):
                    put(c("NEWLINE"))
                    i += 1
                    break
                m = self._key.match(line, col)
                keyed = False
                if m and not m["e"]:
                    put(c("KEY"))
                    keyed = True
                    col = m.end()
                    tail = line[col:]
                    if not tail.strip() or re.match(r"\s+#", tail):
                        put(c("NEWLINE"))
                        i += 1
                        break
                    col += len(tail) - len(tail.lstrip(" \t"))
                    while (m := self._props.match(line, col)) and m.end() > col:
                        put(c("ANCHOR") if m[1] else c("TAG"))
                        col = m.end()
                    rest = line[col:]
                    if not rest.strip() or rest.startswith("#"):
                        put(c("NEWLINE"))
                        i += 1
                        break
                a = rest[0]
                if a in "|>":
                    if re.match(r"[|>](?:[1-9]?[-+]?|[-+][1-9])(?:\s+#.*|\s*)$", rest):
                        put(c("BLOCK"))
                        base = stack[-1]
                        i += 1
                        block(base if keyed or len(stack) > 1 else -1)
                        put(c("NEWLINE"))
                    else:
                        put(NOTHING)
                        i += 1
                elif a in "[{":
                    ln, cl = flow(i, col)
                    i = ln
                    after(lines[i], cl)
                    i += 1
                elif a in "\"'":
                    m = self._whole.match(text, begins[i] + col)
                    if not m:
                        put(NOTHING)
                        i = len(lines)
                        break
                    if a == '"' and re.search(r'(?<!\\)(?:\\\\)*\\(?![0abt\tnvfre "/\\N_LP\n]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})', m[0]):
                        put(NOTHING)
                    put(c("QUOTED"))
                    n = m[0].count("\n")
                    cl = col + len(m[0]) if not n else len(m[0]) - m[0].rfind("\n") - 1
                    i += n
                    after(lines[i], cl)
                    i += 1
                elif a == "*":
                    m = re.match(r"\*[^\s,\[\]{}]+", rest)
                    put(c("ALIAS") if m else NOTHING)
                    after(line, col + (m.end() if m else 1))
                    i += 1
                elif a in "@`%,]}#" or a == "?" and rest[1:2] in (" ", "") or a == ":" and rest[1:2] in (" ", "") or a == "&" or keyed and re.match(r"-(?:\s|$)", rest):
                    put(NOTHING)
                    i += 1
                else:
                    plain = re.sub(r"\s+#.*", "", rest)
                    if re.search(r":(?:\s|$)", plain):
                        put(NOTHING)
                    put(c("PLAIN"))
                    put(c("NEWLINE"))
                    i += 1
                break
            if i == here:
                i += 1
        while len(stack) > 1:
            stack.pop()
            put(c("DEDENT"))
        return "".join(out), where


MAKERS = {"json": lambda: Json("json", grammars.JSON), "go": Go, "java": Java, "typescript": TypeScript, "javascript": JavaScript, "rust": Rust, "python": Python, "yaml": Yaml}
_made: dict[str, Language] = {}


def language(name: str) -> Language:
    """One lexer and chart for each worker process and language."""
    if name not in _made:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # templates in templates are read recursively, at any depth
        _made[name] = MAKERS[name]()
    return _made[name]
