"""An error-correcting chart parser for any context-free grammar, fast enough for whole corpora.

The chart is Earley's: a set of dotted rules for each position, each with the set it started from. Two things make it fast.
A set is stored once (two positions with equal rules and equal origins share it), so its moves are remembered and a known
construct costs one table lookup a token, wherever it occurs. And a bracket pair is a rule of its own: its content is parsed
from a fresh set that depends only on what may stand in the bracket there, so sets do not multiply with nesting.

A text without a zero-cost parse is repaired over the same chart by the search of `repair`.
"""

from __future__ import annotations

import re

OPEN = {"(": ")", "[": "]", "{": "}", "INDENT": "DEDENT"}
_TOKENS = re.compile(r"'([^']+)'|([A-Za-z_]\w*)|([()|?*+])")
#: Dotted rules kept in all sets of a chart; beyond that all are dropped and made again as needed, which changes no result.
KEPT = 300_000
#: A code that no rule takes: a token that is none of the language's.
NOTHING = "\uf8ff"


class Grammar:
    """Rules in EBNF: ``name: alternatives``; quoted words and capitals are terminals, '(' ... ')' pairs become brackets."""

    def __init__(self, text: str, start: str):
        self.rules: list[tuple[str, tuple]] = []
        self.by: dict[str, list[int]] = {}
        self.codes: dict[str, str] = {}
        self.brackets: dict[str, str] = {}
        self.fresh: dict = {}
        for o, c in OPEN.items():
            self.code(o)
            self.code(c)
        defs: dict[str, str] = {}
        for line in re.sub(r"\n\s+", " ", text).strip().splitlines():
            if line.strip() and not line.startswith("--"):
                name, _, body = line.partition(":")
                defs[name.strip()] = body
        self.names = set(defs)
        for name, body in defs.items():
            toks = [("T", a) if a else ("N", b) if b else ("O", c) for a, b, c in _TOKENS.findall(body)]
            tree, at = self._alts(toks, 0)
            assert at == len(toks), (name, toks[at:])
            for seq in tree:
                self._rule(name, seq)
        self._rule("__start", (start,))
        self.nullable: set[str] = set()
        grew = True
        while grew:
            grew = False
            for lhs, rhs in self.rules:
                if lhs not in self.nullable and lhs not in self.brackets and all(s in self.nullable for s in rhs):
                    self.nullable.add(lhs)
                    grew = True

    def code(self, terminal: str) -> str:
        return self.codes.setdefault(terminal, chr(0xE000 + len(self.codes)))

    def _rule(self, lhs: str, rhs: tuple) -> None:
        if (lhs, rhs) not in self.fresh:
            self.fresh[(lhs, rhs)] = True
            self.by.setdefault(lhs, []).append(len(self.rules))
            self.rules.append((lhs, rhs))

    def _sub(self, kind: str, alts: list[tuple]) -> str:
        key = (kind, tuple(alts))
        if key not in self.fresh:
            name = self.fresh[key] = f"__{kind}{len(self.fresh)}"
            for a in alts:
                if kind == "star":
                    self._rule(name, (name, *a))
                else:
                    self._rule(name, a)
            if kind in ("star", "opt"):
                self._rule(name, ())
        return self.fresh[key]

    def _alts(self, toks: list, i: int) -> tuple[list[tuple], int]:
        alts, seq = [], []
        while i < len(toks):
            kind, val = toks[i]
            if (kind, val) == ("O", "|"):
                alts.append(tuple(seq))
                seq, i = [], i + 1
                continue
            if (kind, val) == ("O", ")") or kind == "T" and val in OPEN.values() or kind == "N" and val == "DEDENT":
                break
            if (kind, val) == ("O", "("):
                sub, i = self._alts(toks, i + 1)
                item = self._sub("grp", sub) if len(sub) > 1 or not sub[0] else sub[0]
                i += 1
            elif kind == "T" and val in OPEN or kind == "N" and val == "INDENT":
                sub, j = self._alts(toks, i + 1)
                assert toks[j][1] == OPEN[val], toks[i : j + 1]
                key = ("bracket", val, tuple(sub))
                if key not in self.fresh:
                    g = self.fresh[key] = f"__{val}{len(self.fresh)}"
                    self.brackets[g] = val
                    for a in sub:
                        self._rule(g, a)
                item, i = self.fresh[key], j + 1
            else:
                item = val if kind == "N" and val in self.names else self.code(val)
                i += 1
            if i < len(toks) and toks[i][0] == "O" and toks[i][1] in "?*+":
                body = item if isinstance(item, tuple) else (item,)
                op = toks[i][1]
                i += 1
                if op == "?":
                    seq.append(self._sub("opt", [body]))
                else:
                    star = self._sub("star", [body])
                    seq += [*body, star] if op == "+" else [star]
            elif isinstance(item, tuple):
                seq += item
            else:
                seq.append(item)
        alts.append(tuple(seq))
        return alts, i


class Predicted:
    """What may begin at a place where some of the given symbols may stand; it is the same wherever that is."""

    __slots__ = ("scan", "wait", "expect", "empty")

    def __init__(self, g: Grammar, symbols: frozenset, root: bool):
        rules, by = g.rules, g.by
        self.scan, self.wait, self.empty = {}, {}, set()
        expect: dict[str, set] = {}
        todo = [(r, 0) for n in symbols if root or n in by and n not in g.brackets for r in by[n]]
        seen = set(todo)
        while todo:
            r, dot = todo.pop()
            lhs, rhs = rules[r]
            if dot == len(rhs):
                if root and lhs in symbols:
                    self.empty.add(lhs)
                continue
            sym = rhs[dot]
            if sym not in by:
                self.scan.setdefault(sym, []).append((r, dot + 1))
                continue
            self.wait.setdefault(sym, []).append((r, dot + 1))
            if sym in g.brackets:
                expect.setdefault(g.brackets[sym], set()).add(sym)
                continue
            more = [(q, 0) for q in by[sym]]
            if sym in g.nullable:
                more.append((r, dot + 1))
            for item in more:
                if item not in seen:
                    seen.add(item)
                    todo.append(item)
        self.expect = {o: frozenset(v) for o, v in expect.items()}


class State:
    """A set of the chart: rules begun earlier (items), and what may begin here."""

    __slots__ = ("moves", "jump", "own_scan", "own_wait", "expect", "done", "root", "new", "ways")

    def __init__(self, done: frozenset, root: bool = False):
        self.done, self.root, self.ways = done, root, None
        self.moves: dict[str, State | None] = {}
        self.jump: dict[frozenset, State | None] = {}
        self.own_scan: dict[str, list] = {}
        self.own_wait: dict[str, list] = {}

    def scan(self, c: str) -> list:
        return self.own_scan.get(c, []) + [(r, d, self) for r, d in self.new.scan.get(c, ())]

    def wait(self, name: str) -> list:
        more = self.new.wait.get(name)
        own = self.own_wait.get(name, [])
        return own + [(r, d, self) for r, d in more] if more else own


class Chart:
    """Runs a grammar over strings of terminal codes."""

    def __init__(self, grammar: Grammar):
        self.g = grammar
        g = grammar
        self.openers = {g.code(o): o for o in OPEN}
        self.closers = {g.code(c): o for o, c in OPEN.items()}
        self.any = g.codes.get("ANY", "")
        # at which dot the rest of a rule may be empty
        self.ends = []
        for _, rhs in g.rules:
            n = len(rhs)
            while n and rhs[n - 1] in g.nullable:
                n -= 1
            self.ends.append(n)
        # what makes up token trees, in which any token may stand
        self.loose: set[str] = set()
        grew = bool(self.any)
        while grew:
            grew = False
            for lhs, rhs in g.rules:
                if lhs not in self.loose and rhs and (self.any in rhs or all(x in self.loose or x == lhs for x in rhs)):
                    self.loose.add(lhs)
                    grew = True
        self.predicted: dict = {}
        self.reset()

    def reset(self) -> None:
        self.sets: dict = {}
        self.weight = 0
        self.middle: dict[bool, State] = {}
        self.starts: dict[frozenset, State] = {}
        self.begin = self.start(frozenset(["__start"]))

    def anywhere(self, trees: bool = True) -> State:
        """The set of a text that begins in the middle of anything: every rule at every dot, begun in unknown context.

        trees: also within token trees, the brackets in which any token may stand.
        """
        u = self.middle.get(trees)
        if u is None:
            g = self.g
            skip = set() if trees else self.loose
            u = self.middle[trees] = State(frozenset([*(b for b in g.brackets if b not in skip), "__start"]))
            for r, (lhs, rhs) in enumerate(g.rules):
                for dot, sym in enumerate(rhs):
                    if lhs not in skip:
                        (u.own_wait if sym in g.by else u.own_scan).setdefault(sym, []).append((r, dot + 1, u))
            u.new = self.predict(frozenset())
            u.expect = {o: frozenset(b for b, k in g.brackets.items() if k == o and b not in skip) for o in set(g.brackets.values())}
        return u

    def ways(self, s: State) -> list[tuple[str, State]]:
        """The terminals but brackets that may follow, one for each set that they lead to."""
        if s.ways is None:
            found: dict[int, tuple[str, State]] = {}
            for c in sorted({*s.own_scan, *s.new.scan} - {self.any}):
                if c not in self.openers and c not in self.closers:
                    n = s.moves[c] if c in s.moves else self.step(s, c)
                    if n is not None:
                        found.setdefault(id(n), (c, n))
            s.ways = list(found.values())
        return s.ways

    def predict(self, symbols: frozenset, root: bool = False) -> Predicted:
        p = self.predicted.get((symbols, root))
        if p is None:
            p = self.predicted[(symbols, root)] = Predicted(self.g, symbols, root)
        return p

    def start(self, wanted: frozenset) -> State:
        s = self.starts.get(wanted)
        if s is None:
            new = self.predict(wanted, True)
            s = self.starts[wanted] = State(frozenset(new.empty), True)
            s.new, s.expect = new, new.expect
        return s

    def _advance(self, items: list) -> State | None:
        """The set of the given rules, with all that they complete."""
        rules, ends, brackets = self.g.rules, self.ends, self.g.brackets
        out, todo, done = set(items), list(items), set()
        finished = set()
        while todo:
            r, dot, origin = todo.pop()
            if dot < ends[r]:
                continue
            lhs = rules[r][0]
            if (lhs, origin) in finished:
                continue
            finished.add((lhs, origin))
            if lhs in brackets or lhs == "__start":
                done.add(lhs)  # the text around goes on only after the closing bracket
                continue
            for item in origin.wait(lhs):
                if item not in out:
                    out.add(item)
                    todo.append(item)
        live = frozenset(i for i in out if i[1] < len(rules[i[0]][1]))
        if not live and not done:
            return None
        key = (live, frozenset(done))
        s = self.sets.get(key)
        if s is None:
            s = self.sets[key] = State(key[1])
            self.weight += len(live)
            self._close(s, live)
        return s

    def _close(self, s: State, live: frozenset) -> None:
        g = self.g
        next_symbols, expect = set(), {}
        for r, dot, origin in live:
            rhs = g.rules[r][1]
            while dot < len(rhs):
                sym = rhs[dot]
                item = (r, dot + 1, origin)
                if sym not in g.by:
                    s.own_scan.setdefault(sym, []).append(item)
                    break
                s.own_wait.setdefault(sym, []).append(item)
                if sym in g.brackets:
                    expect.setdefault(g.brackets[sym], set()).add(sym)
                    break
                next_symbols.add(sym)
                if sym not in g.nullable:
                    break
                dot += 1
        s.new = self.predict(frozenset(next_symbols))
        s.expect = s.new.expect
        if expect:
            s.expect = dict(s.expect)
            for o, v in expect.items():
                s.expect[o] = s.expect.get(o, frozenset()) | v

    def step(self, s: State, c: str) -> State | None:
        """The set after a terminal that is no bracket."""
        items = s.scan(c) + (s.scan(self.any) if self.any else []) if c < NOTHING else []
        n = s.moves[c] = self._advance(items) if items else None
        return n

    def after(self, s: State, inner: frozenset) -> State | None:
        """The set after a bracket whose content fits the given rules."""
        items = [i for g in inner for i in s.wait(g)]
        n = s.jump[inner] = self._advance(items) if items else None
        return n

    def go(self, s: State, c: str, stack: list) -> State | None:
        """The set after any terminal; brackets push and pop."""
        if c in self.openers:
            want = s.expect.get(self.openers[c])
            if not want:
                return None
            stack.append((s, self.openers[c]))
            return self.start(want)
        if c in self.closers:
            if not stack or stack[-1][1] != self.closers[c] or not s.done:
                return None
            below = stack[-1][0]
            n = below.jump[s.done] if s.done in below.jump else self.after(below, s.done)
            if n is not None:
                stack.pop()
            return n
        return s.moves[c] if c in s.moves else self.step(s, c)

    def run(self, codes: str, semi: str = "", newline: str = "", into: list | None = None) -> int:
        """-1 when the string has a zero-cost parse, else the index of the code where none is left (len at the end).

        newline: the code of a newline, which is skipped. semi: the code of a semicolon that is supplied before a closing
        brace, at the end, or at a newline, where no parse goes on without it. into: gets the codes that were used.
        """
        if self.weight > KEPT:
            self.reset()
        s, stack, fresh = self.begin, [], False
        brace = self.g.codes.get("}", "")
        for i, c in enumerate(codes):
            n = s.moves.get(c)
            if n is None:
                if c == newline:
                    fresh = True
                    continue
                n = self.go(s, c, stack)
                if n is None and semi and (fresh or c == brace):
                    t = self.go(s, semi, stack)
                    n = self.go(t, c, stack) if t is not None else None
                    if n is not None and into is not None:
                        into.append(semi)
                if n is None:
                    if into is not None:
                        into += [x for x in codes[i:] if x != newline]
                    return i
            if into is not None:
                into.append(c)
            s, fresh = n, False
        if not stack:
            if "__start" in s.done:
                return -1
            t = self.go(s, semi, stack) if semi else None
            if t is not None and "__start" in t.done:
                return -1
        return len(codes)
