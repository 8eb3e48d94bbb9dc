"""Least-cost repair of a text over the chart of its language.

The edits and their costs:

* insert, delete or replace one token: 1
* take the label for another language (the text is then a whole one): 1
* take out the marker lines of an unfinished merge, all together: 1
* supply the lost rest of a text that breaks off (tail), or the lost beginning of one that starts in the middle (head): 1 each
* delete one whole line: 2, a run of whole lines: 3

The search is Dijkstra's over (place, chart set, open brackets), with no bound on cost, places or steps, so the cost is the
least there is. It is directed by a lower bound: a stretch of tokens that occurs in no text of the language needs an edit
within it, and such stretches are found with the chart's set for unknown context. They are counted on different lines and at
most three of them, since one edit of cost 3 may mend any number. Configurations met again at no lower cost are dropped; open
brackets are numbered, so equal ones are one. Where a language has token trees, in which any token may stand, a repair makes no new one and extends none.
"""

from __future__ import annotations

import heapq

from stratalens.llm.chart import NOTHING, OPEN, Chart, State

#: Numbers of the empty bracket stack and of the unknown one.
EMPTY, UNKNOWN = 0, 1


class Search:
    """Repair of one text; upto(bound) goes on until the bound or a repair is reached."""

    def __init__(self, chart: Chart, codes: str, lines: list[int], semi: str = "", newline: str = "", layout: frozenset = frozenset(), trail: frozenset = frozenset(), base: int = 0, plain: bool = False, whole: bool = False, first: tuple = ()):
        """codes with the line of each; base and first: cost and edits made before; plain: token edits only; whole: no head or tail is lost."""
        self.whole = whole
        self.chart, self.semi, self.plain, self.layout = chart, semi, plain, layout
        keep = [i for i, c in enumerate(codes) if c != newline]
        self.codes = [codes[i] for i in keep]
        self.lines = [lines[i] for i in keep]
        self.fresh = [i > 0 and codes[i - 1] == newline for i in keep] if newline else [False] * len(keep)
        self.brace = chart.g.codes.get("}", "")
        self.bang = chart.g.codes.get("!", "") if chart.loose else ""
        self.below: list[tuple] = [(), ()]
        self.number: dict[tuple, int] = {}
        self.best: dict[tuple, int] = {}
        self.base, self.first = base, first
        n = len(self.codes)
        # the places where a line begins, and the next such place of each
        self.begins = [i for i in range(n) if i == 0 or self.lines[i] != self.lines[i - 1]]
        self.upto_line = {a: b for a, b in zip(self.begins, [*self.begins[1:], n])}
        # from where on a text may break off: its end, or a literal cut there
        self.end = n
        while self.end and self.codes[self.end - 1] in trail:
            self.end -= 1
        self.end -= self.end > 0 and self.codes[self.end - 1] == NOTHING
        self.need: list[int] = []
        self.heap: list[tuple] = []
        self.tick = 0
        self.unknown = chart.anywhere(False) if not plain else None
        self._push(0, 0, chart.begin, EMPTY, None, False)

    # Moves -------------------------------------------------------------------------------------------------------

    def stack(self, s: State, opener: str, under: int) -> int:
        key = (s, opener, under)
        k = self.number.get(key)
        if k is None:
            k = self.number[key] = len(self.below)
            self.below.append(key)
        return k

    def move(self, s: State, k: int, c: str) -> tuple[State, int] | None:
        """The configuration after one terminal."""
        n = s.moves.get(c)
        if n is not None:
            return n, k
        ch = self.chart
        if c in ch.openers:
            o = ch.openers[c]
            want = s.expect.get(o)
            return (ch.start(want), self.stack(s, o, k)) if want else None
        if c in ch.closers:
            o = ch.closers[c]
            if not s.done or k == EMPTY:
                return None
            if k == UNKNOWN:
                inner = frozenset(b for b in s.done if ch.g.brackets.get(b) == o)
                s, under = self.unknown, k
            else:
                s, opener, under = self.below[k]
                if opener != o:
                    return None
                inner = None
            inner = inner if inner is not None else self._done
            n = s.jump[inner] if inner in s.jump else ch.after(s, inner)
            return (n, under) if n is not None else None
        n = s.moves[c] if c in s.moves else ch.step(s, c)
        return (n, k) if n is not None else None

    def free(self, i: int, s: State, k: int) -> tuple[State, int] | None:
        """The configuration after the token at a place, with a semicolon supplied before it where the language does that."""
        c = self.codes[i]
        self._done = s.done
        n = self.move(s, k, c)
        if n is None and self.semi and (self.fresh[i] or c == self.brace):
            t = self.move(s, k, self.semi)
            if t is not None:
                self._done = t[0].done
                n = self.move(*t, c)
        return n

    def accepts(self, s: State, k: int) -> bool:
        if k > UNKNOWN:
            return False
        if "__start" in s.done:
            return True
        t = self.move(s, k, self.semi) if self.semi else None
        return t is not None and "__start" in t[0].done

    # Stretches that need an edit -----------------------------------------------------------------------------------

    def _middle(self, lo: int, hi: int, trees: bool) -> int:
        """The first place from lo on, before hi, where a text in unknown context cannot go on; hi where it can."""
        before, self.unknown = self.unknown, self.chart.anywhere(trees)
        try:
            return self._middle_of(lo, hi)
        finally:
            self.unknown = before

    def _middle_of(self, lo: int, hi: int) -> int:
        s, k = self.unknown, UNKNOWN
        for i in range(lo, hi):
            n = self.free(i, s, k)
            if n is None:
                return i
            if self.semi and (self.fresh[i] or self.codes[i] == self.brace):
                t = self.move(s, k, self.semi)
                if t is not None:
                    self._done = t[0].done
                    if self.move(*t, self.codes[i]) is not None:  # with and without a semicolon: nothing is known here
                        n = (self.unknown, UNKNOWN)
            s, k = n
        return hi

    def _stretches(self) -> list[int]:
        """Where the stretches that need an edit begin: the first that fails from the start, made as short as possible, and one more."""
        n, loose = len(self.codes), self.chart.loose
        s, k = self.chart.begin, EMPTY
        e, tree, trees = n, -1, []  # trees[i]: where the token tree that holds place i begins, its name included
        for i in range(n):
            if loose:
                inside = k > UNKNOWN and s.done <= loose and any(x in loose for x in self._wanted(k))
                if inside and tree < 0:
                    tree = max(0, i - 3)
                elif not inside:
                    tree = -1
                trees.append(tree if tree >= 0 else i)
            t = self.free(i, s, k)
            if t is None:
                e = i
                break
            s, k = t
        if e == n:
            return []
        in_tree = bool(loose) and trees[e] < e  # then only brackets and stray characters can be wrong

        def place(i: int) -> int:
            return i if in_tree or i >= len(trees) else trees[i]

        def tight(e: int, lo: int, full: bool) -> int:
            """The greatest a for which text[a : e + 1] fails in any context; lo if it fails in none."""
            step, a, ok = 1, place(e), e + 1
            while a > lo and self._middle(a, e + 1, full) > e:
                step, a, ok = step * 2, max(lo, place(max(lo, a - step))), a
            if self._middle(a, e + 1, full) <= e:
                while a + 1 < ok:
                    mid = place((a + ok) // 2)
                    if mid <= a:
                        break
                    a, ok = (mid, ok) if self._middle(mid, e + 1, full) <= e else (a, mid)
            return a

        out = [tight(e, 0, in_tree)]
        # what fails in any context after this place says more than what fails here
        further = self._middle(e, n, in_tree or not loose)
        if further < n:
            a = tight(further, 0, True) if in_tree or not loose else e  # beyond e, trees are not known
            if a > e:
                out.append(a)
            out[0] = a if out[0] < a <= e else out[0]
            e = further
        while e < n and len(out) < 3:
            lo = e + 1
            while lo < n and self.lines[lo] == self.lines[e]:
                lo += 1
            e = self._middle(lo, n, True)
            if e < n:
                out.append(tight(e, lo, True))
        return out

    def _wanted(self, k: int) -> frozenset:
        """The brackets that may be open innermost on a stack."""
        s, opener, _ = self.below[k]
        return s.expect.get(opener, frozenset())

    def _bounds(self) -> None:
        """least[i]: how many edits, at least, the text from place i on needs; leave[i]: from a place that is left by an edit."""
        n = len(self.codes)
        self.least = [sum(a >= i for a in self.need) if i else max(1, len(self.need)) for i in range(n + 1)] + [0]
        self.leave = [max(self.least[i], 1 + self.least[i + 1]) for i in range(n + 1)]

    # Search ------------------------------------------------------------------------------------------------------

    def _push(self, cost: int, i: int, s: State, k: int, edits: tuple | None, edit: bool) -> None:
        """A configuration to run on from, or (edit) one to be left by an edit."""
        f = cost + (self.leave[i] if edit else self.least[i]) if self.need else cost + edit
        self.tick += 1
        heapq.heappush(self.heap, (f, -i, self.tick, cost, i, s, k, edits, edit))

    def upto(self, bound: int) -> tuple[int, list[tuple[str, int]]] | None:
        """The least repair of at most this cost, as (cost, edits with their lines), or None."""
        bound -= self.base
        while self.heap and self.heap[0][0] <= bound:
            f, _, _, cost, i, s, k, edits, edit = heapq.heappop(self.heap)
            got = self._leave(cost, i, s, k, edits) if edit is True else self._jump(cost, i, s, k, edits) if edit else self._run(cost, i, s, k, edits)
            if got is not None:
                return got
        return None

    def _answer(self, cost: int, edits: tuple | None) -> tuple[int, list[tuple[str, int]]]:
        out = []
        while edits is not None:
            edits, what, i = edits
            out.append((what, self.lines[min(i, len(self.lines) - 1)] if self.lines else 1))
        return cost + self.base, [*self.first, *reversed(out)]

    def _run(self, cost: int, i: int, s: State, k: int, edits: tuple | None) -> tuple | None:
        """As far as it goes without an edit."""
        n, best = len(self.codes), self.best
        start = i
        while True:
            key = (i, s, k)
            if best.get(key, cost + 1) <= cost:
                return None
            best[key] = cost
            if i == n:
                if self.accepts(s, k):
                    # a search for cost 0 ends here too; others wait for their turn in the heap
                    return self._answer(cost, edits)
                break
            if self.need or start:
                self._push(cost, i, s, k, edits, True)
            nxt = self.free(i, s, k)
            if nxt is None:
                break
            i += 1
            s, k = nxt
        if not start and not self.need and cost == 0 and (i < n or self.plain):
            # the first run: now it is known where it fails
            self.need = self._stretches() or [n]
            self._bounds()
            self.best.clear()
            self._push(cost, 0, self.chart.begin, EMPTY, None, False)
            if not self.plain and not self.whole:
                self._push(1, 0, self.unknown, UNKNOWN, (None, "head", 0), False)
            return None
        if i == n:
            self._push(cost, i, s, k, edits, True)
        return None

    def _leave(self, cost: int, i: int, s: State, k: int, edits: tuple | None) -> tuple | None:
        """All edits at one place."""
        n, ch = len(self.codes), self.chart
        if i >= self.end and not self.plain and not self.whole:
            return self._answer(cost + 1, (edits, "tail", max(0, n - 1)))
        c = self.codes[i] if i < n else ""
        if i < n:
            self._push(cost + 1, i + 1, s, k, (edits, "delete", i), False)
            self._line(cost, i, s, k, edits)
        options = [(c2, n2, k) for c2, n2 in ch.ways(s) if c2 != self.bang]
        for o, want in s.expect.items():
            options.append((ch.g.code(o), ch.start(want), self.stack(s, o, k)))
        if s.done and k != EMPTY:
            for o in OPEN if k == UNKNOWN else [self.below[k][1]]:
                self._done = s.done
                t = self.move(s, k, ch.g.code(OPEN[o]))
                if t is not None:
                    options.append((ch.g.code(OPEN[o]), *t))
        for c2, s2, k2 in options:
            if i < n:
                if self.best.get((i, s2, k2), cost + 2) > cost + 1:
                    if self.free(i, s2, k2) is not None:
                        self._push(cost + 1, i, s2, k2, (edits, "insert", i), False)
                    else:
                        self.best[(i, s2, k2)] = cost + 1
                        self._push(cost + 1, i, s2, k2, (edits, "insert", i), True)
                if c2 != c and self.best.get((i + 1, s2, k2), cost + 2) > cost + 1:
                    self._push(cost + 1, i + 1, s2, k2, (edits, "replace", i), False)
            else:
                self._push(cost + 1, i, s2, k2, (edits, "insert", i), False)
        return None

    def _line(self, cost: int, i: int, s: State, k: int, edits: tuple | None) -> None:
        """Whole lines deleted from a place on that begins one; indentation marks are kept."""
        if self.plain or i not in self.upto_line:
            return
        j = self.upto_line[i]
        if j - i > 2:
            t = self._keep(i, j, s, k)
            if t is not None:
                self._push(cost + 2, j, *t, (edits, "line", i), False)
        self.tick += 1
        heapq.heappush(self.heap, (cost + 3, -i, self.tick, cost, i, s, k, edits, 2))

    def _keep(self, i: int, j: int, s: State, k: int) -> tuple[State, int] | None:
        """The configuration after the indentation marks among deleted tokens, pairs of them left out."""
        if not self.layout:
            return s, k
        left: list[str] = []
        for c in self.codes[i:j]:
            if c in self.layout:
                if left and left[-1] in self.chart.openers and c in self.chart.closers:
                    left.pop()
                else:
                    left.append(c)
        for c in left:
            self._done = s.done
            t = self.move(s, k, c)
            if t is None:
                return None
            s, k = t
        return s, k

    def _jump(self, cost: int, i: int, s: State, k: int, edits: tuple | None) -> None:
        """Runs of lines deleted."""
        j = self.upto_line[i]
        n = len(self.codes)
        while j < n:
            j = self.upto_line[j]
            t = self._keep(i, j, s, k) if self.layout else (s, k)
            if t is not None and self.best.get((j, *t), cost + 4) > cost + 3:
                self._push(cost + 3, j, *t, (edits, "lines", i), False)


class Other:
    """A text under another label: free but for the label if that language takes it as it stands, else searched."""

    def __init__(self, takes, make, first: tuple):
        self.takes, self.make, self.first, self.base = takes, make, first, 1
        self.search: Search | None = None

    def upto(self, bound: int) -> tuple[int, list[tuple[str, int]]] | None:
        if self.search is None:
            if bound == self.base and self.takes():
                return self.base, list(self.first)
            if bound == self.base:
                return None
            self.search = self.make()
        return self.search.upto(bound)


def least(ways) -> tuple[int, list[tuple[str, int]]]:
    """The least repair among several ways to read one text, of falling likelihood; equal costs go to the way named first."""
    ways, known, bound = iter(ways), [], 0
    known.append(next(ways))
    while True:
        for s in known:
            got = s.upto(bound)
            if got is not None:
                return got
        if bound == 1:
            for s in ways:
                known.append(s)
                got = s.upto(bound)
                if got is not None:
                    return got
        bound += 1
