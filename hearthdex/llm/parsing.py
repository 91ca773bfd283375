"""Chart parsers from grammar texts: prediction tables, ordered alternatives, a chart of results.

A grammar text has rules ``name = expression`` (a rule ends where the next begins; ``#``
starts a comment). Expressions know ``'token'`` and ``NAME`` (kinds of tokens), ``rule``,
``a b``, ``a / b`` (ordered), ``a? a* a+``, ``&a !a`` and brackets; ``%native`` calls a predicate given
to the compiler, whose attribute ``first`` may name the tokens that it begins with.

The chart holds, by rule and position, where the rule ends or that it can't stand there. ``@rule``
marks the rules with a column in it, ``@@rule`` those of them after whose end a chart that has grown large is
emptied, but for the columns of such rules. A grammar in which a rule can contain itself
without passing a marked rule is refused. So two alternatives that meet the same thing at the same
place parse it once, and time grows with the number of tokens, however deep they are
nested. Ends that are one or two tokens away aren't kept: all longer results below them are.
Sets of first tokens are computed for every expression and compiled into the tests
that choose an alternative, so few alternatives are ever tried; a parse consumes the
whole token stream. The compiled functions are closures over one token list. They call
nothing but each other and the natives, so depth costs frames on the heap, no native stack.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

_TOKEN = re.compile(r"\s+|#[^\n]*|(?P<rule>@{0,2}[a-z_][\w]*)(?=\s*=(?!=))|(?P<str>'[^']+')|(?P<name>%?[A-Za-z_]\w*)|(?P<op>[=/?*+&!()])")


#: Results in a chart from which it is emptied behind a marked rule.
LARGE = 50_000


@contextmanager
def depth(frames: int) -> Iterator[None]:
    """Room for so many calls more of Python functions, whose frames lie on the heap."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(min(before + frames, 2**31 - 1))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


class GrammarError(ValueError):
    pass


def read_grammar(text: str) -> tuple[dict[str, tuple], dict[str, int]]:
    """Rules as nested tuples, and how many marks a marked rule has."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise GrammarError(f"unexpected {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
    rules: dict[str, tuple] = {}
    marked: dict[str, int] = {}
    i = 0

    def choice() -> tuple:
        nonlocal i
        options = [sequence()]
        while i < len(tokens) and tokens[i] == ("op", "/"):
            i += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("or", *options)

    def sequence() -> tuple:
        nonlocal i
        items = []
        while i < len(tokens) and tokens[i][0] != "rule" and tokens[i] not in (("op", "/"), ("op", ")")):
            items.append(suffix())
        return items[0] if len(items) == 1 else ("seq", *items)

    def suffix() -> tuple:
        nonlocal i
        kind, value = tokens[i]
        if (kind, value) in (("op", "&"), ("op", "!")):
            i += 1
            return ("and" if value == "&" else "not", suffix())
        i += 1
        if kind == "str":
            node = ("t", value[1:-1])
        elif kind == "name":
            node = ("native", value[1:]) if value[0] == "%" else ("t", value) if value.isupper() else ("n", value)
        elif (kind, value) == ("op", "("):
            node = choice()
            if i >= len(tokens) or tokens[i] != ("op", ")"):
                raise GrammarError("bracket not closed")
            i += 1
        else:
            raise GrammarError(f"unexpected {value!r}")
        while i < len(tokens) and tokens[i][0] == "op" and tokens[i][1] in "?*+":
            node = (tokens[i][1], node)
            i += 1
        return node

    while i < len(tokens):
        kind, value = tokens[i]
        if kind != "rule" or tokens[i + 1] != ("op", "="):
            raise GrammarError(f"a rule should begin at {value!r}")
        name = value.lstrip("@")
        if value[0] == "@":
            marked[name] = value.count("@")
        if name in rules:
            raise GrammarError(f"two rules {name!r}")
        i += 2
        rules[name] = choice()
    return rules, marked


def _named(x: tuple) -> list[str]:
    """Rules that an expression names, once for each place."""
    if x[0] == "n":
        return [x[1]]
    return [r for y in x[1:] if isinstance(y, tuple) for r in _named(y)]


def unmarked_cycle(rules: dict[str, tuple], marked: Iterable[str]) -> str | None:
    """A rule that can contain itself without passing a marked one, if there is any."""
    below = {name: set(_named(body)).difference(marked) for name, body in rules.items()}
    changed = True
    while changed:
        changed = False
        for name, some in below.items():
            more = some.union(*(below[r] for r in some if r in below))
            if len(more) > len(some):
                below[name] = more
                changed = True
    return next((name for name in rules if name in below[name]), None)


class Parser:
    """Compiled rules. ``natives`` maps names to ``f(kinds, before, p)`` giving a position or -1.

    ``before[p]`` tells whether a line ends before token p.
    """

    def __init__(self, text: str, start: str, natives: dict[str, Callable] | None = None):
        self.rules, self.marked = read_grammar(text)
        self.charted = list(self.marked)
        if name := unmarked_cycle(self.rules, self.marked):
            raise GrammarError(f"{name!r} contains itself without a column in the chart")
        self.natives = natives or {}
        self.start = start
        self._first()
        self._plain = self._compile(False)
        self._traced: tuple | None = None

    def _first(self) -> None:
        self.first: dict[str, set[str]] = {r: set() for r in self.rules}
        self.empty: set[str] = set()
        changed = True
        while changed:
            changed = False
            for name, body in self.rules.items():
                f, e = self._look(body)
                if not f <= self.first[name]:
                    self.first[name] |= f
                    changed = True
                if e and name not in self.empty:
                    self.empty.add(name)
                    changed = True

    def _look(self, x: tuple) -> tuple[set[str], bool]:
        """First tokens, and whether the expression may match without a token (or can't be predicted)."""
        kind = x[0]
        if kind == "t":
            return {x[1]}, False
        if kind == "n":
            if x[1] not in self.rules:
                raise GrammarError(f"no rule {x[1]!r}")
            return self.first[x[1]], x[1] in self.empty
        if kind == "native" and getattr(self.natives.get(x[1]), "first", None):
            return self.natives[x[1]].first, False
        if kind in ("native", "and", "not"):
            return set(), True
        if kind in "?*":
            return self._look(x[1])[0], True
        if kind == "+":
            return self._look(x[1])
        if kind == "or":
            looks = [self._look(y) for y in x[1:]]
            return set().union(*(f for f, _ in looks)), any(e for _, e in looks)
        out: set[str] = set()
        for y in x[1:]:
            f, e = self._look(y)
            out |= f
            if not e:
                return out, False
        return out, True

    def _compile(self, traced: bool) -> tuple:
        lines = ["def build(K, B, far, natives):"]
        sets: dict[frozenset, str] = {}
        counter = [0]

        def fresh() -> str:
            counter[0] += 1
            return f"v{counter[0]}"

        def test(first: set[str], p: str) -> str:
            if len(first) == 1:
                return f"K[{p}] == {next(iter(first))!r}"
            key = frozenset(first)
            return f"K[{p}] in {sets.setdefault(key, f'S{len(sets)}')}"

        def note(ind: str, p: str) -> None:
            if traced:
                lines.append(f"{ind}if {p} > far[0]: far[0] = {p}")

        def emit(x: tuple, p: str, out: str, ind: str, guarded: bool = False) -> None:
            kind = x[0]
            if kind == "t":
                if guarded:
                    lines.append(f"{ind}{out} = {p} + 1")
                else:
                    note(ind, p)
                    lines.append(f"{ind}{out} = {p} + 1 if K[{p}] == {x[1]!r} else -1")
            elif kind == "n":
                f, e = self._look(x)
                if e or guarded:
                    lines.append(f"{ind}{out} = r_{x[1]}({p})")
                else:
                    note(ind, p)
                    lines.append(f"{ind}{out} = r_{x[1]}({p}) if {test(f, p)} else -1")
            elif kind == "native":
                lines.append(f"{ind}{out} = n_{x[1]}(K, B, {p})")
            elif kind == "and":
                v = fresh()
                emit(x[1], p, v, ind)
                lines.append(f"{ind}{out} = {p} if {v} >= 0 else -1")
            elif kind == "not":
                v = fresh()
                emit(x[1], p, v, ind)
                lines.append(f"{ind}{out} = -1 if {v} >= 0 else {p}")
            elif kind == "?":
                f, e = self._look(x[1])
                note(ind, p)
                lines.append(f"{ind}{out} = {p}")
                inner = ind
                if not e:
                    lines.append(f"{ind}if {test(f, p)}:")
                    inner = ind + " "
                v = fresh()
                emit(x[1], p, v, inner, not e)
                lines.append(f"{inner}if {v} >= 0: {out} = {v}")
            elif kind in "*+":
                f, e = self._look(x[1])
                v, w = fresh(), fresh()
                lines.append(f"{ind}{w} = {p}")
                note(ind, w)
                lines.append(f"{ind}while {'True' if e else test(f, w)}:")
                emit(x[1], w, v, ind + " ", not e)
                lines.append(f"{ind} if {v} <= {w}: break")
                lines.append(f"{ind} {w} = {v}")
                note(ind + " ", w)
                lines.append(f"{ind}{out} = {w}" + (f" if {w} > {p} else -1" if kind == "+" else ""))
            elif kind == "seq":
                if len(x) == 1:
                    lines.append(f"{ind}{out} = {p}")
                    return
                lines.append(f"{ind}{out} = -1")
                at = p
                for k, y in enumerate(x[1:]):
                    v = fresh()
                    emit(y, at, v, ind, guarded and k == 0)
                    lines.append(f"{ind}if {v} >= 0:")
                    ind += " "
                    at = v
                lines.append(f"{ind}{out} = {at}")
            elif kind == "or":
                options = x[1:]
                looks = [self._look(y) for y in options]
                if all(y[0] == "t" for y in options):
                    if not guarded:
                        note(ind, p)
                    lines.append(f"{ind}{out} = {p} + 1 if {test(set().union(*(f for f, _ in looks)), p)} else -1")
                    return
                note(ind, p)
                lines.append(f"{ind}{out} = -1")
                for k, (y, (f, e)) in enumerate(zip(options, looks)):
                    conditions = ([f"{out} < 0"] if k else []) + ([] if e else [test(f, p)])
                    inner = ind
                    if conditions:
                        lines.append(f"{ind}if {' and '.join(conditions)}:")
                        inner = ind + " "
                    emit(y, p, out, inner, not e)
            else:
                raise GrammarError(kind)

        body_at = len(lines)
        passing = [c for c in self.charted if self.marked[c] == 1]
        for name, body in self.rules.items():
            lines.append(f" def r_{name}(p):")
            if name in self.charted:
                lines.append(f"  r = m_{name}.get(p)")
                lines.append("  if r is not None: return r")
            emit(body, "p", "r", "  ")
            if name in self.charted:
                lines.append(f"  if r < 0 or r - p > 2: m_{name}[p] = r")
            if self.marked.get(name) == 2 and passing:
                lines.append(f"  if {' + '.join(f'len(m_{c})' for c in passing)} > {LARGE}:")
                lines.append("   " + "; ".join(f"m_{c}.clear()" for c in passing))
            lines.append("  return r")
        head = [f" {v} = frozenset({sorted(k)!r})" for k, v in sets.items()]
        head += [f" m_{c} = {{}}" for c in self.charted]
        head += [f" n_{n} = natives[{n!r}]" for n in self.natives]
        lines[body_at:body_at] = head
        lines.append(f" return r_{self.start}, [{', '.join(f'm_{c}' for c in self.charted)}]")
        space: dict = {}
        exec(compile("\n".join(lines), f"<grammar {self.start}>", "exec"), space)  # noqa: S102
        kinds: list[str] = []
        before: list[bool] = []
        far = [0]
        start, charts = space["build"](kinds, before, far, self.natives)
        return start, charts, kinds, before, far

    def _run(self, compiled: tuple, kinds: list[str], before: list[bool]) -> tuple[bool, int]:
        start, charts, k, b, far = compiled
        k[:], b[:] = kinds, before
        far[0] = 0
        with depth(len(self.rules) * (len(kinds) + 1)):  # as deep as the tokens may be nested
            end = start(0)
        for c in charts:
            c.clear()
        return end == len(kinds), max(far[0], end)

    def parse(self, kinds: list[str], before: list[bool]) -> int:
        """-1 if the tokens (the last is EOF) are a text of the grammar, else the number of the first that can't go on."""
        ok, _ = self._run(self._plain, kinds, before)
        if ok:
            return -1
        if self._traced is None:
            self._traced = self._compile(True)
        return min(self._run(self._traced, kinds, before)[1], len(kinds) - 1)
