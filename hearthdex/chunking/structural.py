"""Definitions of a source file as chunks.

A definition comes out whole and is not searched for others; everything around
definitions (imports, constants, attributes, decorators, ``export``) is left out. Python is
read with its own parser; Rust, JavaScript and TypeScript by a scanner that knows strings,
comments and brackets. The scanner is less tolerant than an incremental parser: a
file whose brackets don't match has no structural chunks and falls back to windows of lines.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hearthdex.chunking.split import Chunk, split_chunk, split_for_embedding, text_lines
from hearthdex.chunking.windows import WINDOW, windows_of
from hearthdex.functions.paths import LANGUAGE_BY_EXTENSION, language_of

#: Raised when chunks of the same source would come out otherwise; an index of another version is rebuilt.
CHUNKER_VERSION = 2

_RUST = re.compile(
    r"(?P<skip>\s+)|(?P<comment>//[^\n]*|/\*)|(?P<str>(?:b|c)?r(#*)\".*?\"\4|[bc]?\"(?:[^\"\\]|\\.)*\")|(?P<char>b?'(?:[^'\\\n]|\\[^u]|\\u\{[^}]*\}|\\x..)')"
    r"|(?P<life>'\w+)|(?P<word>(?:r#)?[^\W\d]\w*)|(?P<num>\d\w*)|(?P<op>.)",
    re.S,
)
_ECMA = re.compile(
    r"(?P<line>\s*\n\s*)|(?P<skip>[^\S\n]+)|(?P<comment>//[^\n]*|/\*)|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<tick>`)"
    r"|(?P<word>[#]?[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|\+\+|--|.)",
    re.S,
)
_ECMA_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\\\]\n]|\\.)*\])+/\w*")
_ECMA_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_CONTROL = frozenset("if for while switch catch with function return typeof new await super import else do".split())


class _Scan:
    """Tokens as (kind, text, start, end, line break before), and partners of brackets."""

    def __init__(self, source: str, pattern: re.Pattern, regexes: bool):
        self.tokens: list[tuple[str, str, int, int, bool]] = []
        self.partner: dict[int, int] = {}
        self.comments: list[int] = []
        stack: list[int] = []
        at, fresh = 0, True
        while at < len(source):
            m = pattern.match(source, at)
            kind, end = m.lastgroup, m.end()
            if kind in ("skip", "line"):
                fresh = fresh or "\n" in m[0]
                at = end
                continue
            if kind == "comment":
                if m[0] == "/*":
                    end = _comment_end(source, end, not regexes)
                    fresh = fresh or "\n" in source[at:end]
                at = end
                continue
            if kind == "tick":
                kind, end = "str", _template_end(source, end)
            if regexes and m[0] == "/" and not (self.tokens and (self.tokens[-1][0] in ("num", "str") or self.tokens[-1][1] in ")]}" or (self.tokens[-1][0] == "word" and self.tokens[-1][1] not in _CONTROL))):
                r = _ECMA_REGEX.match(source, at)
                if r:
                    kind, end = "str", r.end()
            text = source[at:end]
            if kind == "op":
                if text in _PAIRS:
                    stack.append(len(self.tokens))
                elif text in ")]}":
                    if not stack or _PAIRS[self.tokens[stack[-1]][1]] != text:
                        raise ValueError("brackets")
                    self.partner[stack.pop()] = len(self.tokens)
            self.tokens.append((kind, text, at, end, fresh))
            fresh, at = False, end
        if stack:
            raise ValueError("brackets")


def _template_end(source: str, at: int) -> int:
    """The place behind a template string that opens before ``at``; expressions in it may hold strings and templates."""
    opened = [-1]  # -1 for a template, else the braces open in an expression
    while opened:
        if at >= len(source):
            raise ValueError("template")
        c = source[at]
        if opened[-1] < 0:
            if c == "\\":
                at += 1
            elif c == "`":
                opened.pop()
            elif source.startswith("${", at):
                opened.append(0)
                at += 1
        elif c == "`":
            opened.append(-1)
        elif c in "\"'" and (m := _ECMA_STRING.match(source, at)):
            at = m.end() - 1
        elif source.startswith("/*", at):
            at = _comment_end(source, at + 2, False) - 1
        elif c == "{":
            opened[-1] += 1
        elif c == "}":
            opened[-1] -= 1
            if opened[-1] < 0:
                opened.pop()
        at += 1
    return at


def _comment_end(source: str, at: int, nested: bool) -> int:
    depth = 1
    while depth:
        close = source.find("*/", at)
        if close < 0:
            raise ValueError("comment")
        inner = source.find("/*", at) if nested else -1
        if 0 <= inner < close:
            depth, at = depth + 1, inner + 2
        else:
            depth, at = depth - 1, close + 2
    return at


Span = tuple[int, int, str | None]


def _attribute_is_test(words: list[str]) -> bool:
    """Whether the tokens of an attribute mark a test: a path ending in test or bench, or cfg with a bare test."""
    path = [w for w in words if w not in ("(", ")")]
    head = []
    for w in words:
        if w == "(" or w == "=":
            break
        head.append(w)
    if not path:
        return False
    if head and head[-1] in ("test", "bench"):
        return True
    if head != ["cfg"]:
        return False
    nots: list[bool] = []
    for i, w in enumerate(words):
        if w == "(":
            nots.append(words[i - 1] == "not")
        elif w == ")":
            nots.pop()
        elif w == "test" and not (nots and nots[-1]) and (i + 1 == len(words) or words[i + 1] != "="):
            return True
    return False


def _rust(source: str) -> list[Span]:
    scan = _Scan(source, _RUST, False)
    t, partner = scan.tokens, scan.partner
    out: list[Span] = []

    def until(i: int, stop: str) -> int:
        """The first token from i in ``stop`` outside brackets; angle brackets don't nest."""
        while i < len(t) and t[i][1] not in stop:
            i = partner.get(i, i) + 1
        return i

    def walk(i: int, end: int) -> None:
        gated, start = False, -1
        while i < end:
            kind, word = t[i][0], t[i][1]
            if word == "#" and i + 1 < end and t[i + 1][1] in "[!":
                at = i + 1 if t[i + 1][1] == "[" else i + 2
                if at < end and at in partner:
                    inside = [x[1] for x in t[at + 1 : partner[at]] if x[0] in ("word", "op") and x[1] not in (":", ",")]
                    gated = gated or (t[i + 1][1] == "[" and _attribute_is_test(inside))
                    i, start = partner[at] + 1, -1
                    continue
            if kind == "word" and word in ("pub", "const", "async", "unsafe", "extern", "default") and start < 0:
                start = i
            stop = None
            if kind == "word" and word in ("fn", "struct", "enum", "trait", "impl") and i + 1 < end and (word == "impl" or t[i + 1][0] == "word"):
                body = until(i + 1, "{;")
                stop = partner.get(body, body)
                definition = body < end and not (word == "fn" and t[body][1] == ";")
            if stop is not None and stop < end:
                if not gated and definition:
                    first = start if start >= 0 else i
                    out.append((t[first][2], t[stop][3], t[i + 1][1] if word != "impl" else None))
                i, gated, start = stop + 1, False, -1
                continue
            group = i + 2 if word == "!" and i > 0 and t[i - 1][1] == "macro_rules" else i + 1
            if word == "!" and group < end and t[group][1] in _PAIRS:
                i = partner[group] + 1  # a macro's tokens are no items
                gated, start = False, -1
                continue
            if i in partner:
                if word == "{" and not gated:
                    walk(i + 1, partner[i])
                i = partner[i] + 1
                if word == "{":
                    gated, start = False, -1
                continue
            if word == ";":
                gated, start = False, -1
            i += 1

    walk(0, len(t))
    return out


def _ecma(source: str, typed: bool) -> list[Span]:
    scan = _Scan(source, _ECMA, True)
    t, partner = scan.tokens, scan.partner
    out: list[Span] = []
    variables = ("const", "let") if typed else ("const", "let", "var")

    def body(i: int, end: int) -> int:
        """The closing brace of the first braces from i outside other brackets, or -1."""
        while i < end:
            if t[i][1] == "{":
                return partner[i]
            if t[i][1] == ";":
                return -1
            i = partner.get(i, i) + 1
        return -1

    def statement_end(i: int, end: int) -> int:
        last = i
        while i < end:
            if t[i][1] == ";":
                return i
            if i > last and t[i][4] and t[last][1] not in "=,(+-*/%&|^?:<.!~" and t[last][1] != "=>" and t[i][1] not in "=,.)]}?:+-*/%&|^<>":
                return last
            last = partner.get(i, i)
            i = last + 1
        return last

    def starts(i: int, first: int) -> bool:
        before = t[i - 1] if i > first else None
        return before is None or t[i][4] or before[1] in ";{}" or before[1] in ("export", "default", "declare", "else", ")", "abstract", "async")

    def walk(i: int, end: int) -> None:
        first = i
        while i < end:
            kind, word = t[i][0], t[i][1]
            here, stop, name = i, -1, None
            if kind == "word" and starts(i, first) and (i == first or t[i - 1][1] != "."):
                at = i
                if word == "async" and i + 1 < end and t[i + 1][1] == "function":
                    at = i + 1
                if t[at][1] == "function" and at + 1 < end and t[at + 1][0] == "word":
                    stop, name = body(at + 1, end), t[at + 1][1]
                elif word == "class" and i + 1 < end and t[i + 1][0] == "word" and t[i + 1][1] != "extends" and (i == first or t[i - 1][1] != "abstract"):
                    stop, name = body(i + 1, end), t[i + 1][1]
                elif typed and word == "interface" and i + 1 < end and t[i + 1][0] == "word":
                    stop, name = body(i + 1, end), t[i + 1][1]
                elif word in variables and i + 1 < end and (t[i + 1][0] == "word" or t[i + 1][1] in "{["):
                    stop = statement_end(i + 1, end)
            if stop < 0 and kind == "word" and word not in _CONTROL and i + 1 < end and t[i + 1][1] == "(" and i > 0 and (t[i - 1][1] in "{};,*" or t[i - 1][1] in ("async", "get", "set", "static", "public", "private", "protected", "readonly", "override")):
                close = partner[i + 1]
                brace = close + 1
                while brace < end and t[brace][1] not in "{;,=" and not (t[brace][4] and t[brace][1] != "{"):
                    brace = partner.get(brace, brace) + 1
                if brace < end and t[brace][1] == "{" and (brace == close + 1 or t[close + 1][1] == ":"):
                    while here > first and t[here - 1][1] in ("async", "get", "set", "static", "public", "private", "protected", "readonly", "override", "*"):
                        here -= 1
                    stop, name = partner[brace], word
            if stop >= 0:
                out.append((t[here][2], t[stop][3], name))
                i = stop + 1
                continue
            if i in partner:
                walk(i + 1, partner[i])
                i = partner[i] + 1
                continue
            i += 1

    walk(0, len(t))
    return out


def _python(source: str) -> list[Span]:
    tree = ast.parse(source)
    starts = [0]
    for line in source.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    text_of = source.splitlines(keepends=True)

    def place(line: int, column: int) -> int:
        return starts[line - 1] + len(text_of[line - 1].encode()[:column].decode("utf-8", "ignore"))

    out: list[Span] = []

    def walk(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                out.append((place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset), child.name))
            else:
                walk(child)

    walk(tree)
    return out


def definitions(language: str, source: str) -> list[Chunk]:
    """Structural chunks in order; none where the source can't be read."""
    try:
        if language == "python":
            spans = _python(source)
        elif language == "rust":
            spans = _rust(source)
        else:
            spans = _ecma(source, language != "javascript")
    except (ValueError, SyntaxError, RecursionError, AttributeError):
        return []
    breaks = [i for i, c in enumerate(source) if c == "\n"]
    # offsets of the first line are counted from 1; an end is the line of the last character
    line = lambda at: bisect_right(breaks, at - 1) + 1
    return [Chunk(source[a:b], line(a), line(max(b - 1, a)), language, name) for a, b, name in spans]


def chunk_source(language: str | None, source: str, window: int = WINDOW) -> list[Chunk]:
    """Definitions; windows of lines in the language's name where there are none, and as ``text`` without a language."""
    if language is not None:
        found = definitions(language, source)
        if found:
            return found
    return [Chunk(text, a, b, language or "text") for a, b, text in windows_of(text_lines(source), window)]


def language_for_path(path: str) -> str | None:
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    return LANGUAGE_BY_EXTENSION.get(name.rpartition(".")[2]) if "." in name else None


def chunks_for_embedding(path: str, source: str, budget: int) -> tuple[list[Chunk], int]:
    """Chunks within the budget, and the bytes of the largest."""
    pieces = split_for_embedding(chunk_source(language_for_path(path), source), budget)
    return pieces, max((len(p.text.encode("utf-8", "surrogatepass")) for p in pieces), default=0)


def focus_pieces(chunks: list[Chunk], budget: int) -> list[tuple[Chunk, bool]]:
    """Pieces of each chunk with whether their chunk was split."""
    out = []
    for c in chunks:
        parts = split_chunk(c, budget)
        out += [(p, len(parts) > 1) for p in parts]
    return out


def chunked(df: DataFrame, path: str = "path", text: str = "text", window: int = WINDOW, max_bytes: int | None = None) -> DataFrame:
    """Each file's chunks: the other columns with ``chunk_index, start_line, end_line, language, symbol, text``.

    A null text has no chunks. With ``max_bytes`` no chunk is longer, except for a single wider character.
    """
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, at = [], []
            for i, (p, t) in enumerate(zip(pdf["_p"], pdf["_t"])):
                found = chunk_source(language_for_path(p or ""), t, window) if isinstance(t, str) else []
                for k, c in enumerate(split_for_embedding(found, max_bytes) if max_bytes else found):
                    at.append(i)
                    rows.append((k, c.start_line, c.end_line, c.language, c.symbol, c.text))
            out = pd.DataFrame(rows, columns=["chunk_index", "start_line", "end_line", "language", "symbol", text])
            yield pd.concat([pdf[keep].iloc[at].reset_index(drop=True), out], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    schema = f"{fields + ', ' if fields else ''}chunk_index long, start_line long, end_line long, language string, symbol string, `{text}` string"
    return df.withColumns({"_p": F.col(path), "_t": F.col(text)}).drop(text).mapInPandas(run, schema)


def outline(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Definitions by their first line: ``path, start_line, end_line, language, symbol, code, score, why_matched``."""
    from hearthdex.functions.text import first_line

    return chunked(df.select(F.col(path).alias("path"), F.col(text).alias("text"))).select(
        "path", "start_line", "end_line", "language", "symbol", first_line(F.col("text")).alias("code"),
        F.lit(0.0).alias("score"), F.lit("outline").alias("why_matched"),
    )


__all__ = ["CHUNKER_VERSION", "chunk_source", "chunked", "chunks_for_embedding", "definitions", "focus_pieces", "language_for_path", "language_of", "outline"]
