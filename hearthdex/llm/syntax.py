"""Source files that are not valid in the language of their path."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from importlib.resources import files

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hearthdex.functions.paths import LANGUAGE_BY_EXTENSION, language_of
from hearthdex.llm import lexers
from hearthdex.operators.files import current_files
from hearthdex.llm.parsing import Parser, depth

def _grammar(name: str) -> str:
    return files("hearthdex.llm.grammars").joinpath(f"{name}.gram").read_text(encoding="utf-8")


def _word(text_of: dict, word: str):
    def soft(kinds: list[str], before: list[bool], p: int) -> int:
        return p + 1 if kinds[p] == "NAME" and text_of["at"](p) == word else -1

    soft.first = {"NAME"}
    return soft


class Language:
    """A lexer with a grammar; ``error`` gives the place of the first error, or -1."""

    def error(self, text: str) -> int:
        raise NotImplementedError


class Python(Language):
    def __init__(self) -> None:
        self._now: dict = {"at": None}
        soft = {f"soft_{w}": _word(self._now, w) for w in ("match", "case", "type")}
        self.parser = Parser(_grammar("python"), "file", soft)

    def error(self, text: str) -> int:
        tokens = lexers.python_tokens(text)
        text = text.removeprefix("\ufeff")
        if "BAD" in tokens.kinds[-2:]:
            return tokens.places[-2]
        places, n = tokens.places, len(text)

        def at(p: int) -> str:
            start = places[p]
            end = start
            while end < n and (text[end].isalnum() or text[end] == "_"):
                end += 1
            return text[start:end]

        self._now["at"] = at
        p = self.parser.parse(tokens.kinds, tokens.before)
        return -1 if p < 0 else tokens.places[p]


class Rust(Language):
    """The grammar's second list holds each opening bracket's partner."""

    def __init__(self) -> None:
        self._now: dict = {"at": None}

        def attribute(kinds: list[str], partner: list[int], p: int) -> int:
            return partner[p + 1] + 1 if kinds[p] == "#" and kinds[p + 1] == "[" else -1

        def inner_attribute(kinds: list[str], partner: list[int], p: int) -> int:
            return partner[p + 2] + 1 if kinds[p] == "#" and kinds[p + 1] == "!" and kinds[p + 2] == "[" else -1

        def group(kinds: list[str], partner: list[int], p: int) -> int:
            return partner[p] + 1 if kinds[p] in ("(", "[", "{") else -1

        def word(wanted: str):
            def soft(kinds: list[str], partner: list[int], p: int) -> int:
                return p + 1 if kinds[p] == "IDENT" and self._now["text"].startswith(wanted, self._now["places"][p]) and kinds[p + 1] in FOLLOW[wanted] else -1

            soft.first = {"IDENT"}
            return soft

        attribute.first, inner_attribute.first, group.first = {"#"}, {"#"}, {"(", "[", "{"}

        natives = {
            "attribute": attribute, "inner_attribute": inner_attribute, "group": group,
            "back": lambda kinds, partner, p: p - 1,
            "no_block_ns": lambda kinds, partner, p: -1 if kinds[p] == "{" else p,
            "no_block": lambda kinds, partner, p: p,
        }
        natives |= {f"word_{w}": word(w) for w in FOLLOW}
        self.parser = Parser(expanded(_grammar("rust")), "file", natives)

    def error(self, text: str) -> int:
        tokens, partner = lexers.rust_tokens(text)
        if tokens.kinds[-2:-1] == ["BAD"]:
            return tokens.places[-2]
        self._now |= {"text": text, "places": tokens.places}
        p = self.parser.parse(tokens.kinds, partner)
        return -1 if p < 0 else tokens.places[p]


#: What may follow a word that is a keyword only there. Fixed values.
FOLLOW = {
    "default": ("fn", "const", "async", "unsafe", "extern", "impl", "type"),
    "safe": ("fn", "static", "extern"),
    "union": ("IDENT",),
    "auto": ("trait",),
    "macro_rules": ("!",),
    "raw": ("const", "mut"),
}


def expanded(text: str) -> str:
    """Rules between %for and %end twice: with the ending given there in place of @@, and without."""
    out, block, ending = [], None, ""
    for line in text.splitlines():
        if line.startswith("%for"):
            block, ending = [], line.split()[1]
        elif line.startswith("%end"):
            out += [x.replace("@@", e) for e in ("", ending) for x in block]
            block = None
        elif block is not None:
            block.append(line)
        else:
            out.append(line)
    return "\n".join(out)


class Ecma(Language):
    """JavaScript or TypeScript; a file may be a module or a script."""

    def __init__(self, typed: bool, jsx: bool):
        self.typed, self.jsx = typed, jsx
        mine, other = ("ts|", "js|") if typed else ("js|", "ts|")
        lines = [x.removeprefix(mine) for x in _grammar("ecma").splitlines() if not x.startswith(other)]
        now = self._now = {"partner": [], "awaits": None}

        def semi(kinds: list[str], before: list[bool], p: int) -> int:
            kind = kinds[p]
            return p + 1 if kind == ";" else p if before[p] or kind in ("}", "EOF") else -1

        def same(kinds: list[str], before: list[bool], p: int) -> int:
            return -1 if before[p] else p

        def arrow_ahead(kinds: list[str], before: list[bool], p: int) -> int:
            if kinds[p] != "(":
                return -1
            return p if kinds[now["partner"][p] + 1] in (("=>", ":") if typed else ("=>",)) else -1

        def function_ahead(kinds: list[str], before: list[bool], p: int) -> int:
            return p if kinds[p] == "(" and kinds[now["partner"][p] + 1] == "=>" else -1

        def target(kinds: list[str], before: list[bool], p: int) -> int:
            return -1 if kinds[p - 1] in ("NUMBER", "STRING", "REGEX", "TEND", "++", "--", "true", "false", "null") else p

        def require(kinds: list[str], before: list[bool], p: int) -> int:
            return p + 1 if kinds[p] == "require" else -1

        def await_name(kinds: list[str], before: list[bool], p: int) -> int:
            """``await`` as a name: in a script, outside async functions."""
            if kinds[p] != "await":
                return -1
            if now["awaits"] is None:
                now["awaits"] = [(0, len(kinds), True)] if module(kinds) else awaiting(kinds, now["partner"])
            around = [asynchronous for a, b, asynchronous in now["awaits"] if a <= p <= b]
            return -1 if around and around[-1] else p + 1

        require.first, await_name.first = {"require"}, {"await"}
        natives = {
            "semi": semi, "same": same, "arrow_ahead": arrow_ahead, "target": target, "never": lambda kinds, before, p: -1, "await_name": await_name,
        }
        if typed:
            natives |= {
                "function_ahead": function_ahead,
                "line_or_close": lambda kinds, before, p: p if before[p] or kinds[p] == "}" else -1,
                "word_require": require,
            }
        self.parser = Parser("\n".join(lines), "file", natives)

    def error(self, text: str) -> int:
        first = -1
        # a script may hold the comments of HTML, which are operators in a module
        for html in (False, True) if not self.typed and ("<!--" in text or "-->" in text) else (False,):
            for after in (frozenset(), frozenset({"}"}), frozenset({")", "}"})):
                tokens, partner, doubtful = lexers.ecma_tokens(text, self.typed, self.jsx, after, html)
                if tokens.kinds[-2:-1] == ["BAD"]:
                    place = tokens.places[-2]
                elif html and module(tokens.kinds):
                    break
                else:
                    self._now |= {"partner": partner, "awaits": None}
                    p = self.parser.parse(tokens.kinds, tokens.before)
                    if p < 0:
                        marker = lexers._MARKER.search(text)
                        return -1 if marker is None or marker.start() not in set(tokens.places) else marker.start()
                    place = tokens.places[p]
                first = place if first < 0 else first
                if not doubtful:
                    break
        return first


def module(kinds: list[str]) -> bool:
    """Whether a file exports something or imports by a declaration."""
    return any(k == "export" or k == "import" and kinds[i + 1] not in ("(", ".") for i, k in enumerate(kinds))


def awaiting(kinds: list[str], partner: list[int]) -> list[tuple[int, int, bool]]:
    """``first, last, async`` of the tokens of each function's body, outer ones first."""
    opening = {c: o for o, c in enumerate(partner) if c >= 0}
    out = []
    for i, k in enumerate(kinds):
        if k == "=>":
            start = opening[i - 1] if kinds[i - 1] == ")" else i - 1
            end = i + 1
            while kinds[end] not in (",", ";", ")", "]", "}", "EOF"):
                end = max(end, partner[end]) + 1
            out.append((i + 1, partner[i + 1] if kinds[i + 1] == "{" else end, kinds[start - 1] == "async"))
        elif k == "function" or k == "async" and kinds[i + 1] not in ("function", "=>"):
            at = i + 1
            while kinds[at] not in ("(", "EOF", ";", "="):
                at += 1
            body = partner[at] + 1 if kinds[at] == "(" else 0
            if kinds[body] == "{" and body:
                out.append((body, partner[body], k == "async" or kinds[i - 1] == "async"))
    return sorted(out)


LANGUAGES = {
    "python": Python,
    "rust": Rust,
    "javascript": lambda: Ecma(False, True),
    "typescript": lambda: Ecma(True, False),
    "tsx": lambda: Ecma(True, True),
}


@cache
def language(name: str) -> Language:
    return LANGUAGES[name]()


def first_error(path: str, text: str) -> tuple[str, int] | None:
    """Language and line (from 1) of the first error by the path's language; None if there is none or no grammar."""
    name = LANGUAGE_BY_EXTENSION.get(path.rsplit("/", 1)[-1].rpartition(".")[2]) if "." in path else None
    if name is None:
        return None
    with depth(4 * len(text)):  # strings and elements nest in the lexers
        place = language(name).error(text)
    return None if place < 0 else (name, 1 + text.count("\n", 0, place))


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        lines = [x[1] if (x := first_error(p, t or "")) else 0 for p, t in zip(pdf["path"], pdf["text"])]
        yield pdf[["repo", "path", "language"]].assign(line=pd.Series(lines, dtype="int64", index=pdf.index))


def parsed_files(chunks: DataFrame) -> DataFrame:
    """``repo, path, language, line`` of each file with a grammar; ``line`` is that of the first error, else 0.

    The language is that of the path's extension; files of other extensions have no row.
    Whole current texts are parsed, however deep they are nested. An empty text is valid.
    """
    rows = chunks.select("repo", "path", "chunk_index", "text", "indexed_at").where(language_of(F.col("path")).isNotNull())
    return (
        current_files(rows).withColumn("language", language_of(F.col("path")))
        .mapInPandas(_parse, "repo string, path string, language string, line long")
    )


def invalid_files(chunks: DataFrame) -> DataFrame:
    """The rows of :func:`parsed_files` with an error."""
    return parsed_files(chunks).where("line > 0")


def invalid_rates(chunks: DataFrame) -> DataFrame:
    """``repo, language, files, invalid, rate`` over all files with a grammar."""
    return parsed_files(chunks).groupBy("repo", "language").agg(
        F.count("*").alias("files"), F.count_if(F.col("line") > 0).alias("invalid"), F.round(F.avg((F.col("line") > 0).cast("int")), 6).alias("rate")
    )
