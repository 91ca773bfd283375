"""Source files that nobody wrote by hand in their repository.

Four signs, each with its reason:

- ``vendored``: the file lies in a directory kept for third-party code, or in a subtree
  that unrelated repositories share (equal Merkle digests, computed bottom-up), or is
  essentially a known third-party file (shared five-word shingles).
- ``generated``: its leading comment says so, or its lines repeat a few templates.
- ``minified``: hardly any blanks, or nearly all names are one or two letters.
- ``data``: most of it is literals.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hearthdex.operators.files import current_files
from hearthdex.session import materialized

#: Directories kept for third-party code. Fixed values. ``deps`` and ``external`` count
#: only if the file is in a directory below.
THIRD_PARTY = (
    "vendor", "_vendor", "vendored", "_vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "3rd-party",
    "node_modules", "bower_components", "jspm_packages", "site-packages", "pods", "carthage",
)
THIRD_PARTY_BELOW = ("deps", "external", "externals", "extern")

#: Words of a leading comment that say that a tool wrote the file. Fixed values.
GENERATED_WORDS = (
    r"@generated\b|<auto-?generated|\bauto-?\s?generated\b|\bautomatically (?:generated|created|produced)\b|\bgenerated (?:by|from|with|using) "
    r"|\b(?:machine|tool)[- ](?:written|generated|made)\b|\bdo not (?:edit|modify|change)\b|\b(?:edits?|changes) (?:are|will be) (?:overwritten|lost)\b"
    r"|\bbegin emitted code\b|\bcompiled (?:by|from|with) |\bautomatisch (?:erzeugt|generiert)\b|\bnicht (?:bearbeiten|ändern)\b"
    r"|\bgénéré (?:par|automatiquement)\b|\bne pas (?:modifier|éditer)\b|\bgenerado (?:por|automáticamente)\b|\bno (?:editar|modificar)\b"
    r"|自动生成|自動生成|請勿修改|请勿修改|編集しないで"
)
_GENERATED = re.compile(GENERATED_WORDS, re.I)
#: Words of the same comment that say the opposite: it is about such files.
_ABOUT = re.compile(r"\b(?:writer|writes|emits|emitter|puts|adds|strips|removes|detects|looks for|checks|skips|ignores|prints) ", re.I)

CODE = frozenset({"rs", "py", "js", "jsx", "ts", "tsx", "mjs", "cjs"})
STYLE = frozenset({"css"})

#: Lines that a repeating file must have; part of its three-line windows of templates that come
#: again, less where the file is named like output; and the most distinct templates to lines.
LEAST_LINES, REPEATED, REPEATED_NAMED, DISTINCT = 6, 0.55, 0.4, 0.4
#: Names and directories of output. Fixed values.
OUTPUT_NAME = r"(?:_pb2|_pb2_grpc|_gen|_generated|\.gen|\.generated|\.g|\.pb)\.\w+$|(?:^|/)(?:generated|gen|__generated__|autogen|build/out|dist)/"
_OUTPUT = re.compile(OUTPUT_NAME)
#: Characters that a minified file must have, blanks to characters, names of up to two letters to names.
LEAST_CHARACTERS, BLANKS, SHORT_NAMES, LEAST_NAMES = 60, 0.06, 0.75, 10
#: Literals to characters, and the characters that a block of data must have.
LITERALS, LEAST_DATA = 0.45, 120
#: Words in a shingle, and the similarity to a known file.
SHINGLE, SIMILAR = 5, 0.8
#: Shingles of known files up to which their index goes to every task (16 bytes each); beyond it files meet them by a join.
KNOWN = 4_000_000
#: Files and repositories of a shared subtree.
SHARED_FILES, SHARED_REPOS = 2, 3
#: Values drawn from the contents of a repository, by which related ones are told.
DRAWS = 16

_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`\\]*`')
_COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*", re.S)
_HASHES = re.compile(r"(?m)^\s*#(?![!\[]).*$")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"\b\d[\w.]*")
_NUMBERS = re.compile(r"-?\b\d[\w.]*")
_WORD = re.compile(r"\w+")
_KEYWORDS = frozenset(
    "def class return if else elif for while in not and or import from as with try except raise pass lambda yield fn pub let mut impl struct "
    "enum use match mod const static where crate self function var new this typeof export interface type extends async await switch case "
    "break continue default throw catch finally public private readonly do is of null true false None True False".split()
)


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def in_third_party(path: str) -> bool:
    parts = [p.lower() for p in path.split("/")[:-1]]
    return any(p in THIRD_PARTY for p in parts) or any(p in THIRD_PARTY_BELOW for p in parts[:-1])


def leading_comment(text: str) -> str:
    """The comment lines before the first line of code."""
    out, inside = [], False
    for line in text.lstrip("﻿").split("\n"):
        bare = line.strip()
        if inside or bare.startswith("/*") or bare.startswith("<!--"):
            inside = "*/" not in bare and "-->" not in bare
        elif bare and not bare.startswith(("//", "--")) and not (bare.startswith("#") and not bare.startswith("#[")):
            break
        out.append(bare)
    return "\n".join(out)


_QUOTED = re.compile(r"\"[^\"\n]*\"|`[^`\n]*`|“[^”\n]*”|(?<!\w)'[^'\n]*'(?!\w)")
_SENTENCE = re.compile(r"(?<=[.!?;:。])\s+")
_MARGIN = re.compile(r"^[/*#!<>;\-\s]+")


def says_generated(text: str) -> bool:
    """Whether a paragraph of the leading comment says so, before any sentence in it that is about such files.

    What stands in quotes is neither.
    """
    paragraph: list[str] = []
    for line in [*leading_comment(text).split("\n"), ""]:
        bare = _MARGIN.sub("", line)
        # a marker like <auto-generated> is no margin
        bare = line.lstrip("/*#!; \t") if "<auto" in line.lower() else bare
        if bare:
            paragraph.append(bare)
            continue
        if paragraph:
            for sentence in _SENTENCE.split(_QUOTED.sub(" ", "\n".join(paragraph)).replace("\n", " ")):
                if _ABOUT.search(sentence + " "):
                    break
                if _GENERATED.search(sentence + " "):
                    return True
        paragraph = []
    return False


def foreign(text: str, ext: str) -> bool:
    """A script or settings file under the name of another language; such files repeat by nature."""
    if text.startswith("#!"):
        first = text.split("\n", 1)[0]
        return not (("python" in first and ext == "py") or ("node" in first and ext in CODE) or ("deno" in first and ext in CODE))
    lines = [x for x in text.split("\n") if x.strip()]
    yaml = sum(bool(re.match(r"\s*- [\w-]+:(\s|$)|\s*[\w-]+:\s*[|>]?\s*\S*$", x)) for x in lines)
    return any(x.startswith("- ") for x in lines) and yaml > 0.5 * len(lines)


def layout(text: str, ext: str) -> dict:
    """What the layout says: repeated templates, blanks, short names, literals."""
    bare = _HASHES.sub("", text) if ext in ("py", "toml", "yaml") else _COMMENT.sub("", text)
    strings = _STRING.findall(bare)
    rest = _STRING.sub("S", bare)
    numbers = _NUMBERS.findall(rest)
    names = _NAME.findall(_NUMBER.sub("0", rest))
    own = [x for x in names if x not in _KEYWORDS and x != "S"]
    shaped = re.sub(r"[ \t\r]+", "", _NAME.sub("n", _NUMBER.sub("0", rest)))
    lines = [x for x in shaped.split("\n") if x]
    windows = Counter(zip(lines, lines[1:], lines[2:]))
    all_ = sum(windows.values())
    long = [x for x in lines if len(x) > 3]
    return {
        "lines": len(lines),
        "repeated": sum(n for n in windows.values() if n > 1) / all_ if all_ else 0.0,
        "distinct": len(set(long)) / len(long) if long else 1.0,
        "blanks": (len(text) - len("".join(text.split()))) / max(1, len(text)),
        "short": sum(len(x) <= 2 or (len(x) <= 3 and x[-1].isdigit()) for x in own) / max(1, len(own)),
        "names": len(own),
        # separators belong to the list of literals that they part
        "literals": (sum(map(len, strings)) + sum(map(len, numbers)) + sum(c in "," for c in rest)) / max(1, len("".join(bare.split()))),
    }


def verdict(path: str, text: str) -> str | None:
    """Reason by path, comment and layout, or None."""
    if in_third_party(path):
        return "vendored"
    ext = extension(path)
    if ext not in CODE and ext not in STYLE or not text.strip():
        return None
    if says_generated(text):
        return "generated"
    x = layout(text, ext)
    if len(text) >= LEAST_CHARACTERS and x["blanks"] < BLANKS and x["literals"] < LITERALS:
        return "minified"
    if ext in STYLE:
        return "minified" if len(text) >= LEAST_CHARACTERS and x["blanks"] < BLANKS else None
    if foreign(text, ext):
        return None
    if len(text) >= LEAST_DATA and x["literals"] >= LITERALS:
        return "data"
    if len(text) >= LEAST_DATA and text.lstrip()[:1] in "{[":
        try:
            json.loads(text)
            return "data"
        except ValueError:
            pass
    if len(text) >= LEAST_CHARACTERS and x["names"] >= LEAST_NAMES and x["short"] >= SHORT_NAMES:
        return "minified"
    least = REPEATED_NAMED if _OUTPUT.search(path) else REPEATED
    if x["lines"] >= LEAST_LINES and x["repeated"] >= least and x["distinct"] <= DISTINCT:
        return "generated"
    return None


_words: dict[str, int] = {}


def shingles(text: str) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of SHINGLE words; a shorter text is one run."""
    words = _WORD.findall(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_words) > 500_000:
        _words.clear()
    known = _words
    numbers = []
    for w in words:
        n = known.get(w)
        if n is None:
            raw = w.encode("utf-8", "surrogatepass")
            n = known[w] = zlib.crc32(raw) << 32 | zlib.adler32(raw)
        numbers.append(n)
    h = np.array(numbers, dtype=np.uint64)
    k = min(SHINGLE, len(h))
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(out)


class Known:
    """Known texts by their shingles: for each shingle the texts that have it."""

    def __init__(self, shingled: list[np.ndarray]):
        self.size = np.array([len(x) for x in shingled], dtype=np.int64)
        marks = np.concatenate([*shingled, np.zeros(0, dtype=np.uint64)]).astype(np.uint64)
        order = np.argsort(marks, kind="stable")
        self.marks, self.owner = marks[order], np.repeat(np.arange(len(shingled), dtype=np.int32), self.size)[order]

    def holds(self, own: np.ndarray) -> bool:
        """Whether one of the texts is essentially that with these distinct shingles."""
        if not len(own) or not len(self.marks):
            return False
        start, end = np.searchsorted(self.marks, own), np.searchsorted(self.marks, own, side="right")
        count = end - start
        met = self.owner[np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())]
        both = np.bincount(met, minlength=len(self.size))
        return bool(alike(both, len(own), self.size).any())


def alike(both, one, other):
    """Of numbers of shingles: most of the smaller set is shared, and much of all."""
    return (both >= SIMILAR * np.minimum(one, other)) & (both >= SIMILAR * SIMILAR * (one + other - both)) & (both > 0)


def _signs(known, with_marks: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = known.value if known else None
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            marks = [shingles(t) for t in texts] if index is not None or with_marks else [np.zeros(0, dtype=np.uint64)] * len(texts)
            out = pdf[["repo", "path", "d1", "d2"]].assign(
                reason=[verdict(p, t) for p, t in zip(pdf["path"], texts)], copy=[bool(index and index.holds(m)) for m in marks]
            )
            yield out.assign(marks=[m.view(np.int64) if with_marks else np.zeros(0, dtype=np.int64) for m in marks])

    return run


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        marks = [shingles(t or "").view(np.int64) for t in pdf["text"]]
        yield pd.DataFrame({"size": [len(m) for m in marks], "marks": marks})


def signs(files: DataFrame, upstream: DataFrame, known: int = KNOWN) -> DataFrame:
    """``repo, path, d1, d2, reason, copy``: digests of each file, what it says itself, and whether it is a known text.

    All shingles of a file are held against all of all known texts. Up to ``known``
    shingles those are an index that goes to every task; else both meet by a join.
    """
    spark = files.sparkSession
    rows = files.select("repo", "path", "text", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit("second"), "text").alias("d2"))
    marks = materialized(upstream.select("text").mapInPandas(_marks, "size long, marks array<long>").where("size > 0"), "known")
    schema = "repo string, path string, d1 long, d2 long, reason string, copy boolean, marks array<long>"
    if (marks.agg(F.sum("size")).first()[0] or 0) <= known:
        index = spark.sparkContext.broadcast(Known([np.array(r["marks"], dtype=np.int64).view(np.uint64) for r in marks.select("marks").toLocalIterator()]))
        return materialized(rows.mapInPandas(_signs(index, False), schema).drop("marks"), "signs")
    own = materialized(rows.mapInPandas(_signs(None, True), schema), "signs")
    # a known text is named by its place, and each mark's texts stand in one row
    held = marks.withColumn("id", F.monotonically_increasing_id()).select("id", "size", F.explode("marks").alias("mark"))
    held = materialized(held, "held")
    both = (
        own.select("repo", "path", F.size("marks").alias("own"), F.explode("marks").alias("mark")).join(held, "mark")
        .groupBy("repo", "path", "id").agg(F.count("*").alias("both"), F.first("own").alias("own"), F.first("size").alias("size"))
    )
    fits = (F.col("both") >= SIMILAR * F.least("own", "size")) & (F.col("both") >= SIMILAR * SIMILAR * (F.col("own") + F.col("size") - F.col("both")))
    copies = both.where(fits).select("repo", "path", F.lit(True).alias("met")).distinct()
    return own.drop("marks", "copy").join(copies, ["repo", "path"], "left").withColumn("copy", F.coalesce("met", F.lit(False))).drop("met")


def shared_subtrees(leaves: DataFrame, least_files: int = SHARED_FILES, least_repos: int = SHARED_REPOS) -> DataFrame:
    """``repo, dir`` of the directories whose whole content unrelated repositories share.

    ``leaves`` has ``repo, path, d1, d2``. Digests go bottom-up: a directory's is made of the names and digests of its
    entries, without its own name; empty files don't count as files of it. Only directories without a file that too few repositories have are
    built up, so levels end where no directory has a partner. Repositories that have most of their contents in
    common, like forks, are related and count as about one: of DRAWS smallest values over the contents
    of each, how many different ones the sharing repositories have tells how many they are.
    """
    nodes = leaves.select("repo", F.split("path", "/").alias("parts"), "d1", "d2").withColumn("depth", F.size("parts"))
    wide = leaves.groupBy("d1", "d2").agg(F.count_distinct("repo").alias("repos")).where(F.col("repos") >= least_repos).select("d1", "d2")
    nodes = materialized(nodes.join(wide.withColumn("wide", F.lit(True)), ["d1", "d2"], "left"), "leaves")
    above = F.explode(F.when(F.col("depth") > 1, F.sequence(F.lit(1), F.col("depth") - 1)))
    own = nodes.where("wide is null").select("repo", "parts", above.alias("k")).select("repo", F.slice("parts", F.lit(1), F.col("k")).alias("parts"))
    own = materialized(own.distinct(), "own")  # directories with a file of few repositories
    alive = nodes.where("wide and depth > 1").withColumn("dir", F.slice("parts", F.lit(1), F.col("depth") - 1))
    alive = alive.join(own.withColumnRenamed("parts", "dir"), ["repo", "dir"], "left_anti").select("repo", "parts", "d1", "d2", "depth", F.when(F.col("d1") == F.xxhash64(F.lit("")), 0).otherwise(1).cast("long").alias("n"))
    alive = materialized(alive, "alive")
    deepest = alive.agg(F.max("depth")).first()[0] or 0
    below, levels = None, []
    for depth in range(deepest, 1, -1):
        here = alive.where(F.col("depth") == depth).drop("depth")
        if below is not None:
            here = here.unionByName(below)
        name = F.element_at("parts", -1)
        below = here.groupBy("repo", F.slice("parts", 1, depth - 1).alias("parts")).agg(
            F.bit_xor(F.xxhash64(name, "d1", "d2")).alias("d1"), F.bit_xor(F.xxhash64("d2", name, "d1")).alias("d2"), F.sum("n").alias("n")
        ).join(own, ["repo", "parts"], "left_anti").select("repo", "parts", "d1", "d2", "n")
        below = materialized(below, "level")  # else each level's plan would hold all below it
        levels.append(below)
    if not levels:
        return nodes.select("repo", F.lit("").alias("dir")).limit(0)
    dirs = levels[0]
    for level in levels[1:]:
        dirs = dirs.unionByName(level)
    dirs = dirs.where(F.col("n") >= least_files).select("repo", F.array_join("parts", "/").alias("dir"), "d1", "d2", "n")
    key = ["d1", "d2", "n"]
    common = dirs.groupBy(*key).agg(F.count_distinct("repo").alias("repos")).where(F.col("repos") >= least_repos).select(*key)
    common = materialized(dirs.join(common, key, "left_semi"), "common")
    drawn = leaves.groupBy("repo").agg(F.array(*[F.min(F.xxhash64(F.lit(i), "d1", "d2")) for i in range(DRAWS)]).alias("drawn"))
    unrelated = (
        common.select("repo", *key).distinct().join(drawn, "repo").select(*key, F.posexplode("drawn").alias("i", "value"))
        .groupBy(*key, "i").agg(F.count_distinct("value").alias("values"))
        .groupBy(*key).agg(F.avg("values").alias("about")).where(F.col("about") > least_repos / 2).select(*key)
    )
    return common.join(unrelated, key, "left_semi").select("repo", "dir").distinct()


def not_handwritten(chunks: DataFrame, upstream: DataFrame) -> DataFrame:
    """``repo, path, reason`` of each file not written by hand in its repository.

    Files are those of :func:`current_files`. ``upstream`` has known third-party
    texts; it may be empty. Of several reasons the first of the module's list counts.
    Texts are compared whole; empty and blank files come out only by their path.
    """
    each = signs(current_files(chunks), upstream)
    shared = shared_subtrees(each.select("repo", "path", "d1", "d2"))
    above = each.select("repo", "path", F.split("path", "/").alias("parts")).select(
        "repo", "path", F.explode(F.when(F.size("parts") > 1, F.sequence(F.lit(1), F.size("parts") - 1))).alias("k"), "parts"
    )
    inside = (
        above.select("repo", "path", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("dir"))
        .join(shared, ["repo", "dir"], "left_semi").select("repo", "path").distinct().withColumn("shared", F.lit(True))
    )
    return (
        each.select("repo", "path", "reason", "copy").join(inside, ["repo", "path"], "left")
        .withColumn("reason", F.when(F.col("copy") | F.col("shared"), "vendored").otherwise(F.col("reason")))
        .where("reason is not null").select("repo", "path", "reason")
    )
