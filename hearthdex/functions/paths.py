"""Path and digest spellings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Extension to language name; matching is case-sensitive. Fixed values.
LANGUAGE_BY_EXTENSION = {
    "rs": "rust",
    "py": "python",
    "js": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "tsx",
}


def clean_path(path: Column) -> Column:
    """The shortest spelling of a repo-relative path, with ``/``.

    Backslashes count as separators; empty and ``.`` segments vanish and ``..``
    takes back the segment before it (at the root it has nothing to take back and
    vanishes). Null stays null, a path of no segments becomes the empty string.
    Paths that are clean already skip the segment fold.
    """
    slashed = F.translate(path, "\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            x == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return (
        F.when(path.isNull(), None)
        .when(slashed.rlike(r"(^|/)\.\.(/|$)"), F.array_join(folded, "/"))
        .when(slashed.rlike(r"(^|/)\.(/|$)|//|^/|/$"), F.array_join(parts, "/"))
        .otherwise(slashed)
    )


def relative_path(path: Column, root: str) -> Column:
    """``path`` without the prefix ``root`` and with ``/`` as separator."""
    slashed = F.translate(path, "\\", "/")
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(slashed.startswith(prefix), F.substr(slashed, F.lit(len(prefix) + 1))).otherwise(slashed)


def clean_digest(digest: Column) -> Column:
    """A hex digest in lower case without algorithm prefix, ``0x`` or blanks.

    Null and blank digests become null.
    """
    bare = F.regexp_replace(F.lower(F.trim(digest)), r"^[a-z0-9_-]+[:=]|^0x", "")
    return F.nullif(F.regexp_replace(bare, r"[\s-]+", ""), F.lit(""))


def packed_digest(digest: Column) -> Column:
    """:func:`clean_digest` as bytes; what is no hex keeps its characters."""
    clean = clean_digest(digest)
    return F.coalesce(F.try_to_binary(clean, F.lit("hex")), F.encode(clean, "UTF-8"))


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty where there is none."""
    return F.regexp_extract(path, r"\.([^./\\]+)$", 1)


def language_of(path: Column) -> Column:
    """Language by the case-sensitive extension, else null."""
    ext = extension(path)
    out = None
    for suffix, language in LANGUAGE_BY_EXTENSION.items():
        out = F.when(ext == suffix, language) if out is None else out.when(ext == suffix, language)
    return out
