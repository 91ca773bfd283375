"""Line and text functions as column expressions. ``lines`` follows the rule: split at \\n, drop one \\r per line, no phantom last line."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lines(text: Column) -> Column:
    """Lines of a text without their ends; the empty text has none, null stays null."""
    parts = F.split(text, "\n")
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.when(x.endswith("\r"), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x))


def first_line(text: Column) -> Column:
    """The first line without its end, empty for an empty text."""
    return F.regexp_replace(F.substring_index(text, "\n", 1), r"\r\z", "")


def strip_banner(text: Column, strip: bool = True) -> Column:
    """Lines without leading blank or comment lines (if ``strip``), each without trailing blanks.

    A leading line goes if it is blank or begins with ``//``, ``#``, ``/*`` or ``*`` after
    blanks. Blanks are those of Unicode.
    """
    out = F.regexp_replace(text, r"\n\z", "")
    if strip:
        out = F.regexp_replace(out, r"(?U)\A(?:[^\S\n]*(?:(?://|#|/\*|\*)[^\n]*)?(?:\n|\z))+", "")
    return F.regexp_replace(out, r"(?U)[^\S\n]+(?=\n|\z)", "")


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def byte_length(text: Column) -> Column:
    """Bytes in UTF-8."""
    return F.octet_length(text)


def excerpt(text: Column, most: int = 300) -> Column:
    """At most ``most`` characters, with an ellipsis if some are left out."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)
