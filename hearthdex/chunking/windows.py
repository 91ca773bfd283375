"""Overlapping windows of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthdex.functions.text import lines

#: Lines of a window.
WINDOW = 80


def line_windows(df: DataFrame, text: str = "text", window: int = WINDOW, language: str = "text") -> DataFrame:
    """Each row once per window of its text, with ``chunk_index, start_line, end_line, language, symbol, text``.

    A window steps on by its length less a fifth. The closed form gives all windows at
    once: one if the text has no more lines than a window, none if it has none.
    """
    size = max(window, 1)
    step = max(size - size // 5, 1)
    n = F.size("_lines")
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step)).cast("int")
    start = F.col("_i") * step
    return (
        df.withColumn("_lines", lines(F.coalesce(F.col(text), F.lit(""))))
        .where(F.size("_lines") > 0)
        .select("*", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
        .withColumns(
            {
                "chunk_index": F.col("_i").cast("long"),
                "start_line": (start + 1).cast("long"),
                "end_line": F.least(start + size, n).cast("long"),
                "language": F.lit(language),
                "symbol": F.lit(None).cast("string"),
                text: F.array_join(F.slice("_lines", start + 1, F.lit(size)), "\n"),
            }
        )
        .drop("_lines", "_i")
    )


def windows_of(lines_: list[str], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """The same windows of a list of lines: first line, last line, text."""
    size = max(window, 1)
    step = max(size - size // 5, 1)
    out, start = [], 0
    while start < len(lines_):
        end = min(start + size, len(lines_))
        out.append((start + 1, end, "\n".join(lines_[start:end])))
        if end == len(lines_):
            break
        start += step
    return out
