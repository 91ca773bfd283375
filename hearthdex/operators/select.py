"""Choosing entries by the shape of their scores and a budget of tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from hearthdex.functions.text import strip_banner, token_estimate


def entry_order() -> list[Column]:
    """Best score first, then path and first line."""
    return [F.desc("score"), F.asc("path"), F.asc("start_line")]


def ranked(entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``entries`` with ``rank`` from 1 in :func:`entry_order` within ``keys``."""
    return entries.withColumn("rank", F.row_number().over(W.partitionBy(*(keys or [F.lit(0)])).orderBy(*entry_order())))


def relevance_floor(entries: DataFrame, ratio: float = 0.75, keys: Sequence[str] = ()) -> DataFrame:
    """The best entry and all whose score reaches ``ratio`` (held within 0 and 1) of the best."""
    share = min(max(ratio, 0.0), 1.0)
    best = F.first("score").over(W.partitionBy(*(keys or [F.lit(0)])).orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return entries.withColumn("_best", best).where((F.col("rank") == 1) | (F.col("score") >= F.col("_best") * share)).drop("_best")


def token_budget(entries: DataFrame, budget: int = 4000, keys: Sequence[str] = ()) -> DataFrame:
    """Entries by rank that fit: the first always, then each that fits what is left; others are passed over.

    Groups are results of one query, a bounded number of rows.
    """
    group = list(keys) or [F.lit(0).alias("_all")]
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["kept"]) == 0) | (acc["used"] + x["cost"] <= budget)
        return F.struct(
            F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["kept"], F.array(x["rank"]))).otherwise(acc["kept"]).alias("kept"),
        )

    costs = F.array_sort(F.collect_list(F.struct("rank", token_estimate(F.col("code")).alias("cost"))))
    kept = entries.groupBy(*group).agg(F.aggregate(costs, zero, step)["kept"].alias("_kept")).select(*keys, F.explode("_kept").alias("rank"))
    return entries.join(kept, [*keys, "rank"], "left_semi")


def distilled(hits_merged: DataFrame, strip: bool = True, ratio: float = 0.75, budget: int = 4000, keys: Sequence[str] = ()) -> DataFrame:
    """Merged hits, stripped, ranked and chosen: the entries that answer a query."""
    clean = hits_merged.withColumn("code", strip_banner(F.col("code"), strip))
    chosen = token_budget(relevance_floor(ranked(clean, keys), ratio, keys), budget, keys)
    return chosen.withColumn("why_matched", why(F.col("score")))


def why(score: Column) -> Column:
    return F.format_string("similarity %.3f", score)


def focus_why(score: Column, partial: Column) -> Column:
    suffix = F.when(partial, " (partial: split to fit the embedding window)").otherwise("")
    return F.concat(F.format_string("focus similarity %.3f", score), suffix)


def rendered(entries: DataFrame) -> DataFrame:
    """``rank, block``: an entry as text, ``path:first-last [symbol] (why)`` over its code in a fence."""
    symbol = F.when(F.col("symbol").isNotNull(), F.concat(F.lit(" ["), "symbol", F.lit("]"))).otherwise("")
    head = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), symbol)
    block = F.concat(head, F.lit(" ("), "why_matched", F.lit(")\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), "code", F.lit("\n```\n\n"))
    return entries.select("rank", block.alias("block"))


def render(entries: DataFrame) -> str:
    """All blocks by rank; ``No matches.`` if there are none. A result of one query, bounded by its k."""
    return render_rows(entries.collect())


def render_rows(rows: Sequence[Row]) -> str:
    """The same blocks of rows that are on the driver already."""
    out = []
    for r in sorted(rows, key=lambda r: r["rank"]):
        symbol = f" [{r['symbol']}]" if r["symbol"] is not None else ""
        out.append(f"{r['path']}:{r['start_line']}-{r['end_line']}{symbol} ({r['why_matched']})\n```{r['language'] or ''}\n{r['code']}\n```\n\n")
    return "".join(out) or "No matches."
