"""Exact nearest vectors by cosine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from hearthdex.functions.vectors import cosine, literal

#: Query vectors that one pass over the table answers.
BLOCK = 4096


def nearest(df: DataFrame, query: Sequence[float], k: int = 25, vector: str = "vector", ties: Sequence[str] = ("path", "chunk_index")) -> DataFrame:
    """The k best rows with ``score``, without the vector; ties by ``ties``.

    One pass that keeps k rows a task (no full sort). k is one at least. Rows whose
    vector is null, zero, NaN or of another length rank last with -2.
    """
    scored = df.withColumn("score", cosine(F.col(vector), literal(query))).drop(vector)
    return scored.orderBy(F.desc("score"), *[F.asc(t) for t in ties]).limit(max(1, k))


def nearest_many(
    df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, digits: int = 6
) -> DataFrame:
    """``query_id, neighbour_id, score, rank`` for each row of ``queries``, against all rows of ``df``.

    Queries are sent in blocks of bounded size; each task multiplies its rows with a
    block and keeps its k best per query, and only those are shuffled. A query is no
    neighbour of itself. Scores are rounded before they are ranked, ties go to the
    smaller id. Vectors that are null, zero, not finite or of another length than the
    block's first are left out.
    """
    spark = df.sparkSession
    ids, rows, parts = [], [], []

    def one(ids: list, rows: list) -> DataFrame:
        q = np.array(rows, dtype=np.float64)
        names = np.array(ids, dtype=np.int64)
        q /= np.linalg.norm(q, axis=1, keepdims=True)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: pd.DataFrame | None = None
            for pdf in batches:
                ok = [v is not None and len(v) == q.shape[1] for v in pdf["v"]]
                pdf = pdf[ok]
                if not len(pdf):
                    continue
                v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                size = np.linalg.norm(v, axis=1)
                good = np.isfinite(v).all(axis=1) & (size > 0)
                v, there = v[good] / size[good, None], pdf["id"].to_numpy()[good]
                score = np.round(q @ v.T, digits)
                score[names[:, None] == there[None, :]] = -9
                order = np.lexsort((np.broadcast_to(there, score.shape), -score), axis=1)[:, :k]
                top = np.take_along_axis(score, order, axis=1)
                part = pd.DataFrame({"query_id": np.repeat(names, order.shape[1]), "neighbour_id": there[order].ravel(), "score": top.ravel()})
                part = part[part["score"] > -9]
                best = part if best is None else pd.concat([best, part])
                best = best.sort_values(["query_id", "score", "neighbour_id"], ascending=[True, False, True]).groupby("query_id").head(k)
            if best is not None:
                yield best

        return df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).mapInPandas(run, "query_id long, neighbour_id long, score double")

    for row in queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null").toLocalIterator():
        v = [float("nan") if x is None else float(x) for x in row["v"]]
        if (rows and len(v) != len(rows[0])) or not np.isfinite(v).all() or not any(v):
            continue
        ids.append(row["id"])
        rows.append(v)
        if len(ids) == block:
            parts.append(one(ids, rows))
            ids, rows = [], []
    if ids:
        parts.append(one(ids, rows))
    if not parts:
        return spark.createDataFrame([], "query_id long, neighbour_id long, score double, rank int")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
