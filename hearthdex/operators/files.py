"""Files put together from their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from hearthdex.session import shuffle_partitions


def current_files(chunks: DataFrame) -> DataFrame:
    """``repo, path, text``: the current text of each file.

    It is the text of the rows with the latest ``indexed_at``, each ``chunk_index``
    once, joined in order. Rows that repeat count once; of rows that differ only in
    their text the greatest text counts. A null ``indexed_at`` is older than any
    other; a null ``chunk_index`` comes first; a null text is empty. Rows with a null
    ``repo`` or ``path`` are ignored. One shuffle, by file; older versions are dropped there, by a
    window that can spill, before texts are gathered.
    """
    piece = F.struct(F.col("chunk_index").alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    files = (
        chunks.where("repo is not null and path is not null")
        .repartition(shuffle_partitions(chunks.sparkSession), "repo", "path")  # else small shuffles become one task
        .withColumn("newest", F.max("indexed_at").over(W.partitionBy("repo", "path")))
        .where(F.col("indexed_at").eqNullSafe(F.col("newest"))).select("repo", "path", piece.alias("piece"))
        .groupBy("repo", "path")
        .agg(F.array_sort(F.collect_set("piece")).alias("p"))
    )
    last = F.filter("p", lambda x, n: (n == F.size("p") - 1) | ~F.get("p", n + 1)["i"].eqNullSafe(x["i"]))
    return files.select("repo", "path", F.array_join(F.transform(last, lambda x: x["t"]), "").alias("text"))
