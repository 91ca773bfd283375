"""Queries over vectors, hits and entries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hearthdex.embedding.base import byte_sums
from hearthdex.embedding.batching import batch_ids
from hearthdex.functions.globs import excludes_regex, is_excluded, resolve_excludes
from hearthdex.functions.vectors import cosine, literal, norm, normalized
from hearthdex.operators.islands import merged
from hearthdex.operators.knn import nearest, nearest_many
from hearthdex.operators.select import distilled, focus_why, ranked, relevance_floor, rendered, token_budget
from hearthdex.chunking.windows import line_windows
from hearthdex.plans.corpus import _BLANK, _FIRST, _VERSIONS, stand_in
from hearthdex.session import spread, table

#: Numbers of a mock vector, results of a search and the floor of its scores.
DIM, K, RATIO, BUDGET = 16, 25, 0.75, 4000


def mock_embed(spark, sf_dir):
    """Sums per slot of the mock embedding, before they are brought to length one."""

    def run(batches):
        for pdf in batches:
            rows = np.array([byte_sums(t, DIM) for t in pdf["text"]]).reshape(len(pdf), DIM)
            yield pd.DataFrame({"doc_id": np.repeat(pdf["doc_id"].to_numpy(), DIM), "slot": np.tile(np.arange(DIM), len(pdf)), "total": rows.ravel().astype(np.int64)})

    rows = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null and text <> ''")
    return rows.mapInPandas(run, "doc_id long, slot int, total long")


def l2_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", norm(F.col("embedding")).alias("size"), F.posexplode(normalized(F.col("embedding"))).alias("slot", "x"))
    return rows.select("vec_id", F.round("size", 6).alias("size"), "slot", F.round("x", 6).alias("x"))


def _query(spark, sf_dir):
    """The vector with the smallest id, as the query."""
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def knn_cosine_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    found = nearest(rows, _query(spark, sf_dir), K, "embedding", ("vec_id",))
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


def knn_multi_query(spark, sf_dir):
    """Every row whose id a hundred divides, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest_many(rows, rows.where("vec_id % 100 = 0"), 10)


def _chunk_query(spark, sf_dir):
    """The stored vector of the smallest chunk id that has one, as the query of a search."""
    usable = table(spark, sf_dir, "chunks").where("size(vector) = 64 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(vector, x -> x <> 0)")
    return usable.orderBy("chunk_id").select("vector").first()[0]


def _searched(spark, sf_dir):
    """The K best current chunks for that query, whatever their path.

    Vectors become scores in the scan; ids and scores alone are joined, made distinct and
    ranked, and the texts of the K winners are fetched.
    """
    chunks = table(spark, sf_dir, "chunks")
    scored = chunks.select("chunk_id", "repo", "path", "chunk_index", "indexed_at", cosine(F.col("vector"), literal(_chunk_query(spark, sf_dir))).alias("score"))
    newest = chunks.groupBy("repo", "path").agg(F.max("indexed_at").alias("indexed_at"))
    # a search is within one tree: the repository is part of the path
    now = scored.join(newest, ["repo", "path", "indexed_at"]).dropDuplicates(["chunk_id"]).select("chunk_id", F.concat_ws("/", "repo", "path").alias("path"), "chunk_index", "score")
    best = now.orderBy(F.desc("score"), "path", "chunk_index").limit(K)
    parts = chunks.select("chunk_id", "start_line", "end_line", "language", "symbol", "text")
    return parts.join(F.broadcast(best), "chunk_id").dropDuplicates(["chunk_id"]).withColumn("score", F.round("score", 6))


def post_limit_exclude(spark, sf_dir):
    """Excluded paths are dropped behind the limit: fewer than K may come out."""
    return _searched(spark, sf_dir).where(~is_excluded(F.col("path"), resolve_excludes())).select("chunk_id", "path", "score")


def search_by_vector(spark, sf_dir):
    """The whole way from a query vector to entries."""
    hits = _searched(spark, sf_dir).where(~is_excluded(F.col("path"), resolve_excludes()))
    found = distilled(merged(hits), True, RATIO, BUDGET)
    return found.select("rank", "path", "start_line", "end_line", "symbol", "score", "why_matched", F.sha2("code", 256).alias("code_hash"))


def hits_once(spark, sf_dir):
    """Logged hits, each chunk once per query with its latest score; nulls and NaN are below all scores."""
    rows = table(spark, sf_dir, "hits").withColumn("score", F.round(F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(-2.0)), F.lit(-2.0)), 6))
    keys = ["query_id", "chunk_id", "path", "start_line", "end_line", "chunk_index", "language", "symbol", "text"]
    return rows.withColumn("path", F.concat_ws("/", "repo", "path")).groupBy(*keys).agg(F.max(F.struct("logged_at", "score"))["score"].alias("score"))


def _entries(spark, sf_dir):
    return merged(hits_once(spark, sf_dir), ("query_id", "path"), ("chunk_id",))


def merge_islands(spark, sf_dir):
    return _entries(spark, sf_dir).select("query_id", "path", "start_line", "end_line", "language", "symbol", "score", F.sha2("code", 256).alias("code_hash"))


def floor_entries(spark, sf_dir):
    kept = relevance_floor(ranked(_entries(spark, sf_dir), ("query_id",)), RATIO, ("query_id",))
    return kept.select("query_id", "rank", "path", "start_line", "score")


def token_entries(spark, sf_dir):
    """Logged hits of a query under a budget of 600 tokens, passing over what does not fit."""
    kept = token_budget(ranked(_entries(spark, sf_dir), ("query_id",)), 600, ("query_id",))
    return kept.select("query_id", "rank", "path", "start_line")


def render_entries(spark, sf_dir):
    found = distilled(_entries(spark, sf_dir), True, RATIO, BUDGET, ("query_id",))
    return rendered(found.withColumn("rank", F.struct("query_id", "rank"))).select("rank.query_id", "rank.rank", "block")


def focus_top5(spark, sf_dir):
    """The five best hits of each query; equal scores stay in the order of the log. No floor, no budget."""
    from pyspark.sql import Window as W

    rows = hits_once(spark, sf_dir).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where("rank <= 5")
    return rows.select("query_id", "rank", "chunk_id", focus_why(F.col("score"), F.octet_length("text") > 1000).alias("why_matched"))


def embed_batches(spark, sf_dir):
    """Requests per file of at most 4 chunks and 3000 bytes, over the current chunks in order."""
    rows = table(spark, sf_dir, "chunks")
    newest = rows.groupBy("repo", "path").agg(F.max("indexed_at").alias("indexed_at"))
    now = rows.join(newest, ["repo", "path", "indexed_at"]).select("repo", "path", "chunk_index", F.octet_length("text").alias("size")).distinct()
    files = now.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "size"))).alias("c"))
    ids = batch_ids(F.transform("c", lambda x: x["size"]), 4, 3000)
    return files.select("repo", "path", F.explode(F.arrays_zip(F.col("c").alias("c"), ids.alias("b"))).alias("x")).select("repo", "path", F.col("x.c.chunk_index").alias("chunk_index"), F.col("x.b").alias("batch"))


def search_end_to_end(spark, sf_dir):
    """Documents to windows, mock vectors, nearest to a phrase, merged, stripped, chosen. Native but for the vectors."""
    from hearthdex.embedding.base import MockEmbedder

    embedder = MockEmbedder(DIM)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(vector=list(embedder.embed(list(pdf["text"]))))

    pieces = spread(line_windows(stand_in(spark, sf_dir).where("text is not null")))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    chunks = pieces.mapInPandas(run, f"{fields}, vector array<float>")
    hits = nearest(chunks, embedder.embed(["search over the source tree"])[0].tolist(), K)
    hits = hits.where(~is_excluded(F.col("path"), resolve_excludes())).coalesce(1)
    return distilled(merged(hits), True, RATIO, BUDGET).select("rank", "path", "start_line", "end_line", "language", "symbol", "code", F.round("score", 6).alias("score"), "why_matched").orderBy("rank")


QUERIES = {
    "search_end_to_end": search_end_to_end, "search_by_vector": search_by_vector, "mock_embed": mock_embed, "l2_normalize": l2_normalize, "knn_cosine_topk": knn_cosine_topk,
    "knn_multi_query": knn_multi_query, "post_limit_exclude": post_limit_exclude, "merge_islands": merge_islands, "relevance_floor": floor_entries,
    "token_budget": token_entries, "render_entries": render_entries, "focus_top5": focus_top5, "embed_batches": embed_batches,
}

_D = "list_transform({}, lambda x: x::DOUBLE)"
_NEAREST = f"""
WITH RECURSIVE q AS (SELECT {_D.format("vector")} AS q FROM chunks WHERE len(vector) = 64 AND list_bool_and(list_transform(vector, lambda x: isfinite(x)))
    AND list_bool_or(list_transform(vector, lambda x: x <> 0)) ORDER BY chunk_id LIMIT 1),
now AS (SELECT DISTINCT ON (chunk_id) chunk_id, repo || '/' || path AS path, start_line, end_line, chunk_index, language, symbol, text, vector
    FROM (SELECT *, max(indexed_at) OVER (PARTITION BY repo, path) AS newest FROM chunks) WHERE indexed_at = newest),
top AS (SELECT now.* EXCLUDE (vector), round(CASE WHEN len(vector) = 64 AND list_bool_and(list_transform(vector, lambda x: isfinite(x)))
    AND list_bool_or(list_transform(vector, lambda x: x <> 0)) THEN list_cosine_similarity({_D.format("vector")}, q) ELSE -2 END, 6) AS score
    FROM now, q ORDER BY score DESC, path, chunk_index LIMIT {K})
"""
_ONCE = """
once AS (SELECT query_id, chunk_id, repo || '/' || path AS path, start_line, end_line, chunk_index, language, symbol, text, round(coalesce(CASE WHEN isnan(score) THEN -2 ELSE score::DOUBLE END, -2), 6) AS score
    FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id, path, start_line, end_line, chunk_index, language, symbol, text
    ORDER BY logged_at DESC NULLS LAST, coalesce(CASE WHEN isnan(score) THEN -2 ELSE score END, -2) DESC) = 1)
"""


def _islands(source: str, keys: str, ties: str) -> str:
    """SQL of the merged entries of a hit table."""
    order = f"PARTITION BY {keys} ORDER BY start_line, chunk_index{ties}"
    return f"""
marked AS (SELECT *, coalesce(start_line > max(end_line) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2, true) AS opens,
    lag(start_line) OVER ({order}) AS before FROM {source}),
numbered AS (SELECT *, sum(opens::INT) OVER ({order} ROWS UNBOUNDED PRECEDING) AS island,
    CASE WHEN NOT opens AND start_line > before THEN chr(10) ELSE '' END || text AS piece FROM marked),
entries AS (SELECT {keys}, min(start_line) AS start_line, max(end_line) AS end_line, first(language ORDER BY start_line, chunk_index{ties}) AS language,
    first(symbol ORDER BY start_line, chunk_index{ties}) AS symbol, string_agg(piece, '' ORDER BY start_line, chunk_index{ties}) AS code, max(score) AS score
    FROM numbered GROUP BY {keys}, island)"""


_LINES_OF_CODE = "(CASE WHEN list_last(string_split(code, chr(10))) = '' THEN list_slice(string_split(code, chr(10)), 1, -2) ELSE string_split(code, chr(10)) END)"


def _chosen(part: str, keys: str) -> str:
    """SQL of stripping, ranking, the floor and the budget; CTE ``chosen``."""
    return f"""
bares AS (SELECT *, list_transform({_LINES_OF_CODE}, lambda l: regexp_replace(l, '{_BLANK}+$', '')) AS bare FROM entries),
clean AS (SELECT * EXCLUDE (bare, code), CASE WHEN {_FIRST} IS NULL OR {_FIRST} = 0 THEN '' ELSE array_to_string(list_slice(bare, {_FIRST}, len(bare)), chr(10)) END AS code FROM bares),
ordered AS (SELECT *, row_number() OVER ({part} ORDER BY score DESC, path, start_line) AS rank, first_value(score) OVER ({part} ORDER BY score DESC, path, start_line) AS best FROM clean),
floored AS (SELECT *, row_number() OVER ({part} ORDER BY rank) AS place FROM ordered WHERE rank = 1 OR score >= best * {RATIO}),
fold AS (SELECT {keys}place, rank, greatest(1, length(code) // 4) AS used, true AS kept FROM floored WHERE place = 1
    UNION ALL SELECT {keys.replace("query_id", "f.query_id")}f.place, f.rank, CASE WHEN fold.used + greatest(1, length(f.code) // 4) <= {BUDGET} THEN fold.used + greatest(1, length(f.code) // 4) ELSE fold.used END,
    fold.used + greatest(1, length(f.code) // 4) <= {BUDGET} FROM fold JOIN floored f ON f.place = fold.place + 1{" AND f.query_id = fold.query_id" if keys else ""}),
chosen AS (SELECT o.* FROM ordered o JOIN fold ON o.rank = fold.rank{" AND o.query_id = fold.query_id" if keys else ""} WHERE fold.kept)"""


_EXCLUDED = excludes_regex(resolve_excludes())
_BY_QUERY = "PARTITION BY query_id"

SQL = {
    "mock_embed": f"""WITH b AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents WHERE text IS NOT NULL AND text <> ''),
        u AS (SELECT doc_id, unnest(h) AS x, generate_subscripts(h, 1) - 1 AS i FROM b),
        s AS (SELECT doc_id, (i % {DIM})::INT AS slot, sum((('0x' || x)::INT + 1) * (i % 7 + 1))::BIGINT AS total FROM u GROUP BY ALL)
        SELECT d.doc_id, n.slot, coalesce(s.total, 0) AS total FROM (SELECT doc_id FROM b) d CROSS JOIN (SELECT range::INT AS slot FROM range({DIM})) n
        LEFT JOIN s ON s.doc_id = d.doc_id AND s.slot = n.slot""",
    "l2_normalize": f"""WITH e AS (SELECT vec_id, {_D.format("embedding")} AS e FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM e)
        SELECT vec_id, round(n, 6) AS size, generate_subscripts(e, 1)::INT - 1 AS slot, round(unnest(e) / n, 6) AS x FROM n""",
    "knn_cosine_topk": f"""WITH q AS (SELECT {_D.format("embedding")} AS q FROM embeddings ORDER BY vec_id LIMIT 1)
        SELECT vec_id, label, round(list_cosine_similarity({_D.format("embedding")}, q), 6) AS score FROM embeddings, q
        ORDER BY list_cosine_similarity({_D.format("embedding")}, q) DESC, vec_id LIMIT {K}""",
    "knn_multi_query": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_cosine_similarity({_D.format("a.embedding")}, {_D.format("b.embedding")}), 6) AS score
        FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id)::INT AS rank FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) <= 10""",
    "post_limit_exclude": _NEAREST + f"SELECT chunk_id, path, score FROM top WHERE NOT regexp_matches(path, '{_EXCLUDED}')",
    "search_by_vector": _NEAREST
    + f", kept AS (SELECT * FROM top WHERE NOT regexp_matches(path, '{_EXCLUDED}')),"
    + _islands("kept", "path", "") + "," + _chosen("", "")
    + "SELECT rank::INT AS rank, path, start_line, end_line, symbol, score, printf('similarity %.3f', score) AS why_matched, sha256(code) AS code_hash FROM chosen",
    "merge_islands": "WITH" + _ONCE + "," + _islands("once", "query_id, path", ", chunk_id")
    + "SELECT query_id, path, start_line, end_line, language, symbol, score, sha256(code) AS code_hash FROM entries",
    "relevance_floor": "WITH" + _ONCE + "," + _islands("once", "query_id, path", ", chunk_id")
    + f""", r AS (SELECT *, row_number() OVER ({_BY_QUERY} ORDER BY score DESC, path, start_line)::INT AS rank, max(score) OVER ({_BY_QUERY}) AS best FROM entries)
        SELECT query_id, rank, path, start_line, score FROM r WHERE rank = 1 OR score >= best * {RATIO}""",
    "token_budget": "WITH RECURSIVE" + _ONCE + "," + _islands("once", "query_id, path", ", chunk_id")
    + f""", r AS (SELECT *, row_number() OVER ({_BY_QUERY} ORDER BY score DESC, path, start_line)::INT AS rank, greatest(1, length(code) // 4) AS cost FROM entries),
        fold AS (SELECT query_id, rank, cost AS used, true AS kept FROM r WHERE rank = 1 UNION ALL
        SELECT r.query_id, r.rank, CASE WHEN used + cost <= 600 THEN used + cost ELSE used END, used + cost <= 600 FROM fold JOIN r ON r.query_id = fold.query_id AND r.rank = fold.rank + 1)
        SELECT r.query_id, r.rank, r.path, r.start_line FROM r JOIN fold USING (query_id, rank) WHERE kept""",
    "render_entries": "WITH RECURSIVE" + _ONCE + "," + _islands("once", "query_id, path", ", chunk_id") + "," + _chosen(_BY_QUERY, "query_id, ")
    + """SELECT query_id, rank::INT AS rank, path || ':' || start_line || '-' || end_line || coalesce(' [' || symbol || ']', '') || ' (' || printf('similarity %.3f', score) || ')' || chr(10)
        || '```' || coalesce(language, '') || chr(10) || code || chr(10) || '```' || chr(10) || chr(10) AS block FROM chosen""",
    "focus_top5": "WITH" + _ONCE
    + f"""SELECT query_id, row_number() OVER ({_BY_QUERY} ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, printf('focus similarity %.3f', score)
        || CASE WHEN strlen(text) > 1000 THEN ' (partial: split to fit the embedding window)' ELSE '' END AS why_matched FROM once
        QUALIFY row_number() OVER ({_BY_QUERY} ORDER BY score DESC, chunk_id) <= 5""",
    "embed_batches": "WITH RECURSIVE " + _VERSIONS.strip().removeprefix("WITH").replace("file_hash, indexed_at FROM chunks", "strlen(text) AS size, indexed_at FROM chunks")
    + """, c AS (SELECT repo, path, chunk_index, size, row_number() OVER (PARTITION BY repo, path ORDER BY chunk_index) AS place FROM v WHERE indexed_at = newest),
        fold AS (SELECT repo, path, chunk_index, place, 0 AS batch, 1 AS n, size AS held FROM c WHERE place = 1 UNION ALL
        SELECT c.repo, c.path, c.chunk_index, c.place, CASE WHEN n >= 4 OR held + size > 3000 THEN batch + 1 ELSE batch END,
        CASE WHEN n >= 4 OR held + size > 3000 THEN 1 ELSE n + 1 END, CASE WHEN n >= 4 OR held + size > 3000 THEN size ELSE held + size END
        FROM fold JOIN c ON c.repo = fold.repo AND c.path = fold.path AND c.place = fold.place + 1)
        SELECT repo, path, chunk_index, batch FROM fold""",
}
