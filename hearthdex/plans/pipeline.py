"""Queries over the arithmetic of budgets, the answers of endpoints and runs of outcomes.

Inputs are built from the rows of ``chunks`` and ``events``; the same expressions stand in the SQL.
"""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from hearthdex.embedding.budget import tighten_column
from hearthdex.embedding.endpoint import classify, model_caps, props_caps, retryable
from hearthdex.health import worst
from hearthdex.session import table

#: Failures in a row that end a run.
BREAKER = 5


def budget_tighten(spark, sf_dir):
    """The budget after each chunk's rejection, in tokens of three characters against a window of 256, and the fold over a file."""
    rows = table(spark, sf_dir, "chunks").select("chunk_id", "repo", "path", F.octet_length("text").cast("long").alias("sent"), F.floor(F.length("text") / 3).alias("tokens")).distinct()
    each = rows.withColumn("target", tighten_column(F.col("sent"), F.col("tokens"), F.lit(256)))
    return each.groupBy("repo", "path").agg(F.count("*").alias("n"), F.sum("target").alias("total"), F.least(F.min("target"), F.lit(8192)).alias("budget"))


def _answers(spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 400, 401, 403, 413, 429, 500, 503)]), (F.col("event_id") % 8 + 1).cast("int"))
    n_ctx = F.col("event_id") % 3 * 2048
    kind = F.when(F.col("event_id") % 5 == 0, "exceed_context_size_error").otherwise("invalid_request_error")
    body = F.when(F.col("event_id") % 7 == 0, F.lit("<html>busy</html>")).otherwise(
        F.concat(F.lit('{"error":{"code":400,"type":"'), kind, F.lit('","n_prompt_tokens":'), (F.col("user_id") * 100).cast("string"), F.lit(',"n_ctx":'), n_ctx.cast("string"), F.lit("}}"))
    )
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"), body.alias("body"))


def http_classify(spark, sf_dir):
    kind = classify(F.col("status"), F.col("body"))
    return _answers(spark, sf_dir).select("event_id", "status", kind.alias("kind")).select("*", retryable(F.col("kind")).alias("retryable"))


def caps_parse(spark, sf_dir):
    """Windows and slots from properties, else from the list of models."""
    n_ctx, slots = F.col("event_id") % 4 * 1024, F.col("user_id") % 3
    props = F.when(F.col("event_id") % 9 == 0, F.lit("not json")).otherwise(
        F.concat(F.lit('{"default_generation_settings":{"n_ctx":'), n_ctx.cast("string"), F.lit('},"total_slots":'), slots.cast("string"), F.lit("}"))
    )
    name = F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string"))
    models = F.concat(F.lit('{"data":[{"id":"other","meta":{"n_ctx":7}},{"id":"'), name, F.lit('","aliases":["a'), (F.col("event_id") % 2).cast("string"), F.lit('"],"meta":{"n_ctx":512}}]}'))
    window, total = props_caps(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", props.alias("props"), models.alias("models"))
    return rows.select("event_id", total.alias("slots"), F.coalesce(window, model_caps(F.col("models"), "m1"), model_caps(F.col("models"), "a1")).alias("window"))


def severity_rollup(spark, sf_dir):
    """The worst outcome of each user: errors fail, purchases warn."""
    status = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "warn").otherwise("pass")
    by = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"))
    return by.agg(worst(status).alias("status"), F.count_if(F.col("event_type") == "error").alias("errors"))


def failure_runs(spark, sf_dir):
    """Longest run of errors of each user by time, and whether it would end a run of files."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("bad"))
    block = rows.withColumn("block", F.sum((~F.col("bad")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = block.groupBy("user_id", "block").agg(F.count_if("bad").alias("length"))
    return runs.groupBy("user_id").agg(F.max("length").alias("longest")).withColumn("aborts", F.col("longest") >= BREAKER)


QUERIES = {
    "budget_tighten": budget_tighten, "http_classify": http_classify, "caps_parse": caps_parse, "severity_rollup": severity_rollup, "failure_runs": failure_runs,
}

SQL = {
    "budget_tighten": """WITH r AS (SELECT DISTINCT chunk_id, repo, path, strlen(text) AS sent, length(text) // 3 AS tokens FROM chunks),
        t AS (SELECT *, CASE WHEN tokens = 0 THEN 252 ELSE greatest((256 * sent // tokens) * 15 // 16, 252) END AS target FROM r)
        SELECT repo, path, count(*) AS n, sum(target)::BIGINT AS total, least(min(target), 8192) AS budget FROM t GROUP BY repo, path""",
    "http_classify": """WITH a AS (SELECT event_id, [200, 400, 401, 403, 413, 429, 500, 503][event_id % 8 + 1] AS status, event_id % 7 <> 0 AND event_id % 5 = 0 AND event_id % 3 > 0 AS over FROM events),
        k AS (SELECT event_id, status, CASE WHEN status = 200 THEN 'ok' WHEN over THEN 'overflow' WHEN status IN (401, 403) THEN 'auth' WHEN status = 429 OR status >= 500 THEN 'transient' ELSE 'embed' END AS kind FROM a)
        SELECT *, kind IN ('transient', 'timeout') AS retryable FROM k""",
    "caps_parse": """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE nullif(user_id % 3, 0) END AS slots,
        coalesce(CASE WHEN event_id % 9 = 0 THEN NULL ELSE nullif(event_id % 4 * 1024, 0) END, CASE WHEN event_id % 3 = 1 OR event_id % 2 = 1 THEN 512 END) AS window FROM events""",
    "severity_rollup": """SELECT user_id, ts::DATE AS day, CASE max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS status,
        count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id, ts::DATE""",
    "failure_runs": """WITH b AS (SELECT user_id, event_type = 'error' AS bad, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block FROM events),
        r AS (SELECT user_id, block, count(*) FILTER (bad) AS length FROM b GROUP BY ALL)
        SELECT user_id, max(length) AS longest, max(length) >= 5 AS aborts FROM r GROUP BY user_id""",
}
