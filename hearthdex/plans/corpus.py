"""Queries over listings, chunks and the index tables.

``documents`` stands in for a corpus where none of the code tables has the case: a document's
path is its source, its id and an extension that depends on the id.
"""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from hearthdex.chunking.structural import chunked
from hearthdex.chunking.windows import line_windows
from hearthdex.functions.globs import excludes_regex, is_excluded, is_language_allowed, resolve_excludes
from hearthdex.functions.paths import clean_path, extension, language_of
from hearthdex.functions.text import byte_length, first_line, strip_banner, token_estimate
from hearthdex.operators.delta import changed, deleted, delta
from hearthdex.operators.files import current_files
from hearthdex.operators.snapshot_diff import consecutive, settled
from hearthdex.session import table
from hearthdex.store.snapshot import backfill, upserted, without

EXTENSIONS = (".rs", ".py", ".ts", ".tsx", ".md", ".test.ts", "_test.py", "/Cargo.lock")
_WHEN = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS))
_PATH = f"source || '/' || doc_id || CASE doc_id % 8 {_WHEN} END"
LANGUAGES = ("rust", "python", "typescript")
FILE = ["repo", "path"]


def stand_in(spark, sf_dir):
    path = F.expr(f"concat(source, '/', cast(doc_id as string), CASE pmod(doc_id, 8) {_WHEN} END)")
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")


def corpus_scan(spark, sf_dir):
    return stand_in(spark, sf_dir).where("text is not null").select("path", F.sha2("text", 256).alias("hash"), byte_length(F.col("text")).cast("long").alias("n_bytes"))


def clean_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "file_states")
    return rows.groupBy("repo", clean_path(F.col("path")).alias("path")).agg(F.count_distinct("path").alias("spellings"), F.count("*").alias("n"))


def language_detect(spark, sf_dir):
    return table(spark, sf_dir, "chunks").groupBy("repo", "path", language_of(F.col("path")).alias("detected")).agg(F.count_distinct("language").alias("spellings"))


def language_gate(spark, sf_dir):
    gate = is_language_allowed(extension(F.col("path")), language_of(F.col("path")), LANGUAGES)
    return stand_in(spark, sf_dir).select("doc_id", "path", gate.alias("allowed"))


def exclude_filter(spark, sf_dir):
    return stand_in(spark, sf_dir).where(~is_excluded(F.col("path"), resolve_excludes())).select("doc_id", "path")


def exclude_chunks(spark, sf_dir):
    kept = table(spark, sf_dir, "chunks").where(~is_excluded(F.col("path"), resolve_excludes(["*.css", "/apps/**"])))
    return kept.groupBy("repo").agg(F.count("*").alias("chunks"), F.count_distinct("path").alias("files"))


def _two(spark, sf_dir):
    """The last complete snapshot of each repo as what is there, the one before as what is stored."""
    pairs = consecutive(table(spark, sf_dir, "snapshots"))
    last = pairs.where("next_no is null").select("repo", F.col("no").alias("last"), F.explode(F.array("no", "prev_no")).alias("no")).where("no is not null")
    # only rows of the two snapshots are settled, once for both
    rows = settled(table(spark, sf_dir, "file_states"), last).join(last, ["repo", "no"]).select(*FILE, F.lower(F.hex("digest")).alias("hash"), (F.col("no") == F.col("last")).alias("current"))
    return rows.where("current").drop("current"), rows.where("not current").drop("current")


def delta_changed(spark, sf_dir):
    return changed(*_two(spark, sf_dir), keys=FILE)


def delta_deleted(spark, sf_dir):
    return deleted(*_two(spark, sf_dir), keys=FILE)


def delta_full(spark, sf_dir):
    return delta(*_two(spark, sf_dir), keys=FILE)


def _versions(spark, sf_dir):
    rows = table(spark, sf_dir, "chunks").select(*FILE, "chunk_index", "file_hash", "indexed_at").distinct()
    by = W.partitionBy(*FILE)
    return rows.withColumns({"newest": F.max("indexed_at").over(by), "oldest": F.min("indexed_at").over(by)})


def index_upsert(spark, sf_dir):
    """The oldest versions are the index; files with a newer one are replaced by it."""
    v = _versions(spark, sf_dir)
    columns = [*FILE, "chunk_index", "file_hash"]
    old = v.where("indexed_at = oldest").select(columns)
    fresh = v.where("indexed_at = newest and newest > oldest").select(columns)
    return upserted(old, fresh, fresh, tuple(FILE))


def index_delete(spark, sf_dir):
    """Chunks of files that no logged batch calls deleted."""
    gone = table(spark, sf_dir, "deltas").select("repo", F.explode("deleted").alias("path")).select("repo", clean_path(F.col("path")).alias("path")).distinct()
    return without(table(spark, sf_dir, "chunks").select(*FILE, "chunk_id", "chunk_index").distinct(), gone, tuple(FILE))


def meta_upsert(spark, sf_dir):
    """File hashes: the last but one snapshot, brought to the last."""
    current, stored = _two(spark, sf_dir)
    fresh = changed(current, stored, keys=FILE)
    return upserted(without(stored, deleted(current, stored, keys=FILE), tuple(FILE)), fresh, fresh, tuple(FILE))


def meta_backfill(spark, sf_dir):
    return backfill(_versions(spark, sf_dir).where("indexed_at = newest"), tuple(FILE))


def index_stats(spark, sf_dir):
    return _versions(spark, sf_dir).where("indexed_at = newest").agg(F.count_distinct(*FILE).alias("files"), F.count("*").alias("chunks"))


def file_hashes(spark, sf_dir):
    """Path and hash alone, as the backfill scans them."""
    return table(spark, sf_dir, "chunks").select(*FILE, "file_hash").distinct()


def outcome_counts(spark, sf_dir):
    """Files read and not read in each snapshot, with a line for each that was not."""
    rows = table(spark, sf_dir, "file_states").select("repo", "snapshot_no", clean_path(F.col("path")).alias("path"), "hash").distinct()
    lines = F.array_join(F.array_sort(F.collect_set(F.when(F.col("hash").isNull(), F.concat("path", F.lit(": unreadable"))))), "\n")
    return rows.groupBy("repo", "snapshot_no").agg(
        F.count_if(F.col("hash").isNotNull()).alias("indexed"), F.count_if(F.col("hash").isNull()).alias("failed"), lines.alias("report")
    )


def largest_piece(spark, sf_dir):
    return table(spark, sf_dir, "chunks").groupBy(*FILE).agg(F.max(byte_length(F.col("text"))).cast("long").alias("largest"), F.sum(token_estimate(F.col("text"))).alias("tokens"))


def windows(spark, sf_dir):
    return line_windows(stand_in(spark, sf_dir)).select("doc_id", "chunk_index", "start_line", "end_line", F.sha2("text", 256).alias("text_hash"))


def strip_banners(spark, sf_dir):
    rows = table(spark, sf_dir, "chunks").select("chunk_id", "text").distinct()
    return rows.select("chunk_id", strip_banner(F.col("text")).alias("code"), strip_banner(F.col("text"), False).alias("kept"))


def first_lines(spark, sf_dir):
    return table(spark, sf_dir, "chunks").select("chunk_id", "symbol", first_line(F.col("text")).alias("code")).distinct()


def definitions(spark, sf_dir):
    """Structural chunks of all current files."""
    files = current_files(table(spark, sf_dir, "chunks"))
    return chunked(files).select(*FILE, "chunk_index", "start_line", "end_line", "language", "symbol", F.octet_length("text").alias("n_bytes"))


def byte_split(spark, sf_dir):
    """All current files in pieces of at most 512 bytes."""
    files = current_files(table(spark, sf_dir, "chunks"))
    return chunked(files, max_bytes=512).select(*FILE, "chunk_index", "start_line", "end_line", "symbol", F.octet_length("text").alias("n_bytes"))


def files_now(spark, sf_dir):
    return current_files(table(spark, sf_dir, "chunks")).select(*FILE, F.sha2("text", 256).alias("hash"))


QUERIES = {
    "corpus_scan": corpus_scan, "clean_paths": clean_paths, "language_detect": language_detect, "language_gate": language_gate,
    "exclude_filter": exclude_filter, "exclude_chunks": exclude_chunks, "delta_changed": delta_changed, "delta_deleted": delta_deleted, "delta_full": delta_full,
    "index_upsert": index_upsert, "index_delete": index_delete, "meta_upsert": meta_upsert, "meta_backfill": meta_backfill, "index_stats": index_stats,
    "file_hashes": file_hashes, "outcome_counts": outcome_counts, "largest_piece": largest_piece, "line_windows": windows, "strip_banner": strip_banners,
    "outline": first_lines, "files_now": files_now, "definitions": definitions, "byte_split": byte_split,
}

_DOCS = f"(SELECT doc_id, {_PATH} AS path, text FROM documents)"
_CLEAN = r"array_to_string(list_filter(string_split(replace(path, '\', '/'), '/'), lambda x: x NOT IN ('', '.')), '/')"
_LANGUAGE = (
    r"CASE regexp_extract(path, '\.([^./\\]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' "
    "WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' END"
)
_TWO = rf"""
WITH pairs AS (
  SELECT repo, snapshot_no AS no, lag(snapshot_no) OVER w AS prev_no, lead(snapshot_no) OVER w AS next_no
  FROM (SELECT DISTINCT repo, snapshot_no FROM snapshots WHERE status = 'complete') WINDOW w AS (PARTITION BY repo ORDER BY snapshot_no)
), latest AS (
  SELECT repo, snapshot_no AS no, {_CLEAN} AS path, regexp_replace(lower(trim(hash)), '^[a-z0-9_-]+[:=]|^0x', '') AS hash
  FROM file_states
  QUALIFY row_number() OVER (PARTITION BY repo, snapshot_no, {_CLEAN} ORDER BY loaded_at DESC NULLS LAST, lower(hash) DESC NULLS LAST) = 1
), cur AS (
  SELECT l.repo, l.path, l.hash FROM latest l JOIN pairs p ON l.repo = p.repo AND l.no = p.no WHERE p.next_no IS NULL AND l.hash IS NOT NULL
), old AS (
  SELECT l.repo, l.path, l.hash FROM latest l JOIN pairs p ON l.repo = p.repo AND l.no = p.prev_no WHERE p.next_no IS NULL AND l.hash IS NOT NULL
)
"""
_VERSIONS = """
WITH v AS (
  SELECT *, max(indexed_at) OVER (PARTITION BY repo, path) AS newest, min(indexed_at) OVER (PARTITION BY repo, path) AS oldest
  FROM (SELECT DISTINCT repo, path, chunk_index, file_hash, indexed_at FROM chunks)
)
"""
_BLANK = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LINES = r"(CASE WHEN list_last(string_split(text, chr(10))) = '' THEN list_slice(string_split(text, chr(10)), 1, -2) ELSE string_split(text, chr(10)) END)"
_BARE = f"list_transform({_LINES}, lambda l: regexp_replace(l, '{_BLANK}+$', ''))"
_FIRST = rf"list_position(list_transform(bare, lambda l: regexp_matches(l, '^{_BLANK}*($|//|#|/\*|\*)')), false)"

SQL = {
    "corpus_scan": f"SELECT path, sha256(text) AS hash, strlen(text) AS n_bytes FROM {_DOCS} WHERE text IS NOT NULL",
    "clean_paths": f"SELECT repo, {_CLEAN} AS path, count(DISTINCT path) AS spellings, count(*) AS n FROM file_states GROUP BY repo, {_CLEAN}",
    "language_detect": f"SELECT repo, path, {_LANGUAGE} AS detected, count(DISTINCT language) AS spellings FROM chunks GROUP BY repo, path",
    "language_gate": rf"""SELECT doc_id, path, lower(regexp_extract(path, '\.([^./\\]+)$', 1)) IN ('rust', 'python', 'typescript')
        OR coalesce({_LANGUAGE} IN ('rust', 'python', 'typescript'), false) AS allowed FROM {_DOCS}""",
    "exclude_filter": f"SELECT doc_id, path FROM {_DOCS} WHERE NOT regexp_matches(path, '{excludes_regex(resolve_excludes())}')",
    "exclude_chunks": f"""SELECT repo, count(*) AS chunks, count(DISTINCT path) AS files FROM chunks
        WHERE NOT regexp_matches(path, '{excludes_regex(resolve_excludes(["*.css", "/apps/**"]))}') GROUP BY repo""",
    "delta_changed": _TWO + "SELECT cur.repo, cur.path, cur.hash FROM cur LEFT JOIN old USING (repo, path) WHERE old.hash IS DISTINCT FROM cur.hash",
    "delta_deleted": _TWO + "SELECT old.repo, old.path FROM old ANTI JOIN cur USING (repo, path)",
    "delta_full": _TWO
    + """SELECT repo, path, CASE WHEN cur.hash IS NULL THEN 'deleted' ELSE 'changed' END AS kind FROM cur FULL JOIN old USING (repo, path)
        WHERE cur.hash IS DISTINCT FROM old.hash""",
    "index_upsert": _VERSIONS + "SELECT repo, path, chunk_index, file_hash FROM v WHERE indexed_at = newest",
    "index_delete": f"""SELECT DISTINCT repo, path, chunk_id, chunk_index FROM chunks c WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT repo, unnest(deleted) AS path FROM deltas) d WHERE d.repo = c.repo AND {_CLEAN.replace("(path", "(d.path")} = c.path)""",
    "meta_upsert": _TWO + "SELECT repo, path, hash FROM cur",
    "meta_backfill": _VERSIONS + "SELECT repo, path, max(file_hash) AS file_hash FROM v WHERE indexed_at = newest GROUP BY repo, path",
    "index_stats": _VERSIONS + "SELECT count(DISTINCT (repo, path)) AS files, count(*) AS chunks FROM v WHERE indexed_at = newest",
    "file_hashes": "SELECT DISTINCT repo, path, file_hash FROM chunks",
    "outcome_counts": f"""SELECT repo, snapshot_no, count(*) FILTER (hash IS NOT NULL) AS indexed, count(*) FILTER (hash IS NULL) AS failed,
        coalesce(string_agg(DISTINCT CASE WHEN hash IS NULL THEN path || ': unreadable' END, chr(10) ORDER BY CASE WHEN hash IS NULL THEN path || ': unreadable' END), '') AS report
        FROM (SELECT DISTINCT repo, snapshot_no, {_CLEAN} AS path, hash FROM file_states) GROUP BY repo, snapshot_no""",
    "largest_piece": "SELECT repo, path, max(strlen(text)) AS largest, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM chunks GROUP BY repo, path",
    "line_windows": f"""WITH d AS (SELECT doc_id, list_transform({_LINES}, lambda l: CASE WHEN ends_with(l, chr(13)) THEN l[:-2] ELSE l END) AS lines FROM documents WHERE text IS NOT NULL),
        n AS (SELECT *, len(lines) AS n FROM d WHERE len(lines) > 0),
        w AS (SELECT *, unnest(generate_series(0, CASE WHEN n <= 80 THEN 0 ELSE ceil((n - 80) / 64.0)::INT END)) AS i FROM n)
        SELECT doc_id, i::BIGINT AS chunk_index, i * 64 + 1 AS start_line, least(i * 64 + 80, n) AS end_line,
        sha256(array_to_string(list_slice(lines, i * 64 + 1, i * 64 + 80), chr(10))) AS text_hash FROM w""",
    "strip_banner": f"""WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks), b AS (SELECT chunk_id, {_BARE} AS bare FROM c)
        SELECT chunk_id, CASE WHEN {_FIRST} IS NULL OR {_FIRST} = 0 THEN '' ELSE array_to_string(list_slice(bare, {_FIRST}, len(bare)), chr(10)) END AS code,
        array_to_string(bare, chr(10)) AS kept FROM b""",
    "outline": r"SELECT DISTINCT chunk_id, symbol, regexp_replace(string_split(text, chr(10))[1], '\r$', '') AS code FROM chunks",
    "files_now": """SELECT repo, path, sha256(string_agg(text, '' ORDER BY chunk_index)) AS hash FROM (
        SELECT DISTINCT repo, path, chunk_index, text, indexed_at, max(indexed_at) OVER (PARTITION BY repo, path) AS newest FROM chunks)
        WHERE indexed_at = newest GROUP BY repo, path""",
}
