"""The k most similar vectors of every vector, by pruned graphs over shards.

Vectors of one direction, whatever their length, form a class that stands in the graph once and keeps its k + 1 smallest
ids. Classes go to the shard of their nearest centre (k-means on a bounded sample); a
shard too large for one task is dealt out over several. Each class then searches by beam search the graphs of its nearest
centre and of all others that are nearly as near, up to ``probes``: more where shards are fine and where it lies between
them. What a class meets meets it as well, so a pair is found if either of the two comes to the other's shard. The
proposals are scored afresh in double precision, rounded, and merged with ties by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from hearthdex.llm.graph import Graph, one_thread
from hearthdex.session import materialized, shuffle_partitions

#: Vectors that the centres are fitted on, at most; all vectors are indexed.
SAMPLE = 32_768
#: Classes that a shard should have, and centres at most (their size is this bound times the width).
SHARD, CENTRES = 2_000, 2_048
#: Classes in one graph, and searches in one task, at most; larger shards are dealt out.
GRAPH, SEARCHES = 16_384, 65_536
#: Nearest centres whose shards a vector searches, at most, and by how much less cosine than the
#: nearest one has another centre counts.
PROBES, MARGIN = 16, 0.15
#: Edges of a node, edges that dropped neighbours fill, beams of building and of searches in the own shard and in
#: others, relaxation of the pruning, and nodes of which the nearest begin a search.
DEGREE, FILL, BEAM, BEAM_HOME, BEAM_AWAY, ALPHA, ENTRIES = 24, 16, 32, 44, 24, 1.2, 512
DIGITS = 6
#: Digits of the unit vectors by which vectors have one direction: as fine as the scores.
WAY_DIGITS = 6
#: Members from which a class's list is dealt out over several tasks, and such classes up to which their table is broadcast.
HOT, HOT_CLASSES = 100_000, 100_000

_ANSWER = pa.schema([("class", pa.int64()), ("scores", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision, whatever their scale."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _stack(column: pd.Series, width: int) -> np.ndarray:
    return np.concatenate(column.to_numpy()).reshape(len(column), width) if len(column) else np.zeros((0, width), np.float32)


def _matrix(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of ``width`` numbers as rows; null elements become NaN."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's unit vector in whole steps of 10^-WAY_DIGITS.

    Multiples of a vector differ in their last bits only, so few of them fall beside a step's edge.
    """
    steps = np.rint(_units(vectors) * 10.0**WAY_DIGITS).astype(np.int64).astype(np.uint64)
    factors = np.random.default_rng(11).integers(0, 2**63, (2, vectors.shape[1]), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    one, two = ((steps * f).sum(axis=1, dtype=np.uint64).view(np.int64) for f in factors)
    return one, two


def usable(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """``id, vector, h1, h2`` of the rows with an id and ``width`` elements, all finite, not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = pc.equal(pc.list_value_length(batch["vector"]), width)
            batch = batch.filter(pc.and_kleene(fits, pc.is_valid(batch["id"])))
            v = _matrix(batch["vector"], width)
            good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
            batch = batch.filter(pa.array(good))
            h1, h2 = directions(v[good])
            yield pa.record_batch([batch["id"], batch["vector"], pa.array(h1), pa.array(h2)], names=["id", "vector", "h1", "h2"])

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    return rows.mapInArrow(run, "id long, vector array<float>, h1 long, h2 long")


def classes(df: DataFrame, key: str, vector: str, width: int, k: int) -> tuple[DataFrame, DataFrame]:
    """``(classes, members)``: classes are ``class, ids, vector, h1, h2`` with the k + 1 smallest ids, members are ``id, h1, h2``.

    A class is named by its smallest id. ``ids`` is found by a ranking whose limit is
    applied before the shuffle, so a class of any size costs a task k + 1 rows.
    """
    # a repeated id keeps one vector, the one of the smaller hash
    one = usable(df, key, vector, width).groupBy("id").agg(F.min(F.struct("h1", "h2", "vector")).alias("x"))
    one = materialized(one.select("id", "x.h1", "x.h2", "x.vector"), "vectors")
    first = one.withColumn("rank", F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))).where(F.col("rank") <= k + 1)
    all_ = first.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("vector", "id").alias("vector"))
    return all_.select(F.col("ids")[0].alias("class"), "ids", "vector", "h1", "h2"), one.select("id", "h1", "h2")


def centres(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[np.sort(rng.choice(len(sample), min(k, len(sample)), replace=False))]
    for _ in range(rounds if len(c) > 1 else 0):
        near = np.concatenate([np.argmax(sample[i : i + 4096] @ c.T, axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), c)
    return c.astype(np.float32)


def _first(group: np.ndarray, n: int) -> np.ndarray:
    """Which of rows sorted by group are among the first n of theirs."""
    return np.arange(len(group)) - np.searchsorted(group, group) < n


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _search_shard(width: int, k: int, degree: int, beam: int, alpha: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        inside, asking = (np.flatnonzero(table[c].to_numpy()) for c in ("inside", "asking"))
        if not len(inside) or not len(asking):
            return _ANSWER.empty_table()
        if len(table) >= 1 << 20:
            raise ValueError("more rows than a graph and its searches may have")
        one_thread()
        names = table["class"].to_numpy()
        units = _units(_matrix(table["vector"], width))
        graph = Graph(units[inside], degree, beam, alpha, fill=FILL, entries=ENTRIES)
        own = np.full(len(names), -1, dtype=np.int32)
        own[inside] = np.arange(len(inside), dtype=np.int32)
        home, away = asking[own[asking] >= 0], asking[own[asking] < 0]
        n, keep, pairs = len(names), k + 6, []
        for rows, width_ in ((home, max(beam, BEAM_HOME, keep)), (away, max(min(beam, BEAM_AWAY), keep))):
            if len(rows):
                q = units[rows].astype(np.float32)
                starts = np.column_stack([own[rows], graph.starts(q, k=1)]) if rows is home else graph.starts(q)
                found = graph.search(q, starts, width_)[0][:, :keep]
                at, col = np.nonzero(found >= 0)
                x, y = rows[at], inside[found[at, col]]
                pairs.append(np.minimum(x, y) * n + np.maximum(x, y))
        # who is met meets; each pair is scored once
        a, b = np.divmod(_distinct(np.concatenate(pairs)), n)
        score = np.empty(len(a))
        for i in range(0, len(a), 1 << 14):
            part = slice(i, i + (1 << 14))
            score[part] = np.einsum("ij,ij->i", units[a[part]], units[b[part]])
        worse = 10**DIGITS - np.rint(score * 10**DIGITS).astype(np.int64) + 1  # 0 is the best, 22 bits do
        order = _distinct(np.concatenate([(a << 42 | worse << 20 | b), (b << 42 | worse << 20 | a)]))  # rows are sorted by class
        order = order[_first(order >> 42, k + 1)]
        a, b, score = order >> 42, order & (1 << 20) - 1, (10**DIGITS + 1 - (order >> 20 & (1 << 22) - 1)) / 10**DIGITS
        # each class stands for its ids
        ids = table["ids"].combine_chunks()
        start, size, flat = ids.offsets.to_numpy()[:-1].astype(np.int64), pc.list_value_length(ids).to_numpy(), ids.values.to_numpy()
        if len(flat) == n:
            id_ = names[b]
        else:
            many = size[b]
            at = np.repeat(start[b] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            a, score, id_ = np.repeat(a, many), np.repeat(score, many), flat[at]
            order = np.lexsort((id_, -score, a))
            order = order[_first(a[order], k + 1)]
            a, score, id_ = a[order], score[order], id_[order]
        who, count = np.unique(a, return_counts=True)
        offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
        lists = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (score, id_))
        return pa.table([pa.array(names[who]), *lists], schema=_ANSWER)

    return run


def neighbours(
    df: DataFrame, key: str = "chunk_id", vector: str = "vector", width: int = 64, k: int = 10,
    probes: int = PROBES, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, margin: float = MARGIN, seed: int = 5,
) -> DataFrame:
    """``id, near, score``: up to k rows per usable vector, its most similar others.

    Unusable vectors (null, of another width, with a null, NaN or infinite element,
    all zero) and null ids have no rows and are nobody's neighbour. A repeated id
    counts once. ``score`` is the cosine rounded to six decimals; ties go to the
    smaller id. With fewer than k others all of them come out. Empty tables give an
    empty result. Neighbours are found approximately; the tests measure the recall.
    """
    spark = df.sparkSession
    found, one = classes(df, key, vector, width, k)
    table = materialized(found, "classes")
    total = table.count()
    n_centres = max(1, min(CENTRES, -(-total // shard)))
    share = min(1.0, 1.5 * SAMPLE / max(total, 1))
    sample = table.select("class", "vector")
    if share < 1:
        sample = sample.where(F.pmod(F.xxhash64("class"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = sample.orderBy(F.xxhash64("class")).limit(SAMPLE).toPandas()
    centre = centres(_units(_stack(rows["vector"], width)).astype(np.float32), n_centres, seed=seed) if len(rows) else np.zeros((1, width), np.float32)
    probes = min(probes, len(centre))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = _units(_stack(pdf["vector"], width)).astype(np.float32) @ centre.T
            order = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
            score = np.take_along_axis(near, order, axis=1)
            by = np.argsort(-score, axis=1, kind="stable")
            order, score = np.take_along_axis(order, by, axis=1).astype(np.int32), np.take_along_axis(score, by, axis=1)
            yield pdf.assign(near=[o[:n] for o, n in zip(order, (score >= score[:, :1] - margin).sum(axis=1))])

    routed = table.select("class", "ids", "vector").mapInPandas(route, "class long, ids array<long>, vector array<float>, near array<int>")
    routed = routed.select("class", "ids", "vector", F.posexplode("near").alias("rank", "centre"))
    # how many graphs a centre needs, and how many tasks its searches; small tables of a row per centre
    load = (
        routed.groupBy("centre").agg(F.count_if(F.col("rank") == 0).alias("inside"), F.count("*").alias("asking"))
        .select("centre", F.ceil(F.greatest(F.col("inside"), F.lit(1)) / GRAPH).alias("graphs"), F.ceil(F.col("asking") / SEARCHES).alias("tasks"))
    ).collect()  # CENTRES rows at most
    graphs = {r["centre"]: int(r["graphs"]) for r in load}
    tasks = {r["centre"]: int(r["tasks"]) for r in load}
    split = [c for c in graphs if graphs[c] > 1 or tasks[c] > 1]
    g, t = F.lit(1), F.lit(1)
    if split:
        g = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c in split for x in (c, graphs[c])]), F.col("centre")), F.lit(1))
        t = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c in split for x in (c, tasks[c])]), F.col("centre")), F.lit(1))
    deal = F.xxhash64("class")
    # a row stands in one graph of its centre, in each of its tasks, and asks in one task of each graph
    placed = routed.withColumns({"g": g, "t": t}).withColumns({"my_g": F.pmod(deal, "g"), "my_t": F.pmod(F.xxhash64(deal), "t")})
    if split:
        placed = (
            placed.withColumn("to_g", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
            .withColumn("to_t", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
        )
    else:
        placed = placed.withColumns({"to_g": F.lit(0), "to_t": F.lit(0)})
    placed = placed.withColumns(
        {"inside": (F.col("rank") == 0) & (F.col("to_g") == F.col("my_g")), "asking": F.col("to_t") == F.col("my_t")}
    ).where("inside or asking")
    # a graph a task, or few, so that long and short ones even out
    groups = sum(graphs[c] * tasks[c] for c in graphs)
    answers = (
        placed.select("centre", "to_g", "to_t", "class", "ids", "vector", "inside", "asking")
        .repartition(max(shuffle_partitions(spark), 2 * groups), "centre", "to_g", "to_t")
        .groupBy("centre", "to_g", "to_t").applyInArrow(_search_shard(width, k, degree, beam, alpha), "class long, scores array<double>, ids array<long>")
    )
    merged = (
        answers.select("class", F.zip_with("scores", "ids", lambda s, i: F.struct((-s).alias("s"), i.alias("i"))).alias("best"))
        .groupBy("class")
        # a pair comes twice at most, from the shards of both
        .agg(F.slice(F.array_distinct(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, 2 * k + 2)), 1, k + 1).alias("best"))
    )
    # a class of one is its own member; members of larger classes meet their class's list
    lists = merged.join(table.select("class", F.size("ids").alias("size"), "h1", "h2"), "class")
    many, members = lists.where("size > 1").select("h1", "h2", "best"), one
    keys = ["h1", "h2"]
    # only a class with k + 1 ids can be hot; its members and list are salted by its size
    hot = materialized(one.groupBy("h1", "h2").count().where(F.col("count") >= HOT), "hot")
    if n_hot := hot.count():
        hot = hot.select("h1", "h2", F.ceil(F.col("count") / HOT).cast("int").alias("salts"))
        hot = F.broadcast(hot) if n_hot <= HOT_CLASSES else hot
        salts = F.coalesce("salts", F.lit(1))
        many = many.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        members = members.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).drop("salts")
        keys = [*keys, "salt"]
    each = lists.where("size = 1").select(F.col("class").alias("id"), "best").unionByName(members.join(many, keys).select("id", "best"))
    others = F.slice(F.filter("best", lambda x: x["i"] != F.col("id")), 1, k)
    return each.select("id", F.explode(others).alias("x")).select("id", F.col("x.i").alias("near"), (-F.col("x.s")).alias("score"))


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """``chunk_a, chunk_b``: each unordered pair once in which one is among the nearest of the other."""
    return found.select(F.least("id", "near").alias("chunk_a"), F.greatest("id", "near").alias("chunk_b")).distinct()


def _exact(width: int, k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"id": [], "near": [], "score": []})
        q, v, ids = _units(_stack(queries["vector"], width)), _units(_stack(rows["vector"], width)), rows["id"].to_numpy()
        out = []
        for i in range(0, len(q), 256):
            own = queries["id"].to_numpy()[i : i + 256, None]
            score = np.where(own == ids[None, :], -9.0, np.round(q[i : i + 256] @ v.T, DIGITS))
            # all that are as good as the k-th, so that ties go by id
            least = -np.partition(-score, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1, None]
            at, col = np.nonzero((score >= least) & (score > -9))
            order = np.lexsort((ids[col], -score[at, col], at))
            order = order[_first(at[order], k)]
            out.append(pd.DataFrame({"id": own[at[order], 0], "near": ids[col[order]], "score": score[at[order], col[order]]}))
        return pd.concat(out)

    return run


def exact_neighbours(df: DataFrame, key: str = "chunk_id", vector: str = "vector", width: int = 64, k: int = 10, every: int = 100, block: int = 10_000) -> DataFrame:
    """``id, near, score`` as :func:`neighbours`, but exact, and only for the ids divisible by ``every``.

    All rows are compared with all of those queries, block by block; of each pair of blocks the best k a query go on.
    """
    rows = usable(df, key, vector, width).groupBy("id").agg(F.min(F.struct("h1", "h2", "vector")).alias("x")).select("id", "x.vector")
    rows = materialized(rows, "vectors")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    q_blocks, blocks = max(1, -(-asked.count() // block)), max(1, -(-rows.count() // block))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    queries = asked.withColumn("q", deal(q_blocks)).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    others = rows.withColumn("b", deal(blocks)).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    best = queries.groupBy("q", "b").cogroup(others.groupBy("q", "b")).applyInPandas(_exact(width, k), "id long, near long, score double")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "near"))).where(F.col("rank") <= k).drop("rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``queries, pairs, found, recall``: how many rows of ``exact`` are among those of ``found``."""
    hits = exact.join(found.select("id", "near", F.lit(1).alias("hit")), ["id", "near"], "left")
    return hits.agg(
        F.count_distinct("id").alias("queries"), F.count("*").alias("pairs"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall")
    )
