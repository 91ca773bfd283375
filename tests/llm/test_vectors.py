from __future__ import annotations

import numpy as np

from hearthdex.llm.graph import Graph
from hearthdex.llm.neighbours import exact_neighbours, neighbour_pairs, neighbours, recall as recall_of

SCHEMA = "chunk_id long, vector array<float>, id int, class string"


def clusters(n, seed=0, width=16):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, width))
    return (centre[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, width))).astype(np.float32)


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(v @ v.T, 6)
    out = {}
    for i in range(len(ids)):
        order = [j for j in np.lexsort((ids, -score[i])) if j != i][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_graph_finds_most_neighbours():
    v = clusters(3000)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = Graph(v)
    found, far = graph.search(v[:500], np.arange(500, dtype=np.int32), 40)
    score = v[:500] @ v.T
    tenth = np.sort(score, axis=1)[:, -11]
    assert (np.diff(far, axis=1) >= -1e-6).all()
    assert ((1 - far) >= tenth[:, None] - 1e-6).sum(axis=1).clip(0, 11).mean() / 11 > 0.95
    assert (graph.filled <= graph.slack).all()
    for edges in graph.edges[:50]:
        real = edges[edges >= 0]
        assert len(set(real.tolist())) == len(real)


def test_small_and_empty_graphs():
    assert Graph(np.zeros((0, 4), np.float32)).n == 0
    one = Graph(np.array([[1.0, 0.0]], np.float32))
    assert one.search(np.array([[1.0, 0.0]], np.float32))[0][0, 0] == 0
    same = Graph(np.tile(np.array([[1.0, 0.0]], np.float32), (300, 1)))
    assert (same.search(same.v[:3])[0][:, 0] >= 0).all()


def recall(got, want):
    hit = sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items())
    return hit / sum(len(w) for w in want.values())


def collect(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], []).append((-r["score"], r["near"]))
    return {k: [n for _, n in sorted(v)] for k, v in out.items()}


def test_recall_over_many_shards(spark):
    rows = [(i * 3, x.tolist()) for i, x in enumerate(clusters(1500, 1))]
    df = spark.createDataFrame([(i, x, 1, "c") for i, x in rows], SCHEMA).repartition(3)
    got = collect(neighbours(df, width=16, k=5, shard=200))
    assert all(len(v) == 5 for v in got.values()) and len(got) == 1500
    assert recall(got, brute(rows, 5)) > 0.9


def test_large_shards_are_dealt_out(spark, monkeypatch):
    from hearthdex.llm import neighbours as module

    monkeypatch.setattr(module, "GRAPH", 100)
    monkeypatch.setattr(module, "SEARCHES", 150)
    rows = [(i, x.tolist()) for i, x in enumerate(clusters(600, 2))]
    df = spark.createDataFrame([(i, x, 1, "c") for i, x in rows], SCHEMA)
    assert recall(collect(neighbours(df, width=16, k=5, shard=300)), brute(rows, 5)) > 0.9


def test_copies_ties_and_unusable_rows(spark):
    hot = [1.0, 2.0, 2.0, 0.0]
    rows = [(i, hot) for i in range(0, 40)] + [(100 + i, x.tolist()) for i, x in enumerate(clusters(30, 3, 4))] + [(200, [2.0, 4.0, 4.0, 0.0])]
    bad = [(300, None), (301, [1.0]), (302, [0.0] * 4), (303, [float("nan"), 1.0, 1.0, 1.0]), (304, [float("inf"), 1.0, 1.0, 1.0]), (305, [None, 1.0, 1.0, 1.0]), (None, hot)]
    df = spark.createDataFrame([(i, x, 1, "c") for i, x in rows + bad + rows[:5]], SCHEMA)
    got = collect(neighbours(df, width=4, k=5))
    want = brute(rows, 5)
    assert got.keys() == want.keys()
    assert all(sorted(got[i]) == sorted(want[i]) for i in (*range(40), 200))
    assert got[3] == [0, 1, 2, 4, 5] and got[200] == [0, 1, 2, 3, 4]
    pairs = neighbour_pairs(neighbours(df, width=4, k=5)).collect()
    assert all(a < b for a, b in pairs) and len(set(map(tuple, pairs))) == len(pairs)


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, "c"), (2, [0.0, 1.0], 1, "c")], SCHEMA)
    assert sorted(tuple(r) for r in neighbours(df, width=2).collect()) == [(1, 2, 0.0), (2, 1, 0.0)]
    assert neighbours(df.limit(1), width=2).count() == 0 and neighbours(df.limit(0), width=2).count() == 0


def test_hot_group_of_scaled_copies(spark):
    rng = np.random.default_rng(6)
    hot = rng.normal(size=64).astype(np.float32)
    rows = [(2 * i, (hot * np.float32(s)).tolist()) for i, s in enumerate(rng.uniform(0.01, 90, 2000))]
    rows += [(2 * i + 1, x.tolist()) for i, x in enumerate(clusters(1000, 4, 64))] + [(5001, (hot + 0.4 * rng.normal(size=64)).astype(np.float32).tolist())]
    df = spark.createDataFrame([(i, x, 1, "c") for i, x in rows], SCHEMA).repartition(3)
    got, want = collect(neighbours(df, shard=300)), brute(rows, 10)
    assert got.keys() == want.keys()
    assert all(got[2 * i] == want[2 * i] for i in range(2000))
    assert got[5001] == want[5001] and recall(got, want) > 0.9


def test_recall_against_all_rows_in_blocks(spark):
    rows = [(i, x.tolist()) for i, x in enumerate(clusters(700, 8))] + [(i, [1.0] * 16) for i in range(2000, 2030)]
    df = spark.createDataFrame([(i, x, 1, "c") for i, x in rows], SCHEMA)
    want = brute(rows, 5)
    exact = collect(exact_neighbours(df, width=16, k=5, every=10, block=90))
    assert exact == {i: [*want[i]] for i in want if i % 10 == 0}
    one = recall_of(neighbours(df, width=16, k=5, shard=200), exact_neighbours(df, width=16, k=5, every=10)).first()
    assert one["queries"] == 73 and one["pairs"] == 365 and one["recall"] > 0.95 and one["found"] == round(one["recall"] * 365)
    assert exact_neighbours(df.limit(0), width=16).count() == 0


def test_lists_of_hot_classes_are_salted(spark, monkeypatch):
    from hearthdex.llm import neighbours as module

    monkeypatch.setattr(module, "HOT", 7)
    rows = [(i, [1.0, float(i % 2)]) for i in range(60)] + [(100, [-1.0, 0.2]), (101, [0.9, 0.3])]
    df = spark.createDataFrame([(i, x, 1, "c") for i, x in rows], SCHEMA)
    for bound in (100_000, 0):
        monkeypatch.setattr(module, "HOT_CLASSES", bound)
        assert collect(neighbours(df, width=2, k=4)) == brute(rows, 4)
