"""Merging, ordering, floors and budgets of hits, and exact neighbours."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from hearthdex.operators.islands import merged
from hearthdex.operators.knn import nearest, nearest_many
from hearthdex.operators.select import distilled, focus_why, ranked, relevance_floor, render, token_budget

HIT = "path string, start_line long, end_line long, chunk_index long, score float, text string, language string, symbol string, extra int"


def hits(spark, rows):
    return spark.createDataFrame([(p, a, b, i, s, t, "rust", None, 1) for p, a, b, i, s, t in rows], HIT)


def entries(df):
    return [(r["path"], r["start_line"], r["end_line"], r["code"]) for r in df.orderBy("rank").collect()]


def test_touching_hits_merge(spark):
    df = hits(spark, [("a", 1, 5, 0, 0.9, "x"), ("a", 6, 8, 1, 0.8, "y"), ("b", 1, 2, 0, 0.7, "z"), ("a", 11, 12, 2, 0.1, "far")])
    assert entries(distilled(merged(df), False, 0.0)) == [("a", 1, 8, "x\ny"), ("b", 1, 2, "z"), ("a", 11, 12, "far")]


def test_one_line_gap_merges_two_do_not(spark):
    df = hits(spark, [("a", 1, 3, 0, 0.9, "x"), ("a", 5, 6, 1, 0.8, "y"), ("a", 9, 9, 2, 0.7, "z")])
    assert [e[1:3] for e in entries(distilled(merged(df), False, 0.0))] == [(1, 6), (9, 9)]


def test_pieces_of_a_line_join_without_a_break(spark):
    same = hits(spark, [("a", 1, 1, 1, 0.9, "cd"), ("a", 1, 1, 0, 0.8, "ab")])
    assert entries(distilled(merged(same), False, 0.0)) == [("a", 1, 1, "abcd")]
    overlap = hits(spark, [("a", 1, 80, 0, 0.9, "p"), ("a", 65, 144, 1, 0.8, "q")])
    assert entries(distilled(merged(overlap), False, 0.0)) == [("a", 1, 144, "p\nq")]


def test_random_islands_match_the_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), s := rng.randrange(1, 60), s + rng.randrange(0, 9), i, rng.random(), f"<{i}>") for i in range(120)]
    want = {}
    for path in "abc":
        last = None
        for p, a, b, i, _s, t in sorted((r for r in rows if r[0] == path), key=lambda r: (r[1], r[3])):
            if last is not None and a <= last[1] + 2:
                last[2] += ("\n" if a > last[3] else "") + t
                last[1] = max(last[1], b)
                last[3] = a
            else:
                last = [a, b, t, a]
                want.setdefault(path, []).append(last)
    got = {}
    for r in merged(hits(spark, rows)).orderBy("path", "start_line").collect():
        got.setdefault(r["path"], []).append([r["start_line"], r["end_line"], r["code"]])
    assert {k: sorted(x[:3] for x in v) for k, v in want.items()} == {k: sorted(v) for k, v in got.items()}


def test_ties_and_nan(spark):
    df = hits(spark, [("z", 1, 1, 0, 0.5, "z"), ("m", 1, 1, 0, float("nan"), "m"), ("a", 1, 1, 0, 0.5, "a"), ("n", 1, 1, 0, None, "n")])
    assert [e[0] for e in entries(distilled(merged(df), False, 0.0))] == ["a", "z"]
    assert [r["path"] for r in ranked(merged(df)).orderBy("rank").collect()] == ["a", "z", "m", "n"]


def test_floor(spark):
    def kept(scores, ratio):
        df = hits(spark, [(f"p{i}", 1, 1, 0, s, "x") for i, s in enumerate(scores)])
        return relevance_floor(ranked(merged(df)), ratio).count()

    assert kept([1.0, 0.9, 0.8, 0.5], 0.75) == 3
    assert kept([0.9, 0.3, 0.2], 0.75) == 1
    assert kept([-0.1, -0.4], 0.75) == 1
    assert kept([0.5, 0.1], -3) == 2
    assert kept([0.5, 0.4], 7) == 1


def test_budget_passes_over_what_does_not_fit(spark):
    rows = [("a", 0.9, 400), ("b", 0.8, 4000), ("c", 0.7, 100), ("d", 0.6, 90)]
    df = hits(spark, [(p, 1, 1, 0, s, "x" * n) for p, s, n in rows])
    assert [r["path"] for r in token_budget(ranked(merged(df)), 150).orderBy("rank").collect()] == ["a", "c", "d"]
    assert [r["path"] for r in token_budget(ranked(merged(df)), 1).orderBy("rank").collect()] == ["a"]


def test_render(spark):
    df = hits(spark, [("a.rs", 3, 4, 0, 0.5, "// banner\nfn a() {}")])
    assert render(distilled(merged(df))) == "a.rs:3-4 (similarity 0.500)\n```rust\nfn a() {}\n```\n\n"
    assert render(distilled(merged(df.limit(0)))) == "No matches."
    why = spark.range(1).select(focus_why(F.lit(0.25), F.lit(True)), focus_why(F.lit(0.25), F.lit(False))).first()
    assert tuple(why) == ("focus similarity 0.250 (partial: split to fit the embedding window)", "focus similarity 0.250")


def test_nearest_is_total_and_lean(spark):
    rows = [("b", 0, [1.0, 0.0]), ("a", 1, [1.0, 0.0]), ("a", 0, [2.0, 0.0]), ("c", 0, [0.0, 0.0]), ("d", 0, None), ("e", 0, [float("nan"), 1.0]), ("f", 0, [0.0, 1.0]), ("g", 0, [1.0])]
    df = spark.createDataFrame(rows, "path string, chunk_index int, vector array<float>")
    found = nearest(df, [1.0, 0.0], 4)
    assert [(r["path"], r["chunk_index"]) for r in found.collect()] == [("a", 0), ("a", 1), ("b", 0), ("f", 0)]
    assert nearest(df, [1.0, 0.0], 0).count() == 1
    assert [r["score"] for r in nearest(df, [1.0, 0.0], 99).collect()][-1] == -2.0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "Exchange" not in plan


def test_nearest_many_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {(r["query_id"], r["rank"]): r["neighbour_id"] for r in nearest_many(df, df.where("vec_id % 7 = 0"), 3, block=4).collect()}

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 6)

    plain = {i: [float(__import__("numpy").float32(x)) for x in v] for i, v in rows[:60]}
    for q in range(0, 60, 7):
        best = sorted(((-cos(plain[q], plain[i]), i) for i in plain if i != q))[:3]
        assert [got[q, k + 1] for k in range(3)] == [i for _, i in best]
    assert nearest_many(df, df.limit(0), 3).count() == 0
