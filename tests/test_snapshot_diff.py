from __future__ import annotations

import random
from datetime import datetime, timedelta

from hearthdex.operators.snapshot_diff import leaf_bits_for, snapshot_changes

STATES = "repo string, snapshot_no int, path string, hash string, n_bytes long, loaded_at timestamp, status string, node long"
SNAPSHOTS = "repo string, snapshot_no int, taken_at timestamp, status string, path string"
T0 = datetime(2031, 3, 1)


def clean(path):
    out = []
    for x in path.replace("\\", "/").split("/"):
        if x == "..":
            out = out[:-1]
        elif x not in ("", "."):
            out.append(x)
    return "/".join(out)


def brute(states, snapshots):
    latest = {}
    for repo, no, path, digest, _, at, *_x in states:
        if None in (repo, no, path):
            continue
        key = (repo, no, clean(path))
        value = (at or datetime.min, (digest or "").lower().removeprefix("blake3:"))
        latest[key] = max(latest.get(key, value), value)
    out = set()
    for repo in {s[0] for s in snapshots}:
        done = sorted({s[1] for s in snapshots if s[0] == repo and s[3] == "complete" and s[1] is not None})
        for before, now in zip(done, done[1:]):
            a = {k[2]: v[1] for k, v in latest.items() if k[:2] == (repo, before) and v[1]}
            b = {k[2]: v[1] for k, v in latest.items() if k[:2] == (repo, now) and v[1]}
            out |= {(repo, now, p, "added") for p in b.keys() - a.keys()} | {(repo, now, p, "removed") for p in a.keys() - b.keys()}
            out |= {(repo, now, p, "changed") for p in a.keys() & b.keys() if a[p] != b[p]}
    return out


def run(spark, states, snapshots, **more):
    found = snapshot_changes(spark.createDataFrame(states, STATES), spark.createDataFrame(snapshots, SNAPSHOTS), **more)
    assert found.columns == ["repo", "snapshot_no", "path", "kind"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_random_histories_match_brute_force(spark):
    rng = random.Random(3)
    states, snapshots = [], []
    for repo in ("a", "b", "hot"):
        for no in range(1, 6):
            status = rng.choice(["complete", "complete", "complete", "partial", "failed"])
            snapshots.append((repo, no, T0, status, None))
            for i in range(120 if repo == "hot" else 15):
                if rng.random() < 0.8:
                    path = rng.choice([f"d/f{i}.rs", f"./d/f{i}.rs", f"d\\f{i}.rs", f"d//f{i}.rs", f"d/x/../f{i}.rs"])
                    digest = rng.choice([f"{i:032x}", f"{i:032X}", f"blake3:{i:032x}", f"{i + 1:032x}", None])
                    for _ in range(rng.choice([1, 1, 2])):
                        states.append((repo, no, path, digest, None, T0 + timedelta(minutes=i), None, 1))
    want = brute(states, snapshots)
    assert want and run(spark, states, snapshots) == want
    assert run(spark, states, snapshots, leaf_bits=4, fanout_bits=2) == want


def test_late_rows_nulls_and_moves(spark):
    snapshots = [("r", 1, T0, "complete", "x"), ("r", 1, T0, "complete", "x"), ("r", 2, T0, "failed", None), ("r", 3, T0, "complete", None), ("r", 4, T0, "complete", None), (None, 1, T0, "complete", None)]
    early, late = T0, T0 + timedelta(days=9)
    states = [
        ("r", 1, "a", "aa" * 16, 1, early, None, None), ("r", 1, "a", "bb" * 16, 1, late, None, None), ("r", 1, "gone", "cc" * 16, 1, early, None, None),
        ("r", 2, "never", "dd" * 16, 1, early, None, None), ("r", 3, "a", "BB" * 16, 1, early, None, None), ("r", 3, "moved", "cc" * 16, 1, early, None, None),
        ("r", 3, "unread", "ee" * 16, 1, early, None, None), ("r", 3, "unread", None, 1, late, None, None), ("r", 3, None, "ee" * 16, 1, early, None, None),
        (None, 3, "x", "ee" * 16, 1, early, None, None), ("other", 3, "x", "ee" * 16, 1, early, None, None),
    ]
    assert run(spark, states, snapshots) == {
        ("r", 3, "gone", "removed"), ("r", 3, "moved", "added"), ("r", 4, "a", "removed"), ("r", 4, "moved", "removed"),
    }


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [], [("r", 1, T0, "complete", None), ("r", 2, T0, "complete", None)]) == set()


def test_leaves_by_the_rows_of_the_largest_snapshot():
    assert [leaf_bits_for(n) for n in (0, 1, 600, 6_000, 10**6, 10**9)] == [8, 8, 8, 8, 16, 32]
    assert leaf_bits_for(10**9, 4) == 28 and leaf_bits_for(10**30) == 48 and leaf_bits_for(10**30, 5) == 45
