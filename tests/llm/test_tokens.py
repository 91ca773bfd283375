"""Token ids against the library's encoder, and containers against bounds."""

from __future__ import annotations

from collections import Counter

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from hearthdex.llm.bpe import PATTERN, TrieEncoder, default_vocabulary, read_ranks, with_token_counts, with_token_ids
from hearthdex.llm.containers import best_two_fit, packed

tiktoken = pytest.importorskip("tiktoken")
RANKS = read_ranks(default_vocabulary())
TRIE = TrieEncoder(RANKS)
OTHER = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert TRIE.encode([text])[0] == OTHER.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abctheing THE 0123'sll\n\t\r .<|endoftext|>é語", max_size=120))
def test_words(text):
    assert TRIE.encode([text])[0] == OTHER.encode_ordinary(text)
    assert TRIE.count([text]) == [len(OTHER.encode_ordinary(text))]


def test_long_words_and_forgetting():
    encoder = TrieEncoder(RANKS, kept_words=3)
    texts = ["ab" * 4000, " " * 3000 + "x", "\U0001f600" * 500, "one two three four five", "six seven"] * 2
    assert encoder.encode(texts) == [OTHER.encode_ordinary(t) for t in texts]


def test_rows(spark):
    rows = [(1, "hello world", 5), (1, "hello world", 5), (2, None, 5), (3, "", 5), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r["doc_id"] or 0, list(r["ids"])) for r in with_token_ids(df).collect())
    hello = OTHER.encode_ordinary("hello world")
    assert got == sorted([(1, hello), (1, hello), (2, []), (3, []), (0, OTHER.encode_ordinary("x"))])
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in with_token_counts(df).collect()) == sorted([(1, 2), (1, 2), (2, 0), (3, 0), (0, 1)])
    assert with_token_ids(df.limit(0)).count() == 0 and with_token_ids(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


def test_all_documents(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    ids = {r["doc_id"]: list(r["ids"]) for r in with_token_ids(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    assert ids == {k: OTHER.encode_ordinary(t or "") for k, t in docs.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_containers_hold_what_fits(sizes):
    where = best_two_fit(np.array(sizes, dtype=int), 40)
    used = np.bincount(where, weights=sizes, minlength=0) if sizes else np.zeros(0)
    assert len(where) == len(sizes) and (used <= 40).all() and (used > 0).all()
    # no two containers could have been one, but for the last ones opened
    assert len(used) <= 2 * -(-sum(sizes) // 40) + 1


def test_two_smaller_items_replace_the_smallest():
    where = best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sorted(np.bincount(where, weights=[6, 3, 2, 2]).tolist()) == [3, 10]


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 5, 700, 2047, 2048, 2049, 9000])) for i in range(400)] + [(7, 100), (7, 100), (None, 50), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    found = packed(df, group_items=150).collect()
    used, per = {}, {}
    for r in found:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
        per.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["n_tokens"]))
    assert max(used.values()) <= 2048 and 900 not in per
    for doc, n in rows[:400]:
        if doc == 7:
            continue
        pieces = sorted(per.get(doc, []))
        assert sum(p[2] for p in pieces) == n and [p[1] for p in pieces] == [2048 * i for i in range(len(pieces))]
        assert len(pieces) == -(-n // 2048)
    assert sum(p[2] for p in per[7]) == dict(rows[:400])[7] + 200 and per[None] == [(0, 0, 50)]
    total = sum(n or 0 for _, n in rows)
    assert len(used) <= 1.05 * total / 2048  # sizes without small ones to fill gaps
    assert packed(df.limit(0)).count() == 0


def test_a_key_of_many_items_meets_in_no_one_group(spark):
    sizes = spark.createDataFrame([(None, 7)] * 300 + [(1, 7)] * 300, "doc_id long, n_tokens long")
    rows = packed(sizes, capacity=10, group_items=50).collect()
    assert len(rows) == 600 and sum(r["doc_id"] is None for r in rows) == 300
    per = Counter(r["container_id"] >> 40 for r in rows)
    assert len(per) == 12 and max(per.values()) < 120
