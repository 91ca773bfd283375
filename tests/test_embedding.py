from __future__ import annotations

import json
import pickle

import numpy as np
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from hearthdex.embedding.base import AuthError, ContextExceeded, EmbedError, MockEmbedder, TransientError, byte_sums, l2_normalize
from hearthdex.embedding.batching import embed_all, with_retry
from hearthdex.embedding.budget import Budget, CannotShrink, concurrency, seed, tighten_column, tighten_target
from hearthdex.embedding.endpoint import Caps, classify, error_of, model_caps, parse_models, parse_props, probe_url, props_caps
from hearthdex.functions.vectors import cosine, normalized


@pytest.fixture
def counted(tmp_path):
    made = []

    def make(*a, **k):
        made.append(1)
        return MockEmbedder(*a, count_in=str(tmp_path / f"calls{len(made)}"), **k)

    return make


def test_mock_is_deterministic_and_of_unit_length(counted):
    e = counted(8)
    a, b = e.embed(["fn alpha", ""])
    assert np.isclose(np.linalg.norm(a), 1) and not b.any()
    want = [0.0] * 8
    for i, byte in enumerate("fn alpha".encode()):
        want[i % 8] += (byte + 1) * (i % 7 + 1)
    assert list(byte_sums("fn alpha", 8)) == want
    assert np.array_equal(e.embed(["fn alpha"])[0], a) and e.calls() == 2


def test_faults_survive_pickling():
    e = pickle.loads(pickle.dumps(MockEmbedder(4, limit=2, bytes_per_token=4)))
    with pytest.raises(ContextExceeded) as x:
        e.embed(["123456789"])
    again = pickle.loads(pickle.dumps(x.value))
    assert (again.n_prompt, again.n_ctx) == (3, 2)


def test_retry_only_what_may_pass(counted):
    assert len(with_retry(lambda e=counted(4, fail_first=2): e.embed(["a"]), (0, 0))) == 1
    for kind, calls, error in (("transient", 3, TransientError), ("auth", 1, AuthError), ("embed", 1, EmbedError)):
        e = counted(4, always=kind)
        with pytest.raises(error):
            with_retry(lambda e=e: e.embed(["a"]), (0, 0))
        assert e.calls() == calls


def test_requests_are_packed(counted):
    e = counted(4)
    assert embed_all(e, ["ab"] * 5, 2, 100).shape == (5, 4) and e.calls() == 3
    assert embed_all(e, [], 2, 100).shape == (0, 4) and e.calls() == 3


def test_budget_examples():
    assert [seed(2048), seed(None, 2048), seed(0, 1024), seed(None, 0)] == [8192, 8192, 4096, 8192]
    assert tighten_target(32768, 12000, 8192) == 20970 and tighten_target(1, 10**6, 8192) == 8188 == tighten_target(5, 0, 8192)
    assert [concurrency(2, 4), concurrency(None, 4), concurrency(None, None), concurrency(None, 64), concurrency(0, 4)] == [2, 4, 1, 8, 1]
    b = Budget(None, 2048)
    assert b.after_overflow("f", 8000, 4000, 2048) == 3840 and b.after_overflow("f", 5000, 2100, 2048) == 3840
    with pytest.raises(CannotShrink, match="no budget below"):
        b.after_overflow("f", 3000, 1, 2048)
    b.bytes = 2000
    with pytest.raises(CannotShrink, match="made smaller"):
        b.after_overflow("f", 1500, 3000, 2048)


@given(st.integers(1, 10**6), st.integers(0, 10**5), st.integers(1, 10**5))
def test_budgets_only_fall(sent, n_prompt, n_ctx):
    b = Budget(10_000)
    before = b.bytes
    assert b.tighten(sent, n_prompt, n_ctx) == (b.bytes < before)
    assert not b.tighten(sent, n_prompt, n_ctx)


def test_budget_column(spark):
    cases = [(32768, 12000, 8192), (1, 10**6, 8192), (5, 0, 8192), (7, 3, 2)]
    df = spark.createDataFrame(cases, "a long, b long, c long").coalesce(1)
    got = [r[0] for r in df.select(tighten_column(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [tighten_target(*c) for c in cases]


def test_answers(spark):
    over = json.dumps({"error": {"code": 400, "type": "exceed_context_size_error", "n_prompt_tokens": 9, "n_ctx": 4}})
    none = over.replace('"n_ctx": 4', '"n_ctx": 0')
    cases = [(400, over, "overflow"), (500, over, "overflow"), (400, none, "embed"), (401, "", "auth"), (403, "x", "auth"), (429, "", "transient"), (503, "<html>", "transient"), (404, "{}", "embed"), (200, "{}", "ok")]
    df = spark.createDataFrame([(s, b) for s, b, _ in cases], "s int, b string").coalesce(1)
    assert [r[0] for r in df.select(classify(F.col("s"), F.col("b"))).collect()] == [k for *_, k in cases]
    for status, body, kind in cases[:-1]:
        assert error_of(status, "u", body).kind == kind
    assert str(error_of(404, "u", "é" * 400)).endswith("é" * 300 + "…")


def test_capabilities(spark):
    props = json.dumps({"default_generation_settings": {"n_ctx": 8192}, "total_slots": 4})
    models = json.dumps({"data": [{"id": "x", "meta": {"n_ctx": 1}}, {"id": "m", "aliases": ["a"], "meta": {"n_ctx": 512}}, {"id": "bare"}]})
    assert parse_props(props) == Caps(8192, 4, "props") and parse_props("no") == Caps() == parse_props("[1]")
    assert parse_props(props.replace("8192", "0")) == Caps(None, 4, "none")
    assert parse_models(models, "a").max_input_tokens == 512 == parse_models(models, "m").max_input_tokens and parse_models(models, "bare") == Caps() == parse_models("", "m")
    assert Caps(None, 4).or_else(Caps(9, 2, "models")) == Caps(9, 4, "models")
    df = spark.createDataFrame([(props, models), ("no", "{}"), (None, None)], "p string, m string").coalesce(1)
    got = [tuple(r) for r in df.select(*props_caps(F.col("p")), model_caps(F.col("m"), "a"), model_caps(F.col("m"), "zz")).collect()]
    assert got == [(8192, 4, 512, None), (None, None, None, None), (None, None, None, None)]
    assert probe_url("http://h:1/x/", "a b") == "http://h:1/x/props?model=a+b" and probe_url("nowhere", "m") is None


def test_vectors(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([float("nan"), 1.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>").coalesce(1)
    assert [round(r[0], 6) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.96, -2.0, -2.0, -2.0, -2.0]
    assert [r[0] for r in df.select(normalized(F.col("a"))).limit(2).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert np.allclose(l2_normalize(np.array([[3.0, 4.0], [0.0, 0.0]])), [[0.6, 0.8], [0, 0]])
