import random

import numpy as np
import pytest

from paraleaf.llm import packing as P


def test_best_fit_keeps_every_limit():
    rng = random.Random(1)
    for rule in ("norm", "dot"):
        s = np.array([rng.randint(1, 100) for _ in range(500)])
        b = P.best_fit(s, 100, 6, 0, rule)
        load, docs = np.bincount(b, weights=s), np.bincount(b)
        assert load.max() <= 100 and docs.max() <= 6 and docs.min() >= 1
        assert s.sum() / (100 * len(load)) > 0.9
    b = P.best_fit(np.array([50, 50, 50]), 100, 1, 0)
    assert sorted(b.tolist()) == [0, 1, 2]
    assert len(P.best_fit(np.array([], int), 100, 5, 0)) == 0


WINDOWS = "window_id long, model_name string, capacity_tokens int"


def test_windows(spark):
    counts = spark.createDataFrame([(1, 10), (2, 25), (3, 0), (4, 7), (5, 3), (6, 10)], "doc_id long, n_tokens int")
    windows = spark.createDataFrame([(1, "a", 10), (2, "b", 40), (3, "c", None), (None, "d", 5), (4, "e", 0)], WINDOWS)
    rows = P.fill_windows(counts, windows, max_docs_share=1).collect()
    one = [r for r in rows if r["window_id"] == 1]
    assert {r["window_id"] for r in rows} == {1, 2}
    assert sorted((r["doc_id"], r["piece_no"], r["first_token"], r["n_tokens"]) for r in one) == [(1, 0, 0, 10), (2, 0, 0, 10), (2, 1, 10, 10), (2, 2, 20, 5), (3, 0, 0, 0), (4, 0, 0, 7), (5, 0, 0, 3), (6, 0, 0, 10)]
    load = {}
    for r in one:
        if r["n_tokens"]:
            load[r["window_no"]] = load.get(r["window_no"], 0) + r["n_tokens"]
        else:
            assert r["window_no"] is None
    assert max(load.values()) <= 10 and len(load) == 6
    assert all(r["piece_no"] == 0 for r in rows if r["window_id"] == 2)
    assert P.fill_windows(counts.limit(0), windows).count() == 0 and P.fill_windows(counts, windows.limit(0)).count() == 0
    report = {r["window_id"]: r["n_windows"] for r in P.window_report(P.fill_windows(counts, windows, 1), windows).collect()}
    assert report[1] == 6 and report[2] == 2


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([(1, "hello world", 0), (2, None, 0), (3, "", 0), (4, "שלום " * 5000, 0), (None, "x", 0)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in P.token_counts(df, "doc_id", "text").collect()}
    enc = P._encoder(P.TOKENIZERS, P.TOKENIZER)
    assert got == {1: len(enc.encode_ordinary("hello world")), 2: 0, 3: 0, 4: len(enc.encode_ordinary("שלום " * 5000))}


def test_attention_binds():
    rng = random.Random(2)
    for rule in ("norm", "dot"):
        s = np.array([rng.randint(1, 100) for _ in range(400)])
        b = P.best_fit(s, 100, 50, 0.3 * 100 * 100, rule)
        cost, docs = np.bincount(b, weights=s * s), np.bincount(b)
        assert ((cost <= 3000) | (docs == 1)).all() and (docs > 1).any() and np.bincount(b, weights=s).max() <= 100
    assert len(set(P.best_fit(np.array([50, 50]), 100, 8, 4000.0).tolist())) == 2
    assert len(set(P.best_fit(np.array([50, 50]), 100, 8, 10000.0).tolist())) == 1


def test_too_many_windows(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_WINDOWS", 2, raising=False)
    counts = spark.createDataFrame([(1, 10)], "doc_id long, n_tokens int")
    windows = spark.createDataFrame([(i, "a", 10 + i) for i in range(3)], WINDOWS)
    with pytest.raises(ValueError):
        P.fill_windows(counts, windows)
    assert P.fill_windows(counts, windows.limit(2)).count() == 2
