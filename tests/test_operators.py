import pytest

from paraleaf import cli
from paraleaf.operators import admission as D
from paraleaf.operators import layout_text as L
from paraleaf.operators import runner as R
from paraleaf.operators import tables as T


def cell(r0, r1, c0, c1, text):
    return {"row_start": r0, "row_end": r1, "col_start": c0, "col_end": c1, "text": text}


def grid(*cells, polygon=None, rows=2, cols=2):
    return {"table_id": "t", "polygon": polygon, "n_rows": rows, "n_cols": cols, "cells": list(cells)}


def test_table_metrics_of_a_pair():
    g = grid(cell(0, 1, 0, 2, "head"), cell(1, 2, 0, 1, "a"), cell(1, 2, 1, 2, "b"))
    p = grid(cell(0, 1, 0, 1, "head"), cell(1, 2, 0, 1, "a"), cell(1, 2, 1, 2, "b"))
    m = dict(zip(T.COLUMNS, T.metrics(g, p)))
    assert m["span_recall"] == pytest.approx(2 / 3) and m["cells_missing"] == 1 and m["cells_made_up"] == 1 and m["slot_accuracy"] == 0.5
    assert T.similarity(g, g) == 1
    far = [[100.0, 0.0], [110.0, 0.0], [110.0, 10.0], [100.0, 10.0]]
    near = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]
    assert T.similarity(g | {"polygon": near}, p | {"polygon": far}) == 0
    assert dict(zip(T.COLUMNS, T.metrics(g, None)))["span_f1"] == 0 and dict(zip(T.COLUMNS, T.metrics(None, None)))["span_f1"] == 1


def test_table_assignment(spark):
    schema = "page_id string, tables array<struct<table_id:string,region_id:string,polygon:array<array<double>>,n_rows:int,n_cols:int,cells:array<struct<row_start:int,row_end:int,col_start:int,col_end:int,text:string>>>>"
    one = lambda i, text: (i, None, None, 1, 1, [(0, 1, 0, 1, text)])
    g = spark.createDataFrame([("p", [one("a", "x" * 9), one("b", "y" * 9)]), ("q", None), ("r", [one("c", "z")])], schema)
    p = spark.createDataFrame([("p", [one("k", "y" * 9), one("l", "x" * 9)]), ("s", [one("m", "w")])], schema)
    got = {(r["page_id"], r["gold_table"], r["pred_table"], r["status"]) for r in T.table_metrics(g, p).collect()}
    assert got == {("p", "a", "l", "matched"), ("p", "b", "k", "matched"), ("r", "c", None, "missing"), ("s", None, "m", "extra")}


def test_rows_and_order(spark):
    assert L.rows_of_boxes([(0, 0, 10, 10), (20, 2, 30, 11), (0, 20, 10, 30)]) == [[0, 1], [2]]
    assert L.logical_order([("שלום", 50), ("2026", 20), ("OCR", 10), ("עולם", 0)]) == ["שלום", "OCR", "2026", "עולם"]
    assert L.logical_order([("b", 5), ("a", 0)]) == ["a", "b"]
    df = spark.createDataFrame([([("b", 0.0, 0.0, 5.0, 5.0), ("a", -9.0, 0.0, -5.0, 5.0), (None, 1.0, 1.0, 2.0, 2.0)],), (None,)], "w array<struct<text:string,x1:double,y1:double,x2:double,y2:double>>")
    assert [r[0] for r in df.select(L.visual_lines("w")).collect()] == [["a b"], None]


def test_admission(spark):
    schema = "system string, track string, suite string, model string, verified boolean, covered boolean, conformant boolean, score double"
    full = lambda s, **k: [(s, t, k.get("suite", "u"), "m", k.get("verified", True), k.get("covered", True), k.get("conformant", True), k.get("score", 1.0)) for t in D.TRACKS]
    rows = full("a") + full("b")[:4] + full("c", verified=False) + full("d", covered=None) + full("e", conformant=False) + full("f", score=None) + full("g", score=0.0) + full("h", suite=None)
    got = {r["system"]: (r["status"], r["headline"]) for r in D.admission(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("rankable", 100.0), "b": ("incomplete", None), "c": ("invalid_evidence", None), "d": ("incomplete_submission", None), "e": ("non_conformant", None), "f": ("invalid_metrics", None), "g": ("rankable", 0.0), "h": ("invalid_evidence", None)}
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert {tuple(r) for r in D.same_rows(a, b).collect()} == {("only_first", 1), ("only_second", 1)} and D.same_rows(a, a).count() == 0


def test_runner(spark):
    pages = spark.createDataFrame([("p", ("a.png", "h1")), ("q", ("b.png", None)), ("bad", (None, None))], "page_id string, image struct<path:string,sha256:string>")

    def predictor(envelope):
        assert set(envelope) == {"page_id", "image"}
        if envelope["page_id"] == "bad":
            raise RuntimeError("no image")
        return {"page_id": envelope["page_id"], "regions": []}

    first = R.predict(pages, predictor, "v1")
    rows = {r["page_id"]: r for r in first.collect()}
    assert rows["bad"]["status"] == "failed" and "no image" in rows["bad"]["failure"] and rows["p"]["status"] == "ok"
    cache = spark.createDataFrame([(r["cache_key"], r["page_id"], "cached", "ok", None, 0.0, 0) for r in rows.values() if r["page_id"] != "bad"], R.RESULT)
    again = {r["page_id"]: r["payload"] for r in R.predict(pages, predictor, "v1", cache).collect()}
    assert again["p"] == "cached" and again["bad"] != "cached"
    assert {r["payload"] == "cached" for r in R.predict(pages, predictor, "v2", cache).collect()} == {False}


def test_cli(capsys, tmp_path):
    assert cli.main(["list"]) == 0 and "q_line_error_rates" in capsys.readouterr().out
    f = tmp_path / "r.yaml"
    f.write_text("b: 1\na: [1, 2]\n")
    assert cli.main(["fingerprint", str(f)]) == 0 and len(capsys.readouterr().out.strip()) == 64
