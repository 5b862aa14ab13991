import json

from paraleaf.operators.nested import LEVELS, PAIR, PAIRS, XY, XYS, delta, page_tables, rows_of, states, structural_tables, subtype_table, write_structural_tables

PAGE = {
    "page_id": "p1",
    "regions": [
        {"region_id": "r1", "lines": [{"line_id": "l1", "text": "a", "polygon": [[1, 2], [3, 4.5]]}, {"id": "l2", "text": "b", "polygon": None}], "regions": [{"region_id": "r2", "lines": {"line_id": "l1", "text": "c", "polygon": "1,2 3,4 5,6"}}]},
        {"region_id": "r3", "lines": [{"line_id": "l1", "text": "d", "polygon": [{"x": 1, "y": 2}]}]},
        {"region_id": "r4", "lines": None},
    ],
}


def test_states():
    assert delta("array", None, {"number"}) == PAIR and delta("array", None, {PAIR}) == PAIRS
    assert delta("object", frozenset("xy"), {"x": "number", "y": "number"}) == XY and delta("array", None, {XY}) == XYS
    s = states(PAGE)
    assert s[id(PAGE)] == "page" and s[id(PAGE["regions"])] == "regions" and s[id(PAGE["regions"][0]["lines"])] == "lines"


def test_points_of_all_encodings():
    got = [r[2:5] for r in rows_of(1, json.dumps({"result": {"pages": [PAGE]}}), "point")]
    assert got == [("r1", "l1", 1), ("r1", "l1", 2), ("r1", "l2", 0), ("r2", "l1", 1), ("r2", "l1", 2), ("r2", "l1", 3), ("r3", "l1", 1)]
    assert len(list(rows_of(1, "\ufeff" + json.dumps(PAGE), "point"))) == 7
    twice = json.dumps(json.dumps(PAGE))
    assert len(list(rows_of(1, twice, "point"))) == 7
    assert [r[4] for r in rows_of(1, json.dumps(PAGE), "region")] == [None, "r1", None, None]


def test_payloads_without_json():
    for p in (None, "", "null", "5", "upstream error", '{"page_id": "x", "regions": [', '"text"', "[]", "{}"):
        assert list(rows_of(1, p, "point")) == []


def test_deep_payload_does_not_recurse():
    inner = '{"region_id": "r", "lines": [{"line_id": "l", "text": "t", "polygon": []}]}'
    assert len(list(rows_of(1, f'{{"page_id": "p", "regions": [{inner}]}}', "point"))) == 1
    node = {"region_id": "r0", "lines": []}
    for i in range(300):
        node = {"region_id": f"r{i + 1}", "lines": [], "regions": [node]}
    assert len(list(rows_of(1, json.dumps({"page_id": "p", "regions": [node]}), "region"))) == 301


def test_table(spark, tmp_path):
    rows = [(1, json.dumps(PAGE), "x"), (1, json.dumps(PAGE), "y"), (None, json.dumps(PAGE), "z"), (2, "bad", "w")]
    raw = spark.createDataFrame(rows, "raw_id long, payload string, page_id string")
    assert structural_tables(raw, "point").count() == 7
    assert structural_tables(raw, "line").count() == 4 and structural_tables(raw, "page").count() == 1
    assert structural_tables(raw.limit(0), "point").count() == 0
    paths = write_structural_tables(raw, str(tmp_path))
    assert set(paths) == set(LEVELS) and spark.read.parquet(paths["point"]).count() == 7


def test_every_level_keeps_its_parent(spark, tmp_path):
    page = {
        "page_id": "p",
        "model": {"name": "m"},
        "form_fields": [{"field_id": "f", "value_text": "v"}, {"field_id": "g", "label_text": "l", "value_text": None}, 7],
        "regions": [{"region_id": "r", "polygon": [[0, 0], [1, 0], [1, 1]], "lines": [{"line_id": "l", "text": "a b", "words": [{"text": "a", "conf": 0.5}, "b"], "tags": ["x", "y"], "reading_index": 2}, {"line_id": "k", "words": None, "tags": []}]}],
    }
    raw = spark.createDataFrame([(1, json.dumps(page)), (2, None), (3, "[1, 2]")], "raw_id long, payload string")
    get = lambda level, *cols: [tuple(r[c] for c in cols) for r in structural_tables(raw, level).collect()]
    assert get("word", "region_id", "line_id", "word_no", "text", "conf") == [("r", "l", 1, "a", 0.5), ("r", "l", 2, "b", None)]
    assert get("tag", "line_id", "tag_no", "tag") == [("l", 1, "x"), ("l", 2, "y")]
    assert get("field", "page_id", "field_no", "field_id", "label_text", "value_text") == [("p", 1, "f", None, "v"), ("p", 2, "g", "l", None)]
    assert get("region_point", "region_id", "point_no", "x", "y") == [("r", 1, 0.0, 0.0), ("r", 2, 1.0, 0.0), ("r", 3, 1.0, 1.0)]
    write_structural_tables(raw, str(tmp_path / "t"))
    for level in LEVELS:
        once = sorted(map(str, structural_tables(raw, level).collect()))
        assert sorted(map(str, subtype_table(spark, str(tmp_path / "t"), level).collect())) == once
    shapes = {r["subtype"] for r in subtype_table(spark, str(tmp_path / "t"), "line").collect()}
    assert shapes == {"line[points:none+words+tags+indexed]", "line[points:none]"}
    assert "n_words" not in subtype_table(spark, str(tmp_path / "t"), "line", "line[points:none]").columns
    assert subtype_table(spark, str(tmp_path / "t"), "line", "line[points:none+words+tags+indexed]").select("n_words", "reading_index").collect() == [(2, 2)]


def test_typed_columns(spark):
    schema = "pred_id long, page_id string, regions array<struct<region_id:string,type:string,reading_index:int,lines:array<struct<line_id:string,text:string,reading_index:int,polygon:array<array<double>>>>>>"
    rows = [(1, "p", [("r", "t", 0, [("l", "x", 0, [[1.0, 2.0]]), ("m", "y", None, None)])]), (2, "q", None), (3, "s", [("r", None, None, None)])]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r["point_no"] for r in page_tables(df, "point").collect()) == [0, 1]
    assert page_tables(df, "region").count() == 2 and page_tables(df, "line").count() == 2
