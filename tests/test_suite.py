import math

from pyspark.sql import functions as F

from paraleaf.functions import geometry as G
from paraleaf.operators import suite as U

LINE = "struct<line_id:string,text:string,polygon:array<array<double>>,base_direction:string>"
PAGE = f"page_id string, image struct<width:int,height:int,sha256:string>, regions array<struct<region_id:string,polygon:array<array<double>>,lines:array<{LINE}>>>, tables array<struct<table_id:string,n_rows:int,n_cols:int,cells:array<struct<row_start:int,row_end:int,col_start:int,col_end:int>>>>, reading_order struct<edges:array<array<string>>>"
BOX = [[1.0, 1.0], [9.0, 1.0], [9.0, 9.0], [1.0, 9.0]]


def test_every_rule_once(spark):
    good = ("ok", (10, 10, "h"), [("a", BOX, [("1", "אבג", BOX, "rtl")]), ("b", BOX, None)], [("t", 1, 2, [(0, 1, 0, 1), (0, 1, 1, 2)])], ([["a", "b"]],))
    bad = (
        "bad",
        (10, 10, None),
        [("a", [[0.0, 0.0], [11.0, 1.0]], [("1", "é", BOX, "ltr"), ("1", "ָא‪", [[-1.0, 0.0], [1.0, 1.0], [2.0, 2.0]], "ltr"), (None, "אַ", None, "rtl")]), ("a", None, None)],
        [("t", 1, 1, [(0, 1, 0, 1), (0, 1, 0, 2)])],
        ([["a", "b"], ["b", "a"], ["a", "x"]],),
    )
    empty = ("empty", None, None, None, None)
    got = sorted((r["code"], r["location"]) for r in U.page_issues(spark.createDataFrame([good, bad, empty], PAGE)).collect() if r["page_id"] == "bad")
    want = {"duplicate_region_id", "duplicate_line_id", "polygon_out_of_bounds", "polygon_too_short", "text_not_nfc", "bidi_control", "presentation_form", "dangling_mark", "hebrew_line_not_rtl", "unknown_node", "cycle", "cell_out_of_bounds", "overlapping_cells", "missing_image_hash"}
    assert {c for c, _ in got} == want
    rows = U.page_issues(spark.createDataFrame([good, good, empty], PAGE)).collect()
    assert {(r["page_id"], r["code"]) for r in rows if r["code"] not in ("duplicate_region_id", "duplicate_line_id", "overlapping_cells")} == {("ok", "duplicate_page_id"), ("empty", "missing_image_hash")}
    assert U.page_issues(spark.createDataFrame([], PAGE)).count() == 0


def test_limited_keeps_children(spark):
    df = spark.createDataFrame([("p1", "a"), ("p2", "b"), ("p3", "a"), ("p4", None), ("p5", "c")], "page_id string, parent string")
    assert [r["page_id"] for r in U.limited(df, "page_id", 2).collect()] == ["p1", "p2"]
    assert sorted(r["page_id"] for r in U.limited(df, "page_id", 2, "parent").collect()) == ["p1", "p2", "p3"]


def test_ranks(spark):
    rows = [("r1", "s", "t", 0.2, 0.5), ("r2", "s", "t", 0.1, None), ("r3", "s", "t", None, None), ("r4", None, "t", 0.0, 0.0), ("r5", "s", "u", 0.3, 0.1)]
    df = spark.createDataFrame(rows, "run string, suite string, track string, e double, f double")
    ranked = U.contract_rank(df, ["suite", "track"], "e", "f", "run", F.col("run") != "r3")
    assert {r["run"]: r["rank"] for r in ranked.collect()} == {"r1": 2, "r2": 1, "r3": None, "r4": None, "r5": 1}
    assert [r["run"] for r in U.final_order(ranked, "suite", "track", "rank", "e", "run").orderBy("position").collect()] == ["r2", "r1", "r5", "r3", "r4"]


def test_ngrams_and_manifest(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(U.ngrams(F.col("w"), 2)).collect()] == [["a b", "b c"], [], []]
    m = spark.createDataFrame([("1", "x", "y"), ("2", None, "z"), ("3", None, None)], "sample_id string, text string, label string")
    assert [(r["text"], r["image"]) for r in U.manifest(m).collect()] == [("x", None), ("z", None), (None, None)]


def test_polygon_repair():
    bow = [[0, 0], [2, 2], [2, 0], [0, 2]]
    assert G.repaired_polygon(BOX) == ("kept", BOX)
    assert G.repaired_polygon(bow)[0] == "hull" and len(G.repaired_polygon(bow)[1]) == 4
    assert G.repaired_polygon([BOX[0], *BOX])[0] == "deduplicated"
    assert G.repaired_polygon([[0, 0], [1, 1], [2, 2]]) == ("empty", []) and G.repaired_polygon(None) == ("empty", [])
    circle = [[math.cos(k / 10), math.sin(k / 10)] for k in range(62)]
    assert G.is_simple(circle) and len(G.convex_hull(circle + [[0, 0]])) == 62
    assert not G.is_simple([[0, 0], [4, 0], [4, 2], [2, 0], [0, 2]])
