import os

import pytest

from paraleaf.operators import agreement as G
from paraleaf.operators import packs as P


def test_root_is_bound(spark, tmp_path):
    root = str(tmp_path / "root")
    df = spark.createDataFrame([("p", 1)], "page_id string, n int")
    P.build_root(root, {"gold": df}, {"stats.json": {"b": 1, "a": 2}})
    assert P.verify_root(root) == [] and len(P.freeze(root)) == 64 and P.verify_root(root) == []
    with open(os.path.join(root, "stats.json"), "a") as f:
        f.write(" ")
    open(os.path.join(root, "more.txt"), "w").close()
    assert P.verify_root(root) == ["added: more.txt", "changed: stats.json"]
    with pytest.raises(ValueError):
        P.freeze(root)
    with pytest.raises(FileExistsError):
        P.build_root(root, {}, {})


def test_ids(spark):
    pages = spark.createDataFrame([("p",), ("q",), ("r",)], "page_id string")
    ids = P.id_map(pages, "k")
    assert P.aliases_wrong(ids, "k").count() == 0 and P.aliases_wrong(ids, "other").count() == 3
    sub = ids.where("page_id <> 'r'").select("public_id").unionByName(ids.where("page_id = 'q'").select("public_id")).unionByName(spark.createDataFrame([("zzz",)], "public_id string"))
    rows, problems = P.map_back(sub, ids)
    assert rows.count() == 3 and sorted(r["problem"] for r in problems.collect()) == ["duplicate", "missing", "unknown"]


def test_given_away(spark):
    df = spark.createDataFrame([("a", ("x",)), ("/home/a", ("x",))], "image string, inner struct<text:string>")
    assert {r["problem"] for r in P.given_away(df).collect()} == {"forbidden_key"}
    assert [r["problem"] for r in P.given_away(df.select("image")).collect()] == ["local_path"]


def test_agreement():
    assert G.agreement("שלום 12, a", "שלום 12, a") == (1.0, 1.0, 1.0)
    assert G.bag_f1([], []) == 1 and G.bag_f1(["a"], []) == 0
    content, order, punctuation = G.agreement("a b c.", "c b a!")
    assert content == 1 and order < 1 and punctuation == 0


def test_remap(spark):
    e = spark.createDataFrame([("p", "x", "y"), ("p", "y", "ghost")], "page_id string, a string, b string")
    n = spark.createDataFrame([("p", "x"), ("p", "y")], "page_id string, node string")
    m = spark.createDataFrame([("p", "x", "g1")], "page_id string, node string, gold_id string")
    got = {(r["a"], r["b"]) for r in G.remapped_edges(e, n, m).collect()}
    assert got == {("g1", "__prediction_unmatched__:0:y"), ("__prediction_unmatched__:0:y", "__prediction_unknown__:0:ghost")}
