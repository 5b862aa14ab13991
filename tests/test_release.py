import json

import pytest

from paraleaf.operators import packs as P
from paraleaf.plans import files

LINE = "struct<line_id:string,text:string,polygon:array<array<double>>,base_direction:string>"
SCHEMA = f"page_id string, document_id string, split string, metadata struct<source_collection:string>, image struct<width:int,height:int,sha256:string>, regions array<struct<region_id:string,polygon:array<array<double>>,lines:array<{LINE}>>>, tables array<struct<table_id:string,n_rows:int,n_cols:int,cells:array<struct<row_start:int,row_end:int,col_start:int,col_end:int>>>>, reading_order struct<edges:array<array<string>>>"
REGISTRY = [{"source_id": "s", "license_expression": "CC0"}, {"source_id": "unused", "license_expression": "none"}]


def page(pid, doc="d", split="test", source="s", direction="rtl"):
    return (pid, doc, split, (source,), (10, 10, "h"), [("r", None, [("l", "אבג", None, direction)])], None, None)


def certified(spark, folder, rows, **change):
    how = {"registry": REGISTRY, "accepted": {"CC0"}, "version": "1"} | change
    df = spark.createDataFrame(rows, SCHEMA)
    if not files.exists(folder):
        P.build_release(folder, df, REGISTRY, "1")
    return {k for k, v in P.certify(folder, df.schema, **how).items() if not v}


def test_twelve_checks(spark, tmp_path):
    good = [page("p"), page("q"), page("x", "e", "train")]
    root = str(tmp_path / "good")
    assert certified(spark, root, good) == set() and json.loads(files.read_text(f"{root}/{P.CERTIFICATION}"))["certified"]
    assert len(P.certify(root, spark.createDataFrame(good, SCHEMA).schema, REGISTRY, {"CC0"}, "1")) == 12
    assert certified(spark, root, good, version="2") == {"benchmark_version"}
    assert certified(spark, root, good, accepted={"MIT"}) == {"license_profile"}
    assert certified(spark, root, good, registry=REGISTRY[1:]) == {"registry_fingerprint", "source_provenance", "license_profile"}
    files.write_text(f"{root}/stats.json", "{}")
    assert certified(spark, root, good) == {"manifest_inventory", "statistics_recomputed"}
    files.remove(f"{root}/{P.FROZEN}")
    assert certified(spark, root, good) == {"manifest_inventory", "statistics_recomputed", "freeze_marker"}


@pytest.mark.parametrize("rows,wrong", [([page("p", direction="ltr")], "gold_validation"), ([page("p"), page("q", split="train")], "leakage_audit"), ([page("p", source="other")], "source_provenance")])
def test_wrong_pages(spark, tmp_path, rows, wrong):
    assert wrong in certified(spark, str(tmp_path / "r"), rows)
