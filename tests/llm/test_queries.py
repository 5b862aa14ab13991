import glob
import os

import duckdb
import pytest

from paraleaf.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE:
        con = duckdb.connect()
        for path in glob.glob(f"{sf}/*.parquet"):
            con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
        want = con.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(tuple, got[sorted(got.columns)].values.tolist())) == sorted(map(tuple, want[sorted(want.columns)].values.tolist()))


def test_page_lines_all_come_out(spark, sf):
    from paraleaf.llm.canonical import canonical_sql

    got = QUERIES["p5_page_line_forms"](spark, sf).toPandas()
    con = duckdb.connect()
    pages = {"prediction": f"(SELECT * FROM '{sf}/prediction_pages.parquet' WHERE pred_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pred_id ORDER BY received_at NULLS LAST) = 1)", "gold": f"'{sf}/gold_pages.parquet'"}
    for side, src in pages.items():
        key = "pred_id" if side == "prediction" else "page_id"
        want = con.execute(f"SELECT k, l.line_id, l.text, {canonical_sql('l.text')} FROM (SELECT k, unnest(r.lines) AS l FROM (SELECT {key} AS k, unnest(regions) AS r FROM {src}))").fetchall()
        mine = got[got.side == side]
        have = [tuple(None if x != x else x for x in r) for r in zip(mine[key], mine.line_id, mine.text, mine.text_one_form)]
        assert len(want) > 0 and sorted(map(repr, want)) == sorted(repr((type(want[0][0])(k), *rest)) for k, *rest in have)
