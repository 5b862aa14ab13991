from datetime import datetime

from paraleaf.plans import shared as P

SCHEMA = "k long, v string, extra map<string,string>, received_at timestamp"


def at(day):
    return datetime(2020, 1, day)


ROWS = [
    (1, "only", None, at(1)),
    (2, "late", {"a": "b"}, at(9)),
    (2, "early", None, at(2)),
    (3, "tie", None, at(3)),
    (3, "tie", None, at(3)),
    (4, "third", None, at(7)),
    (4, "first", None, at(4)),
    (4, "second", None, at(5)),
    (5, "timed", None, at(5)),
    (5, "untimed", None, None),
    (6, None, None, None),
    (6, None, None, None),
    (None, "keyless", None, at(1)),
]
WANT = {1: "only", 2: "early", 3: "tie", 4: "first", 5: "timed", 6: None}


def check(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = P.once(df, "k").collect()
    assert len(got) == 6 and {r["k"]: r["v"] for r in got} == WANT
    assert P.once(df, "k").columns == df.columns
    assert P.once(df.limit(0), "k").count() == 0


def test_once(spark):
    check(spark)
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(r["k"] for r in P.once(df.drop("received_at"), "k").collect()) == [1, 2, 3, 4, 5, 6]
    assert P.once(df.select("k"), "k").count() == 6


def test_once_with_more_repeated_keys_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_KEYS", 2)
    check(spark)


def test_rows_seen_once_are_not_shuffled(spark, tmp_path):
    spark.createDataFrame([r for r in ROWS if r[0] in (1, 2, 5)], SCHEMA).write.parquet(str(tmp_path / "t"))
    plan = P.once(spark.read.parquet(str(tmp_path / "t")), "k")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "hashpartitioning" not in plan
