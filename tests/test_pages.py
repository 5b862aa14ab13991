import pytest
from pyspark.sql import functions as F

from paraleaf.operators import assignment as M
from paraleaf.operators import corpus as C

UNIT = "page_id string, unit_id string, unit_no int, type string, text string, polygon array<array<double>>"


def box(x1, y1, x2, y2):
    return [[float(x1), float(y1)], [float(x2), float(y1)], [float(x2), float(y2)], [float(x1), float(y2)]]


def test_matching(spark):
    g = spark.createDataFrame([("p", "a", 0, None, "x", box(0, 0, 10, 10)), ("p", "b", 1, None, "y", box(20, 0, 30, 10)), ("q", "a", 0, None, "z", None)], UNIT)
    p = spark.createDataFrame([("p", "b", 0, None, "y", box(1, 0, 11, 10)), ("p", "c", 1, None, "n", box(100, 0, 110, 10))], UNIT)
    got = {(r["page_id"], r["gold_no"], r["pred_no"], r["status"]) for r in M.matched_units(g, p, 0.3).collect()}
    assert got == {("p", 0, 0, "matched"), ("p", 1, None, "missing"), ("p", None, 1, "extra"), ("q", 0, None, "missing")}
    by_id = {(r["gold_no"], r["pred_no"], r["status"]) for r in M.matched_units(g, p, 0.3, by_id=True).where("page_id = 'p'").collect()}
    assert (1, 0, "matched") in by_id and (0, None, "missing") in by_id
    assert M.matched_units(g.limit(0), p.limit(0), 0.3).count() == 0


def test_first_ids_and_split(spark):
    u = spark.createDataFrame([("p", "a", 0, None, "x", box(0, 0, 20, 10)), ("p", "a", 1, None, "y", None)], UNIT)
    assert sorted(r["unit_id"] for r in M.first_ids(u).collect()) == ["a", "a#duplicate-1"]
    p = spark.createDataFrame([("p", "b", 0, None, "x", box(0, 0, 10, 10)), ("p", "c", 1, None, "y", box(10, 0, 20, 10))], UNIT)
    assert [tuple(r) for r in M.split_merge(M.overlapping(u.limit(1), p)).collect()] == [("p", 1, 0)]


def test_corpus(spark):
    df = spark.createDataFrame([(i, f"d{i}") for i in range(2000)], "i int, k string")
    n = {r["s"]: r["count"] for r in df.groupBy(C.hash_split(F.col("k"), {"train": 0.6, "dev": 0.2, "test": 0.2}).alias("s")).count().collect()}
    assert abs(n["train"] - 1200) < 100 and sum(n.values()) == 2000
    with pytest.raises(ValueError):
        C.hash_split(F.col("k"), {"a": 0.5})
    import hashlib
    import hmac

    got = df.where("i = 7").select(C.hmac_id("key", "page", F.col("k"))).first()[0]
    assert got == hmac.new(b"key", b"page|d7", hashlib.sha256).hexdigest()[:24]
    leak = C.split_leaks(spark.createDataFrame([("train", "w", " "), ("test", "w", " "), (None, "w", None)], "split string, writer string, doc string"), "split", ["writer", "doc"]).collect()
    assert [tuple(r) for r in leak] == [("writer", "w", 2, "test,train")]


def test_near_duplicates_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    rows = []
    for i in range(60):
        t = " ".join(rng.choice(vocab) for _ in range(12))
        rows.append((2 * i, "train", t))
        u = list(t)
        for _ in range(rng.choice([0, 1, 2, 9])):
            u[rng.randrange(len(u))] = "z"
        rows.append((2 * i + 1, "test", "".join(u)))
    rows += [(900, "test", None), (901, None, rows[0][2]), (902, "train", "")]
    from paraleaf.functions.align import align

    def ratio(a, b):
        import difflib  # noqa: F401

        where = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                where[i + 1][j + 1] = where[i][j] + 1 if x == y else max(where[i][j + 1], where[i + 1][j])
        return 2 * where[-1][-1] / (len(a) + len(b))

    want = {(b, a) for a, s, t in rows for b, s2, t2 in rows if t and t2 and s == "train" and s2 == "test" and t != t2 and ratio(t, t2) >= 0.94}
    got = {(r["key_a"], r["key_b"]) for r in C.audit_near_duplicates(spark.createDataFrame(rows, "k long, s string, t string"), "k", "t", "s").collect()}
    assert got == want and align("a", "a")


def test_quota_and_repair(spark):
    df = spark.createDataFrame([(i, f"f{i % 5}", 1) for i in range(100)], "i long, f string, n long")
    got = sorted(r["i"] for r in C.greedy_quota(df, "i", "f", 4, {"n": 10}).collect())
    assert got == list(range(10))
    assert C.greedy_quota(df.limit(0), "i", "f", 4, {"n": 10}).count() == 0
    t = spark.createDataFrame([("ða \ufeffððב",), ("\uf027 03-1 \uf0b7 ðב ð",), ("xð ðy éð",), (None,)], "t string")
    assert [r[0] for r in t.select(C.repair_pdf_text(F.col("t"))).collect()] == ["ða ננב", "☎ 03-1 • נב נ", "xð ðy éð", None]
    n = [tuple(r) for r in t.select(*C.repair_counts(F.col("t")).values()).collect()]
    assert n == [(1, 0, 0, 2), (0, 1, 1, 2), (0, 0, 0, 0), (None, None, None, None)]


def test_quota_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "QUOTA_ROWS", 7)
    df = spark.createDataFrame([(i * 37 % 1000, f"f{i % 500}", 1 + i % 3) for i in range(1000)], "i long, f string, n long")
    rows, total, want, held = sorted(map(tuple, df.collect())), 0, [], {}
    for i, f, n in rows:
        held[f] = held.get(f, 0) + 1
        if held[f] <= 1:
            if total >= 300:
                break
            want.append(i)
            total += n
    assert sorted(r["i"] for r in C.greedy_quota(df, "i", "f", 1, {"n": 300}).collect()) == want


def test_joined_tokens(spark):
    j = spark.createDataFrame([(["a", "(", "b", ")", ",", "c"],)], "w array<string>")
    assert j.select(C.smart_join(F.col("w"))).first()[0] == "a (b), c"


def test_repaired_text_joins_whole_texts(spark, tmp_path):
    from paraleaf.queries_corpus import q_repaired_text

    text = " ".join(f"w{i} ( x ) ," for i in range(40)) + "\r\nlast ðב - line ."
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["joined"] for r in q_repaired_text(spark, str(tmp_path)).collect()}
    assert got == {1: " ".join(f"w{i} (x)," for i in range(40)) + "\nlast נב-line.", 3: ""}
