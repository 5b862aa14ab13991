import random

from pyspark.sql import functions as F

from paraleaf.llm import group_splits as G

SCHEMA = "item_no long, writer string, doc string, split string, kind string"


def brute(rows):
    import re

    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in rows:
        find(r[0])
        for c, v in enumerate(r[1:3]):
            v = re.sub("^-+|-+$", "", re.sub(r"[^\w]|_", "-", (v or "").lower()))
            if v and v not in G.NOT_KNOWN:
                a, b = find(r[0]), find((c, v))
                if a != b:
                    parent[a] = b
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), []).append(r[0])
    return {i: min(g) for g in groups.values() for i in g}


def make(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = rng.choice([None, "", "n/a", "Unknown", f"W-{rng.randint(0, n)}", f" w_{rng.randint(0, n)} "])
        d = rng.choice([None, "-", f"D {rng.randint(0, n)}", f"d-{rng.randint(0, n)}"])
        rows.append((i, w, d, rng.choice(["train", "dev", "test", None]), rng.choice(["a", "a", "b", None])))
    return rows


def test_components(spark):
    rows = make(1, 300) + [(1000 + i, f"chain{i}", f"chain{i + 1}", "train", "a") for i in range(0)]
    rows += [(2000 + i, f"c{i // 2}", f"e{(i + 1) // 2}", "train", "a") for i in range(120)]  # one long chain
    rows += [(3000 + i, "hot", None, "test", "b") for i in range(150)]
    got = {r["item_no"]: r["group_no"] for r in G.components(spark.createDataFrame(rows, SCHEMA), "item_no", ["writer", "doc"]).collect()}
    assert got == brute(rows)


def test_torn(spark):
    rows = [(1, "W-1", None, "train", "a"), (2, "w_1", None, "test", "a"), (3, "w 1 ", "x", None, "a"), (4, None, "X", "train", "a"), (5, "q", None, "dev", "a"), (6, None, None, None, None), (None, "w1", None, "dev", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in G.torn_groups(df, "item_no", ["writer", "doc"], "split").collect()} == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert G.torn_groups(df.limit(0), "item_no", ["writer", "doc"], "split").count() == 0


def test_shares(spark):
    rows = make(5, 3000)
    df = spark.createDataFrame(rows, SCHEMA)
    out = G.stratified_splits(df, "item_no", ["writer", "doc"], ["kind"], {"train": 0.8, "dev": 0.1, "test": 0.1}).collect()
    assert len(out) == 3000
    by_group = {}
    for r in out:
        by_group.setdefault(r["group_no"], set()).add(r["new_split"])
    assert all(len(s) == 1 for s in by_group.values())
    big = max(sum(1 for r in out if r["group_no"] == g) for g in by_group)
    for s, share in (("train", 0.8), ("dev", 0.1), ("test", 0.1)):
        assert abs(sum(r["new_split"] == s for r in out) / 3000 - share) < max(0.03, big / 3000)
    assert G.stratified_splits(df.limit(0), "item_no", ["writer", "doc"], ["kind"], {"train": 0.8, "dev": 0.2}).count() == 0


def test_every_label_is_shared_out(spark):
    """Single records and pairs, a rare label, and one group of a third of all rows: one rule, each label near the ratios."""
    rng = random.Random(9)
    rows, n = [], 0
    for g in range(2400):
        kind = "rare" if g < 60 else rng.choice(["a", "b", "c"])
        for _ in range(1 + (g % 7 == 0)):
            rows.append((n, f"g{g}", None, None, kind))
            n += 1
    ratios = {"train": 0.8, "dev": 0.1, "test": 0.1}

    def shares(rows):
        out = {r["item_no"]: r["new_split"] for r in G.stratified_splits(spark.createDataFrame(rows, SCHEMA), "item_no", ["writer"], ["kind"], ratios).collect()}
        assert out.keys() == {r[0] for r in rows}
        return {k: {s: sum(out[r[0]] == s for r in rows if r[4] == k) / sum(r[4] == k for r in rows) for s in ratios} for k in {r[4] for r in rows}}

    assert all(abs(x[s] - ratios[s]) < 0.02 for x in shares(rows).values() for s in ratios)
    hot = rows + [(n + i, "hot", None, None, "a") for i in range(n // 2)]
    got = shares(hot)
    assert all(abs(got[k][s] - ratios[s]) < 0.02 for k in ("b", "c", "rare") for s in ratios)
    assert abs(got["a"]["train"] - 0.8) < 0.02


def test_share_out():
    need, room = {"train": 80.0, "dev": 10.0, "test": 10.0}, {"train": 80.0, "dev": 10.0, "test": 10.0}
    out = G._share_out([(1, 90), (10, 1)], need, room, ["train", "dev", "test"])
    assert out == [(10, 1, [1, 0, 0]), (1, 90, [70, 10, 10])] and not any(need.values())


def test_plain_split(spark):
    df = spark.createDataFrame([(" Train",), ("TRAINING",), ("valid ",), ("Validation",), ("diagnostic",), (" ",), (None,)], "s string")
    assert [r[0] for r in df.select(G.plain_split(F.col("s"))).collect()] == ["train", "train", "dev", "dev", "diagnostic", None, None]
