import random

import numpy as np

from paraleaf.llm import split_overlap as S


def lcs(a, b):
    t = [0] * (len(b) + 1)
    for x in a:
        d = 0
        for j, y in enumerate(b, 1):
            d, t[j] = t[j], d + 1 if x == y else max(t[j], t[j - 1])
    return t[-1]


def test_shared_in_order():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 20))) for _ in range(2))
        assert S.shared_in_order(a, b) == lcs(a, b)


def test_backward_search():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd") for _ in range(50)) for _ in range(30)]
    index = S.Index.load(S.Index(texts).save())
    joined = "\0".join(texts) + "\0"
    q = texts[3][5:40]
    x = index.encode(np.frombuffer(q.encode("utf-32-le"), np.uint32))
    ends, lo, hi = index.search(x, np.arange(6, len(q) + 1), 6)
    for e, a, b in zip(ends, lo, hi):
        want = sorted(i for i in range(len(joined)) if joined.startswith(q[e - 6 : e], i))
        assert sorted(index.order[a:b].tolist()) == want


def records(spark):
    rng = random.Random(3)
    rows = []
    for i in range(80):
        t = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(90, 160)))
        rows.append((f"item:{i}", rng.choice(["train", "test", "dev", None]), "s", t))
        u = list(t)
        for _ in range(rng.choice([0, 1, 3, 6, 30])):
            u[rng.randrange(len(u))] = rng.choice("abcxyz")
        rows.append((f"page:{i}#l", rng.choice(["train", "test"]), None, " ".join("".join(u)).upper()))
    rows += [("item:900", "train", "s", None), ("item:901", "test", "s", ""), ("item:902", "test", "s", "short"), (None, "test", "s", rows[0][3]), ("item:903", "test", "s", "x" * 200_000)]
    return rows, spark.createDataFrame(rows, "name string, split string, source string, text string")


def test_against_all_pairs(spark):
    rows, df = records(spark)
    norm = [(n, s, S.letters(t)) for n, s, _, t in rows if n and s and t and len(S.letters(t)) >= 80]
    want = {(min(a, b), max(a, b)) for a, s, x in norm for b, s2, y in norm if s == "train" != s2 and 2 * lcs(x, y) * 100 >= 88 * (len(x) + len(y)) if len(x) < 500 and len(y) < 500}
    got = [(r["record_a"], r["record_b"]) for r in S.overlapping_pairs(df, 0.88, 80).collect()]
    assert set(got) == want and len(got) == len(want)


def test_several_shards_and_counts(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_CHARS", 1500)
    monkeypatch.setattr(S, "BLOCK_CHARS", 700)
    rows, df = records(spark)
    df = df.where("length(text) < 1000 or text is null")
    many = {(r[0], r[1]) for r in S.overlapping_pairs(df, 0.88, 80).collect()}
    monkeypatch.setattr(S, "SHARD_CHARS", 1_000_000)
    assert many == {(r[0], r[1]) for r in S.overlapping_pairs(df, 0.88, 80).collect()}
    c = S.overlap_counts(df, 0.88, 80).collect()
    assert sum(r["n_overlapping"] for r in c) > 0 and all(r["n_overlapping"] <= r["n_records"] for r in c)


def test_empty(spark):
    _, df = records(spark)
    assert S.overlapping_pairs(df.limit(0), 0.88, 80).count() == 0
    assert S.overlapping_pairs(df.where("split = 'train'"), 0.88, 80).count() == 0


def pairs_of(held, train):
    got = S._pairs_in(S.Index.load(S.Index(held).save()), list(map(str, range(len(held)))), held, list(map(str, range(len(train)))), train, S.Fraction("0.88"))
    return {(int(a), int(b)) for a, b, *_ in got}


def test_edits_spread_out():
    rng = random.Random(5)
    held, train = [], []
    for i in range(60):
        t = [rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(80, 260))]
        held.append("".join(t))
        if i % 3 == 0:  # a substitution every 10 characters
            t[5::10] = ["z"] * len(t[5::10])
        elif i % 3 == 1:  # now one lost, now one added, runs of 4 or 5
            t = [c for k, c in enumerate(t) for c in ([] if k % 9 == 4 else [c, "y"] if k % 18 == 8 else [c])]
        else:
            t = [rng.choice("abcdefghijklmnopqrst") if rng.random() < 0.12 else c for c in t]
        train.append("".join(t))
    want = {(i, j) for i, x in enumerate(train) for j, y in enumerate(held) if 2 * lcs(x, y) * 100 >= 88 * (len(x) + len(y))}
    assert len(want) > 40 and pairs_of(held, train) == want


def test_many_scripts():
    rng = random.Random(6)
    held = []
    for first, n in ((0x5D0, 27), (0x61, 26), (0x430, 32), (0x3B1, 17), (0x621, 26), (0x4E00, 90)):
        held += ["".join(chr(first + rng.randrange(n)) for _ in range(100)) for _ in range(200 if first < 0x100 else 3)]
    assert len(set("".join(held))) > 3 * S.SYMBOLS
    near = [t[:50] + "7" + t[51:] for t in held]
    assert pairs_of(held, held) == {(i, i) for i in range(len(held))} == pairs_of(held, near)


def edited(rng, text, share):
    return "".join(c for x in text for c in ([x] if rng.random() > share else rng.choice(([], [rng.choice("xyz")], [x, rng.choice("xyz")]))))


def sides(held, train):
    signs = S.Signs(held)
    return S.Side(list(map(str, range(len(held)))), held, signs), S.Side(list(map(str, range(len(train)))), train, signs)


def test_few_partners_need_no_index():
    rng = random.Random(7)
    held = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(80, 200))) for _ in range(300)]
    train = [edited(rng, t, 0.05) for t in held[:40]] + ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(80, 200))) for _ in range(300)]
    assert len({(t, h) for t, h, *_ in S._pairs(lambda: 1 / 0, *sides(held, train), S.Fraction("0.88"))}) == 40
    left = sum(len(t) for t, _ in S._possible(*reversed(sides(held, train)), S.Fraction("0.88")))
    assert left < 60  # of 102,000 pairs


def test_bounds_lose_no_pair(monkeypatch):
    rng = random.Random(8)
    held = ["".join(rng.choices(rng.choice(("abcdefgh", "אבגדהוזחטי", "ab")), k=rng.choice((80, 90, 120, 300)))) for _ in range(60)] + ["".join(rng.choices("abcde", k=n)) for n in (2500, 2600, 4000)]
    train = [edited(rng, t, share) for t in held for share in (0, 0.06, 0.1, 0.13)] + [held[0][:40] + "\U0001d7d8" + held[0][41:]]
    want = {(i, j) for i, x in enumerate(train) for j, y in enumerate(held) if min(len(x), len(y)) * 2 >= 0.88 * (len(x) + len(y)) and 2 * S.shared_in_order(x, y) * 100 >= 88 * (len(x) + len(y))}
    assert len(want) > 150 and pairs_of(held, train) == want
    monkeypatch.setattr(S, "MANY", 0)
    monkeypatch.setattr(S, "BATCH", 20)
    monkeypatch.setattr(S, "RUN", 9)
    monkeypatch.setattr(S, "KEPT_BYTES", 500)
    assert pairs_of(held, train) == want


def test_shards_by_length(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_CHARS", 1000)
    texts = [c * n for c in "abcdefghijklmnop" for n in (80, 90, 100)] + ["q" * 3000, "r" * 120, "s" * 130]
    placed, shards = S._placed(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "name string, norm string"))
    rows = placed.collect()
    assert sorted(r["norm"] for r in rows) == sorted(texts)
    assert all(shards[r["shard"]][0] <= len(r["norm"]) <= shards[r["shard"]][1] for r in rows)
    assert shards == [(80, 80)] * 2 + [(90, 90)] * 2 + [(100, 100)] * 2 + [(120, 130), (3000, 3000)]


def test_shards_that_hold_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_CHARS", 90)
    texts = ["".join(random.Random(i).choices("abcdefghij", k=90)) for i in range(12)]
    df = spark.createDataFrame([(f"{s}{i}", s, "s", t) for i, t in enumerate(texts) for s in ("train", "test")], "name string, split string, source string, text string")
    found = S.overlapping_pairs(df, 0.88, 80).collect()
    assert sorted(r["record_b"] for r in found) == sorted(f"train{i}" for i in range(12))
