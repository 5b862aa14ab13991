import random
from collections import Counter

from paraleaf.llm import near_duplicates as N
from paraleaf.llm.words import words


def brute(rows, t, least):
    w = [(i, Counter(words(x))) for i, x in rows if i is not None and x is not None]
    w = [(i, c) for i, c in w if sum(c.values()) >= least]
    return {(a, b) for a, x in w for b, y in w if a < b and sum((x & y).values()) * 10 >= t * sum((x | y).values())}


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["w%d" % int(rng.paretovariate(0.6)) for _ in range(300)]
    rows, i = [], 0
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randint(12, 30))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            x = list(base)
            for _ in range(rng.randint(0, 6)):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            if rng.random() < 0.3:
                rng.shuffle(x)
            rows.append((i, " ".join(x)))
            i += 1
    return rows


def test_against_all_pairs(spark, monkeypatch):
    rows = corpus(1, 150)
    df = spark.createDataFrame(rows, "k long, t string")
    got = {(r["a"], r["b"]) for r in N.near_duplicate_pairs(df, "k", "t", 0.6, 12).collect()}
    assert got == brute(rows, 6, 12)


def test_hot_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 16)
    monkeypatch.setattr(N, "TILE", 8)
    monkeypatch.setattr(N, "PARTNERS", 4)
    rows = corpus(2, 60) + [(1000 + i, "a b c d e f g h i j k l m %d" % i) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, t string")
    got = [(r["a"], r["b"]) for r in N.near_duplicate_pairs(df, "k", "t", 0.6, 12).collect()]
    assert set(got) == brute(rows, 6, 12) and len(got) == len(set(got))


def test_long_lists_of_uncounted_tokens_are_cut(spark, monkeypatch):
    """Where there are too many tokens to send all counts around, long lists are cut by counts joined to them."""
    monkeypatch.setattr(N, "CELL", 8)
    monkeypatch.setattr(N, "KNOWN_TOKENS", 1)
    rows = corpus(3, 60) + [(1000 + i, "a b c d e f g h i j k l m %d" % i) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, t string")
    got = [(r["a"], r["b"]) for r in N.near_duplicate_pairs(df, "k", "t", 0.6, 12).collect()]
    assert set(got) == brute(rows, 6, 12) and len(got) == len(set(got))


def test_edges(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, 9), (2, text.upper(), 9), (3, None, 9), (4, "", 9), (5, "one two", 9), (None, text, 9), (6, text + " thirteen" * 200_00, 9), (7, "שָׁלוֹם " * 12, 9), (8, "שלום " * 12, 9)]
    df = spark.createDataFrame(rows, "id long, toks string, sig int")  # names the operator uses inside
    got = {(r["a"], r["b"]) for r in N.near_duplicate_pairs(df, "id", "toks", 0.6, 12).collect()}
    assert got == {(1, 2), (7, 8)}
    members = {r["id"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in N.linked_members(df, "id", "toks", 0.6, 12).collect()}
    assert members[1] == members[2] == (1, 2, 0) and 5 not in members
    assert N.near_duplicate_pairs(df.limit(0), "id", "toks", 0.6, 12).count() == 0
