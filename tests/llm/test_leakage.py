import random

from paraleaf.llm import leakage as L

rng = random.Random(4)
VOCAB = ["".join(rng.choice("abcdefghklmnoprst") for _ in range(rng.randint(4, 8))) for _ in range(3000)]
PASSAGES = [[rng.choice(VOCAB) for _ in range(30)] for _ in range(30)]


def noise(n):
    return [rng.choice(VOCAB) for _ in range(n)]


def run(spark, docs):
    p = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(PASSAGES)] + [(90, None), (91, ""), (92, "too short"), (None, "x y z")], "passage_no long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    return {(r["doc_id"], r["passage_no"]) for r in L.leaks(d, p, "doc_id", "text", "passage_no", "text").collect()}


def test_cases(spark):
    p = PASSAGES
    wrong = list(p[3])
    for k in range(4, 30, 7):
        wrong[k] = wrong[k][:2] + "zz"[:1] + wrong[k][3:]
    docs = [
        (1, noise(50) + p[0] + noise(50)),  # whole
        (2, noise(50) + p[1][:16] + noise(50)),  # a good half
        (3, noise(50) + p[2][:12] + noise(50)),  # less than half
        (4, noise(20) + wrong + noise(20)),  # single words misspelt
        (5, noise(20) + p[4][:8] + noise(60) + p[4][15:24] + noise(20)),  # two stretches in order
        (6, noise(20) + p[5][15:24] + noise(60) + p[5][:8] + noise(20)),  # two stretches out of order
        (7, noise(20) + p[6][:8] + noise(260) + p[6][15:24]),  # too far apart
        (8, rng.sample(p[7], 30)),  # the same words shuffled
        (9, [w for k in range(0, 30, 3) for w in [*p[8][k : k + 3], *noise(2)]]),  # only short runs
        (10, noise(9000) + p[9] + noise(9000) + p[10]),  # long
    ]
    rows = [(i, " ".join(w), "x") for i, w in docs] + [(11, None, "x"), (12, "", "x"), (13, "​".join(" ".join(p[11]).upper()), "x"), (14, ".\n".join(p[12]), "x"), (None, " ".join(p[13]), "x")]
    assert run(spark, rows) == {(1, 0), (2, 1), (4, 3), (5, 4), (10, 9), (10, 10), (13, 11), (14, 12)}


def test_every_stretch_with_a_misspelt_word(spark):
    """Six stretches of five words, one word of each misspelt: every place in the stretch, and every second word."""

    def bad(w):
        return w[:2] + "z" + w[3:]

    docs = []
    for k in range(5):
        docs.append((k, [x for i in range(0, 30, 5) for x in [*(bad(w) if j == k else w for j, w in enumerate(PASSAGES[k][i : i + 5])), *noise(3)]]))
    docs.append((5, [x for i in range(0, 30, 5) for x in [*(bad(w) if j % 2 else w for j, w in enumerate(PASSAGES[5][i : i + 5])), *noise(3)]]))
    assert run(spark, [(i, " ".join(w), "x") for i, w in docs]) >= {(k, k) for k in range(6)}


def test_against_every_pair(spark):
    """What the seeds let through is what an exact chain finds over all pairs of texts and passages."""
    import numpy as np

    mine = random.Random(31)
    docs = []
    for d in range(60):
        w = noise(mine.randint(0, 40))
        for _ in range(mine.randint(1, 4)):
            p = PASSAGES[mine.randint(0, 29)]
            a, n = mine.randint(0, 20), mine.randint(3, 22)
            w += [x if mine.random() > 0.12 else x[:1] + "z" + x[2:] for x in p[a : a + n]] + noise(mine.randint(0, 30))
        docs.append((d, w))
    ids: dict = {}
    code = lambda w: np.array([ids.setdefault(x, len(ids)) for x in w], np.int64)
    want = set()
    for d, w in docs:
        for k, p in enumerate(PASSAGES):
            if L.chain(L.stretches(p, code(p), w, code(w), 5), 200, 5)[0] * 2 >= len(p):
                want.add((d, k))
    assert len(want) > 20
    assert run(spark, [(i, " ".join(w), "x") for i, w in docs]) == want


def test_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 7)
    rows = [(i, " ".join(noise(10) + w), "x") for i, w in enumerate(PASSAGES)]
    assert run(spark, rows) == {(i, i) for i in range(30)}
    monkeypatch.setattr(L, "BLOCK", 5000)
    assert run(spark, rows) == {(i, i) for i in range(30)}
    assert run(spark, [(1, None, None)]) == set()


def test_alignment():
    import numpy as np

    assert L.smith_waterman(np.array([1, 2, 3, 4]), np.array([9, 1, 2, 3, 4, 9])) == 4
    assert L.chain([(0, 0, 5), (5, 10, 5), (2, 40, 5)], 200, 5)[0] == 10
    assert L.chain([(0, 0, 5), (5, 300, 6)], 200, 5)[0] == 6


def test_copies_and_near_copies(spark):
    mine = random.Random(9)
    near = [[*PASSAGES[1][:k], mine.choice(VOCAB), *PASSAGES[1][k + 1 :]] for k in range(2, 28, 3)]
    p = [PASSAGES[0]] * 10 + near + PASSAGES[2:22]
    held = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(p)], "passage_no long, text string")
    docs = [(1, noise(20) + PASSAGES[0] + noise(20)), (2, noise(20) + near[4] + noise(20)), (3, noise(20) + PASSAGES[1][:22] + noise(20)), (4, PASSAGES[5])]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {(r["doc_id"], r["passage_no"]) for r in L.leaks(d, held, "doc_id", "text", "passage_no", "text").collect()}
    assert {(1, i) for i in range(10)} <= got and {(2, 10 + i) for i in range(9)} <= got and {(3, 10 + i) for i in range(9)} <= got
    assert got - {(i, j) for i in (1, 2, 3) for j in range(19)} == {(4, 22)}
