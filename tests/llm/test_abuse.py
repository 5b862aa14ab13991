import random

from paraleaf.llm import abuse as A


def test_maximal_segments_against_definition():
    rng = random.Random(1)

    def slow(s, lo, hi):
        """The definition: the best run, then the same to its left and right."""
        best = None
        for a in range(lo, hi):
            t = 0.0
            for b in range(a, hi):
                t += s[b]
                if t > 1e-12 and (best is None or t > best[2] + 1e-12):
                    best = (a, b + 1, t)
        if best is None:
            return []
        return [*slow(s, lo, best[0]), best, *slow(s, best[1], hi)]

    for _ in range(150):
        s = [round(rng.uniform(-1, 1), 3) + rng.random() * 1e-6 for _ in range(rng.randint(0, 14))]
        got = A.maximal_segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in slow(s, 0, len(s))]


def test_disguises():
    assert A.sentences("s t u p i d") == [["stupid"]]
    assert A.sentences("you f*o*o*l, st_up_id d1rt") == [["you", "fool", "stupid", "dirt"]]
    assert A.sentences("st​up1d")[0] == ["stupid"] and A.sentences("שָׁלוֹם")[0] == ["שלום"]
    assert A.sentences("") == []


VOCAB = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("tor", "sen", "vik", "dal", "mon", "gar", "lin")]


def text(rng, inside=None):
    s = [" ".join(rng.choice(VOCAB) for _ in range(8)) for _ in range(6)]
    if inside:
        s.insert(rng.randrange(6), inside)
    return ". ".join(s) + "."


def table(spark, n=240):
    rng = random.Random(7)
    docs, labels, bad = [], [], set()
    for i in range(n):
        kind = i % 4
        if kind == 0:
            docs.append((i, text(rng, f"you are a {rng.choice(['vile', 'rotten', 'stupid'])} {rng.choice(['pig', 'fool'])} and everybody hates you"), "s1", 0.0))
            bad.add(i)
        elif kind == 1:
            docs.append((i, text(rng, f"the word {rng.choice(['pig', 'fool'])} was struck out of the proof"), "s2", 0.0))
        else:
            docs.append((i, text(rng), None, 0.0))
        if i % 2 == 0 or kind == 1:
            labels.append((i, "Abusive" if i in bad else "clean"))
    docs += [(900, None, "s1", 0.0), (901, "", "s1", 0.0), (902, "  ", None, 0.0), (903, text(rng) * 400, "s1", 0.0), (904, text(rng, "you are a vi​le pi1g and everybody hates youuuu"), "s1", 0.0), (None, "x", "s1", 0.0)]
    labels += [(1, None), (2, "unsure"), (None, "abusive")]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, score double"), spark.createDataFrame(labels, "doc_id long, label string"), bad


def test_held_out(spark):
    docs, labels, bad = table(spark)
    train = labels.where("doc_id < 160")
    out = {r["doc_id"]: r for r in A.abuse_scores(docs, train, "doc_id", "text", ["source"]).collect()}
    found = {i for i, r in out.items() if r["abusive"]}
    assert found == bad | {904}
    assert out[900]["n_words"] == 0 and out[901]["score"] == 0 and out[903]["n_words"] > 1000 and out[0]["source"] == "s1"


def test_edges(spark):
    docs, labels, _ = table(spark, 40)
    assert A.abuse_scores(docs, labels.limit(0), "doc_id", "text").where("abusive").count() == 0
    assert A.abuse_scores(docs.limit(0), labels, "doc_id", "text").count() == 0


def test_plain_words_of_a_telling_pair():
    m = A.Model()
    m.score = {"rot": 0.5, "away": 0.5, "rot away": 4.0, "the": -0.5, "the end": 0.4, "pig": 0.9}
    m.prepare()
    best, _, _, n, passage = m.document("the day went by. the rot away the. nothing here")
    assert (round(best, 6), n, passage) == (4.4, 10, "rot away") and best > m.least
    rng = random.Random(8)
    for _ in range(300):
        w = [rng.choice(["rot", "away", "the", "end", "pig", "day"]) for _ in range(rng.randint(1, 6))]
        assert m.telling(w) == bool(m.segments(m.tokens(w)))
