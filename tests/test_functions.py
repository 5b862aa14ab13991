import itertools
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paraleaf.functions import align as A
from paraleaf.functions import geometry as G
from paraleaf.functions import order as O
from paraleaf.functions import text as X


def slow_align(a, b):
    """(distance, substitutions) of the best script, by plain recursion over a table."""
    t = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        if i == 0 or j == 0:
            t[i][j] = (i + j, 0)
        else:
            d, s = t[i - 1][j - 1]
            c = (d, s) if a[i - 1] == b[j - 1] else (d + 1, s + 1)
            t[i][j] = min((t[i - 1][j][0] + 1, t[i - 1][j][1]), (t[i][j - 1][0] + 1, t[i][j - 1][1]), c)
    return t[len(a)][len(b)]


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_align_against_table(a, b):
    n, m, s, d, i, c = A.align(a, b)
    assert (s + d + i, s) == slow_align(a, b)
    assert (n, m, i - d, c) == (len(a), len(b), len(b) - len(a), len(a) - s - d)


def test_known_answers():
    assert A.align("שלום", "שלם") == (4, 3, 0, 1, 0, 3)
    assert A.align("", "אב") == (0, 2, 0, 0, 2, 0)
    assert A.align("מלך", "מלכ")[2] == 1
    assert A.confusions("מלך", "מלכ") == {("ך", "כ"): 1}
    assert A.diacritics("שָׁלוֹם", "שלום")[:3] == (3, 0, 0)


def test_unit_counts(spark):
    df = spark.createDataFrame([("שָ", "שַ"), ("בית־ספר", "בית-ספר"), (None, None), ("", "")], "a string, b string")
    rows = df.select(A.aligned_text("a", "b").alias("c"), A.aligned_units(X.graphemes("a"), X.graphemes("b")).alias("g"), A.aligned_units(X.punctuation_list("a"), X.punctuation_list("b")).alias("p")).collect()
    edits = lambda r: r["substitutions"] + r["deletions"] + r["insertions"]
    assert [(r["c"]["n_ref"], edits(r["c"]), r["g"]["n_ref"], edits(r["g"])) for r in rows] == [(2, 1, 1, 1), (7, 1, 7, 1), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert edits(rows[1]["p"]) == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("בשנת 2026 גרסה OCR-v2.1. (x)‮​",), ("",), (None,)], "t string")
    r = df.select(X.number_runs("t").alias("n"), X.ltr_runs("t").alias("l"), X.bracket_list("t").alias("b"), X.first_strong("t").alias("d"), X.mixed_direction("t").alias("m"), X.hygiene("t")["n_unsafe"].alias("u"), X.strict("t").alias("s"), X.scope_issues("t").alias("i")).collect()
    assert r[0]["n"][0] == "2026" and r[0]["l"] == ["2026", "OCR-v2.1", "x"] and r[0]["b"] == ["(", ")"]
    assert (r[0]["d"], r[0]["m"], r[0]["u"]) == ("rtl", True, 1) and "‮" not in r[0]["s"] and "bidi_control" in r[0]["i"]
    assert r[1]["n"] == [] and r[1]["d"] == "neutral" and r[2]["n"] is None and r[2]["s"] is None


def test_balance_and_marks(spark):
    df = spark.createDataFrame([("‪a‬",), ("‪‫‬",), ("‬",)], "t string")
    got = [r[0] for r in df.select(X.unbalanced("t", "‪‫‭‮", "‬")).collect()]
    assert got == [0, 1, 1]
    df = spark.createDataFrame([("שָׁ",)], "t string")
    assert df.select(X.dangling_marks("t")).first()[0] == 0
    assert df.select(X.base_letters("t")).first()[0] == "ש"
    assert spark.createDataFrame([("ָא",)], "t string").select(X.dangling_marks("t")).first()[0] == 1


def square(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def test_polygon_iou():
    assert G.polygon_iou(square(0, 0, 10, 10), square(5, 0, 10, 10)) == pytest.approx(1 / 3)
    assert G.polygon_iou(square(0, 0, 10, 10), square(10, 0, 10, 10)) == 0
    assert G.polygon_iou([[0, 0], [10, 0], [0, 10]], square(0, 0, 10, 10)) == pytest.approx(0.5)
    assert G.polygon_iou([[0, 0], [10, 10], [0, 10]], [[0, 0], [10, 0], [10, 10]]) == pytest.approx(0)
    assert G.polygon_iou(None, square(0, 0, 1, 1)) == 0 and G.polygon_iou([[0, 0], [1, 1]], square(0, 0, 1, 1)) == 0


def test_assignment_is_best():
    rng = random.Random(1)
    for n, m in [(1, 1), (2, 3), (3, 3), (4, 2), (4, 5)]:
        s = np.array([[rng.random() for _ in range(m)] for _ in range(n)])
        got = sum(s[i, j] for i, j in G.assign(s))
        k = min(n, m)
        best = max(sum(s[i, j] for i, j in zip(a, b)) for a in itertools.combinations(range(n), k) for b in itertools.permutations(range(m), k))
        assert got == pytest.approx(best)
    assert G.assign(np.zeros((0, 3))) == []


def test_order():
    assert O.topological(["b", "a", "c"], [("a", "c")]) == ["b", "a", "c"]
    with pytest.raises(ValueError):
        O.topological(["a", "b"], [("a", "b"), ("b", "a")])
    with pytest.raises(ValueError):
        O.topological(["a"], [("a", "x")])
    assert O.order_metrics([("a", "b")], [("b", "a")], ["b", "a"])[2:] == (0.0, 0, 1)
    p, r, f, kept, n = O.order_metrics([("a", "b"), ("b", "c")], [("a", "c"), ("c", "b")], ["a", "c", "b"])
    assert n == 3 and kept == 2
    assert O.precedences([("a", "b"), ("b", "a")]) == {("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")}


def test_indel_ratio(spark):
    df = spark.createDataFrame([("abcd", "abed"), ("", ""), (None, "a"), ("ab", "ab")], "a string, b string")
    assert [r[0] for r in df.select(A.indel_ratio("a", "b")).collect()] == [0.75, 1.0, None, 1.0]


def test_box_iou(spark):
    df = spark.createDataFrame([(square(0.0, 0.0, 20.0, 10.0), square(0.0, 0.0, 10.0, 10.0))], "a array<array<double>>, b array<array<double>>")
    assert df.select(G.box_iou(G.bounds(F.col("a")), G.bounds(F.col("b")))).first()[0] == 0.5
