from paraleaf.llm.canonical import canonical_columns, mappings, same_look

SAME = [
    ("אב", "א​ב"), ("a b", "a b"), ("１2Ａ．", "12A."), ("café", "café"), ("שׁ", "שׁ"), ("שּׁ", "שּׁ"), ("ﬁn", "fin"), ("ײ", "יי"), ("ﭏ", "אל"), ("ℵ", "א"), ("ﬡ", "א"),
    ("Рage", "Page"), ("οld", "old"), ("Ⅳ", "IV"), ("ё", "ë"), ("a️", "a"), ("a͏b", "ab"), ("ﭏַ", "אלַ"),
]
OTHER = [("ה", "ח"), ("שָ", "ש"), ("A", "a"), ("1", "7"), ("2", "²"), ("2", "②"), ("־", "-"), ("", "a"), ("ר", "ד"), ("a  b", "a b")]


def test_pairs(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(SAME + OTHER)], "id long, l string, r string")
    assert {r["id"] for r in same_look(df, "id", "l", "r").collect()} == set(range(len(SAME)))


def test_edges(spark):
    long = "ab​ " * 100_000
    df = spark.createDataFrame([(1, None, "x"), (1, None, None), (2, "", ""), (3, long, "ab " * 100_000), (3, long, "ab " * 100_000), (None, "a​", "a")], "id long, l string, l_one_form string")
    assert [r["id"] for r in same_look(df, "id", "l", "l_one_form").collect()] == [3]
    out = {r["id"]: r["l_one_form"] for r in canonical_columns(df, ["l"]).where("id in (1, 2)").collect()}
    assert out == {1: None, 2: ""}
    assert canonical_columns(df.limit(0), ["l"]).count() == 0


def test_one_form_is_stable(spark):
    df = spark.createDataFrame([(a,) for p in SAME for a in p], "t string")
    once = canonical_columns(df, ["t"]).selectExpr("t_one_form as t")
    assert canonical_columns(once, ["t"]).where("t <> t_one_form").count() == 0
    one, many = mappings()
    assert all(len(v) == 1 for v in one.values()) and "²" not in one and "②" not in one and "①" not in many


def test_letters_of_other_scripts(spark):
    rows = [("Օօ ԁһԛԝӏ ν ɡ", "Oo dhqwl v g"), ("Ԛ", "Q"), ("ı", "i"), ("ν", "V")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "k long, a string, b string")
    assert sorted(r["k"] for r in same_look(df, "k", "a", "b").collect()) == [0, 1]
