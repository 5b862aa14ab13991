import random
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from paraleaf import queries_evaluate as QE
from paraleaf.functions.align import align, distance, distances
from paraleaf.operators import admission as D
from paraleaf.operators import evaluate as E
from paraleaf.operators import scores as S

LINE = "struct<line_id:string,text:string,polygon:array<array<double>>,reading_index:int>"
REGION = f"struct<region_id:string,type:string,reading_index:int,lines:array<{LINE}>>"
GOLD = f"page_id string, document_id string, track string, regions array<{REGION}>, reading_order struct<edges:array<array<string>>>"
PRED = f"page_id string, regions array<{REGION}>, page_text string"


def box(x1, y1, x2, y2):
    return [[float(x1), float(y1)], [float(x2), float(y1)], [float(x2), float(y2)], [float(x1), float(y2)]]


def region(rid, *lines, index=None):
    return (rid, "text", index, list(lines))


def line(lid, text, polygon=None, index=None):
    return (lid, text, polygon, index)


def counts(spark, gold, pred, **how):
    pairs = E.page_pairs(spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, PRED))
    return E.page_counts(pairs, ["page_id", "document_id", "track"], **how)


def test_missing_page_is_all_deletions(spark):
    gold = [("p", "d", "t", [region("r", line("a", "abc"), line("b", "de"))], None), ("q", "d", "t", [region("r", line("a", "xyz"))], None), ("e", "d", "t", None, None)]
    pred = [("q", [region("r", line("a", "xyz"))], None), ("other", [region("r", line("a", "zzz"))], None)]
    rows = {r["page_id"]: r for r in counts(spark, gold, pred).collect()}
    p = rows["p"]
    assert (p["n_pairs"], p["codepoint_n_ref"], p["codepoint_deletions"], p["codepoint_n_pred"], p["exact"], p["p_there"]) == (2, 5, 5, 0, 0, False)
    assert rows["q"]["exact"] == 1 and rows["q"]["page_exact"] == 1 and set(rows) == {"p", "q", "e"}
    assert rows["e"]["n_pairs"] == 0 and rows["e"]["page_exact"] == 1
    one = E.dataset_rates(counts(spark, gold, pred)).first()
    assert (one["n_pages"], one["n_predicted"], one["line_cer"]) == (3, 1, round(5 / 8, 9))
    assert one["macro_page_line_gcer"] == round(1 / 3, 9) and one["macro_document_line_gcer"] == round(5 / 8, 9)


def test_pairs_by_id_extra_and_repeated_ids(spark):
    gold = [("p", "d", "t", [region("r", line("a", "one"), line("a", "two"), line(None, "three"))], None)]
    pred = [("p", [region("r", line("a", "one"), line("x", "four"), line("a", "two"), line(None, "three"))], None)]
    pairs = E.page_pairs(spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, PRED))
    got = sorted((r["status"], r["reference"] or "", r["prediction"] or "") for r in E.paired_lines(pairs, ["page_id"]).collect())
    assert got == [("extra", "", "four"), ("extra", "", "three"), ("extra", "", "two"), ("matched", "one", "one"), ("missing", "three", ""), ("missing", "two", "")]


def test_blind_lines_are_assigned_by_overlap(spark):
    left, right = box(0, 10, 100, 50), box(110, 10, 210, 50)
    gold = [("p", "d", "t", [region("l", line("1", "אבג", left)), region("r", line("2", "דהו", right))], None)]
    same = [("p", [region("x", line("7", "דהו", right)), region("y", line("8", "אבג", left)), region("z", line("9", "?", None))], None)]
    r = counts(spark, gold, same, by_id=False, by_overlap=True).first()
    assert (r["gold_lines"], r["pred_lines"], r["exact"], r["n_pairs"]) == (2, 3, 2, 3)
    swapped = [("p", [region("x", line("1", "אבג", right)), region("y", line("2", "דהו", left))], None)]
    assert counts(spark, gold, swapped, by_id=False, by_overlap=True).first()["exact"] == 0
    assert counts(spark, gold, swapped, by_id=True, by_overlap=True).first()["exact"] == 2
    far = [("p", [region("x", line("9", "אבג", box(400, 10, 500, 50)))], None)]
    assert counts(spark, gold, far, by_id=False, by_overlap=True).first()["n_pairs"] == 3


def test_page_text_follows_the_graph(spark):
    gold = [("p", "d", "t", [region("a", line("1", "one")), region("b", line("2", "two", None, 1), line("3", "three", None, 0))], ([["b", "a"]],)), ("c", "d", "t", [region("a", line("1", "x")), region("b", line("2", "y"))], ([["a", "b"], ["b", "a"]],))]
    df = spark.createDataFrame(gold, GOLD)
    assert {r["page_id"]: r["g_text"] for r in E.gold_text(df).collect()} == {"p": "three\ntwo\n\none", "c": "x\n\ny"}


def test_equal_and_kernel_counts_agree(spark):
    texts = ["", "שָׁלוֹם עולם", "call 054-123 or a@b.co (now) now", "e\u0301 - ok", "1,5 [x] https://a.b/c."]
    df = spark.createDataFrame([(t, t) for t in texts], "reference string, prediction string")
    got = E.line_counts(df).collect()
    for t, r in zip(texts, got, strict=True):
        t = unicodedata.normalize("NFC", t)
        want = dict(zip(E._TEXT + E._BIDI, E._text_counts(t, t) + E._bidi_counts(t, t), strict=True))
        assert {k: r[k] for k in want} == want, t


def test_direction_counts(spark):
    rows = [("טקסט ABC 12", "טקסט ABC 13"), ("אבגד הוזח", "חזוה דגבא"), ("a b c", "c b a"), ("x", "\u202ax")]
    got = E.line_counts(spark.createDataFrame(rows, "reference string, prediction string")).collect()
    assert (got[0]["ltr_ref"], got[0]["ltr_ok"], got[0]["numeric_ref"], got[0]["numeric_ok"]) == (2, 1, 1, 0)
    assert got[1]["visual_bad"] == 1 and got[0]["visual_bad"] == 0
    assert (got[2]["order_pairs"], got[2]["order_ok"]) == (3, 0)
    assert (got[3]["exact"], got[3]["n_unsafe"], got[3]["unbalanced_embeddings"]) == (1, 1, 1)


def test_gate(spark):
    good = [("p", "d", "t", [region("r", line("a", "אבג 12 (x)"))], None)]
    sums = E.summed(counts(spark, good, [("p", good[0][3], None)]))
    rows = E.gate(sums).collect()
    assert len(rows) == 8 and all(r["passed"] and r["status"] == "conformant" for r in rows) and {r["kind"] for r in rows} == {"hard", "quality"}
    bad = [("p", [region("r", line("a", "אבג 13 (x)"))], None)]
    strict, loose = (E.gate(E.summed(counts(spark, good, bad)), gate_quality=q, gate_all_controls=False).collect() for q in (True, False))
    assert {r["status"] for r in strict} == {"non_conformant"} and {r["status"] for r in loose} == {"conformant"}
    assert [r["check"] for r in strict if not r["passed"]] == ["strict_line_exact_rate>=0.95", "ltr_run_exact_rate>=0.98", "numeric_exact_rate>=0.99"]
    assert {r["status"] for r in E.gate(E.summed(counts(spark, good, bad).limit(0)).na.fill(0)).collect()} == {"not_evaluated"}


def test_components_and_headline(spark):
    metrics = {"line_gcer": 0.1, "line_wer": 0.2, "line_exact_rate": 0.5, "zero": 0.0, "none": None}
    df = spark.createDataFrame([tuple(metrics.values())], "line_gcer double, line_wer double, line_exact_rate double, zero double, none double")
    got = df.select(S.component("line").alias("c"), S.geometric([(F.col("zero"), 0.5), (F.col("line_wer"), 0.5)]).alias("z"), S.geometric([(F.col("none"), 0.5), (F.col("line_wer"), 0.5)]).alias("n"), S.headline(lambda k: F.lit(0.81)).alias("h")).first()
    assert got["c"] == pytest.approx(0.9**0.55 * 0.8**0.20 * 0.5**0.25)
    assert got["z"] == 0.0 and got["n"] is None and got["h"] == 81.0
    assert all(abs(sum(w for *_, w in parts) - 1) < 1e-9 for parts in S.COMPONENTS.values()) and abs(sum(S.WEIGHTS.values()) - 1) < 1e-9


def test_admission_steps(spark):
    schema = "system string, track string, suite string, model string, verified boolean, covered boolean, conformant boolean, score double"
    full = lambda s, **x: [(s, t, x.get("suite", "s"), x.get("model", "m"), x.get("verified", True), x.get("covered", True), x.get("conformant", True), x.get("score", 0.81)) for t in D.TRACKS]
    rows = full("ok") + full("few")[:4] + full("nosuite", suite=None) + full("unverified", verified=False) + full("gap", covered=False) + full("gate", conformant=False) + full("nan", score=None) + full("zero", score=0.0)
    got = {r["system"]: (r["status"], r["headline"]) for r in D.admission(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"ok": ("rankable", 81.0), "few": ("incomplete", None), "nosuite": ("invalid_evidence", None), "unverified": ("invalid_evidence", None), "gap": ("incomplete_submission", None), "gate": ("non_conformant", None), "nan": ("invalid_metrics", None), "zero": ("rankable", 0.0)}


def test_robustness(spark):
    schema = "page_id string, parent_id string, is_control boolean, family string, level string, split string, e double"
    rows = [("a0", "a", True, None, None, "test", 0.1), ("a1", "a", False, "blur", "medium", "test", 0.3), ("a2", "a", False, "jpeg", "strong", "test", None), ("b0", "b", True, None, None, "test", 0.2), ("b1", "b", False, "blur", "medium", "dev", 0.2), ("c1", "c", False, "blur", "strong", "test", 0.5), ("x", None, True, None, None, "test", 0.0)]
    df = spark.createDataFrame(rows, schema)
    pairs = S.robustness_pairs(df, ["e"])
    assert {r["page_id"]: None if r["delta_e"] is None else round(r["delta_e"], 9) for r in pairs.collect()} == {"a1": 0.2, "a2": None, "b1": 0.0, "c1": None}
    got = {(r["scope"], r["value"]): (r["n_pairs"], r["e_scored"], r["e_mean_delta"]) for r in S.robustness_summary(pairs, ["e"]).collect()}
    assert got[("macro", "all")] == (4, 2, 0.1) and got[("family", "blur")] == (3, 2, 0.1) and got[("family", "jpeg")] == (1, 0, None) and got[("level", "strong")] == (2, 0, None)
    assert sorted(map(tuple, S.lineage_issues(df.drop("e", "family", "level"), ["split"]).collect())) == [("b", "differs:split"), ("c", "control_count")]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    import json

    from paraleaf import cli

    monkeypatch.setattr(cli, "_session", lambda: spark)
    lines = f"array<{LINE[:-1]},base_direction:string>>"
    page = "page_id string, image struct<width:int,height:int,sha256:string>, regions array<struct<region_id:string,type:string,reading_index:int,polygon:array<array<double>>,lines:" + lines + ">>, tables array<struct<table_id:string,n_rows:int,n_cols:int,cells:array<struct<row_start:int,row_end:int,col_start:int,col_end:int>>>>, reading_order struct<edges:array<array<string>>>"
    gold = [(p, (10, 10, "h"), [("r", "text", 0, None, [("l", "אבג 12", None, 0, d)])], None, None) for p, d in (("p", "rtl"), ("q", "rtl"))]
    spark.createDataFrame(gold, page).write.parquet(str(tmp_path / "gold"))
    spark.createDataFrame([("p", gold[0][2]), ("x", gold[0][2])], "page_id string, regions " + page.partition("regions ")[2].partition(", tables")[0]).write.parquet(str(tmp_path / "pred"))
    assert cli.main(["evaluate", str(tmp_path / "gold"), str(tmp_path / "pred"), "--out", str(tmp_path / "run")]) == 0
    m = json.loads(capsys.readouterr().out)
    assert m["coverage"] == {"gold_pages": 2, "matched": 1, "missing": 1, "extra": 1} and m["recognition"]["line_gcer"] == 0.5 and m["conformance"]["status"] == "non_conformant"
    assert cli.main(["evaluate", str(tmp_path / "gold"), str(tmp_path / "gold"), "--out", str(tmp_path / "same")]) == 0
    assert json.loads(capsys.readouterr().out)["conformance"]["status"] == "conformant"
    assert cli.main(["compare", str(tmp_path / "run"), str(tmp_path / "same"), "--out", str(tmp_path / "cmp")]) == 0
    assert [(r["rank"], r["run"]) for r in json.loads(capsys.readouterr().out)] == [(1, "same"), (None, "run")]
    assert (tmp_path / "cmp" / "comparison.html").exists() and "50.00%" in (tmp_path / "run" / "report.html").read_text()
    bad = [(p, i, [("r", "text", 0, None, [("l", "אבג", None, 0, "ltr")])], t, o) for p, i, _, t, o in gold]
    spark.createDataFrame(bad, page).write.parquet(str(tmp_path / "bad"))
    assert cli.main(["evaluate", str(tmp_path / "bad"), str(tmp_path / "pred")]) == 2


RATES = ["line_gcer", "line_exact_rate", "page_order_gcer", "grapheme_deletion_rate", "grapheme_insertion_rate", "visual_order_failure_rate"]


@pytest.mark.parametrize("odd", [False, True])
def test_sanity_rates_are_those_of_full_scoring(spark, odd):
    body = [region("r", line("a", "שָׁלוֹם עוֹלָם"), line("b", "abc (12.5) אבג־דה׳", None, 0), index=0), region("s", line("c", "é\r\nx‏"), line("d", ""), index=1)]
    gold = [("p", "d", "t", body, ([["s", "r"]],)), ("q", "d", "t", [region("r", line("a", "אבגדהוז חטיכל"))], None), ("e", "d", "t", None, None)]
    if odd:
        gold = [("o", "d", "t", [region(None, line("a", "אבגד"), line("a", "abc"), line(None, "דה"), line("n", None)), (None, None, None, None), region("x")], None), (None, "d", "t", body, None)]
    g = spark.createDataFrame(gold, GOLD)
    got = {r["system"]: r for r in S.sanity_rates(g).collect()}
    assert set(got) == set(S.fault_systems())
    for name in got:
        one = E.summed(E.page_counts(E.page_pairs(g, S.faulty(g, name)), ["page_id"])).select(*[v.alias(k) for k, v in (E.recognition() | E.bidi_rates()).items()]).first()
        read = RATES[:2] + [m for m, who in zip(RATES[2:], (S.ORDERED, S.BY_KIND, S.BY_KIND, S.VISUAL), strict=True) if name in who]
        assert {m: got[name][m] for m in read} == {m: one[m] for m in read}, name
    without_lines = {r["system"]: r for r in S.sanity_rates(spark.createDataFrame([("e", "d", "t", None, None)], GOLD)).collect()}
    assert all(without_lines[s]["line_gcer"] == 0 for s in S.fault_systems())


def test_sanity_is_planned_once_for_all_systems(spark, sf, monkeypatch):
    """Six scoring plans in one filled the driver."""
    plans = []
    monkeypatch.setattr(QE, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    assert QE.q_sanity(spark, sf).count() == 10
    assert len(plans) == 1 and "Join" not in plans[0] and plans[0].count("Relation [") == 2


def test_distance_is_that_of_the_edit_script():
    draw, pairs = random.Random(3), []
    for _ in range(3000):
        a, b = ("".join(draw.choices("abcd"[: draw.randint(1, 4)], k=draw.choice((0, 1, 5, 63, 64, 65, 130)))) for _ in "ab")
        pairs.append((a, a[::-1] if draw.random() < 0.3 else b))
    edits = [sum(align(a, b)[2:5]) for a, b in pairs]
    assert edits == [distance(a, b) for a, b in pairs] == distances(pairs)


def test_graphemes_of_are_clusters():
    draw = random.Random(4)
    signs = "ab \n\r1.é\xa9\xadאבשת־׀׃׆״\u05b8\u05bc\u05c1\u05c7\u0301\u200a\u200d\u200f\u2013\u2028\u1100\u1161"
    for _ in range(20_000):
        t = "".join(draw.choices(draw.sample(signs, 5), k=draw.randint(0, 9)))
        assert E.graphemes_of(t) == regex.findall(r"\X", t)
