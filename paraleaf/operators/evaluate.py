"""Scoring a table of gold pages against a table of predicted pages.

Gold pages are joined once to predicted pages; a page without prediction keeps its lines, which then count as deleted, and predictions
of unknown pages are not scored. All further steps stay in the partition of the page: lines are paired (`paired_lines`), the pairs are
counted (`line_counts`), the counts added up per page, per document and over all. Counters are added first and divided last.
Lines with equal texts are counted by Catalyst expressions; only unequal pairs meet the Python kernel.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import text as X
from ..functions.align import COUNTERS, align, distance
from ..functions.geometry import assign, polygon_iou
from ..functions.order import reading_order
from .assignment import LINE_IOU

UNITS = ("codepoint", "grapheme", "word", "punctuation")
RUNS = ("ltr", "numeric", "bracket")
LAST = 1_000_000_000
_TEXT = [f"{u}_{c}" for u in UNITS for c in COUNTERS]
_BIDI = [f"{r}_{c}" for r in RUNS for c in ("ref", "ok")] + ["order_pairs", "order_ok", "visual_bad"]
HYGIENE = ("n_marks", "n_embeddings", "n_overrides", "n_isolates", "n_zero_width", "n_replacement", "n_private", "n_presentation", "n_unsafe")
#: Least gain and greatest error rate of a line that reads better the wrong way round.
VISUAL_GAIN, VISUAL_RATE = 0.25, 0.25


def page_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold pages with their prediction: page_id, the gold columns, and p_regions, p_text (null where there is none).

    ``gold`` has page_id (unique), regions and reading_order; ``pred`` page_id (unique), regions and page_text. Other columns of ``gold`` are kept.
    """
    p = pred.select("page_id", F.col("regions").alias("p_regions"), F.col("page_text").alias("p_text"), F.lit(True).alias("p_there"))
    return gold.where("page_id is not null").join(p.where("page_id is not null"), "page_id", "left").withColumn("p_there", F.coalesce("p_there", F.lit(False)))


def region_ids(regions: str) -> Column:
    return F.transform(regions, lambda r, i: F.coalesce(r["region_id"], F.concat(F.lit("region-"), i)))


def _lines(regions: str) -> Column:
    """The lines of a page in the order given, with id, text and polygon."""
    inside = lambda r: F.transform(F.coalesce(r["lines"], F.array()), lambda x: F.struct(x["line_id"].alias("id"), x["text"].alias("text"), x["polygon"].alias("polygon")))
    return F.flatten(F.transform(F.coalesce(F.col(regions), F.array()), inside))


def _region_text(r: Column) -> Column:
    top = lambda x, i: F.coalesce(F.array_min(F.transform(x["polygon"], lambda p: p[1])), i.cast("double"))
    ranked = F.transform(r["lines"], lambda x, i: F.struct(F.coalesce(x["reading_index"], F.lit(LAST)).alias("k"), top(x, i).alias("y"), i.alias("i"), x["text"].alias("t")))
    return F.coalesce(F.array_join(F.transform(F.array_sort(ranked), lambda x: F.coalesce(x["t"], F.lit(""))), "\n"), F.lit(""))


def gold_text(df: DataFrame) -> DataFrame:
    """``df`` with g_text: regions in reading order, lines by reading index, top of the polygon, place."""
    keys = F.transform("regions", lambda r: F.coalesce(r["reading_index"], F.lit(LAST)).cast("double"))
    df = df.withColumn("_ids", region_ids("regions")).withColumn("_ord", reading_order("_ids", "reading_order.edges", keys))
    by_id = F.map_from_arrays("_ids", F.transform("regions", _region_text))
    return df.withColumn("g_text", F.coalesce(F.array_join(F.transform("_ord", lambda i: by_id[i]), "\n\n"), F.lit(""))).drop("_ids", "_ord")


def predicted_text(regions: Column | str = "p_regions", text: Column | str = "p_text") -> Column:
    """The page text delivered, or the regions by (reading index, place), which is their order where a prediction states no edges."""
    ranked = F.transform(regions, lambda r, i: F.struct(F.coalesce(r["reading_index"], F.lit(LAST)).alias("k"), i.alias("i"), _region_text(r).alias("t")))
    return F.coalesce(text, F.array_join(F.transform(F.array_sort(ranked), lambda x: x["t"]), "\n\n"), F.lit(""))


def _pairs_by_id() -> Column:
    """Of lines with one id the first of each side are a pair; every other line stands alone."""
    ids = lambda side: F.transform(side, lambda x: x["id"])
    first = lambda side, x, i: x["id"].isNotNull() & (F.array_position(ids(side), x["id"]) == i + 1)
    row = lambda status, g, p: F.struct(status.alias("status"), g.alias("reference"), p.alias("prediction"))
    none = F.lit(None).cast("string")

    def of_gold(x, i):
        at = F.when(first("g", x, i), F.array_position(ids("p"), x["id"])).otherwise(0)
        return F.when(at > 0, row(F.lit("matched"), x["text"], F.element_at("p", F.when(at > 0, at).otherwise(1).cast("int"))["text"])).otherwise(row(F.lit("missing"), x["text"], none))

    def alone(x, j):
        return ~(F.coalesce(first("p", x, j), F.lit(False)) & F.coalesce(F.array_contains(ids("g"), x["id"]), F.lit(False)))

    extra = F.transform(F.filter("p", alone), lambda x: row(F.lit("extra"), none, x["text"]))
    return F.concat(F.transform("g", of_gold), extra)


def _boxes(lines: list) -> list:
    out = []
    for x in lines:
        pts = [p for p in (x["polygon"] or []) if p is not None and len(p) > 1 and p[0] is not None and p[1] is not None]
        out.append((min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts)) if len(pts) > 2 else None)
    return out


def match_by_overlap(gold: list[dict], pred: list[dict], by_id: bool, least: float) -> tuple[list[tuple[int, int, str]], list[int], list[int]]:
    """((gold place, predicted place, how), gold left over, predicted left over) of one page's units.

    With ``by_id`` units of one id go first; of the rest the assignment of greatest total overlap counts, kept from ``least`` on.
    """
    import numpy as np

    pairs: list[tuple[int, int, str]] = []
    left_g, left_p = list(range(len(gold))), list(range(len(pred)))
    if by_id:
        at: dict = {}
        for j, x in enumerate(pred):
            at.setdefault(x["id"], j)
        seen = set()
        for i, x in enumerate(gold):
            if x["id"] is not None and x["id"] in at and x["id"] not in seen:
                pairs.append((i, at[x["id"]], "id"))
            seen.add(x["id"])
        done_g, done_p = {a for a, _, _ in pairs}, {b for _, b, _ in pairs}
        left_g, left_p = [i for i in left_g if i not in done_g], [j for j in left_p if j not in done_p]
    if left_g and left_p:
        gb, pb = _boxes(gold), _boxes(pred)
        score = np.zeros((len(left_g), len(left_p)))
        for a, i in enumerate(left_g):
            for b, j in enumerate(left_p):
                if gb[i] and pb[j] and gb[i][0] < pb[j][2] and pb[j][0] < gb[i][2] and gb[i][1] < pb[j][3] and pb[j][1] < gb[i][3]:
                    score[a, b] = polygon_iou(gold[i]["polygon"], pred[j]["polygon"])
        if score.any():
            for a, b in assign(score):
                if score[a, b] >= least:
                    pairs.append((left_g[a], left_p[b], "overlap"))
    done_g, done_p = {a for a, _, _ in pairs}, {b for _, b, _ in pairs}
    return pairs, [i for i in range(len(gold)) if i not in done_g], [j for j in range(len(pred)) if j not in done_p]


def paired_lines(pairs: DataFrame, keep: list[str], by_id: bool = True, by_overlap: bool = False, least: float = LINE_IOU) -> DataFrame:
    """(*keep, status, reference, prediction): one row per gold line, and one per predicted line without partner, of `page_pairs`.

    ``by_id`` pairs lines of one id; ``by_overlap`` assigns what is left by polygon overlap (both false pairs nothing). status is
    matched, missing or extra; a missing side is null.
    """
    df = pairs.select(*keep, _lines("regions").alias("g"), _lines("p_regions").alias("p"))
    if not by_overlap:
        found = _pairs_by_id() if by_id else F.concat(F.transform("g", lambda x: F.struct(F.lit("missing").alias("status"), x["text"].alias("reference"), F.lit(None).cast("string").alias("prediction"))), F.transform("p", lambda x: F.struct(F.lit("extra").alias("status"), F.lit(None).cast("string").alias("reference"), x["text"].alias("prediction"))))
        return df.select(*keep, F.explode(found).alias("x")).select(*keep, "x.*")
    schema = T.StructType([*df.select(*keep).schema.fields, *[T.StructField(c, T.StringType()) for c in ("status", "reference", "prediction")]])

    def run(batches):
        for batch in batches:
            rows, out = [], []
            for k, (g, p) in enumerate(zip(batch.column("g").to_pylist(), batch.column("p").to_pylist(), strict=True)):
                two, missing, extra = match_by_overlap(g, p, by_id, least)
                out += [("matched", g[i]["text"], p[j]["text"]) for i, j, _ in two] + [("missing", g[i]["text"], None) for i in missing] + [("extra", None, p[j]["text"]) for j in extra]
                rows += [k] * (len(out) - len(rows))
            if out:
                kept = [batch.column(c).take(pa.array(rows)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, pa.string()) for c in zip(*out, strict=True)]], names=schema.names)

    return df.mapInArrow(run, schema)


_GRAPHEME, _PUNCT, _NUMBER, _BRACKET = regex.compile(r"\X"), regex.compile(X.PUNCTUATION), regex.compile(X.NUMBER_RUN), regex.compile(X.BRACKETS)
_RUN, _TOKEN, _HEBREW = regex.compile(X.LTR_RUN), regex.compile(X.VISUAL_TOKEN, regex.S), regex.compile("[\u0590-\u05ff]")


_MARK = re.compile(f"[{X.HEBREW_MARKS}]")
#: Signs that join with nothing but the marks after them.
_SIMPLE = re.compile(f"[\n\x20-\x7e\xa1-\xac\xae-\xff\u05be\u05c0\u05c3\u05c6\u05d0-\u05ea\u05ef-\u05f4\u2000-\u200a\u2010-\u2027{X.HEBREW_MARKS}]*")
_MARKED = re.compile(f"\n|[^\n][{X.HEBREW_MARKS}]*")


def graphemes_of(t: str) -> list[str]:
    """The same as \\X gives, sooner for simple Hebrew and Latin text."""
    if not _SIMPLE.fullmatch(t):
        return _GRAPHEME.findall(t)
    return _MARKED.findall(t) if _MARK.search(t) else list(t)


def _ltr(t: str) -> list[str]:
    return [y for x in _RUN.findall(t) if (y := x.rstrip(".,;!?)]}"))]


def word_order(ref: list[str], pred: list[str]) -> tuple[int, int]:
    """(pairs, pairs in order) of the words on both sides, the k-th of a word with its k-th."""
    at: dict[str, list[int]] = {}
    for j, w in enumerate(pred):
        at.setdefault(w, []).append(j)
    used: dict[str, int] = {}
    places = []
    for w in ref:
        k = used.get(w, 0)
        if k < len(at.get(w, ())):
            places.append(at[w][k])
            used[w] = k + 1
    return len(places) * (len(places) - 1) // 2, sum(a < b for i, a in enumerate(places) for b in places[i + 1 :])


def reads_backwards(ref: list[str], pred: str, logical: float) -> bool:
    """Whether the prediction fits much better when its storage order is taken for a display order."""
    if len(ref) < 2 or logical < VISUAL_GAIN - 1e-12:
        return False
    least = distance(ref, graphemes_of(pred)[::-1])
    if least:
        display = "".join("".join(reversed(_GRAPHEME.findall(t))) if _HEBREW.search(t) else t for t in reversed(_TOKEN.findall(pred)))
        least = min(least, distance(ref, graphemes_of(display)))
    rate = least / max(1, len(ref))
    return logical - rate >= VISUAL_GAIN - 1e-12 and rate <= VISUAL_RATE + 1e-12


def _text_counts(a: str, b: str) -> list[int]:
    return [*align(a, b), *align(_GRAPHEME.findall(a), _GRAPHEME.findall(b)), *align(a.split(), b.split()), *align(_PUNCT.findall(a), _PUNCT.findall(b))]


def _bidi_counts(a: str, b: str) -> list[int]:
    out = []
    for units in (_ltr, _NUMBER.findall, _BRACKET.findall):
        n, *_, ok = align(units(a), units(b))
        out += [n, ok]
    ref = _GRAPHEME.findall(a)
    n, _, s, d, i, _ = align(ref, _GRAPHEME.findall(b))
    return [*out, *word_order(a.split(), b.split()), int(reads_backwards(ref, b, (s + d + i) / max(1, n)))]


def _kernel(names: list[str], count):
    @pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in names]))
    def run(ref: pd.Series, pred: pd.Series) -> pd.DataFrame:
        zero = [0] * len(names)
        return pd.DataFrame([zero if a is None and b is None else count(a or "", b or "") for a, b in zip(ref, pred, strict=True)], columns=names)

    return run


text_counts = _kernel(_TEXT, _text_counts)
line_kernel = _kernel(_TEXT + _BIDI, lambda a, b: _text_counts(a, b) + _bidi_counts(a, b))


def _equal_text_counts(c: Column) -> dict[str, Column]:
    """The counters of two equal texts."""
    size = {"codepoint": F.length(c), "grapheme": F.size(X.graphemes(c)), "word": F.size(X.word_list(c)), "punctuation": F.regexp_count(c, F.lit(X.PUNCTUATION))}
    zero = F.lit(0)
    return {f"{u}_{k}": (n if k in ("n_ref", "n_pred", "correct") else zero).cast("long") for u, n in size.items() for k in COUNTERS}


def _equal_bidi_counts(c: Column) -> dict[str, Column]:
    runs = {"ltr": F.size(X.ltr_runs(c)), "numeric": F.size(X.number_runs(c)), "bracket": F.size(X.bracket_list(c))}
    out = {f"{r}_{k}": n.cast("long") for r, n in runs.items() for k in ("ref", "ok")}
    w = F.size(X.word_list(c)).cast("long")
    pairs = F.floor(w * (w - 1) / 2).cast("long")
    return out | {"order_pairs": pairs, "order_ok": pairs, "visual_bad": F.lit(0).cast("long")}


def _counted(df: DataFrame, kernel, equal: dict[str, Column]) -> DataFrame:
    same = F.col("reference") == F.col("prediction")
    df = df.withColumn("_same", same).withColumn("_k", kernel(F.when(~same, F.col("reference")), F.when(~same, F.col("prediction"))))
    return df.withColumns({n: F.when(F.col("_same"), e).otherwise(F.col("_k")[n]) for n, e in equal.items()}).drop("_k")


def line_counts(lines: DataFrame) -> DataFrame:
    """``lines`` with the additive counters of recognition, direction and character hygiene; texts are brought to the strict form, null counts as empty."""
    df = lines.withColumns({c: X.strict(F.coalesce(F.col(c), F.lit(""))) for c in ("reference", "prediction")} | {"_raw": F.coalesce(F.col("prediction"), F.lit(""))})
    c = F.col("reference")
    df = _counted(df, line_kernel, _equal_text_counts(c) | _equal_bidi_counts(c))
    hygiene = X.hygiene("_raw")
    balance = X.unbalanced("_raw", X.BIDI_EMBEDDINGS[:2] + X.BIDI_OVERRIDES, X.BIDI_EMBEDDINGS[2]), X.unbalanced("_raw", X.BIDI_ISOLATES[:3], X.BIDI_ISOLATES[3])
    df = df.withColumns(hygiene | {"unbalanced_embeddings": balance[0], "unbalanced_isolates": balance[1], "visual_lines": (F.length("reference") > 0).cast("long"), "exact": F.col("_same").cast("long")})
    return df.drop("_raw", "_same")


SUMS = ["exact", *_TEXT, *_BIDI, *HYGIENE, "unbalanced_embeddings", "unbalanced_isolates", "visual_lines"]


def page_counts(pairs: DataFrame, keep: list[str], by_id: bool = True, by_overlap: bool = False) -> DataFrame:
    """(*keep, n_pairs, gold_lines, pred_lines and the line counters summed, and page_* counters of the page texts); one row per gold page, also those without lines.

    ``keep`` must hold page_id.
    """
    lines = line_counts(paired_lines(pairs, ["page_id"], by_id, by_overlap))
    n = lambda *s: F.count_if(F.col("status").isin(*s)).alias
    per = lines.groupBy("page_id").agg(F.count("*").alias("n_pairs"), n("matched", "missing")("gold_lines"), n("matched", "extra")("pred_lines"), *[F.sum(c).alias(c) for c in SUMS])
    texts = gold_text(pairs).withColumn("_p", predicted_text()).select(*keep, "p_there", X.strict("g_text").alias("reference"), X.strict("_p").alias("prediction"))
    texts = _counted(texts, text_counts, _equal_text_counts(F.col("reference")))
    texts = texts.select(*keep, "p_there", F.col("_same").cast("long").alias("page_exact"), *[F.col(c).alias(f"page_{c}") for c in _TEXT])
    return texts.join(per, "page_id", "left").na.fill(0, ["n_pairs", "gold_lines", "pred_lines", *SUMS])


def error_rate(unit: str) -> Column:
    c = lambda k: F.col(f"{unit}_{k}")
    return (c("substitutions") + c("deletions") + c("insertions")) / F.greatest(c("n_ref"), F.lit(1))


def safe_rate(ok: str, ref: str) -> Column:
    """1 where there is nothing to get right."""
    return F.when(F.col(ref) == 0, 1.0).otherwise(F.col(ok) / F.col(ref))


def recognition() -> dict[str, Column]:
    """Rates over summed counters of pages."""
    g = lambda k: F.col(f"grapheme_{k}")
    n = F.greatest(g("n_ref"), F.lit(1))
    edits = g("substitutions") + g("deletions") + g("insertions")
    out = {"line_cer": error_rate("codepoint"), "line_gcer": error_rate("grapheme"), "line_wer": error_rate("word"), "punctuation_error_rate": error_rate("punctuation")}
    out |= {"line_gcer_normalized": edits / F.greatest(edits + g("correct"), F.lit(1)), "grapheme_substitution_rate": g("substitutions") / n, "grapheme_deletion_rate": g("deletions") / n, "grapheme_insertion_rate": g("insertions") / n}
    out |= {"line_exact_rate": F.col("exact") / F.greatest(F.col("n_pairs"), F.lit(1))}
    out |= {"page_order_cer": error_rate("page_codepoint"), "page_order_gcer": error_rate("page_grapheme"), "page_order_wer": error_rate("page_word"), "reading_order_penalty_gcer": error_rate("page_grapheme") - error_rate("grapheme")}
    return {k: F.round(v, 9) for k, v in out.items()}


def bidi_rates() -> dict[str, Column]:
    out = {f"{r if r != 'ltr' else 'ltr_run'}_exact_rate": safe_rate(f"{r}_ok", f"{r}_ref") for r in RUNS}
    out |= {"pairwise_word_order_accuracy": safe_rate("order_ok", "order_pairs"), "visual_order_failure_rate": F.col("visual_bad") / F.greatest(F.col("visual_lines"), F.lit(1))}
    return {k: F.round(v, 9) for k, v in out.items()}


PAGE_SUMS = ["n_pairs", "gold_lines", "pred_lines", *SUMS, "page_exact", *[f"page_{c}" for c in _TEXT]]


def summed(pages: DataFrame, *by: str, more: list[str] | None = None) -> DataFrame:
    """Counters of `page_counts` (and the columns ``more``) added up, with the number of pages."""
    return pages.groupBy(*by).agg(F.count("*").alias("n_pages"), F.count_if("p_there").alias("n_predicted"), *[F.sum(c).alias(c) for c in [*PAGE_SUMS, *(more or [])]])


def dataset_rates(pages: DataFrame) -> DataFrame:
    """One row: micro rates over all pages, the mean of the pages' and of the documents' grapheme error rates."""
    docs = summed(pages.withColumn("_p", error_rate("grapheme")), "document_id", more=["_p"]).withColumn("_d", error_rate("grapheme"))
    all_docs = docs.agg(F.avg("_d").alias("d"), (F.sum("_p") / F.sum("n_pages")).alias("p"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_pages", "n_predicted", *PAGE_SUMS)])
    rates = recognition() | {"page_exact_rate": F.round(F.col("page_exact") / F.greatest(F.col("n_pages"), F.lit(1)), 9), "macro_page_line_gcer": F.round(F.coalesce("p", F.lit(0.0)), 9), "macro_document_line_gcer": F.round(F.coalesce("d", F.lit(0.0)), 9)}
    return all_docs.select("n_pages", "n_predicted", "gold_lines", "pred_lines", *[v.alias(k) for k, v in rates.items()])


# The gate's limits.
GATE = {"min_exact": 0.95, "min_ltr": 0.98, "min_numeric": 0.99, "min_bracket": 0.99, "max_visual": 0, "max_unsafe": 0, "max_unbalanced": 0, "max_controls": 0}


def gate(sums: DataFrame, gate_quality: bool = True, gate_all_controls: bool = True, limits: dict | None = None) -> DataFrame:
    """(check, kind, passed, value, limit, status): the hard and quality checks over one row of counters of the diagnostic pages.

    status is not_evaluated without pages, else conformant unless a check that counts has failed: the hard ones, with
    ``gate_quality`` the quality ones too; with ``gate_all_controls`` any direction control fails hard.
    """
    x = GATE | (limits or {})
    controls = F.col("n_marks") + F.col("n_embeddings") + F.col("n_overrides") + F.col("n_isolates")
    exact = F.col("exact") / F.greatest(F.col("n_pairs"), F.lit(1))
    rows = [
        ("visual_order_failure_count", "hard", F.col("visual_bad"), "max_visual"),
        ("unsafe_bidi_control_count", "hard", F.col("n_unsafe"), "max_unsafe"),
        ("unbalanced_bidi_controls", "hard", F.col("unbalanced_embeddings") + F.col("unbalanced_isolates"), "max_unbalanced"),
        ("strict_line_exact_rate", "quality", exact, "min_exact"),
        ("ltr_run_exact_rate", "quality", safe_rate("ltr_ok", "ltr_ref"), "min_ltr"),
        ("numeric_exact_rate", "quality", safe_rate("numeric_ok", "numeric_ref"), "min_numeric"),
        ("bracket_exact_rate", "quality", safe_rate("bracket_ok", "bracket_ref"), "min_bracket"),
        ("bidi_control_count", "hard" if gate_all_controls else "quality", controls, "max_controls"),
    ]
    checks = []
    for name, kind, value, limit in rows:
        least = limit.startswith("min")
        ok = value >= x[limit] if least else value <= x[limit]
        checks.append(F.struct(F.lit(f"{name}{'>=' if least else '<='}{x[limit]}").alias("check"), F.lit(kind).alias("kind"), ok.alias("passed"), F.round(value.cast("double"), 9).alias("value"), F.lit(float(x[limit])).alias("limit")))
    df = sums.select("n_pages", F.array(*checks).alias("c"))
    counts = lambda c: F.lit(True) if gate_quality else c["kind"] == "hard"
    failed = F.exists("c", lambda c: counts(c) & ~c["passed"])
    status = F.when(F.col("n_pages") == 0, "not_evaluated").when(failed, "non_conformant").otherwise("conformant")
    return df.withColumn("status", status).select(F.explode("c").alias("c"), "status").select("c.*", "status")


def error_rows(pairs: DataFrame, by_id: bool = True, by_overlap: bool = False) -> DataFrame:
    """(page_id, status, reference, prediction, gcer, cer, suspected, n_signs) of the lines with an error, a suspected display order or signs a clean text has none of."""
    lines = line_counts(paired_lines(pairs, ["page_id"], by_id, by_overlap))
    signs = F.col(HYGIENE[0])
    for c in HYGIENE[1:-1]:  # the last one counts signs of two others again
        signs = signs + F.col(c)
    df = lines.select("page_id", "status", "reference", "prediction", F.round(error_rate("grapheme"), 9).alias("gcer"), F.round(error_rate("codepoint"), 9).alias("cer"), (F.col("visual_bad") > 0).alias("suspected"), signs.alias("n_signs"))
    return df.where("gcer > 0 or suspected or n_signs > 0")


def evaluate_tables(gold: DataFrame, pred: DataFrame, by_id: bool = True, by_overlap: bool = False) -> tuple[dict, DataFrame, DataFrame]:
    """(metrics, pages, errors) of two tables: dataset rates, direction rates, the gate over all pages and coverage as a nested dict, and the rows behind them."""
    from ..plans.shared import written

    keep = ["page_id", *[c for c in ("document_id", "track") if c in gold.columns]]
    pairs = page_pairs(gold, pred)
    pages = written(page_counts(pairs, keep, by_id, by_overlap), "page-counts")
    if "document_id" not in pages.columns:
        pages = pages.withColumn("document_id", F.col("page_id"))
    sums = summed(pages).na.fill(0)
    checks = gate(sums).collect()  # eight rows
    row = lambda df: {k: v for k, v in df.first().asDict().items()}
    extra = pred.select("page_id").join(gold.select("page_id"), "page_id", "left_anti").count()
    metrics = {
        "recognition": row(dataset_rates(pages)),
        "bidi": row(sums.select(*[v.alias(k) for k, v in bidi_rates().items()])),
        "conformance": {"status": checks[0]["status"], "checks": {c["check"]: c["passed"] for c in checks}},
        "coverage": row(pages.agg(F.count("*").alias("gold_pages"), F.count_if("p_there").alias("matched"), F.count_if(~F.col("p_there")).alias("missing"))) | {"extra": extra},
    }
    return metrics, pages.select("page_id", "document_id", "n_pairs", "exact", *[v.alias(k) for k, v in recognition().items()]), error_rows(pairs, by_id, by_overlap)
