"""Queries that score gold pages against predicted pages end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import queries_pages as QP
from . import queries_sources as QS
from .functions import text as X
from .operators import admission as D
from .operators import evaluate as E
from .operators import scores as S
from .plans.shared import table, written
from .queries_pages import PP, pred
from .queries_text import CHARS, GRAPHEMES, PUNCT, WORDS, counters_sql

KEEP = ["page_id", "document_id", "track"]


def page_pairs(spark, sf) -> DataFrame:
    return E.page_pairs(table(spark, sf, "gold_pages", [*KEEP, "regions", "reading_order"]), pred(spark, sf, "regions", "page_text"))


def _counts(spark, sf, by_id=True, by_overlap=False) -> DataFrame:
    return E.page_counts(page_pairs(spark, sf), KEEP, by_id, by_overlap)


ORDER = ("page_order_gcer", "page_order_wer", "reading_order_penalty_gcer")


def q_evaluate_page_order(spark, sf):
    """The page texts against each other, in reading order, by grapheme and word."""
    return _counts(spark, sf).select("page_id", *[E.recognition()[k].alias(k) for k in ORDER])


def q_evaluate_pages(spark, sf):
    """Every gold page: lines paired by id, counts and rates; a page without prediction has only deletions."""
    rates = {k: v for k, v in E.recognition().items() if k not in ORDER}
    return _counts(spark, sf).select("page_id", "document_id", "n_pairs", "gold_lines", "pred_lines", "exact", "page_exact", *[v.alias(k) for k, v in rates.items()])


def q_evaluate_dataset(spark, sf):
    return E.dataset_rates(written(_counts(spark, sf), "page-counts")).drop(*ORDER)


def q_evaluate_blind(spark, sf):
    """The same with lines assigned by polygon overlap alone."""
    return E.dataset_rates(written(_counts(spark, sf, False, True), "page-counts"))


def q_evaluate_documents(spark, sf):
    s = E.summed(_counts(spark, sf), "document_id")
    return s.select("document_id", "n_pages", "n_predicted", "n_pairs", *[E.recognition()[k].alias(k) for k in ("line_cer", "line_gcer", "line_wer", "page_order_cer")])


def q_evaluate_slices(spark, sf):
    """Counters per page once, then one group-by for all slice fields; pages without a value of a field are in none of its slices."""
    facts = table(spark, sf, "gold_pages").select("page_id", *[F.col(f"metadata.{c}").alias(c) for c in ("document_type", "layout_type", "script_style", "source_type", "vocalization")])
    kinds = ["track", *facts.columns[1:]]
    pages = _counts(spark, sf).join(facts, "page_id")
    long = pages.withColumn("s", F.explode(F.array(*[F.struct(F.concat(F.lit(f"{c}="), F.col(c)).alias("slice")) for c in kinds]))).where("s.slice is not null").withColumn("slice", F.col("s.slice"))
    s = E.summed(long, "slice")
    return s.select("slice", "n_pages", "gold_lines", *[E.recognition()[k].alias(k) for k in ("line_cer", "line_gcer", "line_exact_rate", "page_order_cer")])


def q_bidi_sums(spark, sf):
    """The direction counters and rates of all pages, by split, without the visual-order diagnostic."""
    facts = table(spark, sf, "gold_pages", ["page_id", "split"]).select("page_id", F.lower(F.trim("split")).alias("split"))
    s = E.summed(_counts(spark, sf).join(facts, "page_id"), "split")
    cols = [f"{r}_{k}" for r in E.RUNS for k in ("ref", "ok")] + ["order_pairs", "order_ok", *E.HYGIENE]
    return s.select("split", *cols, *[v.alias(k) for k, v in E.bidi_rates().items() if "visual" not in k])


def q_visual_failures(spark, sf):
    s = E.summed(_counts(spark, sf))
    return s.select("visual_lines", "visual_bad", "unbalanced_embeddings", "unbalanced_isolates", E.bidi_rates()["visual_order_failure_rate"].alias("visual_order_failure_rate"))


def q_gate(spark, sf):
    """The gate over the pages of the diagnostic split."""
    facts = table(spark, sf, "gold_pages", ["page_id", "split"]).where("lower(trim(split)) = 'diagnostic'").select("page_id")
    return E.gate(E.summed(_counts(spark, sf).join(facts, "page_id", "left_semi")).na.fill(0))


def _family(spark, sf) -> DataFrame:
    """Pages as children of their document: its first page without a degradation is the control."""
    f = table(spark, sf, "gold_pages", ["page_id", "document_id", "metadata"]).select("page_id", F.col("document_id").alias("parent_id"), F.try_element_at("metadata.extra", F.lit("degradation_family")).alias("family"))
    first = f.where("family is null").groupBy("parent_id").agg(F.min("page_id").alias("control"))
    return f.join(first, "parent_id", "left").where("family is not null or page_id = control").select("page_id", "parent_id", F.coalesce(F.col("page_id") == F.col("control"), F.lit(False)).alias("is_control"), "family", F.lit(None).cast("string").alias("level"))


PAIRED = ["line_gcer", "page_order_cer"]


def _paired(spark, sf, counts=None, metrics=PAIRED) -> DataFrame:
    rates = E.recognition()
    c = (counts if counts is not None else _counts(spark, sf)).select("page_id", *[F.when(F.col("p_there"), rates[m]).alias(m) for m in metrics])
    return S.robustness_pairs(_family(spark, sf).join(c, "page_id"), metrics)


def q_robustness(spark, sf):
    """Degraded pages against the clean page of their document: deltas over all, by family and by level; pages without prediction stay in the count."""
    return S.robustness_summary(_paired(spark, sf), PAIRED)


def q_lineage_issues(spark, sf):
    facts = table(spark, sf, "gold_pages", ["page_id", "split", "metadata"]).select("page_id", F.lower(F.trim("split")).alias("split"), F.col("metadata.source_collection").alias("source"))
    return S.lineage_issues(_family(spark, sf).join(facts, "page_id"), ["split", "source"])


def _components(spark, sf) -> DataFrame:
    """One row: the scores of the components, each from the pages of its track; null where its metrics are missing."""
    facts = table(spark, sf, "gold_pages", ["page_id", "split"]).select("page_id", F.lower(F.trim("split")).alias("split"))
    pages = written(_counts(spark, sf).join(facts, "page_id"), "component-pages")
    rates = lambda df: E.summed(df).na.fill(0).select("n_pages", *[v.alias(k) for k, v in (E.recognition() | E.bidi_rates()).items()], F.round(2 * (F.col("gold_lines") + F.col("pred_lines") - F.col("n_pairs")) / F.greatest(F.col("gold_lines") + F.col("pred_lines"), F.lit(1)), 9).alias("line_f1"))
    test = pages.where("split = 'test'")
    regions = QP.q_layout_by_id(spark, sf).select(F.col("f1").alias("region_f1"))
    order = QP.q_order_totals(spark, sf)
    t = QS.q_table_metrics(spark, sf).agg(F.count("gold_table").alias("g"), F.count("pred_table").alias("p"), F.count_if(F.col("status") == "matched").alias("m"), F.avg("span_f1").alias("cell_span_f1"), F.avg("slot_accuracy").alias("grid_slot_accuracy"), (F.sum("cell_edits") / F.greatest(F.sum("cell_ref"), F.lit(1))).alias("cell_text_gcer"))
    tables = t.where("g > 0").withColumn("table_presence_f1", 2 * F.col("m") / (F.col("g") + F.col("p")))
    deltas = _paired(spark, sf, pages, ["line_gcer", "page_order_gcer"]).agg(F.avg("delta_line_gcer").alias("mean_line_gcer_delta"), F.percentile("delta_page_order_gcer", 0.9).alias("p90_page_order_gcer_delta"))
    spread = pages.agg(F.percentile(E.error_rate("grapheme"), 0.9).alias("page_line_gcer_p90"))
    parts = {
        "bidi": rates(pages.where("split = 'diagnostic'")).where("n_pages > 0"),
        "line": rates(test).where("n_pages > 0"),
        "page": rates(test.where("track = 'modern_page_ocr'")).where("n_pages > 0").crossJoin(regions).crossJoin(order),
        "tables": tables,
        "robustness": rates(pages).crossJoin(deltas).crossJoin(spread),
    }  # single rows all
    found = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("component"), F.round(S.component(name), 8).alias("score"))
        found = one if found is None else found.unionByName(one)
    return found


def q_components(spark, sf):
    return _components(spark, sf)


def q_headline(spark, sf):
    """The components, the gate's status and the headline, which stands only where all five are scored and the gate holds."""
    c = _components(spark, sf).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("component", "score"))).alias("s"), F.count("*").alias("n_components"), F.count("score").alias("n_scored"))
    status = q_gate(spark, sf).agg(F.first("status").alias("gate"))
    j = c.crossJoin(status)  # two single rows
    state = F.when(F.col("n_components") < len(S.WEIGHTS), "incomplete").when(F.col("gate") != "conformant", "non_conformant").when(F.col("n_scored") < len(S.WEIGHTS), "invalid_metrics").otherwise("rankable")
    score = S.headline(lambda k: F.try_element_at("s", F.lit(k)))
    return j.select("n_components", "gate", state.alias("status"), score.alias("ungated_headline"), F.when(state == "rankable", score).alias("headline"))


def q_admission(spark, sf):
    """One report per component through the admission steps: its suite is the hash over its gold pages, it is covered if every page has a
    prediction, verified if the counters of its pages, taken anew from the lines, agree."""
    facts = table(spark, sf, "gold_pages", ["page_id", "split"]).select("page_id", F.lower(F.trim("split")).alias("split"))
    pages = _counts(spark, sf).join(facts, "page_id")
    state = pages.agg(F.bool_and("p_there").alias("covered"), F.bool_and(F.col("codepoint_n_ref") == F.col("codepoint_substitutions") + F.col("codepoint_deletions") + F.col("codepoint_correct")).alias("verified"), F.sum(F.xxhash64("page_id").cast("decimal(38,0)")).cast("string").alias("suite"))
    gate = q_gate(spark, sf).agg((F.first("status") == "conformant").alias("conformant"))
    reports = _components(spark, sf).crossJoin(state).crossJoin(gate)  # single rows
    return D.admission(reports.select(F.lit("all").alias("system"), F.col("component").alias("track"), "suite", F.lit("all").alias("model"), "verified", "covered", "conformant", "score"))


def q_sanity(spark, sf):
    """Six fault systems over the gold pages and ten checks of what each must show."""
    # A prediction states no edges; for the swapped order the indices of the regions decide.
    return S.sanity_checks(written(S.sanity_rates(table(spark, sf, "gold_pages", ["page_id", "regions", "reading_order"])), "sanity"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}


def _strict(c: str) -> str:
    return f"nfc_normalize(translate(regexp_replace(coalesce({c}, ''), '\\r\\n?', chr(10), 'g'), '{X.BIDI_CONTROLS}', ''))"


def _lines_sql(src: str) -> str:
    return f"""(SELECT *, l.line_id AS id, l.text AS text, row_number() OVER (PARTITION BY page_id, l.line_id ORDER BY p, q) AS k FROM (SELECT page_id, p, unnest(r.lines) AS l, generate_subscripts(r.lines, 1) AS q FROM (SELECT page_id, unnest(regions) AS r, generate_subscripts(regions, 1) AS p FROM {src})))"""


_PRED = f"(SELECT p.* FROM {PP} p SEMI JOIN gold_pages g ON p.page_id = g.page_id)"
#: One row per pair of lines, by id.
PAIRS = f"""(SELECT row_number() OVER () AS eval_id, page_id, gold, pred, raw, {_strict("rt")} AS reference, {_strict("raw")} AS prediction FROM (
    SELECT coalesce(g.page_id, p.page_id) AS page_id, g.page_id IS NOT NULL AS gold, p.page_id IS NOT NULL AS pred, g.text AS rt, p.text AS raw
    FROM {_lines_sql("gold_pages")} g FULL JOIN {_lines_sql(_PRED)} p ON g.page_id = p.page_id AND g.id = p.id AND g.k = 1 AND p.k = 1))"""
_TOP = "coalesce(list_min(list_transform(l.polygon, lambda x: x[2])), q - 1)"


def _page_text_sql(src: str, order: str, more: str = "") -> str:
    region = f"(SELECT page_id, p, any_value(ri) AS ri, any_value(rid) AS rid, coalesce(string_agg(coalesce(l.text, ''), chr(10) ORDER BY coalesce(l.reading_index, 1000000000), {_TOP}, q) FILTER (q IS NOT NULL), '') AS t FROM (SELECT page_id, p, r.reading_index AS ri, coalesce(r.region_id, 'region-' || (p - 1)) AS rid, unnest(CASE WHEN coalesce(len(r.lines), 0) = 0 THEN [NULL] ELSE r.lines END) AS l, CASE WHEN coalesce(len(r.lines), 0) = 0 THEN NULL ELSE generate_subscripts(r.lines, 1) END AS q FROM (SELECT page_id, unnest(regions) AS r, generate_subscripts(regions, 1) AS p FROM {src})) GROUP BY 1, 2)"
    return f"(SELECT r.page_id, string_agg(t, chr(10) || chr(10) ORDER BY {order}) AS t FROM {region} r {more} GROUP BY 1)"


#: The graph of a page is a chain through all its regions in this data, so a region's place is its number of predecessors; elsewhere index and place decide.
_CLOSED = "(WITH RECURSIVE e AS (SELECT DISTINCT page_id, e[1] AS a, e[2] AS b FROM (SELECT page_id, unnest(reading_order.edges) AS e FROM gold_pages)), c AS (SELECT * FROM e UNION SELECT c.page_id, c.a, e.b FROM c JOIN e ON c.page_id = e.page_id AND c.b = e.a) SELECT page_id, b, count(DISTINCT a) AS n FROM c GROUP BY 1, 2)"
_GOLD_TEXT = _page_text_sql("gold_pages", "coalesce(c.n, 0), coalesce(ri, 1000000000), p", f"LEFT JOIN {_CLOSED} c ON c.page_id = r.page_id AND c.b = r.rid")
_PRED_TEXT = _page_text_sql(_PRED, "coalesce(ri, 1000000000), p")
PAGE_TEXTS = f"""(SELECT row_number() OVER () AS eval_id, g.page_id, {_strict("gt.t")} AS reference, {_strict("coalesce(p.page_text, pt.t)")} AS prediction FROM gold_pages g LEFT JOIN {_GOLD_TEXT} gt ON gt.page_id = g.page_id LEFT JOIN {_PRED} p ON p.page_id = g.page_id LEFT JOIN {_PRED_TEXT} pt ON pt.page_id = g.page_id)"""
_EDITS = "(substitutions + deletions + insertions)"


def _unit(name: str, unit: str, source: str) -> str:
    return f"(SELECT page_id AS page_id_, n_exact, n_lines, n_ref AS {name}_ref, {_EDITS} AS {name}_e, substitutions AS {name}_s, deletions AS {name}_d, insertions AS {name}_i, correct AS {name}_ok FROM ({counters_sql('page_id', unit, source)} SELECT * FROM counted)) AS {name}"


def _distance(name: str, unit: str) -> str:
    """Edit distance of whole pages: every different unit of a page becomes one ASCII character (pages of this data have fewer than 128), for which there is a built-in function."""
    r, p = unit.format("reference"), unit.format("prediction")
    code = lambda x: f"array_to_string(list_transform({x}, lambda u: chr(CAST(list_position(al, u) AS INTEGER))), '')"
    return f"(SELECT page_id AS page_id_, CAST(same AS BIGINT) AS n_exact, len(r) AS {name}_ref, levenshtein({code('r')}, {code('p')}) AS {name}_e FROM (SELECT *, list_distinct(list_concat(r, p)) AS al FROM (SELECT page_id, reference = prediction AS same, {r} AS r, {p} AS p FROM {PAGE_TEXTS}))) AS {name}"


_ALL = f"""(SELECT d.page_id, d.document_id, d.track, d.split, d.metadata AS metadata, coalesce(lc.n_lines, 0) AS n_pairs, coalesce(c.gold_lines, 0) AS gold_lines, coalesce(c.pred_lines, 0) AS pred_lines, coalesce(lc.n_exact, 0) AS exact, pc.n_exact AS page_exact, pp.page_id IS NOT NULL AS there,
    {", ".join(f"coalesce({u}.{u}_{k}, 0) AS {u}_{k}" for u in ("lc", "lg", "lw", "lp", "pc") for k in (("ref", "e", "s", "d", "i", "ok") if u[0] == "l" else ("ref", "e")))}
    FROM gold_pages d LEFT JOIN (SELECT page_id, count(*) FILTER (gold) AS gold_lines, count(*) FILTER (pred) AS pred_lines FROM {PAIRS} GROUP BY 1) c ON c.page_id = d.page_id LEFT JOIN {PP} pp ON pp.page_id = d.page_id
    LEFT JOIN {_unit("lc", CHARS, PAIRS)} ON lc.page_id_ = d.page_id LEFT JOIN {_unit("lg", GRAPHEMES, PAIRS)} ON lg.page_id_ = d.page_id LEFT JOIN {_unit("lw", WORDS, PAIRS)} ON lw.page_id_ = d.page_id LEFT JOIN {_unit("lp", PUNCT, PAIRS)} ON lp.page_id_ = d.page_id
    LEFT JOIN {_distance("pc", CHARS)} ON pc.page_id_ = d.page_id)"""


def _rate(u: str, total: str = "{}") -> str:
    f = total.format
    return f"{f(u + '_e')} / greatest({f(u + '_ref')}, 1)"


def _rates_sql(f: str = "{}") -> dict[str, str]:
    t = f.format
    out = {"line_cer": _rate("lc", f), "line_gcer": _rate("lg", f), "line_wer": _rate("lw", f), "punctuation_error_rate": _rate("lp", f), "line_gcer_normalized": f"{t('lg_e')} / greatest({t('lg_e')} + {t('lg_ok')}, 1)"}
    out |= {f"grapheme_{n}_rate": f"{t('lg_' + k)} / greatest({t('lg_ref')}, 1)" for n, k in (("substitution", "s"), ("deletion", "d"), ("insertion", "i"))}
    out |= {"line_exact_rate": f"{t('exact')} / greatest({t('n_pairs')}, 1)", "page_order_cer": _rate("pc", f)}
    return out


def _select(rates: dict, *names: str) -> str:
    return ", ".join(f"round({rates[k]}, 9) AS {k}" for k in (names or rates))


_SUM = "sum({})"
_S = _rates_sql(_SUM)
_SLICES = ", ".join(f"'{c}=' || {'track' if c == 'track' else 'metadata.' + c}" for c in ("track", "document_type", "layout_type", "script_style", "source_type", "vocalization"))
_BRACED = lambda t: t.replace("{", "{{").replace("}", "}}")
_LTR = f"list_filter(list_transform(regexp_extract_all({{0}}, '{_BRACED(X.LTR_RUN)}'), lambda x: regexp_replace(x, '[.,;!?)\\]}}}}]+$', '')), lambda x: x <> '')"
_NUM = f"regexp_extract_all({{0}}, '{X.NUMBER_RUN}')"
_BR = "regexp_extract_all({0}, '[()\\[\\]{{}}<>]')"
_SPLIT_PAIRS = f"(SELECT x.*, lower(trim(g.split)) AS split FROM {PAIRS} x JOIN gold_pages g ON g.page_id = x.page_id)"
_SIGNS = {k: f"[{v}]" for k, v in (("n_marks", X.BIDI_MARKS), ("n_embeddings", X.BIDI_EMBEDDINGS), ("n_overrides", X.BIDI_OVERRIDES), ("n_isolates", X.BIDI_ISOLATES), ("n_zero_width", X.ZERO_WIDTH), ("n_replacement", "\ufffd"), ("n_private", "\ue000-\uf8ff"), ("n_presentation", X.PRESENTATION), ("n_unsafe", X.BIDI_EMBEDDINGS + X.BIDI_OVERRIDES))}


def _runs(name: str, unit: str) -> str:
    return f"(SELECT split AS split_, n_ref AS {name}_ref, correct AS {name}_ok FROM ({counters_sql('split', unit, _SPLIT_PAIRS)} SELECT * FROM counted)) AS {name}"


_ORDER = f"""(SELECT split AS split_, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS order_pairs, CAST(sum(up) AS BIGINT) AS order_ok FROM (SELECT split, eval_id, count(*) AS n, 0 AS up FROM (SELECT * FROM w) GROUP BY 1, 2 UNION ALL SELECT x.split, x.eval_id, 0, count(*) FROM w x JOIN w y ON x.eval_id = y.eval_id AND x.i < y.i AND x.j < y.j GROUP BY 1, 2) GROUP BY 1) AS o"""
_WORDS_SIDE = "(SELECT split, eval_id, w, i, row_number() OVER (PARTITION BY eval_id, w ORDER BY i) AS k FROM (SELECT split, eval_id, unnest({0}) AS w, generate_subscripts({0}, 1) AS i FROM lines))"
_ok = lambda r: f"CASE WHEN {r}_ref = 0 THEN 1.0 ELSE round({r}_ok / {r}_ref, 9) END"

ORACLE = {
    "q_evaluate_pages": f"SELECT page_id, document_id, n_pairs, gold_lines, pred_lines, exact, page_exact, {_select(_rates_sql())} FROM {_ALL}",
    "q_evaluate_dataset": f"""WITH x AS (SELECT * FROM {_ALL}) SELECT count(*) AS n_pages, count(*) FILTER (there) AS n_predicted, CAST(sum(gold_lines) AS BIGINT) AS gold_lines, CAST(sum(pred_lines) AS BIGINT) AS pred_lines, {_select(_S)}, round(sum(page_exact) / greatest(count(*), 1), 9) AS page_exact_rate,
      round(avg(lg_e / greatest(lg_ref, 1)), 9) AS macro_page_line_gcer, (SELECT round(avg(e / greatest(r, 1)), 9) FROM (SELECT sum(lg_e) AS e, sum(lg_ref) AS r FROM x GROUP BY document_id)) AS macro_document_line_gcer FROM x""",
    "q_evaluate_documents": f"SELECT document_id, count(*) AS n_pages, count(*) FILTER (there) AS n_predicted, CAST(sum(n_pairs) AS BIGINT) AS n_pairs, {_select(_S, 'line_cer', 'line_gcer', 'line_wer', 'page_order_cer')} FROM {_ALL} GROUP BY 1",
    "q_evaluate_slices": f"SELECT slice, count(*) AS n_pages, CAST(sum(gold_lines) AS BIGINT) AS gold_lines, {_select(_S, 'line_cer', 'line_gcer', 'line_exact_rate', 'page_order_cer')} FROM (SELECT *, unnest([{_SLICES}]) AS slice FROM {_ALL}) WHERE slice IS NOT NULL GROUP BY 1",
    "q_robustness": f"""WITH x AS (SELECT page_id, document_id AS parent_id, metadata.extra['degradation_family'] AS family, CASE WHEN there THEN round(lg_e / greatest(lg_ref, 1), 9) END AS lg, CASE WHEN there THEN round(pc_e / greatest(pc_ref, 1), 9) END AS pc FROM {_ALL}),
      c AS (SELECT parent_id, min_by(struct_pack(lg := lg, pc := pc), page_id) AS c FROM x WHERE family IS NULL GROUP BY 1),
      p AS (SELECT family, lg - c.lg AS dl, pc - c.pc AS dp FROM x LEFT JOIN c USING (parent_id) WHERE family IS NOT NULL),
      l AS (SELECT unnest([{{'scope': 'macro', 'value': 'all'}}, {{'scope': 'family', 'value': family}}, {{'scope': 'level', 'value': 'none'}}]) AS s, dl, dp FROM p)
      SELECT s.scope AS scope, s.value AS value, count(*) AS n_pairs, {", ".join(f"count({d}) AS {m}_scored, round(avg({d}), 9) AS {m}_mean_delta, round(quantile_cont({d}, 0.5), 9) AS {m}_median_delta, round(quantile_cont({d}, 0.9), 9) AS {m}_p90_delta" for d, m in (("dl", "line_gcer"), ("dp", "page_order_cer")))} FROM l GROUP BY 1, 2""",
    "q_sanity": """SELECT unnest(['perfect_has_no_errors', 'perfect_is_exact', 'perfect_keeps_order', 'empty_deletes_everything', 'empty_inserts_nothing', 'reverse_is_worse_than_marks', 'reverse_is_seen_as_visual_order', 'swap_keeps_lines', 'swap_changes_pages', 'ascii_is_better_than_empty']) AS "check", true AS passed""",
    "q_bidi_sums": f"""WITH lines AS (SELECT * FROM {_SPLIT_PAIRS}), w AS (SELECT r.split, r.eval_id, r.i, p.i AS j FROM {_WORDS_SIDE.format(WORDS.format("reference"))} r JOIN {_WORDS_SIDE.format(WORDS.format("prediction"))} p ON r.eval_id = p.eval_id AND r.w = p.w AND r.k = p.k)
      SELECT a.split, ltr_ref, ltr_ok, numeric_ref, numeric_ok, bracket_ref, bracket_ok, coalesce(order_pairs, 0) AS order_pairs, coalesce(order_ok, 0) AS order_ok, {", ".join(_SIGNS)},
      {_ok("ltr")} AS ltr_run_exact_rate, {_ok("numeric")} AS numeric_exact_rate, {_ok("bracket")} AS bracket_exact_rate, CASE WHEN coalesce(order_pairs, 0) = 0 THEN 1.0 ELSE round(order_ok / order_pairs, 9) END AS pairwise_word_order_accuracy
      FROM (SELECT split, {", ".join(f"CAST(coalesce(sum(len(regexp_extract_all(raw, '{v}'))), 0) AS BIGINT) AS {k}" for k, v in _SIGNS.items())} FROM lines GROUP BY 1) a
      JOIN {_runs("ltr", _LTR)} ON ltr.split_ = a.split JOIN {_runs("numeric", _NUM)} ON numeric.split_ = a.split JOIN {_runs("bracket", _BR)} ON bracket.split_ = a.split LEFT JOIN {_ORDER} ON o.split_ = a.split""",
}
