"""Queries of text evaluation: alignment, error rates, character hygiene, runs, order of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import align as A
from .functions import text as X
from .plans.shared import once, table

BIG = 1 << 20


def line_evals(spark, sf, columns=("reference", "prediction")) -> DataFrame:
    return once(table(spark, sf, "line_evals", ["eval_id", *columns, "received_at"]), "eval_id")


def rates(prefix: str = "") -> list[Column]:
    p = prefix
    edits = F.col(f"{p}substitutions") + F.col(f"{p}deletions") + F.col(f"{p}insertions")
    return [F.round(edits / F.greatest(F.col(f"{p}n_ref"), F.lit(1)), 9).alias(f"{p}rate")]


def _counted(df: DataFrame, keys: list[str], a: Column) -> DataFrame:
    """Counters of each pair added up per key; equal texts never reach the kernel's tables."""
    return df.withColumn("_a", a).groupBy(*keys).agg(F.count("*").alias("n_lines"), F.count_if(F.coalesce("reference", F.lit("")) == F.coalesce("prediction", F.lit(""))).alias("n_exact"), *[F.sum(F.col("_a")[c]).alias(c) for c in A.COUNTERS])


def q_line_error_rates(spark, sf):
    df = line_evals(spark, sf, ("model_name", "reference", "prediction"))
    return _counted(df, ["model_name"], A.aligned_text("reference", "prediction")).withColumns({"cer": rates()[0]})


def _by_unit(units):
    def run(spark, sf):
        df = line_evals(spark, sf, ("model_name", "reference", "prediction"))
        return _counted(df, ["model_name"], A.aligned_units(units("reference"), units("prediction"))).withColumns({"rate": rates()[0]})

    return run


def q_page_error_rates(spark, sf):
    df = line_evals(spark, sf, ("page_id", "reference", "prediction")).where("page_id is not null")
    return _counted(df, ["page_id"], A.aligned_text("reference", "prediction")).withColumns({"cer": rates()[0]})


def q_micro_macro(spark, sf):
    df = line_evals(spark, sf, ("document_id", "page_id", "reference", "prediction"))
    pages = _counted(df, ["document_id", "page_id"], A.aligned_text("reference", "prediction"))
    edits = "substitutions + deletions + insertions"
    docs = pages.groupBy("document_id").agg(F.sum(F.expr(edits)).alias("edits"), F.sum("n_ref").alias("n_ref"))
    micro = docs.agg(F.sum("edits").alias("e"), F.sum("n_ref").alias("r"), F.avg(F.col("edits") / F.greatest("n_ref", F.lit(1))).alias("m"))
    by_page = pages.agg(F.avg(F.expr(edits) / F.greatest("n_ref", F.lit(1))).alias("p"))
    return micro.crossJoin(by_page).select(F.round(F.col("e") / F.greatest("r", F.lit(1)), 9).alias("micro_cer"), F.round("p", 9).alias("macro_page_cer"), F.round("m", 9).alias("macro_document_cer"))


SLICES = ["document_type", "layout_type", "script_style", "source_type", "vocalization"]


def _page_facts(spark, sf) -> DataFrame:
    return table(spark, sf, "gold_pages").select("page_id", "track", *[F.col(f"metadata.{c}").alias(c) for c in SLICES])


def q_slices(spark, sf):
    """One group-by for all slice fields: counters per page first, then each page counts once per field."""
    df = line_evals(spark, sf, ("page_id", "reference", "prediction")).where("page_id is not null")
    pages = _counted(df, ["page_id"], A.aligned_text("reference", "prediction")).join(_page_facts(spark, sf), "page_id")
    kinds = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in ["track", *SLICES]])
    long = pages.withColumn("s", F.explode(kinds)).where("s.value is not null")
    return long.groupBy("s.field", "s.value").agg(F.count("*").alias("n_pages"), F.sum("n_lines").alias("n_lines"), F.sum("n_ref").alias("n_ref"), F.sum(F.expr("substitutions + deletions + insertions")).alias("edits")).withColumn("cer", F.round(F.col("edits") / F.greatest("n_ref", F.lit(1)), 9))


def q_confusions(spark, sf):
    df = line_evals(spark, sf).where("reference <> prediction").select(F.explode(A.confusion_list("reference", "prediction")).alias("c"))
    return df.groupBy("c.ref", "c.pred").agg(F.sum("c.n").alias("n"))


FINALS = [("ך", "כ"), ("ם", "מ"), ("ן", "נ"), ("ף", "פ"), ("ץ", "צ")]


def q_final_letters(spark, sf):
    pairs = [a + b for a, b in FINALS] + [b + a for a, b in FINALS]
    c = q_confusions(spark, sf)
    return c.agg(F.coalesce(F.sum(F.when(F.concat("ref", "pred").isin(*pairs), F.col("n"))), F.lit(0)).alias("final_letter_confusions"))


def q_diacritics(spark, sf):
    df = line_evals(spark, sf, ("model_name", "reference", "prediction")).withColumn("d", A.diacritic_counts("reference", "prediction"))
    s = df.groupBy("model_name").agg(*[F.sum(F.col("d")[c]).alias(c) for c in ("ref_marks", "pred_marks", "right_marks", "paired_bases", "exact_bases")])
    ratio = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.round(F.col(a) / F.col(b), 9))
    return s.withColumns({"mark_precision": ratio("right_marks", "pred_marks"), "mark_recall": ratio("right_marks", "ref_marks")})


def q_bag_of_words(spark, sf):
    df = line_evals(spark, sf)
    side = lambda c, s: df.select("eval_id", F.explode(X.word_list(c)).alias("w"), F.lit(s).alias("s"))
    both = side("reference", 1).unionByName(side("prediction", -1)).groupBy("eval_id", "w").agg(F.sum("s").alias("d"), F.count("*").alias("n"))
    return both.groupBy("eval_id").agg(F.round(F.sum(F.abs("d")) / F.sum("n"), 9).alias("bag_of_words"))


def q_multiset_f1(spark, sf):
    df = line_evals(spark, sf)
    side = lambda c, a, b: df.select("eval_id", F.explode(X.word_list(c)).alias("w"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    both = side("reference", 1, 0).unionByName(side("prediction", 0, 1)).groupBy("eval_id", "w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.groupBy("eval_id").agg(F.round(2 * F.sum(F.least("a", "b")) / (F.sum("a") + F.sum("b")), 9).alias("f1"))


def q_runs(spark, sf):
    df = line_evals(spark, sf)
    n = lambda f, c: F.coalesce(F.size(f(c)), F.lit(0)).cast("long")
    return df.select("eval_id", n(X.number_runs, "reference").alias("n_numbers"), n(X.bracket_list, "reference").alias("n_brackets"), n(X.punctuation_list, "reference").alias("n_punctuation"), F.array_join(X.number_runs("reference"), "|").alias("numbers"))


def q_ltr_runs(spark, sf):
    df = line_evals(spark, sf)
    return df.select("eval_id", F.array_join(X.ltr_runs("reference"), "|").alias("ltr_runs"))


def q_run_alignment(spark, sf):
    df = line_evals(spark, sf, ("model_name", "reference", "prediction"))
    return _counted(df, ["model_name"], A.aligned_units(X.ltr_runs("reference"), X.ltr_runs("prediction"))).select("model_name", "n_ref", "n_pred", (F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("edits"), F.when(F.col("n_ref") == 0, 1.0).otherwise(F.round(F.col("correct") / F.col("n_ref"), 9)).alias("right_rate"))


def q_hygiene(spark, sf):
    df = line_evals(spark, sf)
    c = X.hygiene("prediction")
    balance = X.unbalanced("prediction", X.BIDI_EMBEDDINGS[:2] + X.BIDI_OVERRIDES, X.BIDI_EMBEDDINGS[2]) + X.unbalanced("prediction", X.BIDI_ISOLATES[:3], X.BIDI_ISOLATES[3])
    return df.select("eval_id", *[v.alias(k) for k, v in c.items()], balance.alias("n_unbalanced"))


def q_hygiene_totals(spark, sf):
    df = line_evals(spark, sf, ("model_name", "prediction"))
    return df.groupBy("model_name").agg(*[F.sum(v).alias(k) for k, v in X.hygiene("prediction").items()])


def q_mark_classes(spark, sf):
    df = line_evals(spark, sf)
    marks = df.select(F.explode(F.regexp_extract_all("reference", F.lit(f"([{X.HEBREW_MARKS}])"), F.lit(1))).alias("m"))
    return marks.groupBy(X.mark_class(F.ascii("m")).alias("mark_class")).agg(F.count("*").alias("n"))


def q_strict_text(spark, sf):
    return line_evals(spark, sf).select("eval_id", X.strict("prediction").alias("strict"))


def q_graphemes(spark, sf):
    return line_evals(spark, sf).select("eval_id", F.coalesce(F.size(X.graphemes("reference")), F.lit(0)).cast("long").alias("n_graphemes"))


def q_directions(spark, sf):
    return line_evals(spark, sf).select("eval_id", X.first_strong("reference").alias("direction"), X.mixed_direction("reference").alias("mixed"))


def q_scope_issues(spark, sf):
    df = table(spark, sf, "documents", ["doc_id", "text"])
    return df.select(F.explode(X.scope_issues("text")).alias("issue")).groupBy("issue").agg(F.count("*").alias("n_documents"))


def q_code_points(spark, sf):
    df = line_evals(spark, sf).select(F.explode(F.split("reference", "")).alias("ch")).where("ch <> ''")
    return df.groupBy("ch").agg(F.count("*").alias("n"))


def q_code_point_view(spark, sf):
    df = line_evals(spark, sf).select(F.explode(X.code_points("reference")).alias("c"))
    return df.groupBy("c.bidi", "c.category").agg(F.count("*").alias("n"), F.count_distinct("c.code").alias("n_codes"))


def q_visual_order(spark, sf):
    """Of the lines with errors those that fit better when read the wrong way round."""
    df = line_evals(spark, sf).where("reference <> prediction")
    df = df.withColumn("visual", X.visual_order("prediction")).withColumn("reversed", F.array_join(F.reverse(X.graphemes("prediction")), ""))
    rate = lambda c: A.error_rate(A.aligned_units(X.graphemes("reference"), X.graphemes(c)))
    df = df.select("eval_id", F.size(X.graphemes("reference")).alias("n"), rate("prediction").alias("logical"), F.least(rate("visual"), rate("reversed")).alias("other"))
    gain = F.col("logical") - F.col("other")
    return df.select("eval_id", F.round("logical", 9).alias("logical"), F.round("other", 9).alias("visual"), ((F.col("n") >= 2) & (gain > 1e-12)).alias("candidate"), ((F.col("n") >= 2) & (gain >= 0.25 - 1e-12) & (F.col("other") <= 0.25 + 1e-12)).alias("suspected"))


def q_word_order(spark, sf):
    """Of the words on both sides (k-th with k-th occurrence) the share of pairs in the same order, with one window per line."""
    df = line_evals(spark, sf)

    def side(c, p):
        w = df.select("eval_id", F.posexplode(X.word_list(c)).alias(p, "w"))
        return w.withColumn("k", F.row_number().over(W.partitionBy("eval_id", "w").orderBy(p)))

    both = side("reference", "i").join(side("prediction", "j"), ["eval_id", "w", "k"]).groupBy("eval_id").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("o"))
    js = F.transform("o", lambda x: x["j"])
    up = F.aggregate(F.sequence(F.lit(1), F.size("o")), F.lit(0).cast("long"), lambda acc, i: acc + F.size(F.filter(F.slice(js, 1, i - 1), lambda x: x < F.element_at(js, i))))
    n = F.size("o").cast("long")
    both = both.select("eval_id", (F.floor(n * (n - 1) / 2)).cast("long").alias("n_pairs"), F.when(n > 1, up).otherwise(0).cast("long").alias("n_in_order"))
    return both


def q_faults(spark, sf):
    """Injected faults: reversed by grapheme, marks stripped, ASCII punctuation, empty."""
    df = line_evals(spark, sf).where("reference is not null")
    return df.select("eval_id", F.array_join(F.reverse(X.graphemes("reference")), "").alias("reversed"), F.regexp_replace("reference", f"[{X.HEBREW_MARKS}]", "").alias("no_marks"), F.translate("reference", "־׳״׃", "-'\":").alias("ascii"))


def q_final_kinds(spark, sf):
    df = table(spark, sf, "documents", ["doc_id", "text"])
    return df.select("doc_id", F.size(X.word_list(F.col("text"))).cast("long").alias("n_words"), F.regexp_count("text", F.lit("[א-ת]")).cast("long").alias("n_hebrew"), F.regexp_count("text", F.lit(f"[{X.HEBREW_MARKS}]")).cast("long").alias("n_marks")).where("n_words is not null")


def q_leak_text(spark, sf):
    return line_evals(spark, sf).select("eval_id", X.nfkc_folded("reference").alias("folded"))


QUERIES = {
    "q_line_error_rates": q_line_error_rates,
    "q_word_error_rates": _by_unit(X.word_list),
    "q_grapheme_error_rates": _by_unit(X.graphemes),
    "q_punctuation_error_rates": _by_unit(X.punctuation_list),
    "q_base_letter_error_rates": lambda spark, sf: _counted(line_evals(spark, sf, ("model_name", "reference", "prediction")).withColumns({"reference": X.base_letters("reference"), "prediction": X.base_letters("prediction")}), ["model_name"], A.aligned_text("reference", "prediction")),
    "q_page_error_rates": q_page_error_rates,
    "q_micro_macro": q_micro_macro,
    "q_slices": q_slices,
    "q_confusions": q_confusions,
    "q_final_letters": q_final_letters,
    "q_diacritics": q_diacritics,
    "q_bag_of_words": q_bag_of_words,
    "q_multiset_f1": q_multiset_f1,
    "q_runs": q_runs,
    "q_ltr_runs": q_ltr_runs,
    "q_run_alignment": q_run_alignment,
    "q_hygiene": q_hygiene,
    "q_hygiene_totals": q_hygiene_totals,
    "q_mark_classes": q_mark_classes,
    "q_strict_text": q_strict_text,
    "q_graphemes": q_graphemes,
    "q_directions": q_directions,
    "q_scope_issues": q_scope_issues,
    "q_code_points": q_code_points,
    "q_code_point_view": q_code_point_view,
    "q_visual_order": q_visual_order,
    "q_word_order": q_word_order,
    "q_faults": q_faults,
    "q_word_counts": q_final_kinds,
    "q_leak_text": q_leak_text,
}

LE = "(SELECT * FROM line_evals WHERE eval_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY eval_id ORDER BY received_at NULLS LAST) = 1)"
CHARS = "list_transform(range(1, length({0}) + 1), lambda i: substring({0}, i, 1))"
GRAPHEMES = "list_transform(range(1, length_grapheme({0}) + 1), lambda i: substring_grapheme({0}, i, 1))"
WORDS = "list_filter(regexp_split_to_array({0}, '[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda w: w <> '')"
PUNCT = "regexp_extract_all({0}, '\\pP')"


def counters_sql(keys: str, unit: str, source: str = LE, where: str = "true") -> str:
    """The relational edit-distance table: one row of the table per step, a running minimum for insertions."""
    r, p = unit.format("reference"), unit.format("prediction")
    return f"""WITH RECURSIVE base AS (SELECT *, coalesce(reference, '') = coalesce(prediction, '') AS same FROM {source} WHERE {where}),
    p0 AS (SELECT eval_id AS id, coalesce({r}, []) AS r, coalesce({p}, []) AS p FROM base WHERE NOT same),
    p1 AS (SELECT id, r[k + 1:] AS r, p[k + 1:] AS p FROM (SELECT *, coalesce(list_position(list_transform(range(1, least(len(r), len(p)) + 1), lambda i: r[i] <> p[i]), true) - 1, least(len(r), len(p))) AS k FROM p0)),
    pr AS (SELECT id, r[:len(r) - k] AS r, p[:len(p) - k] AS p FROM (SELECT *, coalesce(list_position(list_transform(range(0, least(len(r), len(p))), lambda i: r[len(r) - i] <> p[len(p) - i]), true) - 1, least(len(r), len(p))) AS k FROM p1)),
    dp(id, r, p, i, d) AS (
      SELECT id, r, p, 0, list_transform(range(0, len(p) + 1), lambda x: x * {BIG}) FROM pr
      UNION ALL
      SELECT id, any_value(r), any_value(p), i + 1, list(v ORDER BY j) FROM (
        SELECT id, r, p, i, j, j * {BIG} + min(c - j * {BIG}) OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING) AS v FROM (
          SELECT id, r, p, i, j, CASE WHEN j = 0 THEN d[1] + {BIG} ELSE least(d[j + 1] + {BIG}, d[j] + CASE WHEN r[i + 1] = p[j] THEN 0 ELSE {BIG} + 1 END) END AS c
          FROM (SELECT id, r, p, i, d, unnest(range(0, len(p) + 1)) AS j FROM dp WHERE i < len(r)))) GROUP BY id, i),
    fin AS (SELECT id, len(r) AS n, len(p) AS m, d[len(p) + 1] // {BIG} AS dist, d[len(p) + 1] % {BIG} AS s FROM dp WHERE i = len(r)),
    lines AS (SELECT base.*, coalesce(len({r}), 0) AS n_ref, coalesce(len({p}), 0) AS n_pred, coalesce(s, 0) AS substitutions, coalesce((dist - s - (m - n)) // 2, 0) AS deletions FROM base LEFT JOIN fin ON id = eval_id),
    counted AS (SELECT {keys}, count(*) AS n_lines, count(*) FILTER (same) AS n_exact, CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(substitutions) AS BIGINT) AS substitutions, CAST(sum(deletions) AS BIGINT) AS deletions,
      CAST(sum(deletions + n_pred - n_ref) AS BIGINT) AS insertions, CAST(sum(n_ref - substitutions - deletions) AS BIGINT) AS correct FROM lines GROUP BY {keys}) """


_RATE = "round((substitutions + deletions + insertions) / greatest(n_ref, 1), 9)"
_SLICE_LIST = ", ".join(f"{{'field': '{c}', 'value': CAST({'track' if c == 'track' else 'metadata.' + c} AS VARCHAR)}}" for c in ["track", *SLICES])
_CODE = {k: f"[{v}]" for k, v in (("n_marks", X.BIDI_MARKS), ("n_embeddings", X.BIDI_EMBEDDINGS), ("n_overrides", X.BIDI_OVERRIDES), ("n_isolates", X.BIDI_ISOLATES), ("n_zero_width", X.ZERO_WIDTH), ("n_replacement", "�"), ("n_private", "-"), ("n_presentation", X.PRESENTATION), ("n_unsafe", X.BIDI_EMBEDDINGS + X.BIDI_OVERRIDES))}
_COUNTS = ", ".join(f"CAST(len(regexp_extract_all(prediction, '{v}')) AS BIGINT) AS {k}" for k, v in _CODE.items())

ORACLE = {
    "q_line_error_rates": counters_sql("model_name", CHARS) + f"SELECT *, {_RATE} AS cer FROM counted",
    "q_word_error_rates": counters_sql("model_name", WORDS) + f"SELECT *, {_RATE} AS rate FROM counted",
    "q_grapheme_error_rates": counters_sql("model_name", GRAPHEMES) + f"SELECT *, {_RATE} AS rate FROM counted",
    "q_punctuation_error_rates": counters_sql("model_name", PUNCT) + f"SELECT *, {_RATE} AS rate FROM counted",
    "q_page_error_rates": counters_sql("page_id", CHARS, where="page_id IS NOT NULL") + f"SELECT *, {_RATE} AS cer FROM counted",
    "q_micro_macro": counters_sql("document_id, page_id", CHARS)
    + """, docs AS (SELECT document_id, sum(substitutions + deletions + insertions) AS e, sum(n_ref) AS r FROM counted GROUP BY 1)
      SELECT round(sum(e) / greatest(sum(r), 1), 9) AS micro_cer, (SELECT round(avg((substitutions + deletions + insertions) / greatest(n_ref, 1)), 9) FROM counted) AS macro_page_cer, round(avg(e / greatest(r, 1)), 9) AS macro_document_cer FROM docs""",
    "q_slices": counters_sql("page_id", CHARS, where="page_id IS NOT NULL")
    + f""", facts AS (SELECT page_id, unnest([{_SLICE_LIST}]) AS s FROM gold_pages)
      SELECT s.field AS field, s.value AS value, count(*) AS n_pages, CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(substitutions + deletions + insertions) AS BIGINT) AS edits, round(sum(substitutions + deletions + insertions) / greatest(sum(n_ref), 1), 9) AS cer
      FROM counted JOIN facts USING (page_id) WHERE s.value IS NOT NULL GROUP BY 1, 2""",
    "q_bag_of_words": f"""SELECT eval_id, round(sum(abs(d)) / sum(n), 9) AS bag_of_words FROM (SELECT eval_id, w, sum(s) AS d, count(*) AS n FROM (SELECT eval_id, unnest({WORDS.format("reference")}) AS w, 1 AS s FROM {LE} UNION ALL SELECT eval_id, unnest({WORDS.format("prediction")}), -1 FROM {LE}) GROUP BY 1, 2) GROUP BY 1""",
    "q_multiset_f1": f"""SELECT eval_id, round(2 * sum(least(a, b)) / (sum(a) + sum(b)), 9) AS f1 FROM (SELECT eval_id, w, sum(a) AS a, sum(b) AS b FROM (SELECT eval_id, unnest({WORDS.format("reference")}) AS w, 1 AS a, 0 AS b FROM {LE} UNION ALL SELECT eval_id, unnest({WORDS.format("prediction")}), 0, 1 FROM {LE}) GROUP BY 1, 2) GROUP BY 1""",
    "q_runs": f"""SELECT eval_id, CAST(coalesce(len(regexp_extract_all(reference, '{X.NUMBER_RUN}')), 0) AS BIGINT) AS n_numbers, CAST(coalesce(len(regexp_extract_all(reference, '[()\\[\\]{{}}<>]')), 0) AS BIGINT) AS n_brackets, CAST(coalesce(len({PUNCT.format("reference")}), 0) AS BIGINT) AS n_punctuation, array_to_string(regexp_extract_all(reference, '{X.NUMBER_RUN}'), '|') AS numbers FROM {LE}""",
    "q_ltr_runs": f"""SELECT eval_id, array_to_string(list_filter(list_transform(regexp_extract_all(reference, '{X.LTR_RUN}'), lambda x: regexp_replace(x, '[.,;!?)\\]}}]+$', '')), lambda x: x <> ''), '|') AS ltr_runs FROM {LE}""",
    "q_hygiene_totals": f"SELECT model_name, {', '.join(f'CAST(sum({k}) AS BIGINT) AS {k}' for k in _CODE)} FROM (SELECT model_name, {_COUNTS} FROM {LE}) GROUP BY 1",
    "q_mark_classes": f"""SELECT CASE WHEN c BETWEEN 1425 AND 1455 THEN 'cantillation' WHEN c BETWEEN 1456 AND 1467 OR c = 1479 THEN 'vowel' WHEN c = 1468 THEN 'dagesh_mapiq' WHEN c IN (1473, 1474) THEN 'shin_sin_dot' WHEN c IN (1469, 1471) THEN 'meteg_rafe' ELSE 'other' END AS mark_class, count(*) AS n
      FROM (SELECT unicode(unnest(regexp_extract_all(reference, '[{X.HEBREW_MARKS}]'))) AS c FROM {LE}) GROUP BY 1""",
    "q_strict_text": f"SELECT eval_id, nfc_normalize(translate(regexp_replace(prediction, '\\r\\n?', chr(10), 'g'), '{X.BIDI_CONTROLS}', '')) AS strict FROM {LE}",
    "q_graphemes": f"SELECT eval_id, coalesce(length_grapheme(reference), 0) AS n_graphemes FROM {LE}",
    "q_scope_issues": f"""SELECT issue, count(*) AS n_documents FROM (SELECT unnest(list_filter([CASE WHEN NOT regexp_matches(text, '[א-ת]') THEN 'no_hebrew_letters' END, CASE WHEN regexp_matches(text, '[װ-ײ]') THEN 'yiddish_codepoint' END, CASE WHEN regexp_matches(text, '[֑-ׅ֯ׄ]') THEN 'biblical_mark' END,
      CASE WHEN regexp_matches(text, '[{X.BIDI_CONTROLS}]') THEN 'bidi_control' END, CASE WHEN regexp_matches(text, '[-￾￿]') THEN 'invalid_unicode_content' END], lambda x: x IS NOT NULL)) AS issue FROM documents WHERE text IS NOT NULL) GROUP BY 1""",
    "q_code_points": f"SELECT ch, count(*) AS n FROM (SELECT unnest({CHARS.format('reference')}) AS ch FROM {LE}) GROUP BY 1",
    "q_word_order": f"""WITH r AS (SELECT eval_id, w, i, row_number() OVER (PARTITION BY eval_id, w ORDER BY i) AS k FROM (SELECT eval_id, unnest({WORDS.format("reference")}) AS w, generate_subscripts({WORDS.format("reference")}, 1) AS i FROM {LE})),
      p AS (SELECT eval_id, w, i AS j, row_number() OVER (PARTITION BY eval_id, w ORDER BY i) AS k FROM (SELECT eval_id, unnest({WORDS.format("prediction")}) AS w, generate_subscripts({WORDS.format("prediction")}, 1) AS i FROM {LE})),
      b AS (SELECT eval_id, i, j FROM r JOIN p USING (eval_id, w, k))
      SELECT x.eval_id, count(y.i) AS n_pairs, count(*) FILTER (x.j < y.j) AS n_in_order FROM b x LEFT JOIN b y ON x.eval_id = y.eval_id AND x.i < y.i GROUP BY 1""",
    "q_word_counts": f"SELECT doc_id, CAST(len({WORDS.format('text')}) AS BIGINT) AS n_words, CAST(len(regexp_extract_all(text, '[א-ת]')) AS BIGINT) AS n_hebrew, CAST(len(regexp_extract_all(text, '[{X.HEBREW_MARKS}]')) AS BIGINT) AS n_marks FROM documents WHERE text IS NOT NULL",
}
