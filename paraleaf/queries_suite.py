"""Queries around a scored suite: page selection, final order, validation in full, manifests, n-grams, repaired polygons."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text as X
from .functions.geometry import repaired_polygon
from .operators import suite as U
from .plans.shared import new_path, table
from .queries_pages import gold, q_diagnostic_rank
from .queries_text import LE, WORDS, line_evals


def q_split_filter(spark, sf):
    pages = gold(spark, sf, "track", "split").withColumn("split", F.lower(F.trim("split")))
    return U.split_filter(pages, "track", "split", "bidi_diagnostic")


def q_limited_pages(spark, sf):
    """The first 20 pages of a limited run."""
    return U.limited(gold(spark, sf, "document_id").select("page_id", "document_id"), "page_id", 20)


def q_limited_parents(spark, sf):
    """All pages of the first 3 documents."""
    return U.limited(gold(spark, sf, "document_id").select("page_id", "document_id"), "page_id", 3, "document_id")


def q_final_order(spark, sf):
    runs = q_diagnostic_rank(spark, sf).withColumn("rank", F.when(F.col("error") < 0.5, F.col("rank"))).withColumn("suite", F.lit("print"))
    return U.final_order(runs, "suite", "track", "rank", "error", "model_name").select("position", "track", "model_name", "rank", "error")


def q_page_issues(spark, sf):
    g = table(spark, sf, "gold_pages", ["page_id", "image", "regions", "tables", "reading_order"])
    return U.page_issues(g).groupBy("severity", "code").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


def q_ngrams(spark, sf):
    df = line_evals(spark, sf).select("eval_id", X.word_list("reference").alias("w")).where("w is not null")
    return df.select("eval_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct(U.ngrams(F.col("w"), 3))).cast("long").alias("n_trigrams"), F.size(F.filter("w", U.critical)).cast("long").alias("n_critical"))


def q_source_manifest(spark, sf):
    """Samples written as one JSON manifest, half of them with ``label`` for ``text``, and read as a source."""
    s = table(spark, sf, "samples", ["item_no", "item_id", "image_member", "text"]).where("item_no is not null")
    odd = F.col("item_no") % 2 == 1
    path = new_path(spark, "manifest")
    s.select("item_no", F.col("item_id").alias("sample_id"), F.col("image_member").alias("image"), F.when(odd, F.col("text")).alias("text"), F.when(~odd, F.col("text")).alias("label")).write.json(path)
    read = U.manifest(spark.read.schema("sample_id string, image string, text string, label string").json(path))
    return read.groupBy("sample_id").agg(F.count("*").alias("n"), F.count("text").alias("n_text"), F.sum(F.length("text")).alias("n_chars"))


@F.pandas_udf(T.StringType())
def _repair(polygon):
    return polygon.map(lambda p: repaired_polygon(None if p is None else [list(x) if x is not None else None for x in p])[0])


def q_polygon_repair(spark, sf):
    lines = gold(spark, sf, "regions").select(F.explode("regions").alias("r")).select(F.explode("r.lines").alias("l"))
    return lines.select(_repair("l.polygon").alias("repair")).groupBy("repair").agg(F.count("*").alias("n"))


def q_stress_pages(spark, sf):
    """The sources' notes as stress cases in three variants."""
    cases = table(spark, sf, "source_registry", ["source_id", "name", "languages"]).select(F.col("source_id").alias("id"), F.col("name").alias("text"), F.try_element_at("languages", F.lit(1)).alias("language"))
    return U.stress_pages(cases, ["clean", "blur", "rotated"]).select("page_id", "case_id", "variant", "track")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_") and v.__module__ == __name__}

ORACLE = {
    "q_split_filter": "SELECT track, wanted, count(*) FILTER (split = wanted) AS n_kept, count(*) FILTER (split IS NULL OR split <> wanted) AS n_other FROM (SELECT track, lower(trim(split)) AS split, CASE WHEN track = 'bidi_diagnostic' THEN 'diagnostic' ELSE 'test' END AS wanted FROM gold_pages) GROUP BY 1, 2",
    "q_limited_pages": "SELECT page_id, document_id FROM gold_pages ORDER BY page_id LIMIT 20",
    "q_limited_parents": "SELECT page_id, document_id FROM gold_pages WHERE document_id IN (SELECT DISTINCT document_id FROM gold_pages WHERE document_id IS NOT NULL ORDER BY 1 LIMIT 3)",
    "q_final_order": f"""WITH s AS (SELECT track, model_name, round(avg(bag_of_words_error), 9) AS error FROM {LE} e JOIN gold_pages g ON e.page_id = g.page_id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY error NULLS LAST, model_name) AS k FROM s)
      SELECT row_number() OVER (ORDER BY rank IS NULL, track NULLS LAST, rank NULLS LAST, error NULLS LAST, model_name) AS position, track, model_name, rank, error FROM (SELECT track, model_name, error, CASE WHEN error < 0.5 THEN k END AS rank FROM r)""",
    "q_ngrams": f"""SELECT eval_id, len(w) AS n_tokens, len(list_distinct(CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS n_trigrams, len(list_filter(w, lambda x: regexp_matches(x, '[0-9A-Za-z]'))) AS n_critical FROM (SELECT eval_id, {WORDS.format("reference")} AS w FROM {LE} WHERE reference IS NOT NULL)""",
    "q_source_manifest": "SELECT item_id AS sample_id, count(*) AS n, count(text) AS n_text, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM samples WHERE item_no IS NOT NULL GROUP BY 1",
    "q_stress_pages": "SELECT source_id || '::' || v AS page_id, source_id AS case_id, v AS variant, 'stress_' || coalesce(languages[1], CASE WHEN regexp_matches(name, '[א-ת]') THEN 'he' ELSE 'und' END) AS track FROM source_registry, (SELECT unnest(['clean', 'blur', 'rotated']) AS v)",
}
