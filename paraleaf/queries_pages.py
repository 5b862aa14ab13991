"""Queries of page evaluation: coverage, unit matching, order, tables, forms, operations, robustness, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.order import precedence_list, reading_order
from .operators import assignment as M
from .plans.shared import once, table
from .queries_text import LE, line_evals


def gold(spark, sf, *columns) -> DataFrame:
    return table(spark, sf, "gold_pages", ["page_id", *columns])


def pred(spark, sf, *columns) -> DataFrame:
    """One prediction per page: the earliest delivered."""
    df = table(spark, sf, "prediction_pages", list(dict.fromkeys(["pred_id", "page_id", *columns, "received_at"]))).where("pred_id is not null")
    df = once(df, "page_id")
    return df if "pred_id" in columns else df.drop("pred_id")


def q_coverage(spark, sf):
    g, p = gold(spark, sf), pred(spark, sf)
    return g.select("page_id", F.lit(1).alias("g")).join(p.select("page_id", F.lit(1).alias("p")), "page_id", "full").agg(F.count("g").alias("gold_pages"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("matched"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("g").isNull()).alias("extra"))


def _lines(spark, sf):
    return M.units(gold(spark, sf, "regions"), "line"), M.units(pred(spark, sf, "regions"), "line")


def _regions(spark, sf):
    return M.units(gold(spark, sf, "regions"), "region"), M.units(pred(spark, sf, "regions"), "region")


def q_line_pairs(spark, sf):
    return M.shared_id_pairs(*_lines(spark, sf)).groupBy("page_id", "status").agg(F.count("*").alias("n"), F.count_if(F.col("gold_text") == F.col("pred_text")).alias("n_equal"))


def q_region_overlaps(spark, sf):
    return M.overlapping(*_regions(spark, sf))


def q_split_merge(spark, sf):
    return M.split_merge(M.overlapping(*_regions(spark, sf)))


def q_region_matches(spark, sf):
    return M.matched_units(*_regions(spark, sf), M.REGION_IOU)


def q_line_matches(spark, sf):
    return M.matched_units(*_lines(spark, sf), M.LINE_IOU)


def q_layout(spark, sf):
    m = q_region_matches(spark, sf).agg(F.count_if(F.col("status") == "matched").alias("m"), F.count("gold_no").alias("g"), F.count("pred_no").alias("p"), F.avg("iou").alias("mean_iou"))
    return m.select(F.col("m").alias("matched"), F.col("g").alias("gold_regions"), F.col("p").alias("pred_regions"), F.round("mean_iou", 9).alias("mean_iou"), *[v.alias(k) for k, v in M.precision_recall(F.col("m"), F.col("g"), F.col("p")).items()])


def q_layout_by_id(spark, sf):
    pairs = M.shared_id_pairs(*_regions(spark, sf)).agg(F.count_if(F.col("status") == "matched").alias("m"), F.count_if(F.col("status") != "extra").alias("g"), F.count_if(F.col("status") != "missing").alias("p"))
    return pairs.select(F.col("m").alias("matched"), F.col("g").alias("gold_regions"), F.col("p").alias("pred_regions"), *[v.alias(k) for k, v in M.precision_recall(F.col("m"), F.col("g"), F.col("p")).items()])


def q_page_text(spark, sf):
    """Gold pages as text: regions in reading order, lines by (reading index, top of the polygon, place)."""
    df = gold(spark, sf, "regions", "reading_order")
    key = lambda r: F.coalesce(r["reading_index"], F.lit(1_000_000_000)).cast("double")
    ids = F.transform("regions", lambda r, i: F.coalesce(r["region_id"], F.concat(F.lit("region-"), i)))
    df = df.withColumn("ids", ids).withColumn("ord", reading_order("ids", "reading_order.edges", F.transform("regions", key)))

    def text(r):
        top = lambda x: F.coalesce(F.array_min(F.transform(x["polygon"], lambda p: p[1])), F.lit(0.0))
        ranked = F.transform(r["lines"], lambda x, i: F.struct(F.coalesce(x["reading_index"], F.lit(1_000_000_000)).alias("k"), top(x).alias("y"), i.alias("i"), x["text"].alias("t")))
        return F.array_join(F.transform(F.array_sort(ranked), lambda x: F.coalesce(x["t"], F.lit(""))), "\n")

    by_id = F.map_from_arrays("ids", F.transform("regions", text))
    return df.select("page_id", F.array_join(F.transform("ord", lambda i: by_id[i]), "\n\n").alias("page_text"))


def _edges(df: DataFrame) -> DataFrame:
    return df.select("page_id", F.explode("reading_order.edges").alias("e")).where("size(e) = 2").select("page_id", F.col("e")[0].alias("a"), F.col("e")[1].alias("b"))


def q_implied_edges(spark, sf):
    """The order a prediction implies: each region to the next by (reading index, place)."""
    r = pred(spark, sf, "regions").select("page_id", F.posexplode("regions").alias("p", "r"))
    w = W.partitionBy("page_id").orderBy(F.coalesce("r.reading_index", F.lit(1_000_000_000)), "p")
    return r.select("page_id", F.col("r.region_id").alias("a"), F.lead("r.region_id").over(w).alias("b")).where("b is not null")


def q_order_edges(spark, sf):
    g, p = _edges(gold(spark, sf, "reading_order")).distinct(), q_implied_edges(spark, sf).distinct()
    n = lambda d, c: d.groupBy("page_id").agg(F.count("*").alias(c))
    j = gold(spark, sf).join(n(g, "gold_edges"), "page_id", "left").join(n(p, "pred_edges"), "page_id", "left").join(n(g.join(p, ["page_id", "a", "b"]), "right_edges"), "page_id", "left").na.fill(0)
    return j.select("page_id", "gold_edges", "pred_edges", "right_edges", F.round(F.col("right_edges") / F.greatest("pred_edges", F.lit(1)), 9).alias("precision"), F.round(F.col("right_edges") / F.greatest("gold_edges", F.lit(1)), 9).alias("recall"))


def q_order_totals(spark, sf):
    """Over all pages: F1 of the edges and the share of precedences that the predicted order keeps; 1 where there is nothing to keep."""
    e = q_order_edges(spark, sf).agg(F.sum("gold_edges").alias("g"), F.sum("pred_edges").alias("p"), F.sum("right_edges").alias("m"))
    r = pred(spark, sf, "regions").select("page_id", F.posexplode("regions").alias("p", "r"))
    w = W.partitionBy("page_id").orderBy(F.coalesce("r.reading_index", F.lit(1_000_000_000)), "p")
    place = r.select("page_id", F.col("r.region_id").alias("id"), F.row_number().over(w).alias("at")).groupBy("page_id", "id").agg(F.min("at").alias("at"))
    pairs = q_precedences(spark, sf).where("a <> b").join(place.select("page_id", F.col("id").alias("a"), F.col("at").alias("pa")), ["page_id", "a"]).join(place.select("page_id", F.col("id").alias("b"), F.col("at").alias("pb")), ["page_id", "b"])
    kept = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("pa") < F.col("pb")).alias("k"))
    j = e.crossJoin(kept)  # two single rows
    return j.select(F.col("g").alias("gold_edges"), F.col("p").alias("pred_edges"), F.col("m").alias("right_edges"), M.precision_recall(F.col("m"), F.col("g"), F.col("p"))["f1"].alias("edge_f1"), F.col("n").alias("comparable"), F.col("k").alias("kept"), F.when(F.col("n") == 0, 1.0).otherwise(F.round(F.col("k") / F.col("n"), 9)).alias("pairwise_accuracy"))


def q_precedences(spark, sf):
    """Pairs of regions with a path between them: the closure of one page's graph, page by page where it lies."""
    df = gold(spark, sf, "reading_order").select("page_id", F.explode(precedence_list("reading_order.edges")).alias("e"))
    return df.select("page_id", F.col("e.a").alias("a"), F.col("e.b").alias("b"))


def q_reading_order(spark, sf):
    df = gold(spark, sf, "regions", "reading_order").withColumn("ids", F.transform("regions", lambda r, i: F.coalesce(r["region_id"], F.concat(F.lit("region-"), i))))
    keys = F.transform("regions", lambda r: F.coalesce(r["reading_index"], F.lit(1_000_000_000)).cast("double"))
    return df.select("page_id", F.array_join(reading_order("ids", "reading_order.edges", keys), ",").alias("region_order"))


def _cells(df: DataFrame) -> DataFrame:
    t = df.select("page_id", F.explode("tables").alias("t"))
    c = t.select("page_id", F.col("t.table_id").alias("table_id"), F.posexplode("t.cells").alias("k", "c"))
    keys = ["page_id", "table_id", "row_start", "row_end", "col_start", "col_end"]
    flat = c.select("page_id", "table_id", "k", "c.*")
    return flat.groupBy(*keys).agg(F.max_by("text", "k").alias("text"))  # the last of cells with one span counts


def q_table_cells(spark, sf):
    keys = ["page_id", "table_id", "row_start", "row_end", "col_start", "col_end"]
    g, p = _cells(gold(spark, sf, "tables")).withColumnRenamed("text", "gt").withColumn("g", F.lit(1)), _cells(pred(spark, sf, "tables")).withColumnRenamed("text", "pt").withColumn("p", F.lit(1))
    j = g.join(p, keys, "full").groupBy("page_id", "table_id").agg(F.count("g").alias("gold_cells"), F.count("p").alias("pred_cells"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("same_span"), F.count_if(F.col("gt").eqNullSafe(F.col("pt")) & F.col("g").isNotNull() & F.col("p").isNotNull()).alias("same_text"))
    return j.select("*", *[v.alias("span_" + k) for k, v in M.precision_recall(F.col("same_span"), F.col("gold_cells"), F.col("pred_cells")).items()])


def q_grid_slots(spark, sf):
    """Grid slots covered by each table's cells, spans opened up."""
    c = _cells(gold(spark, sf, "tables")).where("row_end > row_start and col_end > col_start")
    s = c.withColumn("r", F.explode(F.sequence("row_start", F.col("row_end") - 1))).withColumn("k", F.explode(F.sequence("col_start", F.col("col_end") - 1)))
    return s.groupBy("page_id", "table_id").agg(F.count("*").alias("n_slots"), F.count_distinct("r", "k").alias("n_distinct"))


def q_table_presence(spark, sf):
    n = lambda d, c: d.agg(F.coalesce(F.sum(F.greatest(F.coalesce(F.size("tables"), F.lit(0)), F.lit(0))), F.lit(0)).cast("long").alias(c))
    ids = lambda d: d.select("page_id", F.explode("tables").alias("t")).select("page_id", "t.table_id").distinct()
    g, p = gold(spark, sf, "tables"), pred(spark, sf, "tables")
    both = ids(g).join(ids(p), ["page_id", "table_id"]).agg(F.count("*").alias("m"))
    j = n(g, "g").crossJoin(n(p, "p")).crossJoin(both)  # three single rows
    return j.select(F.col("m").alias("matched"), F.col("g").alias("gold_tables"), F.col("p").alias("pred_tables"), *[v.alias(k) for k, v in M.precision_recall(F.col("m"), F.col("g"), F.col("p")).items()])


def _fields(df: DataFrame) -> DataFrame:
    f = df.select("page_id", F.posexplode("form_fields").alias("k", "f"))
    return f.groupBy("page_id", F.col("f.field_id").alias("field_id")).agg(F.max_by("f.value_text", "k").alias("value"))


def q_form_fields(spark, sf):
    g, p = _fields(gold(spark, sf, "form_fields")).withColumnRenamed("value", "gv").withColumn("g", F.lit(1)), _fields(pred(spark, sf, "form_fields")).withColumnRenamed("value", "pv").withColumn("p", F.lit(1))
    j = g.join(p, ["page_id", "field_id"], "full").groupBy("page_id").agg(F.count("g").alias("gold_fields"), F.count("p").alias("pred_fields"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("matched"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull() & F.col("gv").eqNullSafe(F.col("pv"))).alias("exact"))
    return j.withColumns({"precision": F.round(F.col("matched") / F.greatest("pred_fields", F.lit(1)), 9), "recall": F.round(F.col("matched") / F.greatest("gold_fields", F.lit(1)), 9)})


def q_operational(spark, sf):
    df = once(table(spark, sf, "prediction_pages", ["pred_id", "model", "timing_ms", "cost_usd", "retries", "api_failures", "status", "received_at"]), "pred_id")
    return df.groupBy(F.col("model.name").alias("model_name")).agg(
        F.count("*").alias("n_pages"),
        F.round(F.percentile("timing_ms", 0.5), 6).alias("p50_ms"),
        F.round(F.percentile("timing_ms", 0.95), 6).alias("p95_ms"),
        F.round(F.avg("timing_ms"), 6).alias("mean_ms"),
        F.round(F.count("timing_ms") / (F.sum("timing_ms") / 60000), 6).alias("pages_per_minute"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.sum("retries").alias("retries"),
        F.sum("api_failures").alias("api_failures"),
        F.count_if(F.col("status") != "ok").alias("n_not_ok"),
    )


def q_error_distribution(spark, sf):
    df = line_evals(spark, sf, ("model_name", "bag_of_words_error"))
    q = lambda x: F.round(F.percentile("bag_of_words_error", x), 9)
    return df.groupBy("model_name").agg(F.count("bag_of_words_error").alias("n"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.round(F.avg("bag_of_words_error"), 9).alias("mean"))


def q_worst_pages(spark, sf):
    """The 20 pages with the greatest mean error; ties by page id."""
    df = line_evals(spark, sf, ("page_id", "bag_of_words_error", "exact")).where("page_id is not null and bag_of_words_error is not null")
    return df.groupBy("page_id").agg(F.round(F.avg("bag_of_words_error"), 9).alias("mean_error"), F.count("*").alias("n_lines")).orderBy(F.desc("mean_error"), "page_id").limit(20)


def q_error_rows(spark, sf):
    """Lines with errors or signs a clean text has none of."""
    df = line_evals(spark, sf, ("page_id", "line_id", "bag_of_words_error", "exact", "prediction"))
    signs = F.regexp_count("prediction", F.lit("[​-‏‪-‮⁠⁦-⁩﻿�]")).cast("long")
    return df.select("eval_id", "page_id", "line_id", F.round("bag_of_words_error", 9).alias("error"), F.coalesce(signs, F.lit(0)).alias("n_signs")).where("error > 0 or n_signs > 0")


SAMPLES = 200


def q_bootstrap(spark, sf):
    """Document bootstrap: each document enters each resample a Poisson(1) number of times, drawn from a hash, so no resample is ever laid out."""
    df = line_evals(spark, sf, ("document_id", "model_name", "bag_of_words_error")).where("document_id is not null and bag_of_words_error is not null")
    docs = df.groupBy("document_id").agg(F.sum(F.round(F.col("bag_of_words_error") * 1_000_000).cast("long")).alias("e"), F.count("*").alias("n"))
    draws = docs.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(SAMPLES))))
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("sample").cast("string"), "document_id"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563]
    k = F.when(u < cuts[0], 0)
    for i, c in enumerate(cuts[1:], 1):
        k = k.when(u < c, i)
    per = draws.withColumn("k", k.otherwise(5)).groupBy("sample").agg(F.sum(F.col("k") * F.col("e")).alias("e"), F.sum(F.col("k") * F.col("n")).alias("n"))
    rate = per.where("n > 0").select((F.col("e") / F.col("n") / 1_000_000).alias("rate"))
    return rate.agg(F.count("*").alias("n_samples"), *[F.round(F.percentile("rate", x), 9).alias(c) for x, c in ((0.025, "lower"), (0.5, "median"), (0.975, "upper"))])


VARIANTS = ["clean", "blur", "jpeg", "low_contrast", "speckle", "downsample", "uneven_illumination"]


def q_variants(spark, sf):
    """Every page in every degradation variant, with a seed from the image's hash."""
    df = gold(spark, sf, "image").withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    seed = F.conv(F.substring(F.sha2(F.concat(F.coalesce("image.sha256", F.lit("")), F.lit("|"), "variant"), 256), 1, 8), 16, 10).cast("long")
    return df.select(F.concat("page_id", F.lit("::degradation::"), "variant").alias("variant_id"), F.col("page_id").alias("parent_page_id"), "variant", seed.alias("seed"), (F.col("variant") == "clean").alias("is_control"))


def q_diagnostic_rank(spark, sf):
    """Models ranked inside each track; a model without scored lines in a track comes last."""
    pages = gold(spark, sf, "track")
    df = line_evals(spark, sf, ("page_id", "model_name", "bag_of_words_error")).join(pages, "page_id")
    s = df.groupBy("track", "model_name").agg(F.round(F.avg("bag_of_words_error"), 9).alias("error"))
    w = W.partitionBy("track").orderBy(F.asc_nulls_last("error"), "model_name")
    return s.withColumn("rank", F.row_number().over(w).cast("long"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

PP = "(SELECT * FROM (SELECT * FROM prediction_pages WHERE pred_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pred_id ORDER BY received_at NULLS LAST) = 1) WHERE page_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY received_at NULLS LAST) = 1)"


def _units_sql(src: str, kind: str) -> str:
    r = f"(SELECT page_id, unnest(regions) AS r, generate_subscripts(regions, 1) AS p FROM {src})"
    if kind == "region":
        return f"(SELECT page_id, coalesce(r.region_id, 'region-' || (p - 1)) AS unit_id, p AS no, NULL AS text, list_min(list_transform(r.polygon, lambda x: x[1])) AS x1, list_min(list_transform(r.polygon, lambda x: x[2])) AS y1, list_max(list_transform(r.polygon, lambda x: x[1])) AS x2, list_max(list_transform(r.polygon, lambda x: x[2])) AS y2 FROM {r})"
    return f"(SELECT page_id, l.line_id AS unit_id, p * 100000 + q AS no, l.text AS text FROM (SELECT page_id, p, unnest(r.lines) AS l, generate_subscripts(r.lines, 1) AS q FROM {r}))"


def _ids_sql(src: str, kind: str) -> str:
    return f"(SELECT page_id, unit_id || CASE WHEN k > 0 THEN '#duplicate-' || k ELSE '' END AS unit_id, text FROM (SELECT *, row_number() OVER (PARTITION BY page_id, unit_id ORDER BY no) - 1 AS k FROM {_units_sql(src, kind)}))"


def _prf_sql(m: str, g: str, p: str, prefix: str = "") -> str:
    pr = f"(CASE WHEN {p} = 0 THEN CASE WHEN {g} = 0 THEN 1.0::DOUBLE ELSE 0.0 END ELSE {m} / {p} END)"
    rc = f"(CASE WHEN {g} = 0 THEN CASE WHEN {p} = 0 THEN 1.0::DOUBLE ELSE 0.0 END ELSE {m} / {g} END)"
    return f"round({pr}, 9) AS {prefix}precision, round({rc}, 9) AS {prefix}recall, round(CASE WHEN {pr} + {rc} = 0 THEN 0 ELSE 2 * {pr} * {rc} / ({pr} + {rc}) END, 9) AS {prefix}f1"


_OVER = f"""(SELECT g.page_id, g.unit_id AS gold_id, p.unit_id AS pred_id, round(i / (ga + pa - i), 9) AS iou FROM (SELECT g, p, (least(g.x2, p.x2) - greatest(g.x1, p.x1)) * (least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS i, (g.x2 - g.x1) * (g.y2 - g.y1) AS ga, (p.x2 - p.x1) * (p.y2 - p.y1) AS pa
  FROM {_units_sql("gold_pages", "region")} g JOIN {_units_sql(PP, "region")} p ON g.page_id = p.page_id AND g.x1 < p.x2 AND p.x1 < g.x2 AND g.y1 < p.y2 AND p.y1 < g.y2))"""
_GE = "(SELECT DISTINCT page_id, e[1] AS a, e[2] AS b FROM (SELECT page_id, unnest(reading_order.edges) AS e FROM gold_pages) WHERE len(e) = 2)"
_IE = f"(SELECT * FROM (SELECT page_id, r.region_id AS a, lead(r.region_id) OVER (PARTITION BY page_id ORDER BY coalesce(r.reading_index, 1000000000), p) AS b FROM (SELECT page_id, unnest(regions) AS r, generate_subscripts(regions, 1) AS p FROM {PP})) WHERE b IS NOT NULL)"


def _cells_sql(src: str) -> str:
    return f"(SELECT page_id, table_id, c.row_start AS row_start, c.row_end AS row_end, c.col_start AS col_start, c.col_end AS col_end, max_by(c.text, k) AS text FROM (SELECT page_id, t.table_id AS table_id, unnest(t.cells) AS c, generate_subscripts(t.cells, 1) AS k FROM (SELECT page_id, unnest(tables) AS t FROM {src})) GROUP BY ALL)"


def _fields_sql(src: str) -> str:
    return f"(SELECT page_id, f.field_id AS field_id, max_by(f.value_text, k) AS value FROM (SELECT page_id, unnest(form_fields) AS f, generate_subscripts(form_fields, 1) AS k FROM {src}) GROUP BY 1, 2)"


_U = "(('0x' || substr(sha256(sample || '|' || document_id), 1, 8))::UBIGINT::DOUBLE / 4294967296.0)"

ORACLE = {
    "q_coverage": f"SELECT count(g.page_id) AS gold_pages, count(*) FILTER (g.page_id IS NOT NULL AND p.page_id IS NOT NULL) AS matched, count(*) FILTER (p.page_id IS NULL) AS missing, count(*) FILTER (g.page_id IS NULL) AS extra FROM gold_pages g FULL JOIN {PP} p ON g.page_id = p.page_id",
    "q_line_pairs": f"""SELECT page_id, status, count(*) AS n, count(*) FILTER (gt = pt) AS n_equal FROM (SELECT coalesce(g.page_id, p.page_id) AS page_id, CASE WHEN g.page_id IS NULL THEN 'extra' WHEN p.page_id IS NULL THEN 'missing' ELSE 'matched' END AS status, g.text AS gt, p.text AS pt
      FROM {_ids_sql("gold_pages", "line")} g FULL JOIN {_ids_sql(PP, "line")} p ON g.page_id = p.page_id AND g.unit_id = p.unit_id) GROUP BY 1, 2""",
    "q_region_overlaps": f"SELECT * FROM {_OVER}",
    "q_split_merge": f"""WITH o AS (SELECT * FROM {_OVER} WHERE iou >= 0.1), g AS (SELECT page_id, count(*) AS n FROM (SELECT page_id FROM o GROUP BY page_id, gold_id HAVING count(*) > 1) GROUP BY 1), p AS (SELECT page_id, count(*) AS n FROM (SELECT page_id FROM o GROUP BY page_id, pred_id HAVING count(*) > 1) GROUP BY 1)
      SELECT coalesce(g.page_id, p.page_id) AS page_id, coalesce(g.n, 0) AS n_split, coalesce(p.n, 0) AS n_merged FROM g FULL JOIN p ON g.page_id = p.page_id""",
    "q_layout_by_id": f"""SELECT m AS matched, g AS gold_regions, p AS pred_regions, {_prf_sql("m", "g", "p")} FROM (SELECT count(*) FILTER (g.page_id IS NOT NULL AND p.page_id IS NOT NULL) AS m, count(g.page_id) AS g, count(p.page_id) AS p FROM {_ids_sql("gold_pages", "region")} g FULL JOIN {_ids_sql(PP, "region")} p ON g.page_id = p.page_id AND g.unit_id = p.unit_id)""",
    "q_implied_edges": f"SELECT * FROM {_IE}",
    "q_order_edges": f"""SELECT page_id, gold_edges, pred_edges, right_edges, round(right_edges / greatest(pred_edges, 1), 9) AS precision, round(right_edges / greatest(gold_edges, 1), 9) AS recall FROM (SELECT d.page_id, coalesce(g.n, 0) AS gold_edges, coalesce(p.n, 0) AS pred_edges, coalesce(b.n, 0) AS right_edges FROM gold_pages d
      LEFT JOIN (SELECT page_id, count(*) AS n FROM {_GE} GROUP BY 1) g USING (page_id) LEFT JOIN (SELECT page_id, count(*) AS n FROM (SELECT DISTINCT * FROM {_IE}) GROUP BY 1) p USING (page_id) LEFT JOIN (SELECT page_id, count(*) AS n FROM {_GE} JOIN (SELECT DISTINCT * FROM {_IE}) USING (page_id, a, b) GROUP BY 1) b USING (page_id))""",
    "q_order_totals": f"""WITH RECURSIVE e AS (SELECT * FROM {_GE}), c AS (SELECT * FROM e UNION SELECT c.page_id, c.a, e.b FROM c JOIN e ON c.page_id = e.page_id AND c.b = e.a),
      pl AS (SELECT page_id, id, min(place) AS place FROM (SELECT page_id, r.region_id AS id, row_number() OVER (PARTITION BY page_id ORDER BY coalesce(r.reading_index, 1000000000), p) AS place FROM (SELECT page_id, unnest(regions) AS r, generate_subscripts(regions, 1) AS p FROM {PP})) GROUP BY 1, 2),
      k AS (SELECT count(*) AS n, count(*) FILTER (x.place < y.place) AS k FROM c JOIN pl x ON x.page_id = c.page_id AND x.id = c.a JOIN pl y ON y.page_id = c.page_id AND y.id = c.b WHERE c.a <> c.b),
      i AS (SELECT DISTINCT * FROM {_IE})
      SELECT g AS gold_edges, p AS pred_edges, m AS right_edges, f1 AS edge_f1, n AS comparable, k AS kept, CASE WHEN n = 0 THEN 1.0 ELSE round(k / n, 9) END AS pairwise_accuracy FROM (SELECT *, {_prf_sql("m", "g", "p")} FROM (SELECT (SELECT count(*) FROM e) AS g, (SELECT count(*) FROM i WHERE page_id IN (SELECT page_id FROM gold_pages)) AS p, (SELECT count(*) FROM e JOIN i USING (page_id, a, b)) AS m)), k""",
    "q_precedences": f"WITH RECURSIVE e AS (SELECT * FROM {_GE}), c AS (SELECT * FROM e UNION SELECT c.page_id, c.a, e.b FROM c JOIN e ON c.page_id = e.page_id AND c.b = e.a) SELECT * FROM c",
    "q_table_cells": f"""SELECT *, {_prf_sql("same_span", "gold_cells", "pred_cells", "span_")} FROM (SELECT coalesce(g.page_id, p.page_id) AS page_id, coalesce(g.table_id, p.table_id) AS table_id, count(g.page_id) AS gold_cells, count(p.page_id) AS pred_cells, count(*) FILTER (g.page_id IS NOT NULL AND p.page_id IS NOT NULL) AS same_span, count(*) FILTER (g.page_id IS NOT NULL AND p.page_id IS NOT NULL AND g.text IS NOT DISTINCT FROM p.text) AS same_text
      FROM {_cells_sql("gold_pages")} g FULL JOIN {_cells_sql(PP)} p ON g.page_id = p.page_id AND g.table_id = p.table_id AND g.row_start = p.row_start AND g.row_end = p.row_end AND g.col_start = p.col_start AND g.col_end = p.col_end GROUP BY 1, 2)""",
    "q_grid_slots": f"SELECT page_id, table_id, count(*) AS n_slots, count(DISTINCT r * 100000 + k) AS n_distinct FROM (SELECT page_id, table_id, r, unnest(range(col_start, col_end)) AS k FROM (SELECT *, unnest(range(row_start, row_end)) AS r FROM {_cells_sql('gold_pages')})) GROUP BY 1, 2",
    "q_table_presence": f"""SELECT m AS matched, g AS gold_tables, p AS pred_tables, {_prf_sql("m", "g", "p")} FROM (SELECT (SELECT CAST(coalesce(sum(len(tables)), 0) AS BIGINT) FROM gold_pages) AS g, (SELECT CAST(coalesce(sum(len(tables)), 0) AS BIGINT) FROM {PP}) AS p,
      (SELECT count(*) FROM (SELECT DISTINCT page_id, t.table_id AS i FROM (SELECT page_id, unnest(tables) AS t FROM gold_pages)) JOIN (SELECT DISTINCT page_id, t.table_id AS i FROM (SELECT page_id, unnest(tables) AS t FROM {PP})) USING (page_id, i)) AS m)""",
    "q_form_fields": f"""SELECT *, round(matched / greatest(pred_fields, 1), 9) AS precision, round(matched / greatest(gold_fields, 1), 9) AS recall FROM (SELECT coalesce(g.page_id, p.page_id) AS page_id, count(g.page_id) AS gold_fields, count(p.page_id) AS pred_fields, count(*) FILTER (g.page_id IS NOT NULL AND p.page_id IS NOT NULL) AS matched, count(*) FILTER (g.page_id IS NOT NULL AND p.page_id IS NOT NULL AND g.value IS NOT DISTINCT FROM p.value) AS exact
      FROM {_fields_sql("gold_pages")} g FULL JOIN {_fields_sql(PP)} p ON g.page_id = p.page_id AND g.field_id = p.field_id GROUP BY 1)""",
    "q_operational": """SELECT model.name AS model_name, count(*) AS n_pages, round(quantile_cont(timing_ms, 0.5), 6) AS p50_ms, round(quantile_cont(timing_ms, 0.95), 6) AS p95_ms, round(avg(timing_ms), 6) AS mean_ms, round(count(timing_ms) / (sum(timing_ms) / 60000), 6) AS pages_per_minute, round(sum(cost_usd), 6) AS cost_usd, CAST(sum(retries) AS BIGINT) AS retries, CAST(sum(api_failures) AS BIGINT) AS api_failures, count(*) FILTER (status <> 'ok') AS n_not_ok
      FROM (SELECT * FROM prediction_pages WHERE pred_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pred_id ORDER BY received_at NULLS LAST) = 1) GROUP BY 1""",
    "q_error_distribution": f"SELECT model_name, count(bag_of_words_error) AS n, {', '.join(f'round(quantile_cont(bag_of_words_error, {x}), 9) AS p{int(x * 100)}' for x in (0.5, 0.9, 0.95, 0.99))}, round(avg(bag_of_words_error), 9) AS mean FROM {LE} GROUP BY 1",
    "q_worst_pages": f"SELECT page_id, round(avg(bag_of_words_error), 9) AS mean_error, count(*) AS n_lines FROM {LE} WHERE page_id IS NOT NULL AND bag_of_words_error IS NOT NULL GROUP BY 1 ORDER BY mean_error DESC, page_id LIMIT 20",
    "q_error_rows": f"SELECT * FROM (SELECT eval_id, page_id, line_id, round(bag_of_words_error, 9) AS error, CAST(coalesce(len(regexp_extract_all(prediction, '[​-‏‪-‮⁠⁦-⁩﻿�]')), 0) AS BIGINT) AS n_signs FROM {LE}) WHERE error > 0 OR n_signs > 0",
    "q_bootstrap": f"""WITH docs AS (SELECT document_id, sum(CAST(round(bag_of_words_error * 1000000) AS BIGINT)) AS e, count(*) AS n FROM {LE} WHERE document_id IS NOT NULL AND bag_of_words_error IS NOT NULL GROUP BY 1), d AS (SELECT *, unnest(range(1, {SAMPLES + 1})) AS sample FROM docs),
      k AS (SELECT sample, e, n, {_U} AS u FROM d), w AS (SELECT sample, e, n, CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 ELSE 5 END AS k FROM k),
      r AS (SELECT sum(k * e) / sum(k * n) / 1000000 AS rate FROM w GROUP BY sample HAVING sum(k * n) > 0) SELECT count(*) AS n_samples, round(quantile_cont(rate, 0.025), 9) AS lower, round(quantile_cont(rate, 0.5), 9) AS median, round(quantile_cont(rate, 0.975), 9) AS upper FROM r""",
    "q_variants": f"SELECT page_id || '::degradation::' || variant AS variant_id, page_id AS parent_page_id, variant, CAST(('0x' || substr(sha256(coalesce(image.sha256, '') || '|' || variant), 1, 8))::UBIGINT AS BIGINT) AS seed, variant = 'clean' AS is_control FROM (SELECT *, unnest({VARIANTS}) AS variant FROM gold_pages)",
    "q_diagnostic_rank": f"SELECT track, model_name, error, row_number() OVER (PARTITION BY track ORDER BY error NULLS LAST, model_name) AS rank FROM (SELECT track, model_name, round(avg(bag_of_words_error), 9) AS error FROM {LE} JOIN gold_pages USING (page_id) GROUP BY 1, 2)",
}
