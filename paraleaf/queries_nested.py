"""Queries of problem 4 (nested records), part of the core."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators.nested import LEVELS, page_tables, structural_tables, subtype_table, write_structural_tables
from .plans.shared import new_path, once, table


def p4_found(spark, sf):
    raw = table(spark, sf, "raw_predictions", ["raw_id", "payload", "received_at"])
    return structural_tables(raw, "point").select("raw_id", "page_id", "region_id", "line_id", "point_no")


def _level(level):
    return lambda spark, sf: structural_tables(table(spark, sf, "raw_predictions", ["raw_id", "payload", "received_at"]), level)


def p4_subtypes(spark, sf):
    """The typed subtype tables: rows and parents of each, from tables written in one pass over the payloads."""
    folder = new_path(spark, "structural")
    write_structural_tables(table(spark, sf, "raw_predictions", ["raw_id", "payload", "received_at"]), folder)
    found = None
    for level in LEVELS:
        one = subtype_table(spark, folder, level).groupBy(F.lit(level).alias("level"), "subtype").agg(F.count("*").alias("n_rows"), F.count_distinct("raw_id").alias("n_payloads"))
        found = one if found is None else found.unionByName(one)
    return found


def _typed(level):
    return lambda spark, sf: page_tables(once(table(spark, sf, "prediction_pages", ["pred_id", "page_id", "regions", "received_at"]), "pred_id"), level)


QUERIES = {
    "p4_found": p4_found,
    "p4_raw_pages": _level("page"),
    "p4_raw_regions": _level("region"),
    "p4_raw_lines": _level("line"),
    "p4_raw_points": _level("point"),
    "p4_raw_region_points": _level("region_point"),
    "p4_raw_words": _level("word"),
    "p4_raw_tags": _level("tag"),
    "p4_raw_fields": _level("field"),
    "p4_subtypes": p4_subtypes,
    "p4_prediction_regions": _typed("region"),
    "p4_prediction_lines": _typed("line"),
    "p4_prediction_points": _typed("point"),
}

_ONCE = "(SELECT * FROM prediction_pages WHERE pred_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pred_id ORDER BY received_at NULLS LAST) = 1)"
_REGIONS = f"(SELECT pred_id, page_id, unnest(regions) AS r, generate_subscripts(regions, 1) AS p FROM {_ONCE})"
_LINES = f"(SELECT pred_id, page_id, r.region_id AS region_id, unnest(r.lines) AS l, generate_subscripts(r.lines, 1) AS q FROM {_REGIONS})"

ORACLE = {
    "p4_prediction_regions": f"SELECT pred_id AS page_key, page_id, CAST(p AS INTEGER) AS region_no, r.region_id AS region_id, r.type AS region_type, r.reading_index AS reading_index, CAST(coalesce(len(r.lines), 0) AS INTEGER) AS n_lines FROM {_REGIONS}",
    "p4_prediction_lines": f"SELECT pred_id AS page_key, page_id, region_id, CAST(q AS INTEGER) AS line_no, l.line_id AS line_id, l.text AS text, l.reading_index AS reading_index FROM {_LINES}",
    "p4_prediction_points": f"""SELECT page_key, page_id, region_id, line_id, CAST(k AS INTEGER) AS point_no, xy[1] AS x, xy[2] AS y FROM (
        SELECT pred_id AS page_key, page_id, region_id, l.line_id AS line_id, unnest(l.polygon) AS xy, generate_subscripts(l.polygon, 1) AS k FROM {_LINES} WHERE len(l.polygon) > 0
        UNION ALL SELECT pred_id, page_id, region_id, l.line_id, NULL, 0 FROM {_LINES} WHERE coalesce(len(l.polygon), 0) = 0)""",
}
