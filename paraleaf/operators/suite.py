"""Rules around a scored suite: which pages count, limited runs, order of the final table, page validation, stress pages, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def split_filter(pages: DataFrame, track: str, split: str, diagnostic: str) -> DataFrame:
    """(track, wanted, n_kept, n_other): pages of the diagnostic track must all be ``diagnostic``, those of others all ``test``; others are violations."""
    wanted = F.when(F.col(track) == diagnostic, "diagnostic").otherwise("test")
    df = pages.withColumn("wanted", wanted)
    return df.groupBy(track, "wanted").agg(F.count_if(F.col(split) == F.col("wanted")).alias("n_kept"), F.count_if(~F.coalesce(F.col(split) == F.col("wanted"), F.lit(False))).alias("n_other"))


def limited(pages: DataFrame, key: str, n: int, parent: str | None = None) -> DataFrame:
    """The first ``n`` pages by key; with ``parent`` all pages of the first ``n`` parents, so that no control loses its children."""
    if parent is None:
        return pages.orderBy(key).limit(n)
    first = pages.where(F.col(parent).isNotNull()).select(parent).distinct().orderBy(parent).limit(n)
    return pages.join(F.broadcast(first), parent, "left_semi")  # n rows


def final_order(ranked: DataFrame, suite: str, track: str, rank: str, error: str, run: str) -> DataFrame:
    """``ranked`` (a table of runs) with ``position``: ranked ones first, then by suite, track, rank, error and run id; a missing error comes last."""
    order = W.orderBy(F.col(rank).isNull(), F.asc_nulls_last(suite), F.asc_nulls_last(track), F.asc_nulls_last(rank), F.asc_nulls_last(error), run)
    return ranked.withColumn("position", F.row_number().over(order).cast("long"))


def contract_rank(runs: DataFrame, group: list[str], error: str, second: str, run: str, fit: Column) -> DataFrame:
    """``runs`` with ``rank`` inside each contract group by (error, second, run id); runs that are not ``fit`` or lack a part of the group have none."""
    ok = fit
    for g in group:
        ok = ok & F.col(g).isNotNull()
    w = W.partitionBy(*group, F.coalesce(ok, F.lit(False))).orderBy(F.asc_nulls_last(error), F.asc_nulls_last(second), run)
    return runs.withColumn("rank", F.when(ok, F.row_number().over(w)).cast("long"))


def ngrams(tokens: Column, n: int) -> Column:
    """The runs of ``n`` tokens; fewer tokens give none."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def critical(token: Column) -> Column:
    """Whether a token holds a digit or a Latin letter."""
    return token.rlike("[0-9A-Za-z]")


def manifest(df: DataFrame) -> DataFrame:
    """(sample_id, image, text) of an image/text manifest read as JSON: ``text``, else ``label``; a record with neither has a null text."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.select(has("sample_id").alias("sample_id"), has("image").alias("image"), F.coalesce(has("text"), has("label")).alias("text"))


def stress_pages(cases: DataFrame, variants: list[str]) -> DataFrame:
    """(page_id, case_id, variant, text, language, track) of every stress case in every variant; ids must be unique, texts are brought to NFC."""
    v = F.explode(F.array(*map(F.lit, variants)))
    language = F.coalesce("language", F.when(F.col("text").rlike("[א-ת]"), "he").otherwise("und"))
    return cases.where("id is not null").select(F.col("id").alias("case_id"), X.nfc("text").alias("text"), language.alias("language"), v.alias("variant")).select(F.concat("case_id", F.lit("::"), "variant").alias("page_id"), "case_id", "variant", "text", "language", F.concat(F.lit("stress_"), "language").alias("track"))


def page_issues(pages: DataFrame) -> DataFrame:
    """(severity, code, page_id, location) of every violated rule, one row each.

    ``pages`` is (page_id, image, regions, tables, reading_order). Null arrays hold nothing to violate.
    """
    from ..functions.order import has_cycle

    base = pages.select("page_id", "image", "regions", "tables", "reading_order.edges")
    region = base.select("page_id", "image", F.posexplode("regions").alias("ri", "r")).withColumn("rid", F.coalesce("r.region_id", F.concat(F.lit("region-"), "ri")))
    line = region.select("page_id", "image", "rid", F.posexplode("r.lines").alias("li", "l")).withColumn("lid", F.coalesce("l.line_id", F.concat(F.lit("line-"), "li")))
    table = base.select("page_id", F.posexplode("tables").alias("ti", "t")).withColumn("tid", F.coalesce("t.table_id", F.concat(F.lit("table-"), "ti")))
    cell = table.select("page_id", "tid", "t.n_rows", "t.n_cols", F.posexplode("t.cells").alias("ci", "c"))
    nodes = F.transform("regions", lambda r: r["region_id"])
    outside = lambda poly: F.exists(poly, lambda p: (p[0] < 0) | (p[1] < 0) | (p[0] > F.col("image.width")) | (p[1] > F.col("image.height")))
    t = F.col("l.text")
    loc = F.concat_ws("/", "rid", "lid")

    def rule(df, code, test, location, severity="error"):
        return df.where(test).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "page_id", location.cast("string").alias("location"))

    def repeated(df, code, *keys):
        return rule(df.groupBy("page_id", *keys).agg(F.count("*").alias("_n")), code, F.col("_n") > 1, F.concat_ws("/", *keys))

    slots = cell.where("c.row_end > c.row_start and c.col_end > c.col_start").select("page_id", "tid", F.explode(F.sequence("c.row_start", F.col("c.row_end") - 1)).alias("row"), "c.col_start", "c.col_end")
    slots = slots.select("page_id", "tid", "row", F.explode(F.sequence("col_start", F.col("col_end") - 1)).alias("col"))
    rules = [
        repeated(base.select("page_id"), "duplicate_page_id"),
        repeated(region, "duplicate_region_id", "rid"),
        repeated(line, "duplicate_line_id", "lid"),
        rule(region, "polygon_out_of_bounds", outside("r.polygon"), F.col("rid")),
        rule(line, "polygon_out_of_bounds", outside("l.polygon"), loc),
        rule(region, "polygon_too_short", F.size("r.polygon").between(0, 2), F.col("rid")),
        rule(line, "polygon_too_short", F.size("l.polygon").between(0, 2), loc),
        rule(line, "text_not_nfc", t != X.nfc("l.text"), loc),
        rule(line, "bidi_control", t.rlike(f"[{X.BIDI_CONTROLS}]"), loc),
        rule(line, "presentation_form", t.rlike(f"[{X.PRESENTATION}]"), loc),
        rule(line, "dangling_mark", X.dangling_marks("l.text") > 0, loc),
        rule(line, "hebrew_line_not_rtl", t.rlike("[א-ת]") & (F.col("l.base_direction") != "rtl"), loc),
        rule(base.select("page_id", nodes.alias("n"), F.explode(F.flatten("edges")).alias("e")), "unknown_node", ~F.coalesce(F.array_contains("n", F.col("e")), F.lit(False)), F.col("e")),
        rule(base.select("page_id", "edges"), "cycle", has_cycle("edges"), F.lit("reading_order")),
        rule(cell, "cell_out_of_bounds", F.expr("c.row_end > n_rows or c.col_end > n_cols or c.row_start < 0 or c.col_start < 0 or c.row_end <= c.row_start or c.col_end <= c.col_start"), F.concat_ws("/", "tid", "ci")),
        repeated(slots, "overlapping_cells", "tid", "row", "col"),
        rule(base, "missing_image_hash", F.expr("image.sha256 is null"), F.lit("image"), "warning"),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out
