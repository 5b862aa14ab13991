"""Queries of the corpus side: splits, leaks, statistics, rules, projections, hashes, selection, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as X
from .operators import corpus as C
from .plans.shared import once, table
from .queries_pages import gold, pred

RATIOS = {"train": 0.8, "dev": 0.1, "test": 0.1}
KEY = "paraleaf-example-key"


def split_name(c: str):
    x = F.lower(F.trim(F.col(c)))
    return F.when(x == "training", "train").when(x.isin("validation", "valid"), "dev").when(x != "", x)


def samples(spark, sf, *columns) -> DataFrame:
    rows = once(table(spark, sf, "samples", ["item_no", "context_id", *columns, "received_at"]), "item_no")
    contexts = table(spark, sf, "conversion_contexts", ["context_id", "split", "source_id", "license_expression"]).dropDuplicates(["context_id"])
    return rows.join(contexts, "context_id", "left").withColumn("split", split_name("split"))


def q_split_hash(spark, sf):
    return gold(spark, sf, "document_id").select("page_id", "document_id", C.hash_split(F.col("document_id"), RATIOS, 7).alias("new_split"))


def q_shards(spark, sf):
    return gold(spark, sf, "document_id").select("document_id").distinct().select("document_id", C.shard(F.col("document_id"), 16).alias("shard"))


def q_opaque_ids(spark, sf):
    return gold(spark, sf).select("page_id", C.hmac_id(KEY, "page", F.col("page_id")).alias("public_id"))


def q_remap(spark, sf):
    """Public ids mapped back; unknown and missing ones counted."""
    ids = q_opaque_ids(spark, sf)
    back = pred(spark, sf).select("page_id", C.hmac_id(KEY, "page", F.col("page_id")).alias("public_id")).select("public_id")
    j = ids.withColumn("g", F.lit(1)).join(back.withColumn("p", F.lit(1)), "public_id", "full")
    return j.agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("mapped"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("g").isNull()).alias("unknown"))


def q_split_leaks(spark, sf):
    return C.split_leaks(samples(spark, sf, "writer", "source_doc", "image_sha256"), "split", ["writer", "source_doc", "image_sha256"])


def q_exact_duplicates(spark, sf):
    df = samples(spark, sf, "text").where("text is not null and trim(text) <> '' and split is not null")
    g = df.groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.count_distinct("split").alias("n_splits"), F.min("item_no").alias("first_item"))
    return g.where("n > 1")


def q_near_duplicates(spark, sf):
    return C.audit_near_duplicates(samples(spark, sf, "text"), "item_no", "text", "split")


def q_corpus_stats(spark, sf):
    df = gold(spark, sf, "document_id", "regions")
    line = F.flatten(F.transform("regions", lambda r: F.coalesce(r["lines"], F.array())))
    rows = df.select("page_id", "document_id", F.size("regions").alias("n_regions"), F.explode_outer(line).alias("l"))
    per = rows.select("page_id", "document_id", "n_regions", F.when(F.col("l").isNotNull(), 1).alias("l"), F.length("l.text").alias("chars"), F.size(X.graphemes("l.text")).alias("g"), F.size(X.word_list("l.text")).alias("w"), F.regexp_count("l.text", F.lit("[א-ת]")).alias("h"), F.regexp_count("l.text", F.lit(f"[{X.HEBREW_MARKS}]")).alias("m"))
    pages = per.groupBy("page_id", "document_id").agg(F.first("n_regions").alias("r"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("l", "chars", "g", "w", "h", "m")])
    s = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n)
    return pages.agg(F.count("*").alias("pages"), F.count_distinct("document_id").alias("documents"), s("r", "regions"), s("l", "lines"), s("chars", "code_points"), s("g", "graphemes"), s("w", "words"), s("h", "hebrew_letters"), s("m", "marks"))


def q_histograms(spark, sf):
    """Pages per value of each catalogued field, in one pass."""
    df = gold(spark, sf, "split", "track", "metadata").withColumn("split", split_name("split"))
    kinds = {"split": "split", "track": "track", "source": "metadata.source_collection", "style": "metadata.script_style", "vocalization": "metadata.vocalization"}
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).alias("value")) for k, c in kinds.items()])
    return df.select(F.explode(fields).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n_pages"))


def q_validation(spark, sf):
    """Rule violations as one long table: (code, page_id, n)."""
    df = gold(spark, sf, "image", "regions", "tables", "reading_order", "split")
    lines = df.select("page_id", "image", F.explode("regions").alias("r")).select("page_id", "image", F.explode("r.lines").alias("l"))
    per = lambda d, code: d.groupBy("page_id").agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "page_id", "n")
    outside = F.exists("l.polygon", lambda p: (p[0] < 0) | (p[1] < 0) | (p[0] > F.col("image.width")) | (p[1] > F.col("image.height")))
    nodes = F.transform("regions", lambda r: r["region_id"])
    bad_node = df.select("page_id", nodes.alias("n"), F.explode(F.flatten("reading_order.edges")).alias("e")).where(~F.array_contains("n", F.col("e")))
    cells = df.select("page_id", F.explode("tables").alias("t")).select("page_id", "t.n_rows", "t.n_cols", F.explode("t.cells").alias("c"))
    dup = lines.groupBy("page_id", "l.line_id").agg(F.count("*").alias("k")).where("k > 1")
    rules = [
        per(lines.where(outside), "polygon_out_of_bounds"),
        per(lines.where(F.col("l.text").rlike(f"[{X.BIDI_CONTROLS}]")), "bidi_control_in_gold"),
        per(lines.where(F.col("l.text").rlike(f"[{X.PRESENTATION}]")), "hebrew_presentation_form"),
        per(lines.where(F.col("l.text").rlike("[א-ת]") & (F.col("l.base_direction") != "rtl")), "hebrew_line_not_rtl"),
        per(bad_node, "reading_order_unknown_node"),
        per(cells.where("c.row_end > n_rows or c.col_end > n_cols or c.row_start < 0 or c.col_start < 0"), "table_cell_out_of_bounds"),
        per(dup, "duplicate_line_id"),
        per(df.where("image.sha256 is null"), "missing_image_hash"),
        per(df.where(~F.coalesce(split_name("split"), F.lit("")).isin("train", "dev", "test", "diagnostic")), "schema"),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def q_certification(spark, sf):
    """Checks of a release, one row each, and whether all passed."""
    pages = gold(spark, sf, "split", "metadata", "image")
    a = pages.agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("d"), F.count_if(F.col("image.sha256").isNull()).alias("nohash"), F.count_if(F.col("metadata.license").isNull()).alias("nolicense"), F.count_if(split_name("split").isNull()).alias("nosplit"))
    checks = [("has_pages", F.col("n") > 0), ("unique_pages", F.col("n") == F.col("d")), ("image_hashes", F.col("nohash") == 0), ("licenses", F.col("nolicense") == 0), ("splits", F.col("nosplit") == 0)]
    whole = F.lit(True)
    for _, p in checks:
        whole = whole & p
    rows = F.array(*[F.struct(F.lit(k).alias("check"), p.alias("passed")) for k, p in [*checks, ("certified", whole)]])
    return a.select(F.explode(rows).alias("c")).select("c.check", "c.passed")


def q_page_candidates(spark, sf):
    """The best three pages of each document: tables first, then forms, mixed direction, both, Hebrew, early pages."""
    df = once(table(spark, sf, "page_evidence", ["evidence_id", "document_id", "page_number", "table_count", "form_signal", "mixed_bidi", "hebrew_letter_ratio", "received_at"]), "evidence_id").where("document_id is not null")
    b = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    t, f = b(F.col("table_count") > 0), b(F.col("form_signal") > 0)
    w = W.partitionBy("document_id").orderBy(F.desc(t), F.desc(f), F.desc(b(F.col("mixed_bidi"))), F.desc(t + f), F.desc_nulls_last("hebrew_letter_ratio"), F.asc_nulls_last("page_number"), "evidence_id")
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("document_id", "evidence_id", "page_number", "rank")


def q_page_evidence(spark, sf):
    """Pages fit for the corpus: enough Hebrew, usable, known template family."""
    df = once(table(spark, sf, "page_evidence", ["evidence_id", "character_count", "hebrew_letter_ratio", "usable", "template_family", "received_at"]), "evidence_id")
    ok = (F.col("character_count") * F.col("hebrew_letter_ratio") >= 120) & (F.col("hebrew_letter_ratio") >= 0.5) & F.col("usable")
    return df.groupBy("template_family").agg(F.count("*").alias("n_pages"), F.count_if(ok).alias("n_fit"))


def q_quota(spark, sf):
    df = once(table(spark, sf, "page_evidence", ["evidence_id", "template_family", "table_count", "form_signal", "received_at"]), "evidence_id").where("template_family is not null").select("evidence_id", "template_family", F.coalesce("table_count", F.lit(0)).cast("long").alias("tables"), F.coalesce("form_signal", F.lit(0)).cast("long").alias("forms"), F.lit(1).cast("long").alias("pages"))
    return C.greedy_quota(df, "evidence_id", "template_family", 3, {"pages": 100, "tables": 30, "forms": 30})


def q_template_family(spark, sf):
    """A family id from the normalised head, page size and font set."""
    df = once(table(spark, sf, "page_evidence", ["evidence_id", "text_head", "width", "height", "fonts", "received_at"]), "evidence_id").where("text_head is not null")
    head = F.array_join(F.slice(X.word_list(F.regexp_replace("text_head", "[0-9]", "#")), 1, 20), " ")
    fonts = F.array_join(F.array_sort(F.array_distinct(F.coalesce("fonts", F.array().cast("array<string>")))), ",")
    size = F.concat(F.coalesce(F.round("width", 1).cast("decimal(18,1)").cast("string"), F.lit("")), F.lit("x"), F.coalesce(F.round("height", 1).cast("decimal(18,1)").cast("string"), F.lit("")))
    return df.select("evidence_id", F.substring(F.sha2(F.concat(head, F.lit("|"), size, F.lit("|"), fonts), 256), 1, 16).alias("family"))


def q_safe_names(spark, sf):
    """Stable page names: document token, short hash, page token."""
    token = lambda c: F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return gold(spark, sf, "document_id").select("page_id", F.concat(token("document_id"), F.lit("--"), F.substring(F.sha2("page_id", 256), 1, 12), F.lit("--"), token("page_id")).alias("name"))


def q_line_crops(spark, sf):
    """Each line as a page of its own: its box widened by 2 and clipped to the image."""
    df = gold(spark, sf, "image", "regions").select("page_id", "image", F.explode("regions").alias("r")).select("page_id", "image", "r.region_id", F.explode("r.lines").alias("l")).where("size(l.polygon) >= 3")
    xs, ys = F.transform("l.polygon", lambda p: p[0]), F.transform("l.polygon", lambda p: p[1])
    x1, y1 = F.greatest(F.lit(0), F.floor(F.array_min(xs)) - 2), F.greatest(F.lit(0), F.floor(F.array_min(ys)) - 2)
    x2, y2 = F.least(F.col("image.width").cast("long"), F.ceil(F.array_max(xs)) + 2), F.least(F.col("image.height").cast("long"), F.ceil(F.array_max(ys)) + 2)
    return df.select("page_id", "region_id", F.col("l.line_id").alias("line_id"), x1.cast("long").alias("x1"), y1.cast("long").alias("y1"), x2.alias("x2"), y2.alias("y2"))


def q_table_pages(spark, sf):
    return gold(spark, sf, "tables", "split").where("size(tables) > 0").select("page_id", F.lit("test").alias("split"), split_name("split").alias("source_split"), F.size("tables").cast("long").alias("n_tables"))


def q_blind(spark, sf):
    """What a participant sees: ids, sizes and layout, no text; and the count of texts left in it, which is 0."""
    df = gold(spark, sf, "image", "regions")
    layout = F.transform("regions", lambda r: F.struct(r["region_id"].alias("region_id"), F.transform(r["lines"], lambda x: F.struct(x["line_id"].alias("line_id"))).alias("lines")))
    blind = df.select("page_id", F.col("image.path").alias("path"), layout.alias("layout"))
    return blind.select("page_id", F.size("layout").cast("long").alias("n_regions"), F.to_json("layout").contains('"text"').alias("has_text"))


def q_id_reuse(spark, sf):
    """Pages whose prediction carries ids of the gold page's regions."""
    ids = lambda d: d.select("page_id", F.explode("regions").alias("r")).select("page_id", "r.region_id").distinct()
    return ids(pred(spark, sf, "regions")).join(ids(gold(spark, sf, "regions")), ["page_id", "region_id"], "left_semi").groupBy("page_id").agg(F.count("*").alias("n_reused"))


def q_membership(spark, sf):
    """Sources registered but unused, and used but not registered."""
    reg = table(spark, sf, "source_registry", ["source_id"]).distinct()
    used = table(spark, sf, "documents", ["source"]).where("source is not null").select(F.col("source").alias("source_id")).distinct()
    a = reg.join(used, "source_id", "left_anti").withColumn("problem", F.lit("unused"))
    b = used.join(reg, "source_id", "left_anti").withColumn("problem", F.lit("not_registered"))
    return a.unionByName(b)


def q_selection_hash(spark, sf):
    """One hash over the (page, image hash) list of each track, built as a tree: rows by eight digits of their hash, and each level by one digit less."""
    df = gold(spark, sf, "track", "image").select("track", F.sha2(F.concat_ws("|", "page_id", F.coalesce("image.sha256", F.lit(""))), 256).alias("h"))
    for digits in range(8, -1, -1):  # a group holds sixteen nodes, or the few rows that agree in eight digits
        df = df.groupBy("track", F.substring("h" if digits == 8 else "b", 1, digits).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "|"), 256).alias("h"))
    return df.select("track", F.col("h").alias("fingerprint"))


def q_row_hash(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")), 256).alias("row_hash"))


def q_union_sorted(spark, sf):
    """Gold and predicted page ids as one list, each once, with where they stand."""
    g, p = gold(spark, sf).select("page_id", F.lit("gold").alias("side")), pred(spark, sf).select("page_id", F.lit("prediction").alias("side"))
    return g.unionByName(p).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("side")), "+").alias("sides"))


def q_repaired_text(spark, sf):
    """Whole texts repaired, and the tokens of every line joined again."""
    df = table(spark, sf, "documents", ["doc_id", "text"]).where("text is not null")
    repaired = df.select("doc_id", C.repair_pdf_text(F.col("text")).alias("text"))
    return repaired.select("doc_id", F.sha2("text", 256).alias("repaired_sha"), C.smart_lines("text").alias("joined"))


# What speaks for a form on a page; word ends are where no letter, digit or underscore stands.
_END, _START = r"($|[^\p{L}\p{N}_])", r"(^|[^\p{L}\p{N}_])"
FORM_SIGNS = {
    "form_word": f"{_START}טופס{_END}",
    "name_label": f"{_START}שם(\\s+מלא)?\\s*[:：]",
    "date_label": f"{_START}תאריך\\s*[:：]",
    "signature_word": f"{_START}חתימה",
    "identifier_label": f"{_START}מספר\\s+(זהות|תיק|בקשה){_END}",
    "underscore_run": "_{3,}",
}


def q_evidence_flags(spark, sf):
    """Capability flags of documents' texts: mixed direction, and how many of six form signs they hold."""
    df = table(spark, sf, "documents", ["doc_id", "text"]).where("text is not null")
    signs = [F.col("text").rlike(p).cast("long") for p in FORM_SIGNS.values()]
    return df.select("doc_id", (F.col("text").rlike("[א-ת]") & F.col("text").rlike("[A-Za-z0-9]")).alias("mixed"), sum(signs[1:], signs[0]).alias("form_signal"))


def q_text_accept(spark, sf):
    """Which text layers are taken: four Hebrew letters at least, two fifths of the letters Hebrew, no cantillation, direction controls or unusable code points."""
    df = table(spark, sf, "documents", ["doc_id", "text"]).where("text is not null")
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    df = df.select("doc_id", n("[א-ת]").alias("hebrew"), n(r"\p{L}").alias("letters"), n("[\u0591-\u05af]").alias("cantillation"), n("[\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]").alias("controls"), n(r"[\p{Co}\p{Cf}]").alias("unusable"))
    ratio = F.col("hebrew") / F.greatest("letters", F.lit(1))
    ok = (F.col("hebrew") >= 4) & (ratio >= 0.40) & (F.col("cantillation") == 0) & (F.col("controls") == 0) & (F.col("unusable") == 0)
    return df.select("doc_id", "hebrew", "letters", "cantillation", "controls", "unusable", ok.alias("accepted"))


def q_repair_counts(spark, sf):
    df = table(spark, sf, "documents", ["doc_id", "text"]).where("text is not null")
    return df.select("doc_id", *[v.alias(k) for k, v in C.repair_counts(F.col("text")).items()])


def q_clean_lines(spark, sf):
    """Prediction lines with their region's direction and language filled in where their own is missing."""
    df = pred(spark, sf, "regions").select("page_id", F.explode("regions").alias("r")).select("page_id", F.col("r.region_id").alias("region_id"), F.explode("r.lines").alias("l"), F.col("r.base_direction").alias("rd"), F.col("r.language").alias("rl"))
    return df.select("page_id", "region_id", F.col("l.line_id").alias("line_id"), F.coalesce("l.base_direction", "rd", F.lit("auto")).alias("direction"), F.coalesce("l.language", "rl", F.lit("und")).alias("language"))


def q_stream_counts(spark, sf):
    """Events per type and hour, counted by a stream over the table's files and then by key over its state; the same as in one batch."""
    from .streaming.incremental import event_counts

    return event_counts(spark, sf)


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_CTX = "(SELECT context_id, CASE WHEN s = 'training' THEN 'train' WHEN s IN ('validation', 'valid') THEN 'dev' WHEN s <> '' THEN s END AS split FROM (SELECT context_id, lower(trim(split)) AS s FROM conversion_contexts))"
_SMP = f"(SELECT s.*, c.split FROM (SELECT * FROM samples WHERE item_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_no ORDER BY received_at NULLS LAST) = 1) s LEFT JOIN {_CTX} c ON s.context_id = c.context_id)"
_SPLIT = "CASE WHEN lower(trim(split)) = 'training' THEN 'train' WHEN lower(trim(split)) IN ('validation', 'valid') THEN 'dev' WHEN trim(split) <> '' THEN lower(trim(split)) END"
_EV = "(SELECT * FROM page_evidence WHERE evidence_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY received_at NULLS LAST) = 1)"
_UNIT = "(('0x' || substr(sha256('" + C.SPLIT_SALT + "|7|' || document_id), 1, 8))::UBIGINT::DOUBLE / 4294967296.0)"
_GL = "(SELECT page_id, image, l FROM (SELECT page_id, image, unnest(r.lines) AS l FROM (SELECT page_id, image, unnest(regions) AS r FROM gold_pages)))"
from .queries_pages import PP  # noqa: E402
from .queries_text import WORDS  # noqa: E402

_IPAD = bytes(b ^ 0x36 for b in KEY.encode().ljust(64, b"\0")).hex()
_OPAD = bytes(b ^ 0x5C for b in KEY.encode().ljust(64, b"\0")).hex()
_HMAC = f"substr(sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode('page|' || page_id)))), 1, 24)"
_BOOL = lambda c: f"CAST(coalesce({c}, false) AS INTEGER)"

_TREE = "(SELECT track, sha256(page_id || '|' || coalesce(image.sha256, '')) AS h, sha256(page_id || '|' || coalesce(image.sha256, '')) AS b FROM gold_pages)"
for _n in range(8, -1, -1):
    _TREE = f"(SELECT track, substr(b, 1, {_n}) AS b, sha256(string_agg(h, '|' ORDER BY h)) AS h FROM {_TREE} GROUP BY track, substr(b, 1, {_n}))"
_TEXT_SIGNS = {"hebrew": "[א-ת]", "letters": "\\p{L}", "cantillation": "[\u0591-\u05af]", "controls": "[\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]", "unusable": "[\\p{Co}\\p{Cf}]"}

ORACLE = {
    "q_split_hash": f"SELECT page_id, document_id, CASE WHEN {_UNIT} < 0.8 THEN 'train' WHEN {_UNIT} < 0.9 THEN 'dev' ELSE 'test' END AS new_split FROM gold_pages",
    "q_shards": "SELECT document_id, CAST(('0x' || substr(sha256(document_id), 1, 8))::UBIGINT % 16 AS BIGINT) AS shard FROM (SELECT DISTINCT document_id FROM gold_pages)",
    "q_opaque_ids": f"SELECT page_id, {_HMAC} AS public_id FROM gold_pages",
    "q_remap": f"SELECT count(*) FILTER (g.page_id IS NOT NULL AND p.page_id IS NOT NULL) AS mapped, count(*) FILTER (p.page_id IS NULL) AS missing, count(*) FILTER (g.page_id IS NULL) AS unknown FROM gold_pages g FULL JOIN {PP} p ON g.page_id = p.page_id",
    "q_split_leaks": f"""SELECT field, value, CAST(sum(n) AS BIGINT) AS n_rows, string_agg(split, ',' ORDER BY split) AS splits FROM (SELECT x.field AS field, x.value AS value, split, count(*) AS n FROM (SELECT split, unnest([{{'field': 'writer', 'value': writer}}, {{'field': 'source_doc', 'value': source_doc}}, {{'field': 'image_sha256', 'value': image_sha256}}]) AS x FROM {_SMP} WHERE split IS NOT NULL)
      WHERE trim(x.value) <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) > 1""",
    "q_exact_duplicates": f"SELECT sha256(text) AS sha, count(*) AS n, count(DISTINCT split) AS n_splits, min(item_no) AS first_item FROM {_SMP} WHERE text IS NOT NULL AND trim(text) <> '' AND split IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "q_corpus_stats": f"""SELECT (SELECT count(*) FROM gold_pages) AS pages, (SELECT count(DISTINCT document_id) FROM gold_pages) AS documents, (SELECT CAST(sum(len(regions)) AS BIGINT) FROM gold_pages) AS regions, count(*) AS lines, CAST(coalesce(sum(length(l.text)), 0) AS BIGINT) AS code_points, CAST(coalesce(sum(length_grapheme(l.text)), 0) AS BIGINT) AS graphemes, CAST(coalesce(sum(len({WORDS.format("l.text")})), 0) AS BIGINT) AS words,
      CAST(coalesce(sum(len(regexp_extract_all(l.text, '[א-ת]'))), 0) AS BIGINT) AS hebrew_letters, CAST(coalesce(sum(len(regexp_extract_all(l.text, '[{X.HEBREW_MARKS}]'))), 0) AS BIGINT) AS marks FROM {_GL}""",
    "q_histograms": f"SELECT x.field AS field, x.value AS value, count(*) AS n_pages FROM (SELECT unnest([{{'field': 'split', 'value': {_SPLIT}}}, {{'field': 'track', 'value': track}}, {{'field': 'source', 'value': metadata.source_collection}}, {{'field': 'style', 'value': metadata.script_style}}, {{'field': 'vocalization', 'value': metadata.vocalization}}]) AS x FROM gold_pages) GROUP BY 1, 2",
    "q_validation": f"""SELECT 'polygon_out_of_bounds' AS code, page_id, count(*) AS n FROM {_GL} WHERE len(list_filter(l.polygon, lambda p: p[1] < 0 OR p[2] < 0 OR p[1] > image.width OR p[2] > image.height)) > 0 GROUP BY 2
      UNION ALL SELECT 'bidi_control_in_gold', page_id, count(*) FROM {_GL} WHERE regexp_matches(l.text, '[{X.BIDI_CONTROLS}]') GROUP BY 2 UNION ALL SELECT 'hebrew_presentation_form', page_id, count(*) FROM {_GL} WHERE regexp_matches(l.text, '[{X.PRESENTATION}]') GROUP BY 2
      UNION ALL SELECT 'hebrew_line_not_rtl', page_id, count(*) FROM {_GL} WHERE regexp_matches(l.text, '[א-ת]') AND l.base_direction <> 'rtl' GROUP BY 2
      UNION ALL SELECT 'reading_order_unknown_node', page_id, count(*) FROM (SELECT page_id, list_transform(regions, lambda r: r.region_id) AS n, unnest(flatten(reading_order.edges)) AS e FROM gold_pages) WHERE NOT list_contains(n, e) GROUP BY 2
      UNION ALL SELECT 'table_cell_out_of_bounds', page_id, count(*) FROM (SELECT page_id, t.n_rows AS r, t.n_cols AS k, unnest(t.cells) AS c FROM (SELECT page_id, unnest(tables) AS t FROM gold_pages)) WHERE c.row_end > r OR c.col_end > k OR c.row_start < 0 OR c.col_start < 0 GROUP BY 2
      UNION ALL SELECT 'duplicate_line_id', page_id, count(*) FROM (SELECT page_id, l.line_id FROM {_GL} GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 2 UNION ALL SELECT 'missing_image_hash', page_id, count(*) FROM gold_pages WHERE image.sha256 IS NULL GROUP BY 2
      UNION ALL SELECT 'schema', page_id, count(*) FROM gold_pages WHERE coalesce({_SPLIT}, '') NOT IN ('train', 'dev', 'test', 'diagnostic') GROUP BY 2""",
    "q_certification": f"""SELECT unnest(['has_pages', 'unique_pages', 'image_hashes', 'licenses', 'splits', 'certified']) AS "check", unnest([n > 0, n = d, h = 0, l = 0, s = 0, n > 0 AND n = d AND h = 0 AND l = 0 AND s = 0]) AS passed FROM (SELECT count(*) AS n, count(DISTINCT page_id) AS d, count(*) FILTER (image.sha256 IS NULL) AS h, count(*) FILTER (metadata.license IS NULL) AS l, count(*) FILTER ({_SPLIT} IS NULL) AS s FROM gold_pages)""",
    "q_page_candidates": f"""SELECT document_id, evidence_id, page_number, rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY {_BOOL("table_count > 0")} DESC, {_BOOL("form_signal > 0")} DESC, {_BOOL("mixed_bidi")} DESC, {_BOOL("table_count > 0")} + {_BOOL("form_signal > 0")} DESC, hebrew_letter_ratio DESC NULLS LAST, page_number NULLS LAST, evidence_id) AS rank FROM {_EV} WHERE document_id IS NOT NULL) WHERE rank <= 3""",
    "q_page_evidence": f"SELECT template_family, count(*) AS n_pages, count(*) FILTER (character_count * hebrew_letter_ratio >= 120 AND hebrew_letter_ratio >= 0.5 AND usable) AS n_fit FROM {_EV} GROUP BY 1",
    "q_quota": f"""SELECT evidence_id, template_family, tables, forms, pages FROM (SELECT *, sum(pages) OVER w AS rp, sum(tables) OVER w AS rt, sum(forms) OVER w AS rf FROM (SELECT evidence_id, template_family, CAST(coalesce(table_count, 0) AS BIGINT) AS tables, CAST(coalesce(form_signal, 0) AS BIGINT) AS forms, 1::BIGINT AS pages FROM {_EV} WHERE template_family IS NOT NULL QUALIFY row_number() OVER (PARTITION BY template_family ORDER BY evidence_id) <= 3) WINDOW w AS (ORDER BY evidence_id ROWS UNBOUNDED PRECEDING))
      WHERE NOT (rp - pages >= 100 AND rt - tables >= 30 AND rf - forms >= 30)""",
    "q_template_family": f"SELECT evidence_id, substr(sha256(array_to_string(({WORDS.format(chr(39) + chr(39))} || {WORDS.format('regexp_replace(text_head, ' + chr(39) + '[0-9]' + chr(39) + ', ' + chr(39) + '#' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')})[1:20], ' ') || '|' || coalesce(CAST(CAST(round(width, 1) AS DECIMAL(18, 1)) AS VARCHAR), '') || 'x' || coalesce(CAST(CAST(round(height, 1) AS DECIMAL(18, 1)) AS VARCHAR), '') || '|' || array_to_string(list_sort(list_distinct(coalesce(fonts, []))), ',')), 1, 16) AS family FROM {_EV} WHERE text_head IS NOT NULL",
    "q_safe_names": "SELECT page_id, regexp_replace(regexp_replace(document_id, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') || '--' || substr(sha256(page_id), 1, 12) || '--' || regexp_replace(regexp_replace(page_id, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS name FROM gold_pages",
    "q_line_crops": """SELECT page_id, region_id, l.line_id AS line_id, CAST(greatest(0, floor(list_min(xs)) - 2) AS BIGINT) AS x1, CAST(greatest(0, floor(list_min(ys)) - 2) AS BIGINT) AS y1, CAST(least(image.width, ceil(list_max(xs)) + 2) AS BIGINT) AS x2, CAST(least(image.height, ceil(list_max(ys)) + 2) AS BIGINT) AS y2
      FROM (SELECT *, list_transform(l.polygon, lambda p: p[1]) AS xs, list_transform(l.polygon, lambda p: p[2]) AS ys FROM (SELECT page_id, image, r.region_id AS region_id, unnest(r.lines) AS l FROM (SELECT page_id, image, unnest(regions) AS r FROM gold_pages)) WHERE len(l.polygon) >= 3)""",
    "q_table_pages": f"SELECT page_id, 'test' AS split, {_SPLIT} AS source_split, len(tables) AS n_tables FROM gold_pages WHERE len(tables) > 0",
    "q_blind": "SELECT page_id, len(regions) AS n_regions, false AS has_text FROM gold_pages",
    "q_id_reuse": f"SELECT page_id, count(*) AS n_reused FROM (SELECT DISTINCT page_id, r.region_id AS i FROM (SELECT page_id, unnest(regions) AS r FROM {PP})) JOIN (SELECT DISTINCT page_id, r.region_id AS i FROM (SELECT page_id, unnest(regions) AS r FROM gold_pages)) USING (page_id, i) GROUP BY 1",
    "q_membership": "SELECT source_id, 'unused' AS problem FROM (SELECT DISTINCT source_id FROM source_registry WHERE source_id NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)) UNION ALL SELECT DISTINCT source, 'not_registered' FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source_id FROM source_registry WHERE source_id IS NOT NULL)",
    "q_selection_hash": f"SELECT track, h AS fingerprint FROM {_TREE}",
    "q_row_hash": "SELECT n_nationkey, sha256(n_nationkey || '|' || n_name || '|' || n_regionkey) AS row_hash FROM nation",
    "q_union_sorted": f"SELECT page_id, string_agg(side, '+' ORDER BY side) AS sides FROM (SELECT DISTINCT page_id, 'gold' AS side FROM gold_pages UNION SELECT DISTINCT page_id, 'prediction' FROM {PP}) GROUP BY 1",
    "q_evidence_flags": f"SELECT doc_id, regexp_matches(text, '[א-ת]') AND regexp_matches(text, '[A-Za-z0-9]') AS mixed, CAST({' + '.join(f"regexp_matches(text, '{p}')::INTEGER" for p in FORM_SIGNS.values())} AS BIGINT) AS form_signal FROM documents WHERE text IS NOT NULL",
    "q_text_accept": f"SELECT *, hebrew >= 4 AND hebrew / greatest(letters, 1) >= 0.40 AND cantillation = 0 AND controls = 0 AND unusable = 0 AS accepted FROM (SELECT doc_id, {', '.join(f"CAST(len(regexp_extract_all(text, '{v}')) AS BIGINT) AS {k}" for k, v in _TEXT_SIGNS.items())} FROM documents WHERE text IS NOT NULL)",
    "q_clean_lines": f"SELECT page_id, region_id, l.line_id AS line_id, coalesce(l.base_direction, rd, 'auto') AS direction, coalesce(l.language, rl, 'und') AS language FROM (SELECT page_id, r.region_id AS region_id, unnest(r.lines) AS l, r.base_direction AS rd, r.language AS rl FROM (SELECT page_id, unnest(regions) AS r FROM {PP}))",
    "q_stream_counts": "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(CAST(round(value * 100) AS BIGINT)) / 100, 2) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
}
