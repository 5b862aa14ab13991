"""The queries of the training-data problems and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.shared import once, table, written
from .abuse import abuse_scores
from .canonical import canonical_columns, canonical_sql, same_look
from .group_splits import NOT_KNOWN, plain_split, stratified_splits, torn_groups
from .leakage import leaks
from .near_duplicates import linked_members, near_duplicate_pairs
from .packing import fill_windows, token_counts, window_report
from .split_overlap import overlap_counts, overlapping_pairs


def _heads(spark, sf):
    return once(table(spark, sf, "page_evidence", ["evidence_id", "text_head", "received_at"]), "evidence_id")


def p1_found(spark, sf):
    return near_duplicate_pairs(_heads(spark, sf), "evidence_id", "text_head", 0.6, 12).withColumnsRenamed({"a": "evidence_id_a", "b": "evidence_id_b"})


def p1_classes(spark, sf):
    return linked_members(_heads(spark, sf), "evidence_id", "text_head", 0.6, 12)


def _records(spark, sf):
    contexts = table(spark, sf, "conversion_contexts", ["context_id", "split", "source_id"]).dropDuplicates(["context_id"])
    items = once(table(spark, sf, "samples", ["item_no", "context_id", "text", "received_at"]), "item_no").join(contexts, "context_id")
    items = items.select(F.concat(F.lit("item:"), "item_no").alias("name"), plain_split(F.col("split")).alias("split"), F.col("source_id").alias("source"), "text")
    gold = table(spark, sf, "gold_pages").select("page_id", "split", F.col("metadata.source_collection").alias("source")).dropDuplicates(["page_id"])
    lines = F.flatten(F.transform("regions", lambda r: F.coalesce(F.transform(r["lines"], lambda x: F.struct(x["line_id"].alias("line_id"), x["text"].alias("text"))), F.array()))).alias("lines")
    pages = once(table(spark, sf, "prediction_pages").select("pred_id", "page_id", "received_at", lines), "pred_id").join(gold, "page_id")
    rows = pages.select("pred_id", "split", "source", F.explode("lines").alias("l")).where("length(l.text) >= 27")
    rows = rows.select(F.concat(F.lit("page:"), "pred_id", F.lit("#"), "l.line_id").alias("name"), plain_split(F.col("split")).alias("split"), "source", F.col("l.text").alias("text"))
    return items.unionByName(rows).where("name is not null").dropDuplicates(["name"])


def p2_found(spark, sf):
    return overlapping_pairs(_records(spark, sf), 0.88, 80)


def p2_counts(spark, sf):
    return overlap_counts(_records(spark, sf), 0.88, 80)


RELATED = ["writer", "source_doc", "entity"]


def _samples(spark, sf, *more):
    rows = once(table(spark, sf, "samples", ["item_no", "context_id", *RELATED, *more, "received_at"]), "item_no")
    contexts = table(spark, sf, "conversion_contexts", ["context_id", "split", "track"]).dropDuplicates(["context_id"])
    return rows.join(contexts, "context_id", "left").withColumn("split", plain_split(F.col("split")))


def p3_found(spark, sf):
    return torn_groups(_samples(spark, sf), "item_no", RELATED, "split")


def p3_new_splits(spark, sf):
    records = _samples(spark, sf, "metadata").withColumn("profile", F.try_element_at("metadata", F.lit("profile")))
    return stratified_splits(records, "item_no", RELATED, ["track", "profile"], {"train": 0.8, "dev": 0.1, "test": 0.1})


def p5_found(spark, sf):
    return same_look(table(spark, sf, "line_evals", ["eval_id", "reference", "prediction"]), "eval_id", "reference", "prediction")


def p5_line_forms(spark, sf):
    rows = once(table(spark, sf, "line_evals", ["eval_id", "reference", "prediction", "received_at"]), "eval_id")
    return canonical_columns(rows.select("eval_id", "reference", "prediction"), ["reference", "prediction"])


def _page_lines(pages, key):
    """(key, region_no, region_id, line_no, line_id, text) of every line; numbers count from 1 in the order given."""
    lines = pages.select(key, F.posexplode("regions").alias("r", "region")).select(key, (F.col("r") + 1).alias("region_no"), F.col("region.region_id").alias("region_id"), F.posexplode("region.lines").alias("l", "line"))
    return lines.select(key, "region_no", "region_id", (F.col("l") + 1).alias("line_no"), F.col("line.line_id").alias("line_id"), F.col("line.text").alias("text"))


def p5_page_line_forms(spark, sf):
    """The lines of all prediction pages (by pred_id) and gold pages (by page_id)."""
    pages = once(table(spark, sf, "prediction_pages", ["pred_id", "regions", "received_at"]), "pred_id")
    gold = table(spark, sf, "gold_pages", ["page_id", "regions"]).where("page_id is not null").dropDuplicates(["page_id"])
    none = F.lit(None)
    rows = _page_lines(pages, "pred_id").withColumn("page_id", none.cast(gold.schema["page_id"].dataType)).unionByName(_page_lines(gold, "page_id").withColumn("pred_id", none.cast(pages.schema["pred_id"].dataType)))
    rows = rows.select(F.when(F.col("pred_id").isNull(), "gold").otherwise("prediction").alias("side"), "pred_id", "page_id", "region_no", "region_id", "line_no", "line_id", "text")
    return canonical_columns(rows, ["text"])


def p7_leaks(spark, sf):
    return leaks(table(spark, sf, "documents", ["doc_id", "text"]), table(spark, sf, "eval_passages", ["passage_no", "text"]), "doc_id", "text", "passage_no", "text")


def p7_found(spark, sf):
    return p7_leaks(spark, sf).select("doc_id", "passage_no")


def p7_items(spark, sf):
    found = p7_found(spark, sf).groupBy("passage_no").agg(F.count("*").alias("n_documents"))
    return table(spark, sf, "eval_passages", ["passage_no", "item_id", "split", "source_id"]).join(found, "passage_no")


def p6_windows(spark, sf):
    counts = written(token_counts(table(spark, sf, "documents", ["doc_id", "text"]), "doc_id", "text"), "tokens")
    return fill_windows(counts, table(spark, sf, "context_windows"))


def p6_filled_share(spark, sf):
    return window_report(p6_windows(spark, sf), table(spark, sf, "context_windows"))


def _abuse(spark, sf, keep=None):
    return abuse_scores(table(spark, sf, "documents", ["doc_id", "text", *(keep or [])]), table(spark, sf, "review_labels", ["doc_id", "label"]), "doc_id", "text", keep)


def p8_found(spark, sf):
    return _abuse(spark, sf).where("abusive").select("doc_id")


def p8_scores(spark, sf):
    return _abuse(spark, sf)


def p8_source_rates(spark, sf):
    scored = _abuse(spark, sf, ["source"])
    return scored.groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if("abusive").alias("n_abusive"), F.round(F.avg(F.col("abusive").cast("double")), 6).alias("rate"))


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p3_found": p3_found,
    "p3_new_splits": p3_new_splits,
    "p5_found": p5_found,
    "p5_line_forms": p5_line_forms,
    "p5_page_line_forms": p5_page_line_forms,
    "p6_windows": p6_windows,
    "p6_filled_share": p6_filled_share,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_source_rates": p8_source_rates,
}

#: Sets of (word, occurrence) of the heads with at least 12 words, by all pairs; no blocks, maps or classes.
_HEADS = """e AS (SELECT evidence_id AS id, text_head FROM page_evidence WHERE evidence_id IS NOT NULL AND text_head IS NOT NULL QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY received_at NULLS LAST) = 1),
  t AS (SELECT id, w, row_number() OVER (PARTITION BY id, w) AS k FROM (SELECT id, unnest(list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(text_head)), '[\\p{M}]', '', 'g'), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM e)),
  s AS (SELECT id, count(*) AS n, string_agg(w || ' ' || k, '|' ORDER BY w, k) AS sig FROM t GROUP BY 1 HAVING count(*) >= 12),
  u AS (SELECT t.* FROM t SEMI JOIN s ON t.id = s.id),
  p AS (SELECT x, y FROM (SELECT a.id AS x, b.id AS y, count(*) AS c FROM u a JOIN u b ON a.w = b.w AND a.k = b.k AND a.id < b.id GROUP BY 1, 2) JOIN s sx ON sx.id = x JOIN s sy ON sy.id = y WHERE c * 10 >= 6 * (sx.n + sy.n - c))"""


def _plain_id_sql(c: str) -> str:
    x = f"nullif(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-'), '')"
    return f"(CASE WHEN {x} NOT IN ({', '.join(repr(v) for v in NOT_KNOWN)}) THEN '{c}:' || {x} END)"


#: Groups by the closure of the relation "has a value in common with the least sample of the value".
_GROUPS = f"""ctx AS (SELECT context_id, any_value(CASE WHEN s = 'training' THEN 'train' WHEN s IN ('validation', 'valid') THEN 'dev' WHEN s <> '' THEN s END) AS split FROM (SELECT context_id, lower(trim(regexp_replace(split, '\\s+', ' ', 'g'))) AS s FROM conversion_contexts) GROUP BY 1),
  r AS (SELECT item_no, x.split AS split, writer, source_doc, entity FROM (SELECT * FROM samples WHERE item_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_no ORDER BY received_at NULLS LAST) = 1) s LEFT JOIN ctx x ON s.context_id = x.context_id),
  v AS (SELECT * FROM (SELECT item_no, unnest([{", ".join(map(_plain_id_sql, RELATED))}]) AS v FROM r) WHERE v IS NOT NULL),
  e AS (SELECT DISTINCT v.item_no AS a, m AS b FROM v JOIN (SELECT v, min(item_no) AS m FROM v GROUP BY 1) USING (v) WHERE item_no <> m),
  s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  c AS (SELECT item_no AS x, item_no AS g FROM r UNION SELECT s.a, c.g FROM c JOIN s ON c.x = s.b),
  m AS (SELECT x, min(g) AS g FROM c GROUP BY 1)"""

ORACLE = {
    "p1_found": f"WITH {_HEADS} SELECT x AS evidence_id_a, y AS evidence_id_b FROM p",
    "p1_classes": f"""WITH {_HEADS}, q AS (SELECT id, min(id) OVER (PARTITION BY sig) AS r, count(*) OVER (PARTITION BY sig) AS k FROM s),
      l AS (SELECT DISTINCT a.r AS x, b.r AS y FROM p JOIN q a ON a.id = p.x JOIN q b ON b.id = p.y WHERE a.r <> b.r), d AS (SELECT x, count(DISTINCT y) AS n FROM (SELECT x, y FROM l UNION SELECT y, x FROM l) GROUP BY 1)
      SELECT id, r AS class_id, k AS n_copies, coalesce(n, 0) AS n_links FROM q LEFT JOIN d ON d.x = q.r""",
    "p3_found": f"WITH RECURSIVE {_GROUPS} SELECT x AS item_no, g AS group_no FROM m WHERE g IN (SELECT g FROM m JOIN r ON r.item_no = m.x WHERE r.split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT r.split) > 1)",
    "p5_found": f"SELECT DISTINCT eval_id FROM line_evals WHERE reference <> prediction AND eval_id IS NOT NULL AND {canonical_sql('reference')} = {canonical_sql('prediction')}",
}
