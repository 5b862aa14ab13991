"""Round trips of the sources: gold pages written in a format and read back, so that the SQL is the table itself."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from .functions.text import word_list
from .operators import admission as D
from .operators import tables as TB
from .operators.layout_text import visual_lines
from .queries_pages import _IE, PP, gold, pred, q_implied_edges
from .queries_text import WORDS
from .sources import pages as S


def _xml(c):
    c = F.coalesce(c, F.lit(""))
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def _points(c):
    return F.array_join(F.transform(c, lambda p: F.concat(p[0].cast("string"), F.lit(","), p[1].cast("string"))), " ")


def _parsed(df, parse):
    """(page_id, region_id, line_id, text, n_points) of one XML text per row."""

    def run(batches):
        for batch in batches:
            out = []
            for page, xml in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for r in parse(xml.encode())["regions"]:
                    out += [(page, r["region_id"], x["line_id"], x["text"], len(x["polygon"])) for x in r["lines"]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(),) * 4 + (pa.int32(),), strict=True)], names=["page_id", "region_id", "line_id", "text", "n_points"])

    return df.mapInArrow(run, "page_id string, region_id string, line_id string, text string, n_points int")


def q_source_pagexml(spark, sf):
    line = lambda x: F.concat(F.lit('<TextLine id="'), _xml(x["line_id"]), F.lit('"><Coords points="'), _points(x["polygon"]), F.lit('"/><TextEquiv><Unicode>'), _xml(x["text"]), F.lit("</Unicode></TextEquiv></TextLine>"))
    region = lambda r: F.concat(F.lit('<TextRegion id="'), _xml(r["region_id"]), F.lit('">'), F.array_join(F.transform(r["lines"], line), ""), F.lit("</TextRegion>"))
    xml = F.concat(F.lit('<PcGts xmlns="x"><Page imageFilename="i" imageWidth="1" imageHeight="1">'), F.array_join(F.transform("regions", region), ""), F.lit("</Page></PcGts>"))
    return _parsed(gold(spark, sf, "regions").select("page_id", xml.alias("xml")), S.pagexml)


def q_source_alto(spark, sf):
    words = lambda t: F.array_join(F.transform(word_list(t), lambda w: F.concat(F.lit('<String CONTENT="'), _xml(w), F.lit('"/>'))), "<SP/>")
    line = lambda x: F.concat(F.lit('<TextLine ID="'), _xml(x["line_id"]), F.lit('"><Shape><Polygon POINTS="'), _points(x["polygon"]), F.lit('"/></Shape>'), words(F.coalesce(x["text"], F.lit(""))), F.lit("</TextLine>"))
    block = lambda r: F.concat(F.lit('<TextBlock ID="'), _xml(r["region_id"]), F.lit('">'), F.array_join(F.transform(r["lines"], line), ""), F.lit("</TextBlock>"))
    xml = F.concat(F.lit('<alto xmlns="x"><Layout><Page WIDTH="1" HEIGHT="1"><PrintSpace>'), F.array_join(F.transform("regions", block), ""), F.lit("</PrintSpace></Page></Layout></alto>"))
    return _parsed(gold(spark, sf, "regions").select("page_id", xml.alias("xml")), S.alto)


def q_source_tsv(spark, sf):
    """Words of gold lines as a recogniser's table, put together again."""
    rows = gold(spark, sf, "regions").select("page_id", F.posexplode("regions").alias("b", "r")).select("page_id", "b", F.posexplode("r.lines").alias("l", "x")).select("page_id", "b", "l", F.posexplode(word_list("x.text")).alias("k", "w"))
    one = lambda c: c.cast("int")
    tsv = rows.select("page_id", F.lit(5).alias("level"), F.lit(1).alias("page_num"), one(F.col("b")).alias("block_num"), F.lit(1).alias("par_num"), one(F.col("l")).alias("line_num"), one(F.col("k")).alias("word_num"), one(F.col("k") * 10).alias("left"), F.lit(1).alias("top"), F.lit(8).alias("width"), F.lit(5).alias("height"), F.lit(90.0).alias("conf"), F.col("w").alias("text"))
    return S.recogniser_tsv(tsv, ["page_id"]).select("page_id", "block_num", "line_num", "text", "x1", "x2")


def q_source_jsonl(spark, sf):
    """Line records written as JSON lines and read with the fixed schema."""
    lines = gold(spark, sf, "regions").select("page_id", F.explode("regions").alias("r")).select("page_id", F.explode("r.lines").alias("l"))
    text = lines.select(F.to_json(F.struct("page_id", F.col("l.line_id").alias("line_id"), F.col("l.text").alias("text"))).alias("j"))
    return text.select(F.from_json("j", "page_id string, line_id string, text string").alias("r")).select("r.*")


def q_source_points(spark, sf):
    r = gold(spark, sf, "regions").select("page_id", F.explode("regions").alias("r"))
    pts = S.point_column(_points(F.col("r.polygon")))
    return r.select("page_id", F.col("r.region_id").alias("region_id"), F.size(pts).cast("long").alias("n"), F.aggregate(pts, F.lit(0.0), lambda a, p: a + p[0] + p[1]).alias("total"))


def q_source_html(spark, sf):
    """Tables of gold pages as HTML with spans, cells placed again on the grid."""
    t = gold(spark, sf, "tables").select("page_id", F.explode("tables").alias("t"))
    cell = lambda c: F.concat(F.lit('<td rowspan="'), (c["row_end"] - c["row_start"]).cast("string"), F.lit('" colspan="'), (c["col_end"] - c["col_start"]).cast("string"), F.lit('">'), _xml(c["text"]), F.lit("</td>"))
    row = lambda i: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.array_sort(F.filter("t.cells", lambda c: c["row_start"] == i), lambda a, b: (a["col_start"] - b["col_start"]).cast("int")), cell), ""), F.lit("</tr>"))
    html = F.concat(F.lit('<div data-label="table"><table>'), F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.col("t.n_rows") - 1, F.lit(0))), row), ""), F.lit("</table></div>"))

    def run(batches):
        for batch in batches:
            out = [(p, i, *c) for p, i, h in zip(*[c.to_pylist() for c in batch.columns], strict=True) for b in S.html_blocks(h) for c in b["cells"]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(),) * 2 + (pa.int32(),) * 4 + (pa.string(),), strict=True)], names=["page_id", "table_id", "row_start", "row_end", "col_start", "col_end", "text"])

    return t.select("page_id", "t.table_id", html.alias("h")).mapInArrow(run, "page_id string, table_id string, row_start int, row_end int, col_start int, col_end int, text string")


def q_table_metrics(spark, sf):
    return TB.table_metrics(gold(spark, sf, "tables"), pred(spark, sf, "tables"))


def q_visual_lines(spark, sf):
    """Lines of predicted pages as word boxes along their box, clustered into rows and put in reading order."""
    r = pred(spark, sf, "regions").select("page_id", F.explode("regions").alias("r")).select("page_id", F.explode("r.lines").alias("l")).where("size(l.polygon) >= 3")
    xs, ys = F.transform("l.polygon", lambda p: p[0]), F.transform("l.polygon", lambda p: p[1])
    boxes = r.groupBy("page_id").agg(F.collect_list(F.struct(F.col("l.text").alias("text"), F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))).alias("w"))
    return boxes.select("page_id", F.size(visual_lines("w")).cast("long").alias("n_rows"))


def q_recomputed(spark, sf):
    """Counters per model computed line by line and from distinct pairs times their count, compared row by row: no rows if they agree."""
    from .functions import align as A
    from .queries_text import QUERIES as T
    from .queries_text import line_evals

    first = T["q_line_error_rates"](spark, sf).select("model_name", *A.COUNTERS)
    pairs = line_evals(spark, sf, ("model_name", "reference", "prediction")).groupBy("model_name", "reference", "prediction").agg(F.count("*").alias("k"))
    pairs = pairs.withColumn("a", A.aligned_text("reference", "prediction"))
    return D.same_rows(first, pairs.groupBy("model_name").agg(*[F.sum(F.col("k") * F.col("a")[c]).alias(c) for c in A.COUNTERS]))


def q_text_agreement(spark, sf):
    """How far prediction and reference agree as two extractions of one line, per model; all three floors must hold."""
    from .operators.agreement import text_agreement
    from .queries_text import line_evals

    df = line_evals(spark, sf, ("model_name", "reference", "prediction")).withColumn("a", text_agreement("reference", "prediction"))
    fit = (F.col("a.content") >= 0.985) & (F.col("a.order") >= 0.8) & (F.col("a.punctuation") >= 0.9)
    return df.groupBy("model_name").agg(F.round(F.avg("a.content"), 9).alias("content"), F.round(F.avg("a.order"), 9).alias("order"), F.round(F.avg("a.punctuation"), 9).alias("punctuation"), F.count_if(fit).alias("n_fit"))


def q_remapped_edges(spark, sf):
    """Implied prediction edges in gold ids, nodes matched by their shared region id."""
    from .operators.agreement import remapped_edges

    nodes = pred(spark, sf, "regions").select("page_id", F.explode("regions").alias("r")).select("page_id", F.col("r.region_id").alias("node")).distinct()
    held = gold(spark, sf, "regions").select("page_id", F.explode("regions").alias("r")).select("page_id", F.col("r.region_id").alias("node"), F.col("r.region_id").alias("gold_id")).distinct()
    return remapped_edges(q_implied_edges(spark, sf), nodes, held)


def q_participant_pack(spark, sf):
    """The participants' view of gold pages and whether anything in it gives gold away."""
    from .operators.packs import given_away, participant_pack
    from .queries_corpus import KEY

    pack = participant_pack(gold(spark, sf, "regions"), KEY)
    bad = given_away(pack).agg(F.count("*").alias("n_given_away"))
    return pack.agg(F.count("*").alias("n_pages"), F.sum(F.size("layout")).alias("n_regions")).crossJoin(bad)  # single rows


def q_mapped_back(spark, sf):
    """A submission under public ids carried back to page ids, and what is wrong with its ids."""
    from .operators.corpus import hmac_id
    from .operators.packs import id_map, map_back
    from .queries_corpus import KEY

    submission = pred(spark, sf).select(hmac_id(KEY, "page", F.col("page_id")).alias("public_id"))
    rows, problems = map_back(submission, id_map(gold(spark, sf), KEY))
    return rows.select(F.lit("mapped").alias("state")).unionByName(problems.select(F.col("problem").alias("state"))).groupBy("state").agg(F.count("*").alias("n"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_") and k != "q_implied_edges"}

_L = "(SELECT page_id, region_id, b, unnest(lines) AS l, generate_subscripts(lines, 1) AS k FROM (SELECT page_id, r.region_id AS region_id, r.lines AS lines, b FROM (SELECT page_id, unnest(regions) AS r, generate_subscripts(regions, 1) AS b FROM gold_pages)))"
ORACLE = {
    "q_source_pagexml": f"SELECT page_id, region_id, l.line_id AS line_id, nfc_normalize(coalesce(l.text, '')) AS text, CAST(coalesce(len(l.polygon), 0) AS INTEGER) AS n_points FROM {_L}",
    "q_source_alto": f"SELECT page_id, region_id, l.line_id AS line_id, nfc_normalize(array_to_string({WORDS.format('coalesce(l.text, ' + chr(39) * 2 + ')')}, ' ')) AS text, CAST(coalesce(len(l.polygon), 0) AS INTEGER) AS n_points FROM {_L}",
    "q_source_tsv": f"""SELECT page_id, CAST(b - 1 AS INTEGER) AS block_num, CAST(k - 1 AS INTEGER) AS line_num, array_to_string(w, ' ') AS text, 0 AS x1, CAST((len(w) - 1) * 10 + 8 AS INTEGER) AS x2 FROM (SELECT *, {WORDS.format("l.text")} AS w FROM {_L}) WHERE len(w) > 0""",
    "q_source_jsonl": f"SELECT page_id, l.line_id AS line_id, l.text AS text FROM {_L}",
    "q_source_points": "SELECT page_id, r.region_id AS region_id, len(r.polygon) AS n, list_sum(list_transform(r.polygon, lambda p: p[1] + p[2])) AS total FROM (SELECT page_id, unnest(regions) AS r FROM gold_pages)",
    "q_source_html": "SELECT page_id, table_id, c.row_start AS row_start, c.row_end AS row_end, c.col_start AS col_start, c.col_end AS col_end, nfc_normalize(trim(c.text)) AS text FROM (SELECT page_id, t.table_id AS table_id, unnest(t.cells) AS c FROM (SELECT page_id, unnest(tables) AS t FROM gold_pages))",
    "q_remapped_edges": f"""WITH g AS (SELECT DISTINCT page_id, r.region_id AS n FROM (SELECT page_id, unnest(regions) AS r FROM gold_pages)), p AS (SELECT DISTINCT page_id, r.region_id AS n FROM (SELECT page_id, unnest(regions) AS r FROM {PP}) WHERE r.region_id IS NOT NULL),
      m AS (SELECT page_id, p.n, g.n AS gid, row_number() OVER (PARTITION BY page_id, g.n IS NULL ORDER BY p.n) - 1 AS k FROM p LEFT JOIN g USING (page_id, n)), x AS (SELECT page_id, n, coalesce(gid, '__prediction_unmatched__:' || k || ':' || n) AS name FROM m)
      SELECT e.page_id, a.name AS a, b.name AS b FROM {_IE} e JOIN x a ON e.page_id = a.page_id AND e.a = a.n JOIN x b ON e.page_id = b.page_id AND e.b = b.n""",
    "q_participant_pack": "SELECT count(*) AS n_pages, CAST(sum(len(regions)) AS BIGINT) AS n_regions, 0::BIGINT AS n_given_away FROM gold_pages",
    "q_mapped_back": f"SELECT state, count(*) AS n FROM (SELECT CASE WHEN g.page_id IS NULL THEN 'unknown' WHEN p.page_id IS NULL THEN 'missing' ELSE 'mapped' END AS state FROM gold_pages g FULL JOIN {PP} p ON g.page_id = p.page_id) GROUP BY 1",
}
