"""Joining predicted to gold units of a page: by shared id, by overlap, and what stays over.

Pages are the unit of work: gold and predicted units are shuffled once on page_id and met in one co-grouped pass; a page
has few units, so no group grows with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import assign, bounds, box_iou, polygon_iou

#: Least overlap of a match.
LINE_IOU, REGION_IOU, SPLIT_IOU = 0.30, 0.50, 0.10


def units(pages: DataFrame, kind: str) -> DataFrame:
    """(page_id, unit_id, unit_no, type, text, polygon) of a page's regions or lines; missing region ids become region-<i>."""
    r = pages.select("page_id", F.posexplode("regions").alias("p", "r"))
    rid = F.coalesce("r.region_id", F.concat(F.lit("region-"), "p"))
    if kind == "region":
        return r.select("page_id", rid.alias("unit_id"), F.col("p").alias("unit_no"), F.col("r.type").alias("type"), F.lit(None).cast("string").alias("text"), F.col("r.polygon").alias("polygon"))
    r = r.select("page_id", rid.alias("rid"), "p", F.posexplode("r.lines").alias("q", "l"))
    no = F.row_number().over(W.partitionBy("page_id").orderBy("p", "q")) - 1
    return r.select("page_id", F.col("l.line_id").alias("unit_id"), no.alias("unit_no"), F.col("rid").alias("type"), F.col("l.text").alias("text"), F.col("l.polygon").alias("polygon"))


def first_ids(u: DataFrame) -> DataFrame:
    """Of units with one id only the first keeps it; the rest become id#duplicate-<i>."""
    k = F.row_number().over(W.partitionBy("page_id", "unit_id").orderBy("unit_no")) - 1
    return u.withColumn("_k", k).withColumn("unit_id", F.when(F.col("_k") > 0, F.concat("unit_id", F.lit("#duplicate-"), "_k")).otherwise(F.col("unit_id"))).drop("_k")


def shared_id_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(page_id, unit_id, gold_text, pred_text, status), full outer: matched, missing or extra."""
    g = first_ids(gold).select("page_id", "unit_id", F.col("text").alias("gold_text"), F.lit(1).alias("_g"))
    p = first_ids(pred).select("page_id", "unit_id", F.col("text").alias("pred_text"), F.lit(1).alias("_p"))
    status = F.when(F.col("_g").isNull(), "extra").when(F.col("_p").isNull(), "missing").otherwise("matched")
    return g.join(p, ["page_id", "unit_id"], "full").withColumn("status", status).drop("_g", "_p")


def overlapping(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(page_id, gold_id, pred_id, iou) of all units whose boxes overlap: an equi-join on the page with the overlap as further condition."""
    b = lambda u, s: u.select("page_id", F.col("unit_id").alias(f"{s}_id"), *[v.alias(f"{s}_{k}") for k, v in bounds(F.col("polygon")).items()])
    g, p = b(gold, "gold"), b(pred, "pred")
    box = lambda s: {k: F.col(f"{s}_{k}") for k in ("x1", "y1", "x2", "y2")}
    j = g.join(p, "page_id").where("gold_x1 < pred_x2 and pred_x1 < gold_x2 and gold_y1 < pred_y2 and pred_y1 < gold_y2")
    return j.select("page_id", "gold_id", "pred_id", F.round(box_iou(box("gold"), box("pred")), 9).alias("iou"))


def matched_units(gold: DataFrame, pred: DataFrame, least: float, by_id: bool = False) -> DataFrame:
    """(page_id, gold_no, pred_no, iou, status): the assignment with the greatest total overlap, kept from ``least`` on, and what stays over.

    With ``by_id`` units of equal id are matched first (iou 1). The threshold comes after the assignment.
    Pages with units on one side only give missing or extra rows; null or short polygons overlap nothing.
    """

    def run(g, p):
        gn, pn = g.column("unit_no").to_pylist(), p.column("unit_no").to_pylist()
        gp, pp = g.column("polygon").to_pylist(), p.column("polygon").to_pylist()
        page = (g if len(gn) else p).column("page_id")[0].as_py()
        rows, left_g, left_p = [], list(range(len(gn))), list(range(len(pn)))
        if by_id:
            at: dict = {}
            for j, x in enumerate(p.column("unit_id").to_pylist()):
                at.setdefault(x, j)
            for i, x in enumerate(g.column("unit_id").to_pylist()):
                if x is not None and x in at and at[x] in left_p:
                    j = at.pop(x)
                    rows.append((page, gn[i], pn[j], 1.0, "matched"))
                    left_g.remove(i)
                    left_p.remove(j)
        score = np.array([[polygon_iou(gp[i], pp[j]) for j in left_p] for i in left_g]).reshape(len(left_g), len(left_p))
        done_g, done_p = set(), set()
        for a, b in assign(score):
            if score[a, b] >= least:
                rows.append((page, gn[left_g[a]], pn[left_p[b]], round(float(score[a, b]), 9), "matched"))
                done_g.add(left_g[a])
                done_p.add(left_p[b])
        rows += [(page, gn[i], None, None, "missing") for i in left_g if i not in done_g]
        rows += [(page, None, pn[j], None, "extra") for j in left_p if j not in done_p]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string()), strict=True)], names=["page_id", "gold_no", "pred_no", "iou", "status"])

    pick = lambda u: u.select("page_id", "unit_id", F.col("unit_no").cast("int").alias("unit_no"), "polygon")
    return pick(gold).groupBy("page_id").cogroup(pick(pred).groupBy("page_id")).applyInArrow(run, "page_id string, gold_no int, pred_no int, iou double, status string")


def split_merge(pairs: DataFrame, least: float = SPLIT_IOU) -> DataFrame:
    """(page_id, n_split, n_merged): gold units that overlap several predicted ones, and the other way round."""
    near = pairs.where(F.col("iou") >= least)
    g = near.groupBy("page_id", "gold_id").count().where("count > 1").groupBy("page_id").agg(F.count("*").alias("n_split"))
    p = near.groupBy("page_id", "pred_id").count().where("count > 1").groupBy("page_id").agg(F.count("*").alias("n_merged"))
    return g.join(p, "page_id", "full").select("page_id", F.coalesce("n_split", F.lit(0)).alias("n_split"), F.coalesce("n_merged", F.lit(0)).alias("n_merged"))


def precision_recall(matched, gold, pred) -> dict[str, object]:
    """P, R and F1; both sides empty give 1."""
    p = F.when(pred == 0, F.when(gold == 0, 1.0).otherwise(0.0)).otherwise(matched / pred)
    r = F.when(gold == 0, F.when(pred == 0, 1.0).otherwise(0.0)).otherwise(matched / gold)
    return {"precision": F.round(p, 9), "recall": F.round(r, 9), "f1": F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 9)}
