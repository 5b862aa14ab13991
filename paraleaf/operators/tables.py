"""Tables: similarity, assignment and metrics per table. A page's tables meet in one co-grouped pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.align import align
from ..functions.geometry import assign, polygon_iou

#: Least similarity of a table match.
LEAST = 0.45


def _spans(t: dict) -> dict[tuple, str]:
    return {(c["row_start"], c["row_end"], c["col_start"], c["col_end"]): c["text"] or "" for c in t["cells"] or []}


def _near(a: int | None, b: int | None) -> float:
    a, b = a or 0, b or 0
    return max(0.0, 1 - abs(a - b) / max(1, a, b))


def _f1(a: set, b: set) -> tuple[float, float, float]:
    if not a and not b:
        return 1.0, 1.0, 1.0
    both = len(a & b)
    p, r = (both / len(b) if b else 0.0), (both / len(a) if a else 0.0)
    return p, r, (2 * p * r / (p + r) if p + r else 0.0)


def slots(spans: dict[tuple, str]) -> dict[tuple[int, int], tuple]:
    """The grid slots each span covers."""
    return {(r, c): s for s in spans for r in range(s[0] or 0, s[1] or 0) for c in range(s[2] or 0, s[3] or 0)}


def structure(a: dict, b: dict) -> float:
    """Mean of row count, column count and span agreement."""
    return (_near(a["n_rows"], b["n_rows"]) + _near(a["n_cols"], b["n_cols"]) + _f1(set(_spans(a)), set(_spans(b)))[2]) / 3


def content(a: dict, b: dict) -> float:
    """One less the edit rate of the cells' texts in order."""
    x, y = ("\n".join(t for _, t in sorted(_spans(v).items())) for v in (a, b))
    n, m, s, d, i, c = align(x, y)
    edits = s + d + i
    return 1.0 if not edits else 1 - edits / max(1, edits + c)


def similarity(a: dict, b: dict) -> float:
    """With both outlines: 0 without overlap, else 0.8 overlap and 0.2 structure; otherwise 0.85 structure and 0.15 content."""
    if a["polygon"] and b["polygon"]:
        iou = polygon_iou(a["polygon"], b["polygon"])
        return 0.8 * iou + 0.2 * structure(a, b) if iou > 0 else 0.0
    return 0.85 * structure(a, b) + 0.15 * content(a, b)


_NONE = {"n_rows": 0, "n_cols": 0, "cells": []}
COLUMNS = ("rows_right", "cols_right", "span_precision", "span_recall", "span_f1", "slot_accuracy", "cell_edits", "cell_ref", "cells_exact", "cells_missing", "cells_made_up")


def metrics(gold: dict | None, pred: dict | None) -> tuple:
    """The metrics of one pair; a missing side scores as an empty table."""
    g, p = gold or _NONE, pred or _NONE
    a, b = _spans(g), _spans(p)
    prec, rec, f1 = _f1(set(a), set(b))
    sa, sb = slots(a), slots(b)
    both = set(sa) | set(sb)
    slot = sum(sa.get(k) == sb.get(k) for k in both) / len(both) if both else 1.0
    counts = [align(a.get(k, ""), b.get(k, "")) for k in set(a) | set(b)]
    return (_near(g["n_rows"], p["n_rows"]), _near(g["n_cols"], p["n_cols"]), prec, rec, f1, slot, sum(c[2] + c[3] + c[4] for c in counts), sum(c[0] for c in counts), sum(a[k] == b[k] for k in set(a) & set(b)), len(set(a) - set(b)), len(set(b) - set(a)))


def table_metrics(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(page_id, gold_table, pred_table, status, score, *COLUMNS) of both sides' tables: matched, missing or extra.

    ``gold`` and ``pred`` are (page_id, tables), one row per page. Ids are never used to match. Nulls count as no tables.
    """
    ints = ("cell_edits", "cell_ref", "cells_exact", "cells_missing", "cells_made_up")
    schema = "page_id string, gold_table string, pred_table string, status string, score double, " + ", ".join(f"{c} {'long' if c in ints else 'double'}" for c in COLUMNS)
    kinds = [pa.string()] * 4 + [pa.float64()] + [pa.int64() if c in ints else pa.float64() for c in COLUMNS]

    def run(key, g, p):
        gt = [t for row in g.column("tables").to_pylist() for t in row or []]
        pt = [t for row in p.column("tables").to_pylist() for t in row or []]
        score = np.array([[similarity(a, b) for b in pt] for a in gt]).reshape(len(gt), len(pt))
        rows, done_g, done_p = [], set(), set()
        for i, j in assign(score):
            if score[i, j] >= LEAST:
                done_g.add(i)
                done_p.add(j)
                rows.append((key[0].as_py(), gt[i]["table_id"], pt[j]["table_id"], "matched", round(float(score[i, j]), 9), *metrics(gt[i], pt[j])))
        rows += [(key[0].as_py(), t["table_id"], None, "missing", None, *metrics(t, None)) for i, t in enumerate(gt) if i not in done_g]
        rows += [(key[0].as_py(), None, t["table_id"], "extra", None, *metrics(None, t)) for j, t in enumerate(pt) if j not in done_p]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "gold_table", "pred_table", "status", "score", *COLUMNS])

    pick = lambda d: d.select("page_id", "tables").where("size(tables) > 0")
    return pick(gold).groupBy("page_id").cogroup(pick(pred).groupBy("page_id")).applyInArrow(run, schema)
