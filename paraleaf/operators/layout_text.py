"""Word boxes to rows and logical text: greedy row clustering and the order of words inside a row."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_HEBREW = regex.compile(r"[֐-׿יִ-ﭏ]")
_LATIN = regex.compile(r"[A-Za-z]")


def rows_of_boxes(boxes: list[tuple[float, float, float, float]]) -> list[list[int]]:
    """Indices of boxes (x1, y1, x2, y2) per visual row, top to bottom: a box joins the row it overlaps vertically by 0.45 of the smaller height
    or whose centre lies within 0.55 of its height; the first such row takes it."""
    order = sorted(range(len(boxes)), key=lambda i: (boxes[i][1] + boxes[i][3], boxes[i][0]))
    rows: list[list[int]] = []
    spans: list[list[float]] = []
    for i in order:
        _, y1, _, y2 = boxes[i]
        h = max(y2 - y1, 1e-9)
        for row, span in zip(rows, spans, strict=True):
            over = min(y2, span[1]) - max(y1, span[0])
            if over / min(h, max(span[1] - span[0], 1e-9)) >= 0.45 or abs((y1 + y2) / 2 - (span[0] + span[1]) / 2) <= 0.55 * h:
                row.append(i)
                span[0], span[1] = min(span[0], y1), max(span[1], y2)
                break
        else:
            rows.append([i])
            spans.append([y1, y2])
    return [r for _, r in sorted(zip([s[0] for s in spans], rows, strict=True), key=lambda x: x[0])]


def logical_order(words: list[tuple[str, float]]) -> list[str]:
    """A row's words (text, left edge) in reading order: right to left where Hebrew leads, runs of Latin words and numbers kept left to right."""
    seen = sorted(words, key=lambda w: w[1])
    kind = ["r" if _HEBREW.search(t) else "l" if _LATIN.search(t) else "n" for t, _ in seen]
    if "r" not in kind:
        return [t for t, _ in seen]
    out: list[str] = []
    run: list[str] = []
    for (t, _), k in reversed(list(zip(seen, kind, strict=True))):
        if k == "r":
            out += reversed(run)
            run = []
            out.append(t)
        else:
            run.append(t)
    return out + list(reversed(run))


_BOX = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("x1", T.DoubleType()), T.StructField("y1", T.DoubleType()), T.StructField("x2", T.DoubleType()), T.StructField("y2", T.DoubleType())]))


@pandas_udf(T.ArrayType(T.StringType()))
def visual_lines(words: pd.Series) -> pd.Series:
    """The text lines of a page's word boxes (array of text, x1, y1, x2, y2); null gives null, boxes with null edges are passed over."""

    def one(ws):
        if ws is None:
            return None
        ws = [w for w in ws if w["text"] and all(w[k] is not None for k in ("x1", "y1", "x2", "y2"))]
        rows = rows_of_boxes([(w["x1"], w["y1"], w["x2"], w["y2"]) for w in ws])
        return [" ".join(logical_order([(ws[i]["text"], ws[i]["x1"]) for i in row])) for row in rows]

    return words.map(one)
