"""Agreement of two extractions of one page, and the graph of a prediction carried over to gold ids."""

from __future__ import annotations

from collections import Counter

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.align import align

_TOKEN = regex.compile(r"https?://\S+|[\w.+-]+@[\w.-]+|[א-ת֑-ׇ]+(?:[׳״'\"][א-ת]+)*|[A-Za-z]+|[0-9]+(?:[.,:/-][0-9]+)*|\S")


def bag_f1(a: list[str], b: list[str]) -> float:
    """F1 of two bags; 1 if both are empty, 0 if one is."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


def agreement(a: str, b: str) -> tuple[float, float, float]:
    """(content of words and numbers, their order, content of punctuation)."""
    x, y = _TOKEN.findall(a), _TOKEN.findall(b)
    is_anchor = lambda t: bool(regex.match(r"\w", t))
    ax, ay = [t for t in x if is_anchor(t)], [t for t in y if is_anchor(t)]
    n, m, s, d, i, c = align(ax, ay)
    longest = max(n, m)
    return bag_f1(ax, ay), 1.0 if not longest else 1 - (s + d + i) / longest, bag_f1([t for t in x if not is_anchor(t)], [t for t in y if not is_anchor(t)])


@pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("content", "order", "punctuation")]))
def text_agreement(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([agreement(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["content", "order", "punctuation"])


def remapped_edges(edges: DataFrame, nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """(page_id, a, b): a prediction's edges in gold ids.

    ``edges`` (page_id, a, b), ``nodes`` (page_id, node) declared by the prediction, ``matches`` (page_id, node, gold_id). A declared node without match
    becomes __prediction_unmatched__:k:id, an undeclared one __prediction_unknown__:k:id, k counting them in a page by id.
    """
    used = edges.select("page_id", F.explode(F.array("a", "b")).alias("node")).unionByName(nodes.select("page_id", "node")).where("node is not null").distinct()
    known = used.join(nodes.select("page_id", "node", F.lit(1).alias("declared")).distinct(), ["page_id", "node"], "left").join(matches.dropDuplicates(["page_id", "node"]), ["page_id", "node"], "left")
    kind = F.when(F.col("gold_id").isNotNull(), "m").when(F.col("declared").isNotNull(), "unmatched").otherwise("unknown")
    known = known.withColumn("kind", kind).withColumn("k", F.row_number().over(W.partitionBy("page_id", "kind").orderBy("node")) - 1)
    name = F.coalesce("gold_id", F.concat(F.lit("__prediction_"), "kind", F.lit("__:"), "k", F.lit(":"), "node"))
    to = known.select("page_id", "node", name.alias("name"))
    a, b = to.select("page_id", F.col("node").alias("a"), F.col("name").alias("na")), to.select("page_id", F.col("node").alias("b"), F.col("name").alias("nb"))
    return edges.join(a, ["page_id", "a"]).join(b, ["page_id", "b"]).select("page_id", F.col("na").alias("a"), F.col("nb").alias("b"))
