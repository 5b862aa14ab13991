"""Admission of score reports to the headline, coverage, and recomputation checks, as rules over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scores import headline

#: The components a headline needs.
TRACKS = ("bidi", "line", "page", "tables", "robustness")


def coverage(row: dict[str, Column]) -> Column:
    """complete where all counts agree and nothing failed, else incomplete."""
    names = ("selected", "source", "gold", "submitted", "matched", "evaluated")
    same = F.lit(True)
    for n in names[1:]:
        same = same & (row[n] == row[names[0]])
    return F.when(F.coalesce(same & (row["failures"] == 0), F.lit(False)), "complete").otherwise("incomplete")


def admission(reports: DataFrame) -> DataFrame:
    """(system, status, headline) from reports (system, track, suite, model, verified, covered, conformant, score), one per track.

    The first failing step decides: a track missing, evidence that does not hold together, coverage, the gate, a score out of range.
    """
    a = reports.groupBy("system").agg(
        F.count_distinct(F.when(F.col("track").isin(*TRACKS), F.col("track"))).alias("tracks"),
        F.count_distinct("suite").alias("suites"),
        F.count_distinct("model").alias("models"),
        F.count("suite").alias("with_suite"),
        F.count("*").alias("n"),
        F.bool_and(F.coalesce("verified", F.lit(False))).alias("verified"),
        F.bool_and(F.coalesce("covered", F.lit(False))).alias("covered"),
        F.bool_and(F.coalesce("conformant", F.lit(False))).alias("conformant"),
        F.bool_and(F.coalesce(F.col("score").between(0, 1), F.lit(False))).alias("scored"),
        F.map_from_entries(F.collect_list(F.struct("track", F.round("score", 8).alias("score")))).alias("by"),
    )
    status = (
        F.when((F.col("tracks") < len(TRACKS)) | (F.col("n") > F.col("tracks")), "incomplete")
        .when((F.col("with_suite") < F.col("n")) | (F.col("suites") != 1) | (F.col("models") != 1) | ~F.col("verified"), "invalid_evidence")
        .when(~F.col("covered"), "incomplete_submission")
        .when(~F.col("conformant"), "non_conformant")
        .when(~F.col("scored"), "invalid_metrics")
        .otherwise("rankable")
    )
    head = headline(lambda k: F.col("by")[k])
    return a.select("system", status.alias("status"), F.when(status == "rankable", head).alias("headline"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): rows of one table that the other lacks, counted with repeats; none if a recomputation agrees."""
    return a.exceptAll(b).select(F.lit("only_first").alias("side")).unionByName(b.exceptAll(a).select(F.lit("only_second").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))
