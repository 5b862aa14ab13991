"""Where intermediate tables live and how tables are read.

Lineage is cut only by tables written to the folder that the session names in
``spark.checkpoint.dir``: all executors see it, so a lost executor costs a re-read and
nothing else. A folder of our own is made only where the session names none (tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One table; with ``columns`` the scan reads only these."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; without one named, a temporary folder in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.conf.get("spark.paraleaf.own.dir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="paraleaf-")
        spark.conf.set("spark.paraleaf.own.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys delivered twice that are sent to every executor at most, and the bytes of text in them.
MOST_KEYS, MOST_KEY_BYTES = 500_000, 32 << 20


def _ranked(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Of each key the row with the least order (of equal ones the one with the least hash); whole rows are shuffled."""
    cols = [c for c in df.columns if c != key]
    plain = [f.name for f in df.schema.fields if f.name != key and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rank = F.struct(order.alias("o"), F.xxhash64(*plain) if plain else F.lit(0))
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), rank).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in cols])


def once(df: DataFrame, key: str, late: str = "received_at") -> DataFrame:
    """Rows delivered twice count once: of each ``key`` the row with the least ``late`` (null comes last).

    Only (key, late) is aggregated. The keys seen twice, few where rows are repeated now and then, are checked for their number and
    sent to the rows, which stay where they were read. Keys with more than two rows or with equal times are
    ranked, and so are all rows where the repeated keys are too many to send. Rows with a null key are left out.
    """
    cols = [c for c in df.columns if c != key]
    order = F.coalesce(F.col(late).cast("timestamp"), F.lit("9999-01-01").cast("timestamp")) if late in cols else F.lit(0)
    df = df.where(F.col(key).isNotNull())
    if not cols:
        return df.distinct()
    twice = written(df.groupBy(key).agg(F.count("*").alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi")).where("_n > 1"), "twice")
    seen = twice.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.col(key).cast("string"))), F.lit(0)).alias("b"), F.count_if(F.expr("_n > 2 or _lo = _hi")).alias("open")).first()
    if not seen["n"]:
        return df
    if seen["n"] > MOST_KEYS or seen["b"] > MOST_KEY_BYTES:
        return _ranked(df, key, order)
    sure = df.join(F.broadcast(twice), key, "left").where(F.col("_n").isNull() | ((F.col("_n") == 2) & (F.col("_lo") < F.col("_hi")) & (order == F.col("_lo")))).select(*df.columns)
    if not seen["open"]:
        return sure
    rest = df.join(F.broadcast(twice.where("_n > 2 or _lo = _hi").select(key)), key, "left_semi")
    return sure.unionByName(_ranked(rest, key, order).select(*df.columns))


def workers(spark: SparkSession) -> int:
    """Tasks that run at once, never less than 2."""
    return max(2, spark.sparkContext.defaultParallelism)
