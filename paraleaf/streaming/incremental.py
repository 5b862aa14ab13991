"""Incremental scoring: additive counters over a stream; every row counts, however late it comes.

Each micro-batch is aggregated by itself and its partial sums go to a folder of its own, which a repeated batch overwrites; sums are added when the
result is read. Nothing is kept between batches, so there is no watermark behind which rows would be dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import new_path


def counts(df: DataFrame) -> DataFrame:
    """Events per type and hour as sums of integers, so that any order of arrival gives the same; rows without a time are left out."""
    return df.where("ts is not null").groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


def score_batches(stream: DataFrame, score, path: str, checkpoint: str):
    """Scores each micro-batch with ``score`` and writes the additive counters it gives below ``path``, once per batch even where a batch is repeated."""

    def add(batch: DataFrame, epoch: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(spark, sf, files_per_batch: int = 100) -> DataFrame:
    """Runs the stream over all files there are and adds up the partial sums."""
    source = f"{sf}/events.parquet"
    schema = spark.read.parquet(source).schema
    out, check = new_path(spark, "stream-state"), new_path(spark, "stream-checkpoint")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source if _is_dir(spark, source) else source.rsplit("/", 1)[0] + "/events.parque[t]")
    score_batches(stream, counts, out, check).awaitTermination()
    total = spark.read.parquet(out).groupBy("event_type", "hour").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
    return total.select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "n", F.round(F.col("cents") / 100, 2).alias("total"))


def _is_dir(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
