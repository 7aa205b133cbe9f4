"""Work on what is new only: as a batch against the output, and as streams over files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def unprocessed(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def process_new_files(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Runs ``step`` over the Parquet files that came since the last run and appends its rows to ``target``.

    Each batch is written under its number and replaces itself if it runs again, so a restart repeats nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    new = spark.readStream.schema(schema).parquet(source)
    return new.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly_counts_stream(seen: DataFrame, late: str = "31 days") -> DataFrame:
    """Counts ``square_id, code, month_start, month, n`` of a stream ``square_id, code, ts``, keyed by month.

    The watermark is on the month's beginning: a month is given out, and its state dropped, once a sighting has come whose own
    month began ``late`` after it. Later ones for it are left out.
    """
    by = seen.withColumn("month_start", F.date_trunc("month", "ts")).withWatermark("month_start", late)
    counts = by.groupBy("month_start", "square_id", "code").agg(F.count("*").alias("n"))
    return counts.select("square_id", "code", "month_start", F.month("month_start").alias("month"), "n")


def counts_of_new_files(spark: SparkSession, source: str, schema: str, keys: list[str], step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> DataFrame:
    """Counts by ``keys`` over all files that ever came to ``source``; only files that are new since the last call are read.

    Each batch of new files is counted (after ``step``) and written under its number, so one that runs again replaces itself;
    the batches' counts are summed up.
    """
    counted = lambda df: step(df).groupBy(*keys).agg(F.count("*").alias("n"))
    process_new_files(spark, source, schema, counted, target, checkpoint).awaitTermination()
    return spark.read.parquet(target).groupBy(*keys).agg(F.sum("n").alias("n"))
