"""Writers: sample shards, anonymised metadata, grids, summaries, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.operators.runs import sums_before
from wavegrid.operators.sizes import small
from wavegrid.sources.scratch import written


def write_shards(samples: DataFrame, path: str, n: int, by_tag: bool = False, max_rows: int | None = None) -> None:
    """Samples by split (and first tag), dealt out over ``n`` files by a hash of their recording; files of at most ``max_rows``.

    Where ``samples`` has a column ``error``, rows with one are left out of the shards, so that a recording that can't be
    read doesn't stop the others; they go to ``_failed`` beside the shards, which readers of the folder pass over.
    """
    if "error" in samples.columns:
        samples = written(samples, "shard-samples")  # two tables come from it, and decoding is dear
        failed, samples = samples.where("error is not null"), samples.where("error is null").drop("error")
    else:
        failed = None
    w = samples.repartition(n, F.md5(F.col("rec_id").cast("string").cast("binary"))).write.mode("overwrite").partitionBy(*["split", *["first_tag"] * by_tag])
    (w.option("maxRecordsPerFile", max_rows) if max_rows else w).parquet(path)
    if failed is not None:
        failed.write.mode("overwrite").parquet(f"{path}/_failed")


def failed_samples(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_shards` left out of the shards in ``path``, with its ``error``."""
    return spark.read.parquet(f"{path}/_failed")


def anonymised(recordings: DataFrame, tracks: DataFrame) -> DataFrame:
    """A row per recording for export: places rounded to 0.1 degrees, a dense number for each device and place, tracks nested, missing bands -1.

    Numbers follow device and place in order, nulls last. They are given to the distinct pairs, not to the recordings, and
    only the devices with their numbers of places are ordered as a whole.
    """
    r = recordings.withColumn("lat", F.round("lat", 1)).withColumn("lng", F.round("lng", 1))
    sites = r.select("device_id", "lat", "lng").distinct()
    sites = sums_before(sites, [], ["device_id"], [F.asc_nulls_last("lat"), F.asc_nulls_last("lng")], {"site_id": F.lit(1)}).withColumn("site_id", F.col("site_id") + 1)
    t = tracks.groupBy("rec_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", F.coalesce("min_freq", F.lit(-1.0)).alias("min_freq"), F.coalesce("max_freq", F.lit(-1.0)).alias("max_freq"), "label"))).alias("tracks")
    )
    out = r.alias("r").join(sites.alias("s"), F.expr("r.device_id <=> s.device_id and r.lat <=> s.lat and r.lng <=> s.lng"), "left")
    return out.select("r.rec_id", "s.site_id", "r.lat", "r.lng").join(t, "rec_id", "left")


def training_counts(samples: DataFrame) -> DataFrame:
    """Per split and label: samples and recordings."""
    return samples.groupBy("split", "label").agg(F.count("*").alias("n_samples"), F.countDistinct("rec_id").alias("n_recs"))


def training_summary(samples: DataFrame) -> DataFrame:
    """``split, label, n_samples, n_recs, rec_id``: each recording's id once, with the samples and recordings of its split and label.

    A row an id, so that no row grows with the data. Samples without an id have a row, too, which ``n_recs`` leaves out.
    """
    ids = samples.select("split", "label", "rec_id").distinct()
    out = ids.alias("i").join(small(training_counts(samples), 64).alias("c"), F.expr("i.split <=> c.split and i.label <=> c.label"))
    return out.select("i.split", "i.label", "c.n_samples", "c.n_recs", "i.rec_id")


def training_recordings(samples: DataFrame) -> DataFrame:
    """``split, label, rec_id``, each once; recordings without an id are left out."""
    return samples.where("rec_id is not null").select("split", "label", "rec_id").distinct()


def write_summary(samples: DataFrame, path: str) -> None:
    """Counts as JSON, and the recordings' ids beside them in a table by split: no row grows with the data."""
    write_json(training_counts(samples), f"{path}/counts")
    training_recordings(samples).write.mode("overwrite").partitionBy("split").parquet(f"{path}/recordings")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    preds.write.mode("overwrite").partitionBy("model").parquet(path)
