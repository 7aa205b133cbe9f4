"""Filters on samples and tracks; each keeps or drops whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.functions.arrays import has_bad
from wavegrid.operators.runs import runs_for
from wavegrid.operators.segmenting import keyed_order, keyed_uniform


def finite(df: DataFrame, payload: str, features: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose payload is finite; the feature blocks, if named, are finite and not all zero."""
    keep = ~has_bad(F.col(payload))
    for f in features:
        keep &= ~has_bad(F.col(f)) & F.exists(f, lambda x: x != 0)
    return df.where(keep)


def labelled(df: DataFrame, idx: str = "label_idx") -> DataFrame:
    return df.where(F.size(idx) > 0)


def generic_only(df: DataFrame, generic: int, idx: str = "label_idx", keep: bool = False) -> DataFrame:
    """Drops rows whose only label is the generic one, or keeps only those."""
    only = F.col(idx) == F.array(F.lit(generic))
    return df.where(only if keep else ~only)


def with_label(df: DataFrame, label: int, exactly: bool = False, idx: str = "label_idx") -> DataFrame:
    return df.where(F.col(idx) == F.array(F.lit(label)) if exactly else F.array_contains(idx, label))


def signal_share(df: DataFrame, above: float = 0.0, below: float | None = None, share: str = "signal_percent") -> DataFrame:
    keep = F.col(share) > above
    return df.where(keep if below is None else keep & (F.col(share) < below))


def longer_than(df: DataFrame, seconds: float, start: str = "start", end: str = "end") -> DataFrame:
    return df.where(F.col(end) - F.col(start) > seconds)


def not_of_length(df: DataFrame, payload: str, n: int) -> DataFrame:
    """Drops payloads of exactly n values; null payloads go too."""
    return df.where(F.col(payload).isNotNull() & (F.size(payload) != n))


def in_band(df: DataFrame, lo: float, hi: float, min_freq: str = "min_freq", max_freq: str = "max_freq") -> DataFrame:
    """Tracks whose band reaches into [lo, hi]; unknown bounds count as inside."""
    return df.where(F.coalesce(F.col(max_freq) >= lo, F.lit(True)) & F.coalesce(F.col(min_freq) <= hi, F.lit(True)))


def without_labels(idx: Column, *labels: int) -> Column:
    return F.array_except(idx, F.array(*map(F.lit, labels)))


def length_agrees(df: DataFrame, declared: str, decoded: str, by: float = 1.0) -> DataFrame:
    return df.where(F.abs(F.col(declared) - F.col(decoded)) <= by)


def batches(df: DataFrame, keys: list[str], size: int, seed: int = 1, runs: int = 64, run_rows: int = 1_000_000) -> DataFrame:
    """Adds ``run`` and ``batch``: rows in keyed order in batches of ``size`` within hashed runs, so that no order is made in one task.

    There are ``runs`` of them, and more where a run would have over ``run_rows`` rows.
    """
    cols = [F.col(k) for k in keys]
    run = F.floor(keyed_uniform(seed, F.lit("run"), *cols) * runs_for(df, runs, run_rows)).cast("int")
    w = Window.partitionBy("run").orderBy(keyed_order(seed, *cols), *keys)
    return df.withColumn("run", run).withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def random_track(recordings: DataFrame, seg: float = 3.0, seed: int = 1) -> DataFrame:
    """Recordings (``rec_id, duration``) with one track of a segment's length at a keyed place, or the whole if they are shorter."""
    start = F.greatest(F.lit(0.0), keyed_uniform(seed, F.lit("track"), F.col("rec_id")) * (F.col("duration") - seg))
    return recordings.withColumn("start", start).withColumn("end", F.least(F.col("start") + seg, F.col("duration")))


def clips(segments: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """``samples`` cut to each span (``start, end`` in seconds) of its recording, one row per span."""
    both = segments.select(key, "rate", "samples").join(spans, key)
    first = F.floor(F.col("start") * F.col("rate")).cast("int")
    n = F.greatest(F.lit(0), F.floor(F.col("end") * F.col("rate")).cast("int") - first)
    return both.withColumn("samples", F.slice("samples", first + 1, n))


def only_recordings(rows: DataFrame, ids: DataFrame, path: str, key: str = "rec_id") -> DataFrame:
    """Rows whose file name begins with one of the ids, up to the first ``-``."""
    name = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^([^-.]+)", 1)
    return rows.withColumn(key, name).join(ids.select(key).distinct(), key, "left_semi")
