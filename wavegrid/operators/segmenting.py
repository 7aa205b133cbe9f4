"""Cutting tracks and recordings into samples. Random choices depend on a seed and the row's keys only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRACK_SAMPLES = 4
MIN_SAMPLE_LENGTH, LEEWAY = 1.5, 0.5


def keyed_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) made from the first 8 hex digits of the md5 of seed and keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def keyed_order(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def segment_tracks(tracks: DataFrame, seg: float = 3.0, stride: float = 1.0, seed: int = 3, small_strides: bool = True) -> DataFrame:
    """Samples of each track (``track_id, start, end``): ``kind, i, sample_start, sample_end``.

    Samples begin every ``stride`` within the track. If the track has room for more than one
    (n = bround((length - seg) / stride) + 1), each begin is moved by up to a quarter of a second; of more than four,
    four are ``used`` and the others ``unused``. A second list of ``ceil(n / stride)`` begins, half a stride later, is
    ``small_stride``. Ends stop at the track's, begins at 0. The first of all is always kept; further ones only if
    they begin within the track and are at least ``seg - 0.5`` long, the first ``small_stride`` one if 1.5. Tracks of
    no length have no samples.
    """
    length = F.col("end") - F.col("start")
    n = F.greatest(F.bround((length - seg) / stride), F.lit(0)).cast("int") + 1
    t = tracks.where(length > 0).withColumn("_n", n)

    def begins(t: DataFrame, kind: str, count: Column, shift: float) -> DataFrame:
        """Samples that stay are chosen within the row: each has its jitter's hash once, and only they are rows."""

        def one(i: Column) -> Column:
            jitter = F.when(F.col("_n") > 1, keyed_uniform(seed, F.lit(kind), F.col("track_id"), i) / 2 - 0.25).otherwise(F.lit(0.0))
            return F.struct(i.alias("i"), F.greatest(F.lit(0.0), F.col("start") + i * stride + shift + jitter).alias("begin"))

        def stays(s: Column) -> Column:
            size = F.least(s["begin"] + seg, F.col("end")) - s["begin"]
            least = F.when(s["i"] == 0, F.lit(MIN_SAMPLE_LENGTH)).otherwise(F.lit(seg - LEEWAY)) if kind == "small" else F.lit(seg - LEEWAY)
            fits = (s["begin"] <= F.col("end")) & (size >= least)
            return fits if kind == "small" else (s["i"] == 0) | fits

        at = F.transform(F.sequence(F.lit(0), count.cast("int") - 1), one)
        s = t.withColumn("_s", F.explode(F.filter(at, stays)))
        return s.withColumns({"i": F.col("_s.i"), "sample_start": F.col("_s.begin")}).drop("_s")

    # four of a long track's samples, chosen within its row
    places = F.transform(F.sequence(F.lit(0), F.ceil(length / stride).cast("int") - 1), lambda i: F.struct(keyed_order(seed, F.lit("pick"), F.col("track_id"), i), i.alias("i")))
    picked = F.when(F.col("_n") > MAX_TRACK_SAMPLES, F.slice(F.array_sort(places), 1, MAX_TRACK_SAMPLES)["i"])
    main = begins(t.withColumn("_picked", picked), "main", F.ceil(length / stride), 0.0)
    kind = F.when((F.col("_n") <= MAX_TRACK_SAMPLES) | F.array_contains("_picked", F.col("i")), F.lit("used")).otherwise(F.lit("unused"))
    main = main.withColumn("kind", kind).drop("_picked")
    all_ = main
    if small_strides:
        all_ = main.unionByName(begins(t, "small", F.ceil(F.col("_n") / stride), stride / 2).withColumn("kind", F.lit("small_stride")))
    return all_.withColumn("sample_end", F.least(F.col("sample_start") + seg, F.col("end"))).drop("_n")


def predict_windows(tracks: DataFrame, seg: float = 3.0, stride: float = 1.0) -> DataFrame:
    """Windows for prediction: a track shorter than ``seg`` is widened around its middle (not below 0), a longer one has a window every ``stride`` that fits."""
    length = F.col("end") - F.col("start")
    begin = F.when(length < seg, F.greatest(F.lit(0.0), (F.col("start") + F.col("end") - seg) / 2)).otherwise(F.col("start"))
    n = F.greatest(F.floor((length - seg) / stride), F.lit(0)).cast("int")
    w = tracks.withColumn("i", F.explode(F.sequence(F.lit(0), n)))
    return w.withColumn("win_start", begin + F.col("i") * stride).withColumn("win_end", F.col("win_start") + seg)


def fixed_windows(recordings: DataFrame, seg: float = 3.0, pad: bool = False) -> DataFrame:
    """Windows over a whole recording (``rec_id, duration``): the last one padded beyond the end, or moved back to be flush with it."""
    n = F.greatest(F.ceil(F.col("duration") / seg), F.lit(1)).cast("int")
    w = recordings.where("duration > 0").withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    begin = F.col("i") * F.lit(seg)
    if not pad:
        begin = F.greatest(F.lit(0.0), F.least(begin, F.col("duration") - seg))
    return w.withColumn("win_start", begin).withColumn("win_end", F.least(begin + seg, F.col("duration")) if not pad else begin + seg)


def minute_chunks(recordings: DataFrame, size: float = 60.0, min_last: float = 20.0) -> DataFrame:
    """Chunks of a minute; a last one under 20 s goes with the one before; recordings of one chunk or less give none."""
    whole = F.ceil(F.col("duration") / size).cast("int")
    n = F.when(F.col("duration") - (whole - 1) * size < min_last, whole - 1).otherwise(whole)
    w = recordings.withColumn("_n", n).where("_n > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    end = F.when(F.col("i") == F.col("_n") - 1, F.col("duration")).otherwise((F.col("i") + 1) * size)
    return w.withColumn("chunk_start", F.col("i") * F.lit(size)).withColumn("chunk_end", end).drop("_n")


def at_least(tracks: DataFrame, seg: float = 1.5, seed: int = 3) -> DataFrame:
    """Tracks shorter than ``seg`` are widened to it, by a keyed share on the left, within ``[0, duration]``."""
    missing = F.greatest(F.lit(0.0), F.lit(seg) - (F.col("end") - F.col("start")))
    left = F.col("start") - missing * keyed_uniform(seed, F.lit("pad"), F.col("track_id"))
    start = F.greatest(F.lit(0.0), F.least(left, F.col("duration") - seg))
    wide = F.when(missing > 0, F.struct(start.alias("start"), F.least(start + seg, F.col("duration")).alias("end"))).otherwise(F.struct("start", "end"))
    return tracks.withColumn("_w", wide).withColumn("start", F.col("_w.start")).withColumn("end", F.col("_w.end")).drop("_w")


def even_split(tracks: DataFrame, max_length: float = 6.0) -> DataFrame:
    """Tracks longer than ``max_length`` in ``ceil(length / max_length)`` equal parts."""
    length = F.col("end") - F.col("start")
    n = F.greatest(F.ceil(length / max_length), F.lit(1)).cast("int")
    s = tracks.withColumn("_n", n).withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    unit = length / F.col("_n")
    return s.withColumn("_a", F.col("start") + F.col("part") * unit).withColumn("_b", F.col("start") + (F.col("part") + 1) * unit).drop("start", "end", "_n").withColumnsRenamed({"_a": "start", "_b": "end"})


def signal_windows(signals: DataFrame, seg: float = 3.0, stride: float = 1.0) -> DataFrame:
    """Windows inside signals (``start, end``): the first begins with the signal, others every ``stride`` while they end before it does; ends stop at the signal's.

    A signal of no length has its first window, empty.
    """
    # the largest i with start + i * stride + seg < end
    n = F.greatest(F.ceil((F.col("end") - F.col("start") - seg) / stride) - 1, F.lit(0)).cast("int")
    w = signals.withColumn("i", F.explode(F.sequence(F.lit(0), n))).withColumn("win_start", F.col("start") + F.col("i") * stride)
    return w.withColumn("win_end", F.least(F.col("win_start") + seg, F.col("end")))
