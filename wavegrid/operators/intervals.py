"""Operators on intervals ``(key, start, end)``; every one returns a DataFrame. Overlap joins look up the levels of length in use first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.functions import arrays
from wavegrid.operators import runs


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length two intervals share; negative (the gap) when they are disjoint."""
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def merge_nearby(df: DataFrame, keys: list[str], gap: float, start: str = "start", end: str = "end") -> DataFrame:
    """Merge the intervals of each key that lie closer than ``gap``: one row per merged run.

    Rows with a null bound are left out. The running maximum of the ends is used, not the previous
    end, because intervals can nest.
    """
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.coalesce((F.col(start) - F.max(end).over(before) >= gap).cast("int"), F.lit(1))
    return (
        df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
        .withColumn("_open", opened)
        .withColumn("run", F.sum("_open").over(upto))
        .groupBy(*keys, "run")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged"))
    )


def merge_nearby_any_length(df: DataFrame, keys: list[str], gap: float, start: str = "start", end: str = "end") -> DataFrame:
    """:func:`merge_nearby` for keys with any number of intervals: no key is ordered in one task.

    Equal intervals are counted first; the latest end so far and the number of the run are prefixes over blocks.
    """
    some = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(*keys, start, end).agg(F.count("*").alias("_copies"))
    kind = some.schema[end].dataType.simpleString()
    later = lambda a, b: F.greatest(a, b)  # noqa: E731  (a null counts for nothing)
    seen = runs.prefix(some, keys, [start, end], F.col(end), later, F.lit(None).cast(kind), "_latest")
    opened = seen.withColumn("_open", F.coalesce((F.col(start) - F.col("_latest") >= gap).cast("long"), F.lit(1).cast("long")))
    numbered = runs.prefix(opened, keys, [start, end], F.col("_open"), lambda a, b: a + b, F.lit(0).cast("long"), "run", inclusive=True)
    return numbered.groupBy(*keys, "run").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_copies").alias("n_merged"))


def covered_any_length(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """``keys, covered``: length of the union of each key's intervals, for keys with any number of them. Empty intervals and nulls cover nothing."""
    some = df.where(F.col(start) < F.col(end)).groupBy(*keys, start).agg(F.max(end).alias(end))
    kind = some.schema[end].dataType.simpleString()
    seen = runs.prefix(some, keys, [start], F.col(end), lambda a, b: F.greatest(a, b), F.lit(None).cast(kind), "_latest")
    new = F.col(end) - F.greatest(F.col(start), F.coalesce("_latest", F.col(start)))
    return seen.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0.0), new)).alias("covered"))


def agreement_any_length(windows: DataFrame, keys: list[str], order: list[str], label: str, prob: str, threshold: float) -> DataFrame:
    """:func:`consecutive_agreement` for keys with any number of windows: the last window before each is a prefix, too."""
    last = F.struct(F.col(label).alias("label"), F.col(prob).alias("prob"), F.lit(True).alias("is"))
    kind = runs.zero_type(windows, last)
    seen = runs.prefix(windows, keys, order, last, lambda a, b: F.when(b["is"], b).otherwise(a), F.lit(None).cast(kind), "_last")
    both = (F.col("_last.label") == F.col(label)) & (F.col("_last.prob") > threshold) & (F.col(prob) > threshold)
    return seen.where(both).drop("_last")


def ema_over_rows(frames: DataFrame, keys: list[str], order: list[str], values: str, s: float = 0.04, name: str = "ema") -> DataFrame:
    """Adds ``name``, the exponential moving average (``arrays.ema``) of a band whose frames stand in many rows.

    Each row holds consecutive frames (``values``, an array) of its band ``keys``; the average goes on from row to row along
    ``order``. A row maps the average before it linearly to that after it, (1-s)^n * x + b, and these maps are combined
    as prefixes, so a band of any length is spread over tasks. The first frame of a band begins the average. Empty rows change nothing.
    """
    v = arrays.doubles(F.col(values))
    decay = lambda a: F.aggregate(a, F.lit(0.0), lambda m, x: (1 - s) * m + s * x)
    with_first = F.struct(F.pow(F.lit(1 - s), F.size(v)).alias("a"), decay(v).alias("b"), F.get(v, F.lit(0)).alias("first"))
    zero = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(None).cast("double").alias("first"))

    def go_on(p: Column, q: Column) -> Column:
        return F.struct((p["a"] * q["a"]).alias("a"), (p["b"] * q["a"] + q["b"]).alias("b"), F.coalesce(p["first"], q["first"]).alias("first"))

    seen = runs.prefix(frames, keys, order, F.coalesce(F.when(F.size(F.col(values)) > 0, with_first), zero), go_on, zero, "_before")
    # an average that begins with its first value is one that was at that value before
    start = F.col("_before.a") * F.col("_before.first") + F.col("_before.b")
    return seen.withColumn(name, arrays.ema(v, s, start=start)).drop("_before")


def _level(start: Column, end: Column, bucket: float) -> Column:
    """The level whose cells, of ``bucket * 2^level`` seconds, are at least as long as the interval."""
    return F.greatest(F.ceil(F.log2((end - start) / F.lit(bucket)) - 1e-9), F.lit(0)).cast("int")


#: Lengths of up to 2^3 times the smallest cell are joined in these cells alone.
FEW_LEVELS = 3


def overlapping(a: DataFrame, b: DataFrame, key: str, bucket: float) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` with one key whose intervals overlap; columns of both, all but the key named apart.

    Both sides have ``start`` and ``end`` (``b``'s are ``b_start``, ``b_end``). Time is cut into cells of ``bucket`` seconds, of twice that,
    and so on. An interval lies at the level whose cells are as long as itself, in two or three of them, and a pair meets at the
    longer one's level: there the shorter one, too, lies in few cells. So an interval of any length takes a few rows for
    each level that the other side has intervals of, at most as many as the logarithm of the longest over ``bucket`` (where no interval is
    longer than 8 times ``bucket``, it takes the up to 9 smallest cells it touches), and a key with many rows is spread over its cells. A pair counts in the cell where the later of the two begins, and so only
    once. Empty intervals and nulls overlap nothing.
    """
    a, b = a.where(F.col("start") < F.col("end")), b.where(F.col("b_start") < F.col("b_end"))
    own_a, own_b = _level(F.col("start"), F.col("end"), bucket), _level(F.col("b_start"), F.col("b_end"), bucket)
    lengths = a.select(own_a.alias("v")).union(b.select(own_b))
    if (lengths.agg(F.max("v")).first()[0] or 0) <= FEW_LEVELS:  # then nothing is in more than 2^FEW_LEVELS + 1 of the smallest cells, and one join will do
        small = lambda df, s, e: df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket))))
        both = small(a, "start", "end").join(small(b, "b_start", "b_end"), [key, "_cell"])
        first = F.floor(F.greatest("start", "b_start") / bucket)
        return both.where((F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")) & (F.col("_cell") == first)).drop("_cell")
    in_use = a.select(F.lit(True).alias("is_a"), own_a.alias("v")).union(b.select(F.lit(False), own_b)).distinct().collect()  # a few numbers, whatever the rows
    on_a, on_b = (sorted(r["v"] for r in in_use if r["is_a"] == side and r["v"] is not None) for side in (True, False))

    def cells(df: DataFrame, s: str, e: str, level: Column) -> DataFrame:
        df = df.withColumn("_level", level)
        side = F.lit(bucket) * F.pow(F.lit(2.0), F.col("_level"))
        return df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(s) / side), F.floor(F.col(e) / side))))

    def up(own: Column, least: Column, used: list[int]) -> Column:
        """The levels used by the other side from ``least`` on."""
        every = F.array(*[F.lit(v) for v in used]) if used else F.array().cast("array<int>")
        return F.explode(F.filter(every, lambda v: v >= least))

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        both = left.join(right, [key, "_level", "_cell"])
        first = F.floor(F.greatest("start", "b_start") / (F.lit(bucket) * F.pow(F.lit(2.0), F.col("_level"))))
        hit = (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")) & (F.col("_cell") == first)
        return both.where(hit).drop("_level", "_cell")

    longer_b = pairs(cells(a, "start", "end", up(own_a, own_a, on_b)), cells(b, "b_start", "b_end", own_b))
    if not any(x > y for x in on_a for y in on_b):
        return longer_b
    longer_a = pairs(cells(a, "start", "end", own_a), cells(b, "b_start", "b_end", up(own_b, own_b + 1, on_a)))
    return longer_b.unionByName(longer_a)


def union_share(tracks: DataFrame, signals: DataFrame, key: str, bucket: float, min_low: float = 1000.0) -> DataFrame:
    """``track_id, signal_percent``: the part of each track covered by signals with ``f_lo`` of at least ``min_low``.

    Signals are clipped to the track; where they overlap each other they count once, by the running maximum of
    their ends. A track of no length, or without signals, has share 0.
    """
    pairs = overlapping(tracks, signals.where(F.col("f_lo") >= min_low), key, bucket)
    lo, hi = F.greatest("start", "b_start"), F.least("end", "b_end")
    clipped = pairs.select("track_id", lo.alias("lo"), hi.alias("hi"))
    before = Window.partitionBy("track_id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("hi") - F.greatest("lo", F.coalesce(F.max("hi").over(before), F.col("lo")))
    covered = clipped.withColumn("part", F.greatest(F.lit(0.0), new)).groupBy("track_id").agg(F.sum("part").alias("covered"))
    length = F.col("end") - F.col("start")
    share = F.when(length > 0, F.coalesce("covered", F.lit(0.0)) / length).otherwise(F.lit(0.0))
    return tracks.select("track_id", "start", "end").join(covered, "track_id", "left").select("track_id", share.alias("signal_percent"))


def low_signal(shares: DataFrame, limit: float = 0.1) -> DataFrame:
    """Flags tracks whose signal share is under ``limit``."""
    return shares.withColumn("is_low", F.col("signal_percent") < limit)


def trim_to_signal(tracks: DataFrame, signals: DataFrame, key: str, bucket: float) -> DataFrame:
    """Tracks cut down to their first and last overlapping signal; tracks without signals go."""
    pairs = overlapping(tracks, signals, key, bucket)
    return pairs.groupBy(key, "track_id").agg(
        F.max(F.col("start")).alias("og_start"),
        F.max(F.col("end")).alias("og_end"),
        F.greatest(F.max("start"), F.min("b_start")).alias("start"),
        F.least(F.max("end"), F.max("b_end")).alias("end"),
    )


def overlap_labels(samples: DataFrame, tracks: DataFrame, key: str, bucket: float, part: float = 0.9) -> DataFrame:
    """Labels of other tracks that a sample overlaps by at least ``part`` of the shorter of the two.

    ``sample_id, track_id, start, end`` and ``b_track_id, b_label, b_start, b_end, b_min_freq, b_max_freq``. The band is that of all
    tracks taken, and null if any bound is null.
    """
    pairs = overlapping(samples, tracks, key, bucket).where("track_id <> b_track_id")
    shared = overlap(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end"))
    enough = shared >= part * F.least(F.col("end") - F.col("start"), F.col("b_end") - F.col("b_start"))
    return (
        pairs.where(enough)
        .groupBy("sample_id")
        .agg(
            F.sort_array(F.collect_set("b_label")).alias("labels"),
            F.sort_array(F.collect_set("b_track_id")).alias("track_ids"),
            F.when(~F.bool_or(F.isnull("b_min_freq")), F.min("b_min_freq")).alias("min_freq"),
            F.when(~F.bool_or(F.isnull("b_max_freq")), F.max("b_max_freq")).alias("max_freq"),
        )
    )


def best_window(df: DataFrame, id_col: str, values: str, width: int) -> DataFrame:
    """``id, offset, total``: where ``width`` consecutive values have the largest sum, the first such place on ties.

    A list shorter than ``width`` has offset 0 and the sum of all; a null or empty list has none, a null value counts as 0. Sums are
    rounded to 9 places, so that equal windows tie. All is worked out within the row, by running sums; nothing is shuffled.
    """
    some = df.where(F.size(values) > 0).select(id_col, F.transform(values, lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("_v"))

    def best(sums: Column) -> Column:
        last = F.greatest(F.size(sums) - 1 - width, F.lit(0))
        total = lambda o: F.round(F.get(sums, F.least(o + width, F.size(sums) - 1)) - F.get(sums, o), 9)
        return F.array_max(F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(total(o).alias("total"), (-o).alias("back"))))

    found = some.select(id_col, arrays.let(arrays.running_sums(F.col("_v")), best).alias("_b"))
    return found.select(id_col, (-F.col("_b.back")).alias("offset"), F.col("_b.total").alias("total"))


def tighten(df: DataFrame, id_col: str, values: str, width: int, hop: float, min_spread: float = 0.01) -> DataFrame:
    """The best window as new bounds in seconds; ``rejected`` where the values' deviation is under ``min_spread`` of their mean, or there are none."""
    best = best_window(df.select(F.struct(id_col, values).alias("_row"), values), "_row", values, width)
    none = df.where(F.coalesce(F.size(values), F.lit(0)) <= 0).select(F.struct(id_col, values).alias("_row"), F.lit(None).cast("int").alias("offset"))
    stats = arrays.mean_and_deviation(F.col(f"_row.{values}"))
    out = best.select("_row", "offset").unionByName(none).withColumn("_s", stats)
    flat = F.coalesce(F.abs(F.col("_s.sd") / F.nullif(F.col("_s.mean"), F.lit(0.0))) < min_spread, F.lit(True))
    return out.select(F.col(f"_row.{id_col}").alias(id_col), (F.col("offset") * hop).alias("start"), ((F.col("offset") + width) * hop).alias("end"), flat.alias("rejected"))


def best_segment(tracks: DataFrame, signals: DataFrame, key: str, bucket: float, seg: float = 3.0, step: float = 0.5) -> DataFrame:
    """For each track the segment of ``seg`` seconds with most signal in and around it.

    Segments begin every ``step`` while they fit in the track, and there is at least one. A segment's own length is
    the signal inside, each signal clipped; its score adds half of either neighbour, for the first the whole next one.
    The last is not scored unless it is the only one. Ties go to the earliest.
    """
    n = F.greatest(F.floor((F.col("end") - F.col("start") - seg) / step), F.lit(0))
    steps = tracks.withColumn("k", F.explode(F.sequence(F.lit(0), n.cast("int")))).withColumn("n", n)
    steps = steps.withColumn("seg_start", F.col("start") + F.col("k") * step)
    spans = steps.select(key, "track_id", "k", F.col("seg_start").alias("start"), (F.col("seg_start") + seg).alias("end"))
    inside = overlapping(spans, signals, key, bucket)
    own = inside.groupBy("track_id", "k").agg(F.sum(overlap(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end"))).alias("own"))
    s = steps.join(own, ["track_id", "k"], "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    w = Window.partitionBy("track_id").orderBy("k")
    before, after = F.coalesce(F.lag("own").over(w), F.lit(0.0)), F.coalesce(F.lead("own").over(w), F.lit(0.0))
    s = s.withColumn("score", F.round(F.when(F.col("k") == 0, F.col("own") + after).otherwise(F.col("own") + (before + after) / 2), 6))
    s = s.where((F.col("k") < F.col("n")) | (F.col("n") == 0))
    return s.groupBy("track_id").agg(F.max_by(F.struct("k", "seg_start", "own", "score"), F.struct("score", -F.col("k"))).alias("b")).select("track_id", "b.*")


def consecutive_agreement(windows: DataFrame, key: str, order: list[str], label: str, prob: str, threshold: float) -> DataFrame:
    """Windows that have the same label as the one before them, both above the threshold."""
    w = Window.partitionBy(key).orderBy(*order)
    both = (F.lag(label).over(w) == F.col(label)) & (F.lag(prob).over(w) > threshold) & (F.col(prob) > threshold)
    return windows.withColumn("_agrees", both).where("_agrees").drop("_agrees")


def silent_end(frames: DataFrame, key: str, chunk: str, low: str, high: str) -> DataFrame:
    """The first chunk of each recording that is constant, where the usable part ends; null if there is none."""
    return frames.groupBy(key).agg(F.min(F.when(F.col(low) == F.col(high), F.col(chunk))).alias("end_chunk"))
