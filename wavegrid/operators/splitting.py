"""Splits without leaks, balancing, mixing. All random choices are keyed by a seed and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.functions.arrays import let
from wavegrid.operators.runs import hashed_run, runs_for, sums_before
from wavegrid.operators.segmenting import keyed_order, keyed_uniform
from wavegrid.operators.sizes import small


def split_leakfree(samples: DataFrame, seed: int = 1, val: float = 0.15, test: float = 0.05, min_samples: dict[str, int] | None = None, no_test: bool = False) -> DataFrame:
    """``bin_id, owner, split``: every bin (a recording) in one of train, validation and test.

    ``samples`` has ``sample_id, bin_id, tag`` (a row per tag). A bin belongs to the smallest of its tags. The bins
    of an owner, in keyed order, fill validation until both ``val`` of its tag's samples and of its tag's bins (one at
    least) are reached, then test likewise, the rest is train. Limits are of what carries the tag; progress counts all
    samples of a bin. An owner's bins are summed up in runs of their order, not in one task.
    """
    bins = samples.groupBy("bin_id").agg(F.min("tag").alias("owner"), F.countDistinct("sample_id").alias("n"))
    owned = samples.join(bins.select("bin_id", "owner"), "bin_id").where("tag = owner")
    limits = owned.groupBy("owner").agg(F.countDistinct("sample_id").alias("own_samples"), F.countDistinct("bin_id").alias("own_bins"))
    floor_ = F.lit(1)
    for tag, least in (min_samples or {}).items():
        floor_ = F.when(F.col("owner") == tag, F.lit(least)).otherwise(floor_)

    def limit(total: str, part: float, least: Column) -> Column:
        return F.greatest(least.cast("double"), F.col(total) * part)

    b = bins.withColumn("_o", keyed_order(seed, F.col("bin_id"))).withColumn("_p", hashed_run(F.col("_o")))
    b = sums_before(b, ["owner"], ["_p"], ["_o", "bin_id"], {"_s": F.col("n"), "_b": F.lit(1)}).join(limits, "owner")
    in_val = (F.col("_s") < limit("own_samples", val, floor_)) | (F.col("_b") < limit("own_bins", val, F.lit(1)))
    b = b.withColumn("_v", in_val)
    # both sums only grow along the order, so validation took its first bins
    taken = b.where("_v").groupBy("owner").agg(F.sum("n").alias("_vs"), F.count("*").alias("_vb"))
    b = b.join(taken, "owner", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_vs", "_vb")})
    in_test = (F.col("_s") - F.col("_vs") < limit("own_samples", test, floor_)) | (F.col("_b") - F.col("_vb") < limit("own_bins", test, F.lit(1)))
    split = F.when(F.col("_v"), F.lit("validation")).when(F.lit(not no_test) & in_test, F.lit("test")).otherwise(F.lit("train"))
    return b.select("bin_id", "owner", split.alias("split"))


def split_leaks(rows: DataFrame, key: str, low_sample: str | None = None) -> DataFrame:
    """Keys found in more than one split; rows flagged in ``low_sample`` (oversampled ones) don't count."""
    rows = rows if low_sample is None else rows.where(~F.coalesce(F.col(low_sample), F.lit(False)))
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits")).where("size(splits) > 1")


def split_from_list(recs: DataFrame, listed: DataFrame, samples: DataFrame, seed: int = 1) -> DataFrame:
    """Splits as listed (``bin_id, split``); recordings not on the list are split by :func:`split_leakfree`."""
    known = recs.join(listed, "bin_id").select("bin_id", "split")
    rest = samples.join(listed, "bin_id", "left_anti")
    return known.unionByName(split_leakfree(rest, seed).select("bin_id", "split"))


def missing_from(recs: DataFrame, listed: DataFrame) -> DataFrame:
    return listed.join(recs, "bin_id", "left_anti")


def nth_largest_count(counts: DataFrame, n: int = 9) -> DataFrame:
    """One row ``target``: the n-th largest count, or the smallest if there are fewer."""
    top = counts.orderBy(F.desc("n")).limit(n)
    return top.agg(F.min("n").alias("target"))


def undersample(samples: DataFrame, seed: int = 1, share: float = 0.75) -> DataFrame:
    """Samples (``sample_id, tag``, a row per tag) that survive for all of their tags.

    A tag with more than the target (``share`` of the ninth largest count) loses each sample with the chance
    (n - target) / n. With one tag nothing is lost.
    """
    counts = samples.groupBy("tag").agg(F.count("*").alias("n"))
    target = nth_largest_count(counts).crossJoin(counts.agg(F.count("*").alias("n_tags")))  # one row each
    facts = counts.crossJoin(F.broadcast(target)).withColumn("goal", F.col("target") * share)  # one row is broadcast
    chance = F.when((F.col("n_tags") > 1) & (F.col("n") > F.col("goal")), (F.col("n") - F.col("goal")) / F.col("n")).otherwise(F.lit(0.0))
    rolled = samples.join(facts.select("tag", chance.alias("chance")), "tag")
    lives = keyed_uniform(seed, F.col("tag"), F.col("sample_id")) >= F.col("chance")
    return rolled.groupBy("sample_id").agg(F.bool_and(lives).alias("lives")).where("lives").select("sample_id")


def oversample(used: DataFrame, pools: DataFrame, seed: int = 1, skip: tuple[str, ...] = ("bird", "noise")) -> DataFrame:
    """``sample_id, tag, pool`` of the spare samples that fill each tag up to the ninth largest count.

    ``used`` has ``sample_id, tag``; ``pools`` also ``priority`` (lower first). Tags in ``skip`` are not filled.
    """
    counts = used.where(~F.col("tag").isin(*skip)).groupBy("tag").agg(F.count("*").alias("n"))
    facts = counts.crossJoin(F.broadcast(nth_largest_count(counts))).withColumn("deficit", F.greatest(F.lit(0), F.col("target") - F.col("n")))  # one row is broadcast
    spare = pools.join(facts.where("deficit > 0").select("tag", "deficit"), "tag").withColumn("_o", keyed_order(seed, F.col("tag"), F.col("sample_id")))
    spare = sums_before(spare.withColumn("_p", hashed_run(F.col("_o"))), ["tag"], ["priority", "_p"], ["_o", "sample_id"], {"_r": F.lit(1)})
    return spare.where("_r < deficit").select("sample_id", "tag", "priority")


def folds(ids: DataFrame, key: str, seed: int = 1, k: int = 5, hold_out: float = 0.2) -> DataFrame:
    """Fold of each id: -1 for about ``hold_out`` of them by keyed share, else 0 to k - 1 by another."""
    out = keyed_uniform(seed, F.lit("hold"), F.col(key)) < hold_out
    fold = F.floor(keyed_uniform(seed, F.lit("fold"), F.col(key)) * k).cast("int")
    return ids.select(key).distinct().withColumn("fold", F.when(out, F.lit(-1)).otherwise(fold))


def pick(df: DataFrame, keys: list[str], n: int, seed: int = 1, per: list[str] | None = None) -> DataFrame:
    """n rows in keyed order, of all or of each group."""
    order = keyed_order(seed, *[F.col(k) for k in keys])
    if not per:
        return df.withColumn("_o", order).orderBy("_o", *keys).limit(n).drop("_o")
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*per).orderBy(order, *keys))).where(F.col("_r") <= n).drop("_r")


def interleave(df: DataFrame, source: str, keys: list[str], seed: int = 1, stop_on_empty: bool = False) -> DataFrame:
    """Adds ``turn``: sources take turns in it, each in keyed order; optionally until the first is used up."""
    keyed = df.withColumn("_o", keyed_order(seed, *[F.col(k) for k in keys])).withColumn("_p", hashed_run(F.col("_o")))
    placed = sums_before(keyed, [source], ["_p"], ["_o", *keys], {"turn": F.lit(1)})
    out = placed.withColumn("turn", F.col("turn") + 1).drop("_o", "_p")
    if stop_on_empty:
        out = out.join(F.broadcast(df.groupBy(source).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_n"))), F.col("turn") <= F.col("_n")).drop("_n")  # one row is broadcast
    return out


def uniform_classes(df: DataFrame, label: str, keys: list[str], seed: int = 1) -> DataFrame:
    """Keeps each row with the chance smallest class count / its class count."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    least = counts.agg(F.min("_n").alias("_least"))
    facts = counts.crossJoin(F.broadcast(least))  # one row is broadcast
    kept = df.join(small(facts, 64), label)
    return kept.where(keyed_uniform(seed, *[F.col(k) for k in keys]) < F.col("_least") / F.col("_n")).drop("_n", "_least")


def mixup_pairs(df: DataFrame, key: str, values: str, label: str, seed: int = 1, runs: int = 64, run_rows: int = 10_000) -> DataFrame:
    """Pairs each row with another by place in two keyed orders and mixes their arrays by a keyed share in [0.2, 0.8].

    Places are ranks within hashed runs (``runs``, or more where one would have over ``run_rows`` rows), so no order is made
    in one task. The label is that of the larger share.
    """
    n_runs = runs_for(df, runs, run_rows)

    def placed(name: str, s: int) -> DataFrame:
        # both orders use one run per row, so partners meet in it
        run = F.floor(keyed_uniform(seed, F.lit("run"), F.col(key)) * n_runs).cast("int")
        d = df.select(key, values, label).withColumn("_run", run)
        w = Window.partitionBy("_run").orderBy(keyed_order(s, F.col(key)), key)
        d = d.withColumn("_at", F.row_number().over(w))
        return d.select("_run", "_at", *[F.col(c).alias(f"{c}{name}") for c in (key, values, label)])

    both = placed("_1", seed).join(placed("_2", seed + 1), ["_run", "_at"])
    share = F.lit(0.2) + F.lit(0.6) * keyed_uniform(seed, F.lit("mix"), F.col(f"{key}_1"))
    both = both.withColumn("share", share)
    mixed = F.zip_with(f"{values}_1", f"{values}_2", lambda a, b: F.col("share") * a.cast("double") + (1 - F.col("share")) * b.cast("double"))
    label_ = F.when(F.col("share") >= 0.5, F.col(f"{label}_1")).otherwise(F.col(f"{label}_2"))
    return both.select(F.col(f"{key}_1").alias(key), F.col(f"{key}_2").alias("partner"), "share", label_.alias(label), mixed.alias(values))


def without_oversampled(samples: DataFrame, flag: str = "low_sample") -> DataFrame:
    """Rows that aren't flagged; a null counts as not flagged."""
    return samples.where(~F.coalesce(F.col(flag), F.lit(False)))


def keyed_share(df: DataFrame, keys: list[str], share: float, seed: int = 1) -> DataFrame:
    """About ``share`` of the rows, by a number made from their keys: the same rows in every run."""
    return df.where(keyed_uniform(seed, F.lit("share"), *[F.col(k) for k in keys]) < share)


def oversample_rounds(used: DataFrame, pools: DataFrame, repeats: DataFrame, max_repeats: int = 1, seed: int = 1, skip: tuple[str, ...] = ("bird", "noise")) -> DataFrame:
    """``sample_id, tag, round``: spare samples as in :func:`oversample` (round 0), then samples made anew.

    A tag that still lacks more than half of the target takes from its sets in ``repeats`` (``sample_id, tag, set_no`` 0 to
    2, a set a round, in turn), until it lacks nothing or every set was used ``max_repeats`` times. Rounds are known from
    running sums of set sizes, so no round waits for another.
    """
    counts = used.where(~F.col("tag").isin(*skip)).groupBy("tag").agg(F.count("*").alias("n"))
    facts = counts.crossJoin(F.broadcast(nth_largest_count(counts))).withColumn("lack", F.greatest(F.lit(0), F.col("target") - F.col("n")))  # a row per tag, one row
    spare = oversample(used, pools, seed, skip).select("sample_id", "tag")
    filled = spare.groupBy("tag").agg(F.count("*").alias("_got"))
    still = facts.join(filled, "tag", "left").withColumn("lack", F.col("lack") - F.coalesce("_got", F.lit(0))).where("lack > target / 2")
    # a tag without any sample of set 0 has no rounds
    sizes = repeats.groupBy("tag", "set_no").agg(F.count("*").alias("_n"))
    some = sizes.where("set_no = 0").select("tag")
    rounds = sizes.join(some, "tag", "left_semi").withColumn("round", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda i: i * 3 + F.col("set_no").cast("int"))))
    before = Window.partitionBy("tag").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    rounds = rounds.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(still.select("tag", "lack"), "tag")
    rounds = rounds.withColumn("_take", F.least(F.col("_n"), F.col("lack") - F.col("_before"))).where("_take > 0")
    again = repeats.join(rounds.select("tag", "set_no", "round", "_take"), ["tag", "set_no"])
    again = again.withColumn("_o", keyed_order(seed, F.col("round"), F.col("tag"), F.col("sample_id"))).withColumn("_p", hashed_run(F.col("_o")))
    again = sums_before(again, ["tag", "round"], ["_p"], ["_o", "sample_id"], {"_r": F.lit(1)}).where("_r < _take")
    return spare.withColumn("round", F.lit(0)).unionByName(again.select("sample_id", "tag", (F.col("round") + 1).alias("round")))


def keyed_beta(seed: int, alpha: float, *keys: Column, tries: int = 8) -> Column:
    """A number with the Beta(alpha, alpha) distribution made from keys: the first of ``tries`` pairs of powers of uniforms whose sum is at most 1.

    With alpha 0.2 a pair fails with a chance of 5 %; if all fail, the last pair's ratio is taken.
    """
    x, y = ([F.pow(keyed_uniform(seed, F.lit(name), *keys, F.lit(i)), F.lit(1 / alpha)) for i in range(tries)] for name in ("x", "y"))
    ratio = [a / F.nullif(a + b, F.lit(0.0)) for a, b in zip(x, y)]
    return F.coalesce(*[F.when(a + b <= 1, q) for a, b, q in zip(x, y, ratio)], ratio[-1], F.lit(0.5))


def mix_rows(values_1: Column, values_2: Column, y_1: Column, y_2: Column, share: Column, soft: bool = True) -> tuple[Column, Column]:
    """Arrays and label arrays mixed by a share; with ``soft`` false the labels are those of the larger share (the second on a tie)."""
    weight = share if soft else F.when(share > 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    blend = lambda a, b, w: let(w, lambda k: F.zip_with(a, b, lambda u, v: k * u.cast("double") + (1 - k) * v.cast("double")))
    return blend(values_1, values_2, share), blend(y_1, y_2, weight)


def mixup(df: DataFrame, key: str, values: str, y: str, seed: int = 1, alpha: float = 0.2, chance: float = 0.25, soft: bool = True, run_rows: int = 10_000) -> DataFrame:
    """Each row mixed with a partner: ``key, partner, share, values, y``; the share is Beta(alpha, alpha), or 0 except with ``chance``.

    A share of 0 leaves the partner's row. Partners are neighbours in a keyed order, the last with the first, within
    hashed runs of about ``run_rows``, whose number comes from a count.
    """
    runs = max(1, df.count() // run_rows)
    d = df.select(key, values, y).withColumn("_run", F.pmod(F.xxhash64(F.col(key)), F.lit(runs)))
    order = Window.partitionBy("_run").orderBy(keyed_order(seed, F.col(key)), key)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.struct(F.col(key).alias("k"), F.col(values).alias("v"), F.col(y).alias("y"))
    d = d.withColumn("_o", F.coalesce(F.lead(other).over(order), F.first(other).over(whole)))
    hit = keyed_uniform(seed, F.lit("chance"), F.col(key)) < chance
    d = d.withColumn("share", F.when(hit, keyed_beta(seed, alpha, F.col(key))).otherwise(F.lit(0.0)))
    v, w = mix_rows(F.col(values), F.col("_o.v"), F.col(y), F.col("_o.y"), F.col("share"), soft)
    return d.select(key, F.col("_o.k").alias("partner"), "share", v.alias(values), w.alias(y))


def offline_mix(df: DataFrame, key: str, values: str, y: str, text: str, track: str, seed: int = 1, run_rows: int = 10_000, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Every row mixed with a partner, as rows of their own to be stored: all columns of the first, changed as follows.

    ``share`` lies in [0.2, 0.8] by key; ``values`` and ``y`` are weighted by it, ``y`` clipped to [0, 1]. Texts of both are joined by
    newlines. ``track`` (ids separated by blanks) becomes one id a line, of both rows. A mixture has no place: ``lat`` and ``lng`` are -1.
    Partners are as in :func:`mixup`: neighbours in a keyed order within hashed runs. Null texts and tracks count for nothing.
    """
    runs = max(1, df.count() // run_rows)
    run = F.pmod(F.xxhash64(F.col(key)), F.lit(runs))
    order = Window.partitionBy("_run").orderBy(keyed_order(seed, F.col(key)), key)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.struct(F.col(key).alias("k"), F.col(values).alias("v"), F.col(y).alias("y"), F.col(text).alias("text"), F.col(track).alias("track"))
    d = df.withColumn("_run", run).withColumn("_o", F.coalesce(F.lead(other).over(order), F.first(other).over(whole)))
    d = d.withColumn("share", F.lit(0.2) + F.lit(0.6) * keyed_uniform(seed, F.lit("mix"), F.col(key)))
    mix = lambda a, b: F.zip_with(a, b, lambda p, q: F.col("share") * p.cast("double") + (1 - F.col("share")) * q.cast("double"))
    lines = lambda *c: F.concat_ws("\n", *c)
    ids = F.array_join(F.split(F.concat_ws(" ", F.col(track), F.col("_o.track")), " "), "\n")
    d = d.withColumns(
        {
            values: mix(F.col(values), F.col("_o.v")),
            y: F.transform(mix(F.col(y), F.col("_o.y")), lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))),
            text: lines(F.col(text), F.col("_o.text")),
            track: ids,
            lat: F.lit(-1.0),
            lng: F.lit(-1.0),
            "partner": F.col("_o.k"),
        }
    )
    return d.drop("_run", "_o")
