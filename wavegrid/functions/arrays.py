"""Expressions on arrays of numbers, computed in double precision."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(a: str | Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once; an expression used in a lambda would be computed again for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _range(v: Column) -> Column:
    return F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi"))


def minmax(a: Column, eps: float = 1e-6) -> Column:
    """To [-1, 1]: 2 * (x - min) / (max - min + eps) - 1."""
    return let(a, lambda v: let(_range(v), lambda r: F.transform(v, lambda x: 2 * ((x - r["lo"]) / (r["hi"] - r["lo"] + eps)) - 1)))


def unit_minmax(a: Column) -> Column:
    """To [0, 1]; zeros where all are equal."""
    to_unit = lambda x, r: F.when(r["hi"] > r["lo"], (x - r["lo"]) / (r["hi"] - r["lo"])).otherwise(F.lit(0.0))
    return let(a, lambda v: let(_range(v), lambda r: F.transform(v, lambda x: to_unit(x, r))))


def standardize(a: Column) -> Column:
    """Less the mean, over the population deviation; zeros where there is none."""
    spread = lambda v, m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.nullif(F.size(v), F.lit(0)))
    facts = lambda v: let(array_sum(v) / F.nullif(F.size(v), F.lit(0)), lambda m: F.struct(m.alias("mean"), spread(v, m).alias("sd")))
    return let(a, lambda v: let(facts(v), lambda f: F.transform(v, lambda x: F.when(f["sd"] > 0, (x - f["mean"]) / f["sd"]).otherwise(F.lit(0.0)))))


def power_to_db(a: Column, floor: float = 1e-10, top: float = 80.0) -> Column:
    """10 log10 of the values, at least ``floor``, and nothing more than ``top`` below the largest."""
    db = F.transform(a, lambda x: 10 * F.log10(F.greatest(x, F.lit(floor))))
    return let(db, lambda v: let(F.array_max(v) - top, lambda low: F.transform(v, lambda x: F.greatest(x, low))))


def ema(a: Column, s: float = 0.04, block: int = 256, start: Column | None = None) -> Column:
    """Exponential moving average that begins with the first value, or goes on from ``start`` where that isn't null.

    Places are appended in blocks, as appending copies what is there.
    """
    blend = lambda last, x: F.coalesce((1 - s) * last + s * x, x)
    none = F.lit(None).cast("double") if start is None else start

    def one_block(last: Column, values: Column) -> Column:
        step = lambda acc, x: F.array_append(acc, blend(F.when(F.size(acc) == 0, last).otherwise(F.try_element_at(acc, F.lit(-1))), x))
        return F.aggregate(values, F.array().cast("array<double>"), step)

    def add(state: Column, values: Column) -> Column:
        return let(one_block(state["last"], values), lambda r: F.struct(F.try_element_at(r, F.lit(-1)).alias("last"), F.array_append(state["out"], r).alias("out")))

    def whole(v: Column) -> Column:
        places = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(block))).otherwise(F.array().cast("array<int>"))
        begin = F.struct(none.alias("last"), F.array().cast("array<array<double>>").alias("out"))
        return F.aggregate(F.transform(places, lambda p: F.slice(v, p, block)), begin, add, lambda state: F.flatten(state["out"]))

    return let(a, whole)


def running_sums(a: Column, block: int = 256) -> Column:
    """0 and the sums of the first 1, 2, ... values. Places are appended in blocks, as appending copies what is there."""

    def one_block(last: Column, values: Column) -> Column:
        step = lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), last) + x)
        return F.aggregate(values, F.array().cast("array<double>"), step)

    def add(state: Column, values: Column) -> Column:
        return let(one_block(state["last"], values), lambda r: F.struct(F.try_element_at(r, F.lit(-1)).alias("last"), F.array_append(state["out"], r).alias("out")))

    def whole(v: Column) -> Column:
        places = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(block))).otherwise(F.array().cast("array<int>"))
        begin = F.struct(F.lit(0.0).alias("last"), F.array(F.array(F.lit(0.0))).alias("out"))
        return F.aggregate(F.transform(places, lambda p: F.slice(v, p, block)), begin, add, lambda state: F.flatten(state["out"]))

    return let(a, whole)


def mean_and_deviation(a: Column) -> Column:
    """Struct ``mean, sd`` (population) of an array without its nulls; nulls if nothing is left."""
    n = lambda v: F.nullif(F.size(v), F.lit(0))
    spread = lambda v, m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n(v))
    known = F.filter(doubles(a), lambda x: x.isNotNull())
    return let(known, lambda v: let(array_sum(v) / n(v), lambda m: F.struct(m.alias("mean"), spread(v, m).alias("sd"))))


def pcen(a: Column, s: float = 0.04, gain: float = 0.98, bias: float = 2.0, root: float = 2.0, eps: float = 1e-6) -> Column:
    """Per-channel energy normalisation: (x / (eps + ema)^gain + bias)^(1/root) - bias^(1/root)."""
    return F.zip_with(a, ema(a, s), lambda x, m: F.pow(x / F.pow(F.lit(eps) + m, F.lit(gain)) + bias, F.lit(1 / root)) - bias ** (1 / root))


def has_bad(a: Column) -> Column:
    """Whether any value is null, not a number or infinite."""
    return F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def quality_flags(df: DataFrame, col: str, limit: float = 1.00002) -> DataFrame:
    """Flags of a payload: out of range, not finite, constant."""
    a = F.col(col)
    return df.withColumns(
        {
            "out_of_range": F.exists(a, lambda x: F.abs(x) > limit),
            "not_finite": has_bad(a),
            "constant": F.coalesce(F.array_min(a) == F.array_max(a), F.lit(True)),
        }
    )


def argmax(p: Column) -> Column:
    """Place (from 0) of the largest value, the first on ties; null for an empty array."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def ranked(p: Column) -> Column:
    """Structs (p, i), the largest first, the smaller place on ties."""
    return F.transform(F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("neg"), i.alias("i")))), lambda s: F.struct((-s["neg"]).alias("p"), s["i"].alias("i")))


def multi_hot(label_idx: Column, n: int) -> Column:
    """A 0/1 array of n places; indices below 0 count for nothing."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(label_idx, i.cast("int")).cast("int"))


def label_indices(text: Column, label_map: Column) -> Column:
    """Indices of newline-separated labels by a map column, without those that are unknown or below 0, each once, in order."""
    idx = F.transform(F.split(text, "\n"), lambda x: F.element_at(label_map, x))
    return F.array_sort(F.array_distinct(F.filter(idx, lambda i: i.isNotNull() & (i >= 0))))


def encode_labels(text: Column, label_map: Column, extra_map: Column, n: int, multi: bool = True) -> Column:
    """A 0/1 array of ``n`` places for newline-separated labels by a map and an extra map (a specific label's general one).

    With ``multi`` the indices of both count. Without, one place at most is set: the smallest index by the map, or, where the
    map has none, the smallest by the extra map. Unknown labels and indices below 0 or beyond ``n`` count for nothing, a null text neither.
    """
    inside = lambda m: F.filter(F.coalesce(label_indices(text, m), F.array().cast("array<int>")), lambda i: i < n)
    own, extra = inside(label_map), inside(extra_map)
    one = F.coalesce(F.array_min(own), F.array_min(extra))
    chosen = F.array_distinct(F.concat(own, extra)) if multi else F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<int>"))
    return let(chosen, lambda c: multi_hot(c, n))


def first_tag(tags: Column, last: tuple[str, ...] = ("noise", "bird")) -> Column:
    """The first tag that is none of the given ones, else the first."""
    return F.coalesce(F.get(F.filter(tags, lambda t: ~t.isin(*last)), F.lit(0)), F.get(tags, F.lit(0)))


def generic_shared(y: Column, generic: int, weight: float = 0.5) -> Column:
    """Label array with the generic label's weight lowered where a specific one is set."""
    other = lambda w: F.exists(F.transform(w, lambda v, i: (v > 0) & (i != generic)), lambda b: b)
    return let(y, lambda w: let(other(w), lambda o: F.transform(w, lambda v, i: F.when((i == generic) & o, v * weight).otherwise(v.cast("double")))))


def _scaled(a: Column, w: float) -> Column:
    return F.transform(a, lambda x: x * w)


def weighted_average(arrays: list[Column], weights: list[float]) -> Column:
    """Ensemble of probability arrays of one length."""
    parts = [_scaled(a, w / sum(weights)) for a, w in zip(arrays, weights)]
    return reduce(lambda p, q: F.zip_with(p, q, lambda x, y: x + y), parts)


def weighted_max(arrays: list[Column], weights: list[float]) -> Column:
    parts = [_scaled(a, w) for a, w in zip(arrays, weights)]
    return reduce(lambda p, q: F.zip_with(p, q, lambda x, y: F.greatest(x, y)), parts)


def elementwise_stats(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """``i, n, mean, sd`` of each place over all rows (of a group): population deviation."""
    long_ = df.select(*by, F.posexplode(col).alias("i", "v"))
    return long_.groupBy(*by, "i").agg(F.count("v").alias("n"), F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("sd"))
