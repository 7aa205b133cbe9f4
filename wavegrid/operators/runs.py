"""Running sums, and prefixes of any associative aggregate, within groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.sources.scratch import written


def sums_before(df: DataFrame, by: list[str], run: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Adds to each row, for every name in ``sums``, the sum of that expression over earlier rows of its group ``by``.

    Rows are ordered by the columns ``run``, ascending and nulls last, then by ``order``. Runs are summed first, and a group
    is only ordered as its table of runs, so no task sorts more rows than a run has. Null keys are a group of their own;
    without ``by`` all rows are one group.
    """
    keyed = df.withColumn("_run", F.struct(*by, *run))
    inside = Window.partitionBy("_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*[f"_run.{c}" for c in by]).orderBy(*[F.col(f"_run.{c}").asc_nulls_last() for c in run]).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    runs = keyed.groupBy("_run").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    offsets = runs.select("_run", *[F.coalesce(F.sum(k).over(earlier), zero).alias(f"_from_{k}") for k in sums])
    ranked = keyed.withColumns({f"_in_{k}": F.coalesce(F.sum(c).over(inside), zero) for k, c in sums.items()})
    out = ranked.join(offsets, "_run")
    return out.select(*[c for c in df.columns if c not in sums], *[(F.col(f"_from_{k}") + F.col(f"_in_{k}")).alias(k) for k in sums])


def hashed_run(order: Column) -> Column:
    """One of 4,096 runs of a keyed order: the first three hex digits of its md5, so runs follow each other as the order does."""
    return F.substring(order, 1, 3)


def runs_for(df: DataFrame, least: int, run_rows: int) -> int:
    """As many runs as keep one at about ``run_rows`` rows, by a count, and ``least`` at the least."""
    return max(least, df.count() // run_rows)


def score_run(p: Column) -> Column:
    """Runs of falling scores: cells of the log odds, as scores crowd at both ends. Scores of 1 and above come first, of 0 and below last, nulls after them."""
    cell = F.floor(F.log(p / (1 - p)) * 64)
    return -F.when(p >= 1, F.lit(1 << 20)).when(p <= 0, F.lit(-(1 << 20))).otherwise(cell)


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows, written, with ``_pos``: the place (from 0) of each in its group ``by`` along ``order``, nulls first.

    Ranges of the order are sorted each in its task and numbered there. What is summed up over tasks is a row for each range and
    group; a group of any size is spread over as many ranges as it needs. Rows equal in ``order`` follow each other in no
    certain way.
    """
    drawn = written(df.withColumn("_tie", F.monotonically_increasing_id()), "runs-rows")
    keys = [*by, *order, "_tie"]
    ranged = drawn.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged.drop("_tie"), "runs-ranges")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    group = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    sizes = ranged.groupBy(group.alias("_of"), part.alias("_part")).agg(F.count("*").alias("n"), F.min(inside).alias("_first"))
    before = Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_of", "_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = ranged.withColumns({"_of": group, "_part": part}).join(shifts, ["_of", "_part"])
    return placed.select(*df.columns, (inside + F.col("_shift")).alias("_pos"))


def prefix(df: DataFrame, by: list[str], order: list[str], value: Column, combine: Callable[[Column, Column], Column], zero: Column, name: str = "before", inclusive: bool = False, block: int = 512) -> DataFrame:
    """Adds ``name``: the combination of ``value`` over all earlier rows of the group ``by``, along ``order``; ``zero`` for the first row.

    ``combine(earlier, later)`` may be any associative expression with ``zero`` as its neutral value: sums, the largest so far, the
    last that isn't null, linear maps one after another. With ``inclusive`` the row itself counts, too.

    A tree over the places: blocks of ``block`` rows are combined, then blocks of blocks, until a group is one block; on the way
    back each block begins with what came before it. No task holds more than a block of a group at a time, whatever the
    group's size, and there are as many levels as the logarithm of the largest group to the base of ``block``.
    Rows equal in ``order`` follow each other in no certain way, and null keys are a group of their own.
    """
    kind = zero_type(df, zero)
    zero = zero.cast(kind)
    placed = written(numbered(df.withColumn("_v", value.cast(kind)), by, order), "prefix-rows")
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_"))
    leaf = placed.select(group.alias("_of"), F.col("_pos").alias("_n"), "_v", F.struct(*df.columns).alias("_row"))

    def blocks(rows: DataFrame, more: list[str]) -> DataFrame:
        """Rows of a block in order, and their combination."""
        got = rows.groupBy("_of", F.expr(f"_n div {block}").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_n", "_v", *more)), _by_place).alias("_rows"))
        return written(got.withColumn("_v", F.aggregate("_rows", zero, lambda a, r: combine(a, r["_v"]).cast(kind))), "prefix-blocks")

    levels = [blocks(leaf, ["_row"])]
    while levels[-1].where("_block > 0").limit(1).count():
        levels.append(blocks(levels[-1].select("_of", F.col("_block").alias("_n"), "_v"), []))

    def spread(level: DataFrame, starts: DataFrame | None) -> DataFrame:
        """Each row of the blocks with what comes before it."""
        begun = level.withColumn("_start", zero) if starts is None else level.join(starts, ["_of", "_block"])
        step = lambda s, r: F.struct(combine(s["at"], r["_v"]).cast(kind).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
        first = F.struct(F.col("_start").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        seen = F.aggregate("_rows", first, step, lambda s: s["out"])
        return begun.withColumn("_z", F.arrays_zip(F.col("_rows").alias("r"), seen.alias("before"))).select("_of", F.explode("_z").alias("_z"))

    starts = None
    for level in reversed(levels[1:]):
        starts = spread(level, starts).select("_of", F.col("_z.r._n").alias("_block"), F.col("_z.before").alias("_start"))
    out = spread(levels[0], starts)
    got = combine(F.col("_z.before"), F.col("_z.r._v")).cast(kind) if inclusive else F.col("_z.before")
    return out.select("_z.r._row.*", got.alias(name))


def _by_place(a: Column, b: Column) -> Column:
    return F.when(a["_n"] < b["_n"], -1).when(a["_n"] > b["_n"], 1).otherwise(0)


def zero_type(df: DataFrame, zero: Column) -> str:
    return df.select(zero.alias("z")).schema["z"].dataType.simpleString()

