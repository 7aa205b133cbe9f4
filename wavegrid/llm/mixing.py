"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.llm.common import WORD, materialize, quoted, set_apart

#: Runs of one size class that a source is split into, so that no source is ordered in one task.
SALTS = 32


def _md5_share(*parts) -> F.Column:
    """A number in [0, 1) that depends on the parts only."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``: one row per source.

    Weights repeat over the sources in code-point order, null last. All targets together make ``budget`` times
    all sizes; a target stops at ``cap`` times its source's size and the excess is shared again by weight until
    none is above. Sorted by size over weight, the sources that stop come first, so one running sum finds them.
    The tables here have a row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight)
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(budget)) * F.sum("source_size").over(every) - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    full = F.lit(float(cap)) * F.col("source_size")
    s = s.withColumn("_share", share).withColumn("_full", full <= F.col("weight") * F.col("_share"))
    level = F.min(F.when(~F.col("_full"), F.struct(F.col("source_size") / F.col("weight"), F.col("_share")))).over(every)["_share"]
    s = s.withColumn("_level", level)
    return s.withColumn("target", F.when(F.col("_full"), full).otherwise(F.col("weight") * F.col("_level"))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, cap: float = 2.0, seed: int = 11) -> DataFrame:
    """Adds ``size, source_size, target, copies, taken`` to every document (``doc_id, text, source`` and others).

    Within a source each document expects target / source_size copies. The expected copies are summed up along an
    order (size class, hashed run, size, hash of the id), one random offset per source is added, and a document is
    emitted once for each whole number its stretch crosses. Neighbours in that order are of like size, so the
    words taken come near the target, within about the largest document.

    The order is never sorted in one task: rows are counted by (source, size class, run), the counts are summed
    up, and only rows of one run are ranked together. The rank times the rate is the prefix sum.

    A null text has size 0; a null source is a source of its own, last in order; a null id is ordered as such.
    Repeated rows are drawn for each by itself. Sources without words get target 0. Empty tables give no rows.
    Columns of the added names are replaced, others kept whatever their names are.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    docs, named = set_apart(docs, {"doc_id": "doc_id", "text": "text", "source": "source"}, added)
    names = docs.columns
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint")
    bits = F.length(F.bin("size"))
    rows = docs.withColumn("size", size)
    rows = rows.withColumn("__wg_class", (bits * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))")).cast("int"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"))
    rows = rows.withColumn("__wg_key", key).withColumn("__wg_run", (F.conv(F.substring("__wg_key", 1, 4), 16, 10).cast("int") % SALTS))
    runs = materialize(rows.groupBy("source", "__wg_class", "__wg_run").agg(F.count("*").alias("__wg_n"), F.sum("size").alias("__wg_words")), "mix-runs")
    targets = source_targets(runs.groupBy("source").agg(F.sum("__wg_words").alias("source_size")), weights, budget, cap)
    before = Window.partitionBy("source").orderBy("__wg_class", "__wg_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__wg_before", F.coalesce(F.sum("__wg_n").over(before), F.lit(0))).select("source", "__wg_class", "__wg_run", "__wg_before")
    offset = _md5_share(F.lit(str(seed)), F.lit("offset"), F.coalesce(F.col("r.source"), F.lit("(none)")))
    facts = runs.alias("r").join(targets.alias("t"), F.expr("r.source <=> t.source")).select("r.*", "t.source_size", "t.target", offset.alias("__wg_u"))
    facts = facts.withColumnsRenamed({"source": "__wg_source", "__wg_class": "__wg_fclass", "__wg_run": "__wg_frun"})
    rank = F.row_number().over(Window.partitionBy("source", "__wg_class", "__wg_run").orderBy("size", "__wg_key", F.col("doc_id").asc_nulls_last()))
    ranked = rows.withColumn("__wg_rank", rank)
    joined = ranked.join(facts, F.expr("source <=> __wg_source and __wg_class = __wg_fclass and __wg_run = __wg_frun"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.col("__wg_before") + F.col("__wg_rank")
    copies = F.floor(F.col("__wg_u") + upto * rate) - F.floor(F.col("__wg_u") + (upto - 1) * rate)
    return named(joined.withColumn("copies", copies.cast("int")).withColumn("taken", F.col("copies") * F.col("size")).select(*names, *added))


def emit_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per copy, with the given columns; rows with no or null ``copies`` give none. Repeated rows are copied each by itself, nulls in other columns stay."""
    return mixed.where("copies > 0").withColumn("__wg_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*map(quoted, columns))
