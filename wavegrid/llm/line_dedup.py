"""Line deduplication across documents, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.llm.common import BLANKS, ascii_lower, materialize, maybe_broadcast, partitions, set_apart


def _lines(docs: DataFrame) -> F.Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _row_key() -> F.Column:
    """Tells rows apart that share an id; equal rows may share it, as they lose the same lines."""
    return F.xxhash64("text")


def line_keep_runs(docs: DataFrame, min_length: int = 20, min_docs: int = 3, hot_docs: int = 2000) -> DataFrame:
    """``doc_id, row_key, dropped``: for each document that loses lines, its keep bitmap in run-length form.

    ``dropped`` lists the runs (first, last) of line numbers whose bit is 0; all other lines are kept. A line's
    key is the line without blanks at both ends, A-Z lower-cased; keys of at least ``min_length`` code points in
    at least ``min_docs`` documents are kept only in the largest ``doc_id`` holding them.

    Hashes of the keys (two of 64 bits) are dealt out by range and sorted by document, the largest first, and
    position; a pass over each range keeps what comes with the first document of a hash. Keys in more than
    ``hot_docs`` documents, or more than an eighth of a range's fair share, would overload one range: these few
    (their number is bounded by that share) are counted with partial sums first and judged where they are read.

    Rows with null ids count as one document that comes before all others; null and empty texts are one empty
    line; repeated rows get the same runs.
    """
    spark = docs.sparkSession
    key = F.transform(
        _lines(docs),
        lambda x, i: F.struct(ascii_lower(F.btrim(x, F.lit(BLANKS))).alias("k"), i.alias("i")),
    )
    long_ones = F.filter(key, lambda s: F.char_length(s["k"]) >= min_length)
    occ = docs.select("doc_id", _row_key().alias("row_key"), F.explode(long_ones).alias("s"))
    occ = occ.select("doc_id", "row_key", F.xxhash64("s.k").alias("h1"), F.xxhash64("s.k", F.lit(1)).alias("h2"), F.col("s.i").alias("pos"))
    occ = materialize(occ, "line-hashes")

    per_doc = occ.select("h1", "h2", "doc_id").distinct()
    counts = per_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
    common = materialize(counts.where(F.col("n_docs") >= hot_docs), "line-common")
    fair = (occ.count() / (8 * partitions(spark))) if common.limit(1).count() else 0
    hot = common.where(F.col("n_docs") >= F.lit(max(float(hot_docs), fair)))
    hot = maybe_broadcast(hot.withColumnsRenamed({"h1": "g1", "h2": "g2", "n_docs": "hot_n"}), 64)
    at = occ.join(hot, F.expr("h1 = g1 and h2 = g2"), "left").drop("g1", "g2")

    hot_drop = at.where(F.col("hot_n") >= min_docs).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    cold = at.where("hot_n is null").select("doc_id", "row_key", "h1", "h2", "pos").repartitionByRange(partitions(spark), "h1", "h2")
    by_doc = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").desc_nulls_last())
    cold = cold.sortWithinPartitions("h1", "h2", F.col("doc_id").desc_nulls_last(), "pos").withColumn("nth", F.dense_rank().over(by_doc))
    cold = cold.withColumn("n_docs", F.max("nth").over(Window.partitionBy("h1", "h2")))
    cold_drop = cold.where((F.col("n_docs") >= min_docs) & (F.col("nth") > 1))

    lost = hot_drop.select("doc_id", "row_key", "pos").unionByName(cold_drop.select("doc_id", "row_key", "pos"))
    per_row = lost.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    first = F.filter("p", lambda x, i: (i == 0) | (F.element_at(F.col("p"), F.greatest(i, F.lit(1))) != x - 1))
    last = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.element_at(F.col("p"), F.least(i + 2, F.size("p"))) != x + 1))
    runs = F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    return per_row.select("doc_id", "row_key", runs.alias("dropped"))


def apply_keep_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds ``n_lines, n_dropped, kept_text`` to the documents, from the runs of :func:`line_keep_runs`; columns of these names are replaced."""
    docs, named = set_apart(docs, {"doc_id": "doc_id", "text": "text"}, ["n_lines", "n_dropped", "kept_text"])
    runs = runs.withColumnsRenamed({"doc_id": "__wg_doc", "row_key": "__wg_row", "dropped": "__wg_dropped"})
    both = docs.withColumn("__wg_key", _row_key()).join(runs, F.expr("doc_id <=> __wg_doc and __wg_key = __wg_row"), "left")
    lines = _lines(docs)
    gone = F.coalesce(F.aggregate("__wg_dropped", F.lit(0).cast("bigint"), lambda a, r: a + r["last"] - r["first"] + 1), F.lit(0).cast("bigint"))

    def cut(all_: F.Column) -> F.Column:
        """The stretches between the runs, in one pass over lines that are split once."""
        begin = F.concat(F.array(F.lit(0)), F.transform("__wg_dropped", lambda r: r["last"] + 1))
        end = F.concat(F.transform("__wg_dropped", lambda r: r["first"]), F.array(F.size(all_)))
        return F.array_join(F.flatten(F.zip_with(begin, end, lambda a, b: F.slice(all_, a + 1, b - a))), "\n")

    kept = F.when(F.col("__wg_dropped").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.get(F.transform(F.array(lines), cut), F.lit(0)))
    out = both.withColumns({"n_lines": F.size(lines).cast("bigint"), "n_dropped": gone, "kept_text": kept})
    return named(out.drop("__wg_doc", "__wg_row", "__wg_key", "__wg_dropped"))
