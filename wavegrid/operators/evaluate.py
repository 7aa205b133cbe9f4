"""Evaluating predictions: rows ``row_id, y_true, probs`` (an array with a probability per label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.functions.arrays import argmax, ranked
from wavegrid.operators.runs import score_run, sums_before
from wavegrid.operators.sizes import small

#: The column for rows without a prediction.
NONE = -1


def decide(probs: Column, threshold: float = 0.7) -> Column:
    return F.when(F.array_max(probs) > threshold, argmax(probs)).otherwise(F.lit(NONE))


def full_matrix(pairs: DataFrame, n_labels: int) -> DataFrame:
    """``true_i, pred_i, n`` for all label pairs and None, from counted pairs."""
    i = F.sequence(F.lit(0), F.lit(n_labels - 1))
    cells = pairs.sparkSession.range(1).select(F.explode(i).alias("true_i")).withColumn("pred_i", F.explode(F.concat(i, F.array(F.lit(NONE)))))
    n = pairs.groupBy("true_i", "pred_i").agg(F.count("*").alias("n"))
    return cells.join(small(n, 32), ["true_i", "pred_i"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion(preds: DataFrame, n_labels: int, threshold: float = 0.7) -> DataFrame:
    return full_matrix(preds.select(F.col("y_true").alias("true_i"), decide(F.col("probs"), threshold).alias("pred_i")), n_labels)


def row_percent(matrix: DataFrame) -> DataFrame:
    """Share of each row in percent; 0 for empty rows."""
    total = F.sum("n").over(Window.partitionBy("true_i"))
    return matrix.withColumn("percent", F.when(total > 0, F.col("n") * 100.0 / total).otherwise(F.lit(0.0)))


def label_rates(matrix: DataFrame) -> DataFrame:
    """Per label tp, fp, fn, tn and precision, recall, F1 (0 where undefined)."""
    total = matrix.agg(F.sum("n").alias("total"))
    own = matrix.groupBy("true_i").agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("true_i") == F.col("pred_i"), F.col("n")).otherwise(0)).alias("tp"))
    pred = matrix.where(F.col("pred_i") != NONE).groupBy(F.col("pred_i").alias("true_i")).agg(F.sum("n").alias("predicted"))
    r = own.join(pred, "true_i", "left").crossJoin(F.broadcast(total)).withColumn("predicted", F.coalesce("predicted", F.lit(0)))  # one row is broadcast
    r = r.withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("actual") - F.col("tp"))
    r = r.withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))

    def rate(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    f1 = rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return r.select(F.col("true_i").alias("label_i"), "tp", "fp", "fn", "tn", rate(F.col("tp"), F.col("predicted")).alias("precision"), rate(F.col("tp"), F.col("actual")).alias("recall"), f1.alias("f1"))


def multi_confusion(preds: DataFrame, threshold: float, generic: int, fallback: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Pairs ``true_i, pred_i`` of multi-label rows (``y`` is a 0/1 array): the main ones, and those of rows without any prediction.

    A predicted label that isn't true is charged to every true label; a true one that is predicted is a hit, one that
    isn't goes to None. Where nothing passes the threshold, the best label of at least ``fallback`` that isn't true is
    charged in the second table; the generic label gives way to the runner-up there.
    """
    long_ = preds.select("row_id", "y", "probs", F.posexplode(F.arrays_zip(F.col("y"), F.col("probs"))).alias("i", "c"))
    y, p = F.col("c.y"), F.col("c.probs")
    true = F.filter(F.transform("y", lambda v, i: F.when(v == 1, i)), lambda v: v.isNotNull())
    wrong = long_.where((y == 0) & (p >= threshold)).select(F.explode(true).alias("true_i"), F.col("i").alias("pred_i"))
    own = long_.where(y == 1).select(F.col("i").alias("true_i"), F.when(p >= threshold, F.col("i")).otherwise(F.lit(NONE)).alias("pred_i"))
    top = ranked(F.col("probs"))
    best, second = F.element_at(top, 1), F.element_at(top, 2)
    best = F.when((best["i"] == generic) & (second["p"] != 0), second).otherwise(best)
    rest = preds.withColumn("_b", best).where((F.array_max("probs") < threshold) & (F.col("_b.p") >= fallback) & ~F.array_contains(true, F.col("_b.i")))
    none = rest.select(F.explode(true).alias("true_i"), F.col("_b.i").alias("pred_i"))
    return wrong.unionByName(own), none


def track_decision(windows: DataFrame, how: str, threshold: float = 0.7) -> DataFrame:
    """``track_id, pred_i, p`` from windows ``track_id, k, probs``: by ``mean``, ``max`` or ``vote``.

    A vote counts windows whose best label is above the threshold; ties, and tracks without votes, go by the mean.
    """
    long_ = windows.select("track_id", F.posexplode("probs").alias("i", "p"))
    by = long_.groupBy("track_id", "i").agg(F.round(F.avg("p"), 9).alias("mean"), F.max("p").alias("max"))
    if how in ("mean", "max"):
        best = by.groupBy("track_id").agg(F.max_by(F.struct("i", F.col(how).alias("p")), F.struct(how, -F.col("i"))).alias("b"))
        return best.select("track_id", F.when(F.col("b.p") > threshold, F.col("b.i")).otherwise(F.lit(NONE)).alias("pred_i"), F.col("b.p").alias("p"))
    votes = windows.withColumn("i", decide(F.col("probs"), threshold)).where(F.col("i") != NONE).groupBy("track_id", "i").agg(F.count("*").alias("votes"))
    all_ = by.join(votes, ["track_id", "i"], "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    best = all_.groupBy("track_id").agg(F.max_by(F.struct("i", F.col("mean").alias("p"), "votes"), F.struct("votes", "mean", -F.col("i"))).alias("b"))
    ok = (F.col("b.votes") > 0) | (F.col("b.p") > threshold)
    return best.select("track_id", F.when(ok, F.col("b.i")).otherwise(F.lit(NONE)).alias("pred_i"), F.col("b.p").alias("p"))


def f1_scores(preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: macro F1 at the threshold, macro soft F1 cost, macro double soft F1 cost, of ``y`` (0/1 array) and ``probs``."""
    long_ = preds.select(F.posexplode(F.arrays_zip(F.col("y"), F.col("probs"))).alias("i", "c"))
    y, p = F.col("c.y").cast("double"), F.col("c.probs").cast("double")
    hard = (p > threshold).cast("double")
    s = long_.groupBy("i").agg(
        *[F.sum(a * b).alias(n) for n, a, b in (("tp", hard, y), ("fp", hard, 1 - y), ("fn", 1 - hard, y))],
        *[F.sum(a * b).alias(n) for n, a, b in (("stp", p, y), ("sfp", p, 1 - y), ("sfn", 1 - p, y), ("stn", 1 - p, 1 - y))],
    )
    f1 = lambda t, a, b: 2 * F.col(t) / (2 * F.col(t) + F.col(a) + F.col(b) + 1e-16)
    soft, zero = 1 - f1("stp", "sfn", "sfp"), 1 - f1("stn", "sfn", "sfp")
    return s.agg(F.avg(f1("tp", "fn", "fp")).alias("macro_f1"), F.avg(soft).alias("soft_f1_cost"), F.avg((soft + zero) / 2).alias("double_soft_f1_cost"))


def precision_at_k(preds: DataFrame, k: int = 3, generic: int | None = None, weights: list[float] | None = None) -> DataFrame:
    """One row: of the first k true labels of all rows, the share among the k best predictions; zeros are no labels, the generic label may be left out.

    With ``weights``, one for each label, hits and labels count by them.
    """
    keep = (lambda i: i != generic) if generic is not None else (lambda i: F.lit(True))
    top = lambda c: F.transform(F.slice(F.filter(ranked(F.col(c).cast("array<double>")), lambda s: (s["p"] > 0) & keep(s["i"])), 1, k), lambda s: s["i"])
    if weights is None:
        r = preds.select(F.size(F.array_intersect(top("y"), top("probs"))).alias("hit"), F.size(top("y")).alias("n"))
        return r.agg((F.sum("hit") / F.greatest(F.sum("n"), F.lit(1))).alias("precision_at_k"))
    w = F.array(*map(F.lit, weights))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, i: s + F.get(w, i))
    r = preds.select(total(F.array_intersect(top("y"), top("probs"))).alias("hit"), total(top("y")).alias("n"))
    return r.agg((F.sum("hit") / F.when(F.sum("n") > 0, F.sum("n")).otherwise(F.lit(1.0))).alias("precision_at_k"))


def best_thresholds(preds: DataFrame, n_labels: int) -> DataFrame:
    """``label_i, threshold, f1``: per label the score that as a threshold has the best F1 (0/0 counts 0), the smallest on ties; 0 for labels without positives.

    Equal scores are one point of the curve. Counts are summed by (label, score), and running sums go by cells of the score,
    so no label's scores are ordered in one task.
    """
    long_ = preds.select("y_true", F.posexplode("probs").alias("label_i", "p"))
    by = long_.groupBy("label_i", "p").agg(F.sum((F.col("y_true") == F.col("label_i")).cast("long")).alias("pos"), F.count("*").alias("n"))
    total = long_.groupBy("label_i").agg(F.sum((F.col("y_true") == F.col("label_i")).cast("long")).alias("total"))
    c = sums_before(by.withColumn("run", score_run(F.col("p"))), ["label_i"], ["run"], [F.desc("p")], {"tp": F.col("pos"), "pred": F.col("n")})
    c = c.join(total, "label_i").withColumns({"tp": F.col("tp") + F.coalesce("pos", F.lit(0)), "pred": F.col("pred") + F.col("n")})
    c = c.withColumn("f1", F.round(2 * F.col("tp") / (F.col("pred") + F.col("total")), 9))
    best = c.where("total > 0").groupBy("label_i").agg(F.max_by(F.struct("p", "f1"), F.struct("f1", -F.col("p"))).alias("b"))
    labels = preds.sparkSession.range(n_labels).select(F.col("id").cast("int").alias("label_i"))
    return labels.join(best, "label_i", "left").select("label_i", F.coalesce("b.p", F.lit(0.0)).alias("threshold"), F.coalesce("b.f1", F.lit(0.0)).alias("f1"))


def two_stage(main: DataFrame, pre: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``track_id, pred_i``: the main model's confident label, else the pre-model's, else None; tracks of either model."""
    a = main.select("track_id", F.col("pred_i").alias("_a"), F.col("p").alias("_pa"))
    b = pre.select("track_id", F.col("pred_i").alias("_b"), F.col("p").alias("_pb"))
    pick = F.when(F.col("_pa") > threshold, F.col("_a")).when(F.col("_pb") > threshold, F.col("_b")).otherwise(F.lit(NONE))
    return a.join(b, "track_id", "full_outer").select("track_id", pick.alias("pred_i"))


def compare_models(first: DataFrame, second: DataFrame, generic: int | None = None) -> DataFrame:
    """Per label of two matrices: hits, totals, accuracy and None share in whole percent (half to even), and the label most confused with.

    The generic label and None don't count as confusions; without any, the label is null.
    """

    def one(m: DataFrame, s: str) -> DataFrame:
        wrong = (F.col("true_i") != F.col("pred_i")) & (F.col("pred_i") != NONE) & (F.col("n") > 0)
        if generic is not None:
            wrong &= F.col("pred_i") != generic
        a = m.groupBy("true_i").agg(
            F.sum("n").alias("total"),
            F.sum(F.when(F.col("true_i") == F.col("pred_i"), F.col("n")).otherwise(0)).alias("hits"),
            F.sum(F.when(F.col("pred_i") == NONE, F.col("n")).otherwise(0)).alias("none"),
            F.max_by("pred_i", F.when(wrong, F.struct("n", -F.col("pred_i")))).alias("worst"),
        )
        share = lambda c: F.when(F.col("total") > 0, F.bround(100.0 * F.col(c) / F.col("total"))).otherwise(F.lit(0.0))
        return a.select("true_i", *[x.alias(f"{n}_{s}") for n, x in (("total", F.col("total")), ("hits", F.col("hits")), ("accuracy", share("hits")), ("none_share", share("none")), ("worst", F.col("worst")))])

    return one(first, "1").join(one(second, "2"), "true_i", "left").withColumn("diff", F.col("hits_1") - F.col("hits_2"))


def losses(preds: DataFrame, smoothing: float = 0.0) -> DataFrame:
    """One row: mean binary and categorical cross entropy of ``y`` and ``probs``, probabilities clipped at 1e-7."""
    clip = lambda x: F.least(F.greatest(x.cast("double"), F.lit(1e-7)), F.lit(1 - 1e-7))
    n = F.size("y")
    smooth = F.transform("y", lambda v: v.cast("double") * (1 - smoothing) + smoothing / 2)
    bce = F.aggregate(F.zip_with(smooth, F.col("probs"), lambda v, p: -(v * F.log(clip(p)) + (1 - v) * F.log(1 - clip(p)))), F.lit(0.0), lambda a, x: a + x) / n
    soft = F.transform("y", lambda v: v.cast("double") * (1 - smoothing) + smoothing / n)
    ce = F.aggregate(F.zip_with(soft, F.col("probs"), lambda v, p: -v * F.log(clip(p))), F.lit(0.0), lambda a, x: a + x)
    return preds.agg(F.avg(bce).alias("bce"), F.avg(ce).alias("ce"))


def label_distribution(labels: DataFrame, n_labels: int) -> DataFrame:
    """``label_i, n`` with zeros for labels not seen."""
    n = labels.groupBy("label_i").agg(F.count("*").alias("n"))
    every = labels.sparkSession.range(n_labels).select(F.col("id").cast("int").alias("label_i"))
    return every.join(n, "label_i", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_weights(dist: DataFrame, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """total / (labels seen) / n, within the bounds; 0 for labels not seen."""
    facts = dist.agg(F.sum("n").alias("_total"), F.sum((F.col("n") > 0).cast("int")).alias("_seen"))
    w = F.least(F.greatest(F.col("_total") / F.col("_seen") / F.col("n"), F.lit(low)), F.lit(high))
    return dist.crossJoin(F.broadcast(facts)).withColumn("weight", F.when(F.col("n") > 0, w).otherwise(F.lit(0.0))).drop("_total", "_seen")  # one row is broadcast


def share_histogram(shares: DataFrame, label: str, share: str, scale: int = 10) -> DataFrame:
    """Counts by label and bround(share * scale), all buckets 0 to scale."""
    n = shares.select(label, F.bround(F.col(share) * scale).cast("int").alias("bucket")).groupBy(label, "bucket").agg(F.count("*").alias("n"))
    every = shares.select(label).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(scale))))
    return every.join(n, [label, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def most_confused(matrix: DataFrame) -> DataFrame:
    """Per label the wrong label with most rows, the smallest on ties; labels without errors are left out."""
    wrong = matrix.where((F.col("true_i") != F.col("pred_i")) & (F.col("pred_i") != NONE) & (F.col("n") > 0))
    return wrong.groupBy("true_i").agg(F.max_by(F.struct("pred_i", "n"), F.struct("n", -F.col("pred_i"))).alias("b")).select("true_i", "b.*")


def accuracy_by_share(matrix: DataFrame, counts: DataFrame) -> DataFrame:
    """``label_i, share, accuracy``: each label's part of the training rows (``label_i, n``) beside its accuracy, the largest share first."""
    total = counts.agg(F.sum("n").alias("_total"))
    acc = label_rates(matrix).select("label_i", F.col("recall").alias("accuracy"))
    s = counts.crossJoin(F.broadcast(total)).select("label_i", (F.col("n") / F.col("_total")).alias("share"))  # one row is broadcast
    return s.join(acc, "label_i", "left").orderBy(F.desc("share"), "label_i")


def folder_accuracy(decisions: DataFrame, bird_labels: list[int]) -> DataFrame:
    """One row from ``label_i, pred_i``: hits on the folder's label, and agreement on bird or not."""
    bird = lambda c: F.coalesce(F.col(c).isin(bird_labels), F.lit(False))
    return decisions.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label_i") == F.col("pred_i")).alias("hits"),
        F.count_if(bird("label_i") == bird("pred_i")).alias("bird_hits"),
    )


def species_result(probs: Column, names: Column, threshold: float) -> Column:
    """Structs (name, percent) of labels over the threshold, else of the best label alone."""
    all_ = F.transform(ranked(probs), lambda s: F.struct(F.get(names, s["i"]).alias("name"), F.bround(s["p"] * 100).cast("int").alias("percent"), s["p"].alias("p")))
    over = F.filter(all_, lambda s: s["p"] > threshold)
    return F.transform(F.when(F.size(over) > 0, over).otherwise(F.slice(all_, 1, 1)), lambda s: F.struct(s["name"].alias("name"), s["percent"].alias("percent")))


def bad_tracks(rows: DataFrame, birds: list[int], others: list[int]) -> DataFrame:
    """Rows labelled as birds (``label_idx``) whose predictions (``pred_idx``) are noise or human and no bird."""
    b, o = (F.array(*map(F.lit, x)) for x in (birds, others))
    return rows.where(F.arrays_overlap("label_idx", b) & F.arrays_overlap("pred_idx", o) & ~F.arrays_overlap("pred_idx", b))


def _mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _clipped(p: Column) -> Column:
    return F.least(F.greatest(p.cast("double"), F.lit(1e-7)), F.lit(1 - 1e-7))


def weighted_bce(y: Column, probs: Column) -> Column:
    """Binary cross entropy of a row whose labels are weights: any above 0 is a positive, its term weighed by it."""
    term = lambda v, p: F.when(v > 0, v.cast("double") * F.log(_clipped(p) + 1e-7)).otherwise(F.log(1 - _clipped(p) + 1e-7))
    return -_mean_of(F.zip_with(y, probs, term))


def sigmoid_bce(y: Column, logits: Column) -> Column:
    """Binary cross entropy of a row's logits; log1p of the exponential of the negative absolute value keeps it finite."""
    soft = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    return _mean_of(F.zip_with(y, logits, lambda v, x: v.cast("double") * soft(-x.cast("double")) + (1 - v.cast("double")) * soft(x.cast("double"))))


def masked_ce(y: Column, possible: Column, probs: Column) -> Column:
    """Cross entropy of a row in which only labels that are ``possible`` (0/1) are held against it where they are not set."""
    z = F.arrays_zip(y.alias("y"), possible.alias("m"), probs.alias("p"))
    term = lambda s: (1 - s["y"].cast("double")) * F.log(1 - _clipped(s["p"]) + 1e-7) * s["m"] + s["y"].cast("double") * F.log(_clipped(s["p"]) + 1e-7)
    return -_mean_of(F.transform(z, term))


def threshold_summary(thresholds: DataFrame) -> DataFrame:
    """One row: mean and median of the labels' best thresholds."""
    return thresholds.agg(F.avg("threshold").alias("mean"), F.percentile("threshold", 0.5).alias("median"))


def compare_totals(first: DataFrame, second: DataFrame, generic: int | None = None, skip: tuple[int, ...] = ()) -> DataFrame:
    """One row on two matrices of the same rows: hits, errors (neither right nor None nor generic), their differences over all rows, and the better model.

    ``score`` is the share of hits the first has more, less the share of errors it has more, both as amounts. Labels in ``skip``
    count for nothing. The first model is better only if it has more hits.
    """

    def one(m: DataFrame, s: str) -> DataFrame:
        if skip:
            m = m.where(~F.col("true_i").isin(*skip))
        hit = F.col("true_i") == F.col("pred_i")
        error = ~hit & (F.col("pred_i") != NONE)
        if generic is not None:
            error &= F.col("pred_i") != generic
        part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
        return m.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"total_{s}"), part(hit).alias(f"hits_{s}"), part(error).alias(f"errors_{s}"))

    both = one(first, "1").crossJoin(F.broadcast(one(second, "2")))  # one row each
    rate = lambda c: F.when(F.col("total_1") > 0, F.abs((F.col(f"{c}_1") - F.col(f"{c}_2")) / F.col("total_1"))).otherwise(F.lit(0.0))
    better = F.when(F.col("hits_1") > F.col("hits_2"), F.lit("first")).otherwise(F.lit("second"))
    return both.withColumns({"score": rate("hits") - rate("errors"), "better": better})
