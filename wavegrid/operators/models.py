"""Classifiers over feature tables with Spark's own machine learning."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.operators.evaluate import class_weights, label_distribution, track_decision
from wavegrid.operators.sizes import small
from wavegrid.operators.segmenting import keyed_uniform
from wavegrid.sources import readers, writers


def with_vector(df: DataFrame, array_col: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(array_col).cast("array<double>")))


def with_class_weight(df: DataFrame, label: str, n_labels: int) -> DataFrame:
    """Adds ``weight`` by the bounded inverse class counts."""
    w = class_weights(label_distribution(df.select(F.col(label).cast("int").alias("label_i")), n_labels))
    return df.join(small(w.select(F.col("label_i").alias(label), "weight"), 32), label)


def fit_linear(df: DataFrame, label: str = "label", weight: str | None = None):
    """One logistic regression per label."""
    one = LogisticRegression(maxIter=20, regParam=0.01, labelCol=label)
    if weight:
        return OneVsRest(classifier=one, labelCol=label, weightCol=weight).fit(df)
    return OneVsRest(classifier=one, labelCol=label).fit(df)


def fit_forest(df: DataFrame, label: str = "label", trees: int = 20, depth: int = 6, seed: int = 1, weight: str | None = None):
    rf = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return (rf.setWeightCol(weight) if weight else rf).fit(df)


def score(model, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, the predicted label, and for forests the probabilities."""
    out = model.transform(df)
    cols = [*keep, F.col("prediction").cast("int").alias("pred_i")]
    if "probability" in out.columns:
        cols.append(vector_to_array("probability").alias("probs"))
    return out.select(*cols)


def cross_fold(df: DataFrame, key: str, label: str, k: int = 3, seed: int = 1) -> DataFrame:
    """``fold, n, hits, accuracy`` of forests that are each trained without the rows of their fold."""
    rows = df.withColumn("fold", F.floor(keyed_uniform(seed, F.lit("fold"), F.col(key)) * k).cast("int"))
    out = None
    for f in range(k):  # k models, not rows
        got = score(fit_forest(rows.where(F.col("fold") != f), label), rows.where(F.col("fold") == f), ["fold", label])
        out = got if out is None else out.unionByName(got)
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col(label) == F.col("pred_i")).alias("hits")).withColumn("accuracy", F.col("hits") / F.col("n"))


#: The fold of rows that no fold trains on.
HELD_OUT = -1


def fold_of(file: Column, folds: int = 5, held: float = 0.2, seed: int = 1) -> Column:
    """:data:`HELD_OUT` for a share ``held`` of the files, else a fold from 0; all rows of a file go together."""
    u = keyed_uniform(seed, F.lit("fold"), file)
    return F.when(u < held, HELD_OUT).otherwise(F.floor((u - held) / (1 - held) * folds)).cast("int")


def forest_pipeline(array_col: str, n: int, label: str, trees: int = 20, depth: int = 6, seed: int = 1) -> Pipeline:
    """From an array of ``n`` places to a forest's probabilities, all in one pipeline that can be written and read."""
    places = ", ".join(f"double(get(`{array_col}`, {i})) AS _p{i}" for i in range(n))
    forest = RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[SQLTransformer(statement=f"SELECT *, {places} FROM __THIS__"), VectorAssembler(inputCols=[f"_p{i}" for i in range(n)], outputCol="_features"), forest])


def cross_validated(df: DataFrame, file: str, array_col: str, n: int, label: str, folds: int = 5, held: float = 0.2, depths: tuple[int, ...] = (3, 6), seed: int = 1) -> tuple[CrossValidatorModel, DataFrame]:
    """The tuned model, and ``fold, label_i, pred_i`` of every row: of each fold by the best setting trained without it, of held-out files by the model of all folds.

    Files are dealt out by :func:`fold_of`; the setting is chosen by the mean F1 over folds, and held-out rows have no part in it.
    """
    rows = df.withColumn("fold", fold_of(F.col(file), folds, held, seed))
    pipe = forest_pipeline(array_col, n, label, seed=seed)
    grid = ParamGridBuilder().addGrid(pipe.getStages()[-1].maxDepth, list(depths)).build()
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol="fold", collectSubModels=True, parallelism=2)
    fitted = cv.fit(rows.where(F.col("fold") != HELD_OUT))
    best = max(range(len(grid)), key=lambda i: fitted.avgMetrics[i])
    by = [(f, fitted.subModels[f][best]) for f in range(folds)] + [(HELD_OUT, fitted.bestModel)]  # a model a fold
    scored = [m.transform(rows.where(F.col("fold") == f)).select("fold", F.col(label).cast("int").alias("label_i"), F.col("prediction").cast("int").alias("pred_i")) for f, m in by]
    return fitted, reduce(DataFrame.unionByName, scored)


def fold_rates(scored: DataFrame) -> DataFrame:
    """``fold, label_i, tp, fp, fn, tn, precision, recall``: a row for each fold and each label that is true or predicted anywhere; rates of nothing are 0."""
    pairs = scored.groupBy("fold", "label_i", "pred_i").agg(F.count("*").alias("n"))
    totals = pairs.groupBy("fold").agg(F.sum("n").alias("total"))
    labels = pairs.select("label_i").union(pairs.select("pred_i")).distinct()
    cells = totals.join(labels)  # folds and labels are few: no rows of the table
    actual = pairs.groupBy("fold", "label_i").agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("label_i") == F.col("pred_i"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = pairs.groupBy("fold", F.col("pred_i").alias("label_i")).agg(F.sum("n").alias("predicted"))
    r = cells.join(actual, ["fold", "label_i"], "left").join(predicted, ["fold", "label_i"], "left").fillna(0, ["actual", "tp", "predicted"])
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    fp, fn = F.col("predicted") - F.col("tp"), F.col("actual") - F.col("tp")
    return r.select("fold", "label_i", "tp", fp.alias("fp"), fn.alias("fn"), (F.col("total") - F.col("actual") - fp).alias("tn"), rate("tp", "predicted").alias("precision"), rate("tp", "actual").alias("recall"))


def run_model(model_path: str, windows: DataFrame, out: str, name: str, how: str = "mean", threshold: float = 0.7) -> DataFrame:
    """Reads a written pipeline, scores ``windows`` (``track_id, k`` and its inputs), writes their predictions under ``out`` by model, and decides each track from what was written.

    Returns ``track_id, pred_i, p``. A second run under the same name replaces the first one's predictions.
    """
    spark = windows.sparkSession
    model = PipelineModel.load(model_path)
    scored = model.transform(windows).select("track_id", "k", vector_to_array("probability").alias("probs"), F.lit(name).alias("model"))
    writers.write_predictions(scored, out)
    return track_decision(readers.predictions(spark, out, name).select("track_id", "k", "probs"), how, threshold)
