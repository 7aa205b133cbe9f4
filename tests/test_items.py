"""Whole model runs, folds, new files only, summaries, both label maps, mixtures, measured clips."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from wavegrid.functions import arrays
from wavegrid.operators import features, labels, models, splitting
from wavegrid.plans import long_runs, queries
from wavegrid.sources import readers, writers
from wavegrid.sources.tables import table
from wavegrid.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_fold_rates_equal_plain_counts(spark):
    r = np.random.default_rng(1)
    rows = [(int(f), int(t), int(t if r.random() < 0.6 else r.integers(0, 4))) for f, t in zip(r.integers(-1, 3, 300), r.integers(0, 4, 300))]
    got = {(x["fold"], x["label_i"]): x for x in models.fold_rates(spark.createDataFrame(rows, "fold int, label_i int, pred_i int")).collect()}
    assert len(got) == 16
    for (fold, label), x in got.items():
        mine = [(t, p) for f, t, p in rows if f == fold]
        tp = sum(t == p == label for t, p in mine)
        fp, fn = sum(p == label != t for t, p in mine), sum(t == label != p for t, p in mine)
        assert (x["tp"], x["fp"], x["fn"], x["tn"]) == (tp, fp, fn, len(mine) - tp - fp - fn)
        assert x["precision"] == pytest.approx(tp / (tp + fp) if tp + fp else 0) and x["recall"] == pytest.approx(tp / (tp + fn) if tp + fn else 0)


def test_folds_keep_files_together_and_learn(spark):
    r = np.random.default_rng(2)
    rows = [(i, i // 5, i // 5 % 3, (r.normal(0, 0.3, 4) + np.eye(4)[i // 5 % 3]).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, file long, label int, x array<double>")
    per = df.withColumn("fold", models.fold_of(F.col("file"))).groupBy("file").agg(F.count_distinct("fold").alias("n"), F.first("fold").alias("fold"))
    assert per.where("n > 1").count() == 0 and {x["fold"] for x in per.collect()} == {-1, 0, 1, 2, 3, 4}
    fitted, scored = models.cross_validated(df, "file", "x", 4, "label", depths=(1, 4))
    assert len(fitted.avgMetrics) == 2 and scored.count() == 600
    hits = scored.where("label_i = pred_i").groupBy(F.col("fold") == models.HELD_OUT).count().collect()
    assert sum(x["count"] for x in hits) > 480 and len(hits) == 2


def test_model_run_decides_the_same_after_reload(spark, tmp_path):
    at = f"file://{tmp_path}"
    got = sorted(map(tuple, long_runs.model_decisions(spark, SF, at).collect()))
    # the decisions, in SQL over the written predictions
    sql = f"""WITH l AS (SELECT track_id, unnest(probs) AS p, generate_subscripts(probs, 1) - 1 AS i FROM '{tmp_path}/predictions/model=forest/*.parquet'),
      m AS (SELECT track_id, i, round(avg(p), 9) AS p FROM l GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY p DESC, i) AS k FROM m)
      SELECT track_id, CASE WHEN p > 0.15 THEN i ELSE -1 END, p FROM b WHERE k = 1"""
    want = sorted(duckdb.sql(sql).fetchall())
    assert [(t, i) for t, i, _ in got] == [(t, i) for t, i, _ in want] and len({i for _, i, _ in got}) > 2
    # a model fitted anew and never written gives the same probabilities
    e = table(spark, SF, "embeddings")
    fresh = models.forest_pipeline("embedding", 64, "label", trees=10, depth=4).fit(e.where("vec_id % 5 <> 0"))
    read = PipelineModel.load(f"{at}/model")
    assert [r["probability"] for r in fresh.transform(e).orderBy("vec_id").collect()] == [r["probability"] for r in read.transform(e).orderBy("vec_id").collect()]
    again = long_runs.model_decisions(spark, SF, at)
    assert sorted(map(tuple, again.collect())) == got


def test_counts_of_new_files_are_those_of_one_batch(spark, tmp_path):
    src, out, cp = (f"file://{tmp_path}/{x}" for x in ("src", "out", "cp"))
    step = lambda d: d.where("id % 7 <> 0")
    for k in range(3):
        spark.range(k * 100, k * 100 + 100).select("id", (F.col("id") % 5).alias("g")).write.mode("append").parquet(src)
        got = {r["g"]: r["n"] for r in incremental.counts_of_new_files(spark, src, "id long, g long", ["g"], step, out, cp).collect()}
        want = {}
        for i in range(k * 100 + 100):
            if i % 7:
                want[i % 5] = want.get(i % 5, 0) + 1
        assert got == want
    # nothing new: nothing counted twice
    again = incremental.counts_of_new_files(spark, src, "id long, g long", ["g"], step, out, cp)
    assert {r["g"]: r["n"] for r in again.collect()} == want
    # a batch that runs again replaces itself
    last = sorted(x for x in os.listdir(tmp_path / "out") if x.startswith("batch="))
    assert last == ["batch=0", "batch=1", "batch=2"]


def test_months_of_a_stream_are_months(spark, tmp_path):
    src = str(tmp_path / "seen")
    rows = [(1, "tui", f"2020-01-{d:02d} 10:00:00") for d in (1, 15, 31)] + [(1, "tui", "2020-02-01 00:00:00"), (2, "kea", "2020-06-01 00:00:00")]
    spark.createDataFrame(rows, "square_id long, code string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    s = incremental.monthly_counts_stream(spark.readStream.schema("square_id long, code string, ts timestamp").parquet(src))
    s.writeStream.format("memory").queryName("months").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    got = sorted((r["square_id"], r["code"], r["month_start"].isoformat()[:10], r["month"], r["n"]) for r in spark.table("months").collect())
    assert got == [(1, "tui", "2020-01-01", 1, 3), (1, "tui", "2020-02-01", 2, 1)]  # June is still open


def test_summary_beside_its_recordings(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", 1), ("train", "a", 1), ("train", "a", 2), ("test", "b", None)], "split string, label string, rec_id long")
    writers.write_summary(df, f"file://{tmp_path}/s")
    counts = {(r["split"], r["label"]): (r["n_samples"], r["n_recs"]) for r in spark.read.json(f"{tmp_path}/s/counts").collect()}
    assert counts == {("train", "a"): (3, 2), ("test", "b"): (1, 0)}
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/s/recordings").select("split", "label", "rec_id").collect()) == [("train", "a", 1), ("train", "a", 2)]


def test_summary_lists_all_recordings(spark):
    con = duckdb.connect()
    sql = f"SELECT lang, source, count(*), count(DISTINCT n_chars), list_sort(list(DISTINCT n_chars)) FROM '{SF}/documents.parquet' GROUP BY ALL"
    want = {(split, label, n, recs): ids for split, label, n, recs, ids in con.execute(sql).fetchall()}
    got = {}
    for r in queries.QUERIES["training_summary"](spark, SF).collect():
        got.setdefault((r["split"], r["label"], r["n_samples"], r["n_recs"]), []).append(r["rec_id"])
    assert {k: sorted(v) for k, v in got.items()} == want


def test_summary_keeps_nulls(spark):
    rows = [("train", "a", 1), ("train", "a", 1), ("train", "a", 2), ("train", "a", None), ("test", "b", None), (None, "a", 1), (None, None, 3), ("train", None, 3), ("", "a", 4)]
    df = spark.createDataFrame(rows, "split string, label string, rec_id long")
    out = writers.training_summary(df)
    assert out.columns == ["split", "label", "n_samples", "n_recs", "rec_id"]
    want = [("train", "a", 4, 2, 1), ("train", "a", 4, 2, 2), ("train", "a", 4, 2, None), ("test", "b", 1, 0, None), (None, "a", 1, 1, 1), (None, None, 1, 1, 3), ("train", None, 1, 1, 3), ("", "a", 1, 1, 4)]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert writers.training_summary(df.limit(0)).collect() == []


def test_labels_by_both_maps(spark):
    df = spark.createDataFrame([("kea\ntui",), ("odd",), ("gone\nodd",), ("kea\nodd\nkea",), ("",), (None,)], "t string")
    own, extra = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in ({"kea": 2, "tui": 1, "gone": -1, "far": 9}, {"odd": 3, "tui": 0, "gone": 0}))
    got = df.select(arrays.encode_labels(F.col("t"), own, extra, 4), arrays.encode_labels(F.col("t"), own, extra, 4, False)).collect()
    assert [r[0] for r in got] == [[1, 1, 1, 0], [0, 0, 0, 1], [1, 0, 0, 1], [0, 0, 1, 1], [0] * 4, [0] * 4]
    assert [r[1] for r in got] == [[0, 1, 0, 0], [0, 0, 0, 1], [1, 0, 0, 0], [0, 0, 1, 0], [0] * 4, [0] * 4]


def test_offline_mixtures(spark):
    rows = [(i, [float(i)], [1.0, 2.0], None if i == 3 else f"t{i}", f"{i} {i}b", 1.0, 2.0, "kept") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, x array<double>, y array<double>, text string, tracks string, lat double, lng double, `a.b` string")
    out = splitting.offline_mix(df, "k", "x", "y", "text", "tracks", run_rows=15).collect()
    assert sorted(r["k"] for r in out) == sorted(r["partner"] for r in out) == list(range(40))
    for r in out:
        s, p = r["share"], r["partner"]
        assert 0.2 <= s <= 0.8 and r["x"][0] == pytest.approx(s * r["k"] + (1 - s) * p) and r["y"] == [1.0, 1.0]
        assert r["text"] == "\n".join(f"t{i}" for i in (r["k"], p) if i != 3) and r["tracks"] == f"{r['k']}\n{r['k']}b\n{p}\n{p}b"
        assert r["lat"] == r["lng"] == -1 and r["a.b"] == "kept"


def test_clips_are_measured(spark, tmp_path):
    d = tmp_path / "w"
    (d / "x").mkdir(parents=True)
    for name, seconds in (("a.wav", 1.5), ("x/b.wav", 0.25)):
        (d / name).write_bytes(features.write_wav(np.zeros(int(8000 * seconds)), 8000))
    (d / "bad.wav").write_bytes(b"junk")
    clips = spark.createDataFrame([("a.wav", "tui", None, None), ("in/a.wav", "tui", 0.5, 9.0), ("b.wav", "kea", 0.0, 0.1), ("bad.wav", "kea", None, None), ("none.wav", "kea", None, 2.0)], "filename string, label string, start double, end double")
    got = {(r["filename"]): (r["end"], r["duration"], r["error"]) for r in readers.with_durations(spark, clips, str(d)).collect()}
    assert got["a.wav"] == (1.5, 1.5, None) and got["in/a.wav"] == (1.5, 1.5, None) and got["b.wav"] == (0.1, 0.25, None)
    assert got["bad.wav"][:2] == (None, None) and got["bad.wav"][2] and got["none.wav"] == (2.0, None, "no such file")


def test_label_groups_are_parameters(spark):
    t = spark.createDataFrame([("buzz",), ("kea",), ("boat",)], "label string")
    none = spark.createDataFrame([], "alias string, code string")
    got = {r[0] for r in labels.label_set(t, none, "coarse", generic=False, noise=["buzz"], human=["boat"]).collect()}
    assert got == {"noise", "bird", "animal"}
    flags = labels.track_flags(F.array("label"), F.array(F.lit("kea")), noise=["buzz"], human=["boat"])
    assert sorted(tuple(r) for r in t.select("label", *flags).collect()) == [("boat", False, True, False), ("buzz", False, False, True), ("kea", True, True, False)]
