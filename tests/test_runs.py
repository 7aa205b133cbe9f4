from pyspark.sql import functions as F

from wavegrid.operators import evaluate, filters
from wavegrid.operators.runs import score_run, sums_before
from wavegrid.sources import writers


def test_sums_before_equal_plain_running_sums(spark):
    rows = [(i, None if i % 5 == 0 else f"g{i % 3}", None if i % 11 == 0 else i % 7, i * 37 % 101, i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, r int, k int, n int")
    got = {r["id"]: (r["s"], r["c"]) for r in sums_before(df, ["g"], ["r"], ["k", "id"], {"s": F.col("n"), "c": F.lit(1)}).collect()}
    for g in (None, "g0", "g1", "g2"):
        s = c = 0
        for i, _, _, _, n in sorted((x for x in rows if x[1] == g), key=lambda x: (x[2] is None, x[2] or 0, x[3], x[0])):
            assert got[i] == (s, c)
            s, c = s + n, c + 1
    assert len(got) == 400
    assert sums_before(df.limit(0), ["g"], ["r"], ["k"], {"s": F.col("n")}).collect() == []


def test_score_runs_follow_the_scores(spark):
    p = [-1.0, 0.0, 5e-324, 1e-9, 0.1, 0.25, 0.5, 0.5000001, 0.9, 1 - 1e-16, 1.0, 2.0]
    p += [i / 977 for i in range(977)]
    got = spark.createDataFrame([(x,) for x in p], "p double").select("p", score_run(F.col("p")).alias("r")).collect()
    runs = [r["r"] for r in sorted(got, key=lambda r: -r["p"])]
    assert runs == sorted(runs) and len(set(runs)) > 300


def test_thresholds_of_one_label_equal_brute_force(spark):
    rows = [(i, i % 3, [(i * 31 % 97) / 96, (i * 17 % 89) / 1e6, 1 - (i * 13 % 83) / 1e7]) for i in range(300)]
    got = evaluate.best_thresholds(spark.createDataFrame(rows, "row_id int, y_true int, probs array<double>"), 4).collect()
    for label, threshold, f1 in got:
        if label == 3:
            assert (threshold, f1) == (0.0, 0.0)
            continue
        best = (-1.0, 0.0)
        for t in sorted({r[2][label] for r in rows}):
            said = [r for r in rows if r[2][label] >= t]
            score = round(2 * sum(r[1] == label for r in said) / (len(said) + sum(r[1] == label for r in rows)), 9)
            best = max(best, (score, -t))
        assert (f1, threshold) == (best[0], -best[1])


def test_sites_are_numbered_over_devices(spark):
    rows = [(i, f"d{i % 4}", (i % 6) / 3.0, -(i % 5) / 2.0) for i in range(90)]
    recs = spark.createDataFrame(rows, "rec_id int, device_id string, lat double, lng double")
    tracks = spark.createDataFrame([(1, 0.0, 1.0, None, None, "a")], "rec_id int, start double, end double, min_freq double, max_freq double, label string")
    got = {r["rec_id"]: r["site_id"] for r in writers.anonymised(recs, tracks).collect()}
    sites = sorted({(d, round(a, 1), round(b, 1)) for _, d, a, b in rows})
    assert got == {i: sites.index((d, round(a, 1), round(b, 1))) + 1 for i, d, a, b in rows}


def test_more_runs_for_more_rows(spark):
    got = filters.batches(spark.range(500), ["id"], 3, run_rows=5).groupBy("run", "batch").count().collect()
    assert sum(r["count"] for r in got) == 500 and max(r["count"] for r in got) <= 3 and max(r["run"] for r in got) > 64
