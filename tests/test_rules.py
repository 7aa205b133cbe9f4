"""Label rules, decisions and expressions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from wavegrid.functions import arrays
from wavegrid.operators import evaluate, grid, intervals, labels, segmenting, splitting


def test_label_sets_and_groups(spark):
    t = spark.createDataFrame([("Tui",), ("tui",), ("wind",), ("human",), (None,), ("kea",)], "label string")
    am = labels.alias_map((spark.createDataFrame([("Tui", "tui1"), ("Kea", "kea1")], "alias string, code string"), 1))
    get = lambda **k: sorted(r["label"] for r in labels.label_set(t, am, **k).collect())
    assert get() == ["bird", "human", "kea1", "tui1", "wind"]
    assert get(mode="coarse", generic=False) == ["animal", "bird", "noise"]
    assert get(mode="single", only="kea1") == ["bird", "kea1", "noise"]
    e = labels.evaluation_label(F.col("label"), ["tui"], birds=F.col("label").isin("kea"))
    assert [r[0] for r in t.select(e).collect()] == ["Tui", "tui", "noise", "human", None, "bird"]


def test_flags_masks_and_audit(spark):
    df = spark.createDataFrame([(["tui"], [3]), (["wind"], [0]), (["human", "wind"], [0, 3]), (["bird"], [0])], "tags array<string>, idx array<int>")
    b, a, n = labels.track_flags(F.col("tags"), F.array(F.lit("tui")))
    assert [tuple(r) for r in df.select(b, a, n).collect()] == [(True, True, False), (False, False, True), (False, True, True), (True, True, False)]
    m = labels.possible_labels(F.col("idx"), 0, 4, F.lit(-43.0), F.lit(172.0), (160, -50, 180, -30), [1, 3], [1, 2, 3])
    assert [r[0] for r in df.select(m).collect()] == [[1, 1, 1, 1], [0, 1, 0, 1], [1, 1, 1, 1], [0, 1, 0, 1]]
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("a\nb", 1)], "t string, i int")
    assert tuple(labels.label_audit(rows, "t", "i").first()) == (1, ["a", "b"], 1)
    assert [r[0] for r in rows.select(labels.family_rule(F.lit("Brown Kiwi"), "kiwi", F.lit("x"))).collect()] == ["kiwi"] * 3


def test_decisions(spark):
    p = spark.createDataFrame([(1, [0.7, 0.3]), (2, [0.71, 0.29]), (3, [0.0, 0.0]), (4, [0.9, 0.9])], "i int, probs array<double>")
    assert [r[0] for r in p.select(evaluate.decide(F.col("probs"))).collect()] == [-1, 0, -1, 0]
    s = evaluate.species_result(F.col("probs"), F.array(F.lit("a"), F.lit("b")), 0.5)
    assert [[tuple(x) for x in r[0]] for r in p.select(s).collect()] == [[("a", 70)], [("a", 71)], [("a", 0)], [("a", 90), ("b", 90)]]
    m = spark.createDataFrame([(0, 1, 2), (0, 2, 2), (0, 0, 9), (1, -1, 5), (1, 1, 5)], "true_i int, pred_i int, n long")
    assert [tuple(r) for r in evaluate.most_confused(m).collect()] == [(0, 1, 2)]
    share = evaluate.accuracy_by_share(m, spark.createDataFrame([(0, 1), (1, 3)], "label_i int, n int")).collect()
    assert [tuple(r) for r in share] == [(1, 0.75, 0.5), (0, 0.25, pytest.approx(9 / 13))]
    d = spark.createDataFrame([(0, 0), (0, 1), (5, 1), (5, -1)], "label_i int, pred_i int")
    assert tuple(evaluate.folder_accuracy(d, [0, 1]).first()) == (4, 1, 3)
    b = spark.createDataFrame([([0], [5]), ([0], [5, 1]), ([5], [5])], "label_idx array<int>, pred_idx array<int>")
    assert evaluate.bad_tracks(b, [0, 1], [5]).count() == 1


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 3.0],), ([2.0, 2.0],), ([],)], "x array<double>")
    one = lambda c: [r[0] for r in df.select(c).collect()]
    assert one(arrays.unit_minmax(F.col("x"))) == [[0.0, 1.0], [0.0, 0.0], []]
    assert one(arrays.standardize(F.col("x"))) == [[-1.0, 1.0], [0.0, 0.0], []]
    assert one(arrays.argmax(F.col("x"))) == [1, 0, None]
    assert one(arrays.ema(F.col("x"), 0.5)) == [[1.0, 2.0], [2.0, 2.0], []]
    assert one(arrays.generic_shared(F.array(F.lit(1.0), F.lit(1.0)), 0))[0] == [0.5, 1.0]


def test_intervals_on_edges(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 10.0, 20.0), (1, 3, 5.0, 5.0)], "rec_id long, track_id long, start double, end double")
    b = spark.createDataFrame([(1, 9, 10.0, 12.0, 2000.0), (1, 8, 0.0, 30.0, 500.0)], "rec_id long, b_id long, b_start double, b_end double, f_lo double")
    got = sorted((r["track_id"], r["b_id"]) for r in intervals.overlapping(a, b, "rec_id", 3.0).collect())
    assert got == [(1, 8), (2, 8), (2, 9)]  # touching and empty intervals don't overlap, no pair comes twice
    share = {r["track_id"]: r["signal_percent"] for r in intervals.union_share(a, b, "rec_id", 3.0).collect()}
    assert share == {1: 0.0, 2: 0.2, 3: 0.0}
    flat = spark.createDataFrame([(1, [1.0] * 8), (2, [0.0, 5.0, 5.0, 0.0]), (3, None)], "i int, v array<double>")
    t = {r["i"]: (r["start"], r["rejected"]) for r in intervals.tighten(flat, "i", "v", 2, 0.5).collect()}
    assert t == {1: (0.0, True), 2: (0.5, False), 3: (None, True)}
    frames = spark.createDataFrame([("a", 0, 1, 2), ("a", 1, 3, 3), ("a", 2, 4, 4), ("b", 0, 1, 2)], "r string, c int, lo int, hi int")
    assert sorted(map(tuple, intervals.silent_end(frames, "r", "c", "lo", "hi").collect()), key=str) == [("a", 1), ("b", None)]


def test_short_tracks_are_widened(spark):
    t = spark.createDataFrame([(1, 0.2, 0.5, 30.0), (2, 29.9, 30.0, 30.0), (3, 1.0, 9.0, 30.0)], "track_id long, start double, end double, duration double")
    for r in segmenting.at_least(t).collect():
        assert r["start"] >= 0 and r["end"] <= 30 and r["end"] - r["start"] >= 1.5 - 1e-9
    assert segmenting.fixed_windows(t.select(F.col("track_id").alias("rec_id"), F.lit(7.0).alias("duration")), 5.0, pad=True).agg(F.max("win_end")).first()[0] == 10.0


@pytest.mark.parametrize("seed", [1, 2])
def test_splits_do_not_leak(spark, seed):
    s = spark.range(3000).select(F.col("id").alias("sample_id"), (F.col("id") % 211).alias("bin_id"), F.concat(F.lit("t"), F.col("id") % 5).alias("tag"))
    split = splitting.split_leakfree(s, seed, min_samples={"t0": 10})
    assert split.count() == 211 and split.select("bin_id").distinct().count() == 211
    n = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert set(n) == {"train", "validation", "test"} and n["validation"] >= 0.15 * 211
    assert splitting.split_leaks(split, "bin_id").count() == 0
    again = splitting.split_leakfree(s.repartition(7), seed, min_samples={"t0": 10})
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, again.collect()))
    assert splitting.split_leakfree(s, seed, no_test=True).where("split = 'test'").count() == 0


def test_new_squares_cover_points(spark):
    p = spark.createDataFrame([(i, (i * 37 % 100) / 50.0, (i * 53 % 100) / 50.0) for i in range(200)], "row_no long, lng double, lat double")
    sq = grid.new_squares(p, 0.4, 0.3)
    hit = grid.points_in_squares(p.withColumnRenamed("row_no", "point_id"), sq)
    assert hit.count() == 200 and sq.count() < 100
