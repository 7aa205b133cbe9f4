"""Covers, joins by cells of many sizes and prefixes, against plain ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wavegrid.functions import arrays
from wavegrid.operators import grid, intervals, runs
from wavegrid.plans.queries import QUERIES


def plain_squares(points, w, h):
    made = []
    for i, x, y in sorted(p for p in points if None not in p):
        if not any(a <= x <= c and b <= y <= d for _, a, b, c, d in made):
            made.append((i, x - w / 2, y - h / 2, x + w / 2, y + h / 2))
    return made


@pytest.mark.parametrize("cell", [1.0, 2.6])
def test_new_squares_equal_the_ordered_fold(spark, cell):
    r = random.Random(3)
    crowd = [(i, r.gauss(0, 0.05), r.gauss(0, 0.05)) for i in range(1500)]
    spread = [(5000 + i, r.uniform(-1, 1), r.uniform(-1, 1)) for i in range(800)]
    chain = [(9000 + i, 5 + 0.19 * i, 0.0) for i in range(12)]
    edges = [(9500 + i, 8 + 0.2 * (i % 3), 8 + 0.15 * (i // 3)) for i in range(9)]
    points = crowd + spread + chain + edges + [(7, None, 1.0), (8, 1.0, None), (None, 30.0, 30.0), (6000, 0.5, 0.5), (6001, 0.5, 0.5)]
    r.shuffle(points)
    df = spark.createDataFrame(points, "row_no long, lng double, lat double")
    got = sorted(tuple(x) for x in grid.new_squares(df, 0.4, 0.3, cell).collect())
    assert got == plain_squares(points, 0.4, 0.3)


def test_new_squares_of_nothing(spark):
    df = spark.createDataFrame([], "row_no long, lng double, lat double")
    assert grid.new_squares(df, 0.4, 0.3).count() == 0
    with pytest.raises(ValueError):
        grid.new_squares(df, 1, 1, 0.5)


def test_regions_of_unlike_sizes(spark):
    r = random.Random(5)
    box = lambda code, x, y, a: (code, x, y, x + a, y + a * 0.7)
    regions = [box(f"r{i:03d}", r.uniform(-20, 20), r.uniform(-20, 20), r.choice([0.0, 0.01, 0.25, 0.5, 3.0, 40.0])) for i in range(300)]
    regions += [("point", 0.5, 0.5, 0.5, 0.5), ("null", None, 0.0, 1.0, 1.0), ("world", -1000.0, -1000.0, 1000.0, 1000.0)]
    squares = [(i, x := r.uniform(-20, 20), y := r.uniform(-20, 20), x + 0.1, y + 0.1) for i in range(400)] + [(1000, 0.0, 0.0, 1.0, 1.0), (1001, None, 0.0, 1.0, 1.0)]
    s = spark.createDataFrame(squares, "square_id long, x0 double, y0 double, x1 double, y1 double")
    for some in (regions, regions[:-1], []):
        g = spark.createDataFrame(some, "code string, x0 double, y0 double, x1 double, y1 double")
        out = grid.square_regions(s, g)
        plan = out._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        want = {}
        for i, x0, y0, x1, y1 in squares:
            inside = [c for c, a, b, d, e in some if None not in (x0, a) and a <= (x0 + x1) / 2 <= d and b <= (y0 + y1) / 2 <= e]
            want[i] = min(inside, default=None)
        assert {x["square_id"]: x["region"] for x in out.collect()} == want


def test_overlaps_of_mixed_lengths(spark):
    r = random.Random(6)
    length = lambda: r.choice([0.0, 0.1, 1.0, 64.0, 128.0, 5000.0, 86400.0, -1.0])
    make = lambda n, at: [(at + i, r.choice("ab"), s := round(r.uniform(-2000, 90_000), 1), s + length()) for i in range(n)]
    a = make(250, 0) + [(900, "a", None, 5.0), (901, None, 0.0, 5.0), (902, "a", 0.0, 64.0)]
    b = make(250, 10_000) + [(19_000, "a", 64.0, 128.0), (19_001, "a", 63.0, 65.0)]
    da = spark.createDataFrame(a, "a_id long, k string, start double, end double")
    db = spark.createDataFrame(b, "b_id long, k string, b_start double, b_end double")
    got = sorted((x["a_id"], x["b_id"]) for x in intervals.overlapping(da, db, "k", 64.0).collect())
    want = sorted((i, j) for i, k, s, e in a for j, m, t, f in b if None not in (k, s) and k == m and s < e and t < f and s < f and t < e)
    assert got == want and len(want) > 1000
    assert intervals.overlapping(da.where(F.lit(False)), db, "k", 64.0).count() == 0
    # a year among seconds takes a few rows, not one for every cell
    year = spark.createDataFrame([(1, "a", 0.0, 365 * 86400.0)], "a_id long, k string, start double, end double")
    few = intervals.overlapping(year, db, "k", 1.0)
    assert few.count() == sum(k == "a" and t < f and f > 0 for _, k, t, f in b)


@pytest.mark.parametrize("block", [2, 7, 512])
def test_prefixes_equal_plain_ones(spark, block):
    r = random.Random(block)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.random(), r.choice([None, r.randint(-9, 9)])) for _ in range(400)] + [("alone", 0.5, 3)]
    df = spark.createDataFrame(rows, "k string, at double, v int").repartition(5)
    add = runs.prefix(df, ["k"], ["at"], F.coalesce("v", F.lit(0)), lambda a, b: a + b, F.lit(0), block=block)
    top = runs.prefix(add, ["k"], ["at"], F.col("v"), lambda a, b: F.greatest(a, b), F.lit(None).cast("int"), "top", inclusive=True, block=block)
    got = sorted((tuple(x) for x in runs.prefix(top, ["k"], ["at"], F.col("v"), lambda a, b: F.coalesce(b, a), F.lit(None).cast("int"), "last", block=block).collect()), key=repr)
    want = []
    for k in {x[0] for x in rows}:
        total, best, last = 0, None, None
        for _, at, v in sorted((x for x in rows if x[0] == k), key=lambda x: x[1]):
            best = v if best is None else best if v is None else max(best, v)
            want.append((k, at, v, total, best, last))
            total, last = total + (v or 0), last if v is None else v
    assert got == sorted(want, key=repr)


def test_prefixes_without_groups_or_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("x"))
    got = runs.prefix(df, [], ["x"], F.col("x"), lambda a, b: a + b, F.lit(0).cast("long"), block=8)
    assert all(r["before"] == r["x"] * (r["x"] - 1) // 2 for r in got.collect())
    assert runs.prefix(df.where("x < 0"), [], ["x"], F.col("x"), lambda a, b: a + b, F.lit(0).cast("long")).count() == 0


def test_one_recording_of_many_signals_is_in_many_tasks(spark):
    """Nested, equal, null and far intervals of one key, merged over blocks as by one window."""
    df = spark.range(60_000).select(F.lit("one").alias("k"), (F.col("id") * 7919 % 60_000).alias("start"))
    df = df.withColumn("end", F.col("start") + F.when(F.col("start") % 1000 < 990, 1).when(F.col("start") % 7000 == 991, 5000).otherwise(0))
    df = df.where("start % 1000 < 995").unionByName(df.limit(50)).unionByName(spark.createDataFrame([("one", None, 1), (None, 5, 6)], "k string, start long, end long"))
    a = intervals.merge_nearby(df, ["k"], 2.0).select("k", "run", "start", "end", "n_merged")
    b = intervals.merge_nearby_any_length(df, ["k"], 2.0).select("k", "run", "start", "end", "n_merged")
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        spread = runs.numbered(df, ["k"], ["start", "end"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1


def test_average_over_rows_equals_that_of_the_joined_array(spark):
    r = random.Random(2)
    band = [[r.uniform(0, 5) for _ in range(r.choice([0, 1, 3, 300]))] for _ in range(60)]
    rows = [("a", i, v) for i, v in enumerate(band)] + [("b", 0, [2.0]), ("c", 0, [])]
    df = spark.createDataFrame(rows, "k string, no int, x array<double>").repartition(6)
    got = {(x["k"], x["no"]): x["ema"] for x in intervals.ema_over_rows(df, ["k"], ["no"], "x").collect()}
    joined = spark.createDataFrame([(sum(band, []),)], "x array<double>").select(arrays.ema(F.col("x")).alias("e")).first()["e"]
    assert sum((got["a", i] for i in range(60)), []) == pytest.approx(joined, rel=1e-9)
    assert got["b", 0] == [2.0] and got["c", 0] == []


@pytest.mark.parametrize("name", ["neighbours", "neighbour_sum", "mark_present", "rare_species", "species_present"])
def test_cells_of_squares_and_points_do_not_go_through_the_driver(spark, name):
    """Their tables are large where customers and parts are, whatever size Spark takes them for."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[_cx#", plan) and not re.search(r"BroadcastHashJoin \[(_cx|point_id)#", plan)
