"""Points and rectangles: squares, regions, neighbours, monthly counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.sources.scratch import written


def points_in_squares(points: DataFrame, squares: DataFrame, cell: float = 0.25) -> DataFrame:
    """``point_id, square_id`` of the square each point lies in, edges included; of several the smallest (x0, y0, square_id).

    Squares (``square_id, x0, y0, x1, y1``) are listed under every cell of a grid they touch, points under theirs, and
    both are joined by cell: sorted, as Spark's estimates of sizes leave out the cells of a square.
    """
    cx = F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))
    cy = F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell)))
    s = squares.withColumn("_cx", cx).withColumn("_cy", cy)
    p = points.withColumn("_cx", F.floor(F.col("lng") / cell)).withColumn("_cy", F.floor(F.col("lat") / cell))
    hit = p.join(s.hint("merge"), ["_cx", "_cy"]).where(F.col("lng").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1")))
    return hit.groupBy("point_id").agg(F.min(F.struct("x0", "y0", "square_id"))["square_id"].alias("square_id"))


def box_level(x0: Column, y0: Column, x1: Column, y1: Column, cell: float) -> Column:
    """The level whose cells, of side ``cell * 2^level``, are at least as large as the box: it touches four of them at most."""
    side = F.greatest(x1 - x0, y1 - y0, F.lit(cell))
    return F.ceil(F.log2(side / F.lit(cell)) - 1e-9).cast("int")


def boxes_at_points(points: DataFrame, boxes: DataFrame, x: str, y: str, cell: float = 0.25) -> DataFrame:
    """Rows of ``points`` with those of ``boxes`` (``x0, y0, x1, y1``) that hold them, edges included; joined by cells of many sizes.

    A box is listed under the cells it touches at its own level, and a point once for each level that boxes are of: so a box
    of any size takes four rows at most, and a point as many as there are levels, which only their sizes' logarithms count.
    """
    side = lambda level: F.lit(cell) * F.pow(F.lit(2.0), level)
    at = lambda c, level: F.floor(c / side(level))
    level = F.col("_level")
    b = boxes.withColumn("_level", box_level(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), cell)).where("_level is not null")
    used = sorted(r[0] for r in b.select("_level").distinct().collect())  # a row for each size, by powers of two
    b = b.withColumn("_cx", F.explode(F.sequence(at(F.col("x0"), level), at(F.col("x1"), level)))).withColumn("_cy", F.explode(F.sequence(at(F.col("y0"), level), at(F.col("y1"), level))))
    p = points.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in used]) if used else F.array().cast("array<int>")))
    p = p.withColumn("_cx", at(F.col(x), level)).withColumn("_cy", at(F.col(y), level))
    hit = p.join(b, ["_level", "_cx", "_cy"]).where(F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1")))
    return hit.drop("_level", "_cx", "_cy")


def square_regions(squares: DataFrame, regions: DataFrame, cell: float = 0.25) -> DataFrame:
    """The region (``code`` and bounds) that holds each square's middle; of several the smallest code, null for none.

    Regions may be of any number and of unlike sizes: :func:`boxes_at_points` joins them by equal cells. Boxes or squares with null
    bounds match nothing.
    """
    middles = squares.select("square_id", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"))
    found = boxes_at_points(middles, regions.select("code", "x0", "y0", "x1", "y1"), "mx", "my", cell)
    found = found.groupBy("square_id").agg(F.min("code").alias("region"))
    return squares.select("square_id").distinct().join(found, "square_id", "left")


def neighbours(squares: DataFrame, dx: float = 0.16, dy: float = 0.11) -> DataFrame:
    """``square_id, nb_id``: squares whose middles are nearer than ``dx`` and ``dy``, not the square itself.

    Each square is listed under nine cells, which Spark's estimates of sizes leave out: so the join is by sorted cells, and no side
    goes through the driver.
    """
    m = squares.select("square_id", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"))
    a = m.withColumn("_cx", F.floor(F.col("mx") / dx)).withColumn("_cy", F.floor(F.col("my") / dy))
    around = lambda c, d: F.explode(F.sequence(F.floor(F.col(c) / d) - 1, F.floor(F.col(c) / d) + 1))
    b = m.select(F.col("square_id").alias("nb_id"), F.col("mx").alias("nx"), F.col("my").alias("ny"))
    b = b.withColumn("_cx", around("nx", dx)).withColumn("_cy", around("ny", dy))
    both = a.join(b.hint("merge"), ["_cx", "_cy"]).where((F.col("square_id") != F.col("nb_id")) & (F.abs(F.col("mx") - F.col("nx")) < dx) & (F.abs(F.col("my") - F.col("ny")) < dy))
    return both.select("square_id", "nb_id")


def monthly_counts(seen: DataFrame) -> DataFrame:
    """``square_id, code, month, n`` for all twelve months, from rows ``square_id, code, month``."""
    n = seen.groupBy("square_id", "code", "month").agg(F.count("*").alias("n"))
    every = n.select("square_id", "code").distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return every.join(n, ["square_id", "code", "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def merge_neighbours(counts: DataFrame, near: DataFrame) -> DataFrame:
    """Counts of each square summed with those of its neighbours."""
    nb = near.join(counts.withColumnRenamed("square_id", "nb_id"), "nb_id").select("square_id", "code", "month", "n")
    return counts.select("square_id", "code", "month", "n").unionByName(nb).groupBy("square_id", "code", "month").agg(F.sum("n").alias("n"))


def rare_species(merged: DataFrame, limit: int = 1) -> DataFrame:
    """``square_id, code, total`` of species with at most ``limit`` sightings in a neighbourhood."""
    return merged.groupBy("square_id", "code").agg(F.sum("n").alias("total")).where(F.col("total") <= limit)


def species_present(merged: DataFrame) -> DataFrame:
    """Species of each square's neighbourhood with a total above 0."""
    some = merged.groupBy("square_id", "code").agg(F.sum("n").alias("total")).where("total > 0")
    return some.groupBy("square_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def mark_present(counts: DataFrame, marks: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Counts with marked species (``square_id, code``, optionally of neighbours too) set to 1 in every month without a count."""
    m = marks.select("square_id", "code")
    if near is not None:
        m = m.unionByName(near.join(m, "square_id").select(F.col("nb_id").alias("square_id"), "code")).distinct()
    m = m.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("n", F.lit(1).cast("long"))
    return counts.select("square_id", "code", "month", "n").unionByName(m).groupBy("square_id", "code", "month").agg(F.max("n").alias("n"))


def new_squares(points: DataFrame, width: float, height: float, cell: float = 1.0) -> DataFrame:
    """Squares for points that lie in none: in order of ``row_no`` each point not yet covered makes one around itself. Returns ``square_id`` (the point's row), bounds.

    The order is that of the whole table, worked out in rounds over cells of ``cell`` times half a square (1 at least). A square
    reaches no further than the cells next to its own, so the first open point of a cell can decide as soon as it is
    before the first open points of all eight around it: nothing earlier is left that could cover it. It makes a square,
    points that it covers are closed, and the next round begins, until no point is open. Any ``cell`` gives the same squares.

    A cell of any number of points sends one of them on (partial minima), and squares reach points by cells, so no cell is
    gathered in one task. The number of rounds is that of the longest chain of cells whose first points follow each other
    in order: few where the order is not one of place. Points without a place or row are left out; of points of one place
    the first counts, and of points of one row that with the smaller place comes first.
    """
    if cell < 1:
        raise ValueError("cells must have at least half the square's sides")
    half_x, half_y = width / 2, height / 2
    # a little larger than half a square, so that rounding can't reach over a whole cell
    dx, dy = half_x * cell * (1 + 1e-9), half_y * cell * (1 + 1e-9)
    open_ = points.where("lng is not null and lat is not null and row_no is not null").groupBy("lng", "lat").agg(F.min("row_no").alias("row_no"))
    open_ = written(open_.select(F.floor(F.col("lng") / dx).alias("cx"), F.floor(F.col("lat") / dy).alias("cy"), F.struct("row_no", "lng", "lat").alias("p")), "new-squares-points")
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    bounds = lambda p: [(p["lng"] - half_x).alias("x0"), (p["lat"] - half_y).alias("y0"), (p["lng"] + half_x).alias("x1"), (p["lat"] + half_y).alias("y1")]
    made: list[DataFrame] = []
    while True:
        heads = open_.groupBy("cx", "cy").agg(F.min("p").alias("p"))
        near = heads.select(around("cx").alias("cx"), "cy", "p").select("cx", around("cy").alias("cy"), "p")
        first = near.groupBy("cx", "cy").agg(F.min("p").alias("p"))
        # the first of the nine cells around, if it is a cell's own
        new = written(heads.join(first, ["cx", "cy", "p"]).select("p.row_no", *bounds(F.col("p")), "cx", "cy"), "new-squares-made")
        if not new.limit(1).count():
            break
        made.append(new)
        reach = new.drop("row_no").withColumn("cx", around("cx")).withColumn("cy", around("cy"))
        # several squares may reach into a cell, but not more than fit around it
        gone = reach.groupBy("cx", "cy").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"))
        inside = lambda b: F.col("p.lng").between(b["x0"], b["x1"]) & F.col("p.lat").between(b["y0"], b["y1"])
        left = open_.join(gone, ["cx", "cy"], "left").where(F.col("boxes").isNull() | ~F.exists("boxes", inside))
        open_ = written(left.select("cx", "cy", "p"), "new-squares-points")
    schema = new.select(F.col("row_no").alias("square_id"), "x0", "y0", "x1", "y1")
    return reduce(DataFrame.unionByName, [m.select(F.col("row_no").alias("square_id"), "x0", "y0", "x1", "y1") for m in made], schema)


def nested_counts(counts: DataFrame) -> DataFrame:
    """``square_id, species_per_month``: code to month to count, for export."""
    months = counts.groupBy("square_id", "code").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("month", "n")))).alias("m"))
    return months.groupBy("square_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "m"))).alias("species_per_month"))


def latest_observation(seen: DataFrame, date: str = "obs_date") -> DataFrame:
    """One row: the latest date among sightings that have a square and a code."""
    return seen.where("square_id is not null and code is not null").agg(F.max(date).alias("latest_obs_date"))


def grid_export(counts: DataFrame, seen: DataFrame, source: str, date: str = "obs_date") -> DataFrame:
    """:func:`nested_counts` with the latest date and the name of the source on every row, for JSON."""
    return nested_counts(counts).crossJoin(F.broadcast(latest_observation(seen, date))).withColumn("source", F.lit(source))  # one row
