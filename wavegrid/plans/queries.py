"""Named queries over the supplied tables, each with its SQL for an independent check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.functions import arrays
from wavegrid.operators import evaluate, features, filters, grid, intervals, labels, models, segmenting, splitting
from wavegrid.operators import folds as folds_
from wavegrid.sources import writers
from wavegrid.sources.tables import event_intervals, table
from wavegrid.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Interval view of events, as in sources.tables.event_intervals.
EVENTS = """iv AS (SELECT event_id AS track_id, user_id AS rec_id, event_type AS label, value,
  epoch_us(ts) / 1e6 AS "start", epoch_us(ts) / 1e6 + 600.0 * value AS "end" FROM events)"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@query(
    "merge_nearby",
    f"""WITH {EVENTS},
    o AS (SELECT *, max("end") OVER (PARTITION BY rec_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
          FROM iv WHERE "start" IS NOT NULL AND "end" IS NOT NULL),
    r AS (SELECT *, sum(CASE WHEN before IS NULL OR "start" - before >= 60 THEN 1 ELSE 0 END)
            OVER (PARTITION BY rec_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM o)
    SELECT rec_id, CAST(run AS BIGINT) AS run, round(min("start"), 3) AS "start", round(max("end"), 3) AS "end", count(*) AS n_merged
    FROM r GROUP BY rec_id, run""",
)
def merge_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intervals.merge_nearby(event_intervals(spark, sf_dir), ["rec_id"], 60.0)
    return out.select("rec_id", "run", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n_merged")


#: Clicks as tracks, views as signals whose low frequency is 40 * value Hz.
TRACKS_SQL = f"""{EVENTS},
  tr AS (SELECT track_id, rec_id, label, "start", "end" FROM iv WHERE label = 'click'),
  sg AS (SELECT track_id AS b_id, rec_id, "start" AS b_start, "end" AS b_end, 40.0 * value AS f_lo FROM iv WHERE label = 'view'),
  ov AS (SELECT tr.*, b_id, b_start, b_end, f_lo FROM tr JOIN sg ON tr.rec_id = sg.rec_id AND "start" < b_end AND b_start < "end" AND "start" < "end" AND b_start < b_end)"""
CELL = 6 * 3600.0


def _tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    iv = event_intervals(spark, sf_dir)
    tracks = iv.where("label = 'click'").select("track_id", "rec_id", "label", "start", "end")
    signals = iv.where("label = 'view'").select(
        F.col("track_id").alias("b_id"), "rec_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"), (F.lit(40.0) * F.col("value")).alias("f_lo")
    )
    return tracks, signals


@query("interval_overlap", f"""WITH {TRACKS_SQL} SELECT track_id, b_id, round(least("end", b_end) - greatest("start", b_start), 3) AS shared FROM ov""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks, signals = _tracks(spark, sf_dir)
    shared = intervals.overlap(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end"))
    return intervals.overlapping(tracks, signals, "rec_id", CELL).select("track_id", "b_id", F.round(shared, 3).alias("shared"))


@query(
    "union_share",
    f"""WITH {TRACKS_SQL},
    c AS (SELECT track_id, greatest("start", b_start) AS lo, least("end", b_end) AS hi FROM ov WHERE f_lo >= 1000),
    m AS (SELECT *, max(hi) OVER (PARTITION BY track_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
    s AS (SELECT track_id, sum(greatest(0, hi - greatest(lo, coalesce(before, lo)))) AS covered FROM m GROUP BY track_id)
    SELECT tr.track_id, round(CASE WHEN "end" > "start" THEN coalesce(covered, 0) / ("end" - "start") ELSE 0 END, 6) AS signal_percent,
      CASE WHEN "end" > "start" THEN coalesce(covered, 0) / ("end" - "start") ELSE 0 END < 0.1 AS is_low
    FROM tr LEFT JOIN s USING (track_id)""",
)
def union_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks, signals = _tracks(spark, sf_dir)
    out = intervals.low_signal(intervals.union_share(tracks, signals, "rec_id", CELL))
    return out.withColumn("signal_percent", F.round("signal_percent", 6))


@query(
    "trim_to_signal",
    f"""WITH {TRACKS_SQL} SELECT rec_id, track_id, round("start", 3) AS og_start, round("end", 3) AS og_end,
    round(greatest("start", min(b_start)), 3) AS "start", round(least("end", max(b_end)), 3) AS "end"
    FROM ov GROUP BY rec_id, track_id, "start", "end" """,
)
def trim_to_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks, signals = _tracks(spark, sf_dir)
    out = intervals.trim_to_signal(tracks, signals, "rec_id", CELL)
    return out.select("rec_id", "track_id", *[F.round(c, 3).alias(c) for c in ("og_start", "og_end", "start", "end")])


@query(
    "overlap_labels",
    f"""WITH {EVENTS}, p AS (SELECT a.track_id AS sample_id, b.track_id AS tid, b.label, CASE WHEN b.value > 60 THEN NULL ELSE 40 * b.value END AS lo, 80 * b.value AS hi
      FROM iv a JOIN iv b ON a.rec_id = b.rec_id AND a.track_id <> b.track_id AND a."start" < b."end" AND b."start" < a."end" AND a."start" < a."end" AND b."start" < b."end"
      WHERE a.label = 'click' AND least(a."end", b."end") - greatest(a."start", b."start") >= 0.9 * least(a."end" - a."start", b."end" - b."start"))
    SELECT sample_id, list_sort(list(DISTINCT label)) AS labels, list_sort(list(DISTINCT tid)) AS track_ids,
      CASE WHEN bool_or(lo IS NULL) THEN NULL ELSE min(lo) END AS min_freq, CASE WHEN bool_or(hi IS NULL) THEN NULL ELSE max(hi) END AS max_freq
    FROM p GROUP BY sample_id""",
)
def overlap_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = event_intervals(spark, sf_dir)
    samples = iv.where("label = 'click'").select(F.col("track_id").alias("sample_id"), "track_id", "rec_id", "start", "end")
    tracks = iv.select(
        "rec_id",
        F.col("track_id").alias("b_track_id"),
        F.col("label").alias("b_label"),
        F.col("start").alias("b_start"),
        F.col("end").alias("b_end"),
        F.when(F.col("value") <= 60, F.lit(40) * F.col("value")).alias("b_min_freq"),
        (F.lit(80) * F.col("value")).alias("b_max_freq"),
    )
    return intervals.overlap_labels(samples, tracks, "rec_id", CELL)


@query(
    "best_window",
    """WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS "offset", len(embedding) AS n FROM embeddings),
    s AS (SELECT *, round(sum(v) OVER (PARTITION BY vec_id ORDER BY "offset" ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING), 9) AS total FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY total DESC, "offset") AS k FROM s WHERE "offset" + 12 <= n OR "offset" = 0)
    SELECT vec_id, CAST("offset" AS INTEGER) AS "offset", round(total, 6) AS total FROM r WHERE k = 1""",
)
def best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intervals.best_window(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 12)
    return out.withColumn("total", F.round("total", 6))


@query(
    "best_segment",
    f"""WITH {EVENTS},
    tr AS (SELECT track_id, rec_id, "start", "start" + value AS "end", greatest(floor((value - 3) / 0.5), 0) AS n FROM iv WHERE label = 'click'),
    sg AS (SELECT rec_id, "start" AS b_start, "start" + value AS b_end FROM iv WHERE label <> 'click'),
    st AS (SELECT track_id, rec_id, n, unnest(range(0, n::INT + 1)) AS k, "start" FROM tr),
    sp AS (SELECT *, "start" + k * 0.5 AS a, "start" + k * 0.5 + 3 AS b FROM st),
    ow AS (SELECT track_id, k, n, a, coalesce((SELECT sum(least(b, b_end) - greatest(a, b_start)) FROM sg WHERE sg.rec_id = sp.rec_id AND a < b_end AND b_start < b AND b_start < b_end), 0) AS own FROM sp),
    sc AS (SELECT *, round(CASE WHEN k = 0 THEN own + coalesce(lead(own) OVER w, 0) ELSE own + (coalesce(lag(own) OVER w, 0) + coalesce(lead(own) OVER w, 0)) / 2 END, 6) AS score
           FROM ow WINDOW w AS (PARTITION BY track_id ORDER BY k)),
    r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, k) AS x FROM sc WHERE k < n OR n = 0)
    SELECT track_id, CAST(k AS INTEGER) AS k, round(a, 3) AS seg_start, round(own, 3) AS own, round(score, 3) AS score FROM r WHERE x = 1""",
)
def best_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = event_intervals(spark, sf_dir).withColumn("end", F.col("start") + F.col("value"))
    tracks = iv.where("label = 'click'").select("track_id", "rec_id", "start", "end")
    signals = iv.where("label <> 'click'").select("rec_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    out = intervals.best_segment(tracks, signals, "rec_id", 600.0)
    return out.select("track_id", "k", *[F.round(c, 3).alias(c) for c in ("seg_start", "own", "score")])


@query(
    "consecutive_agreement",
    """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS l, lag(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE l = event_type AND v > 5 AND value > 5""",
)
def consecutive_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return intervals.consecutive_agreement(e, "user_id", ["ts", "event_id"], "event_type", "value", 5.0).select("event_id", "user_id", "event_type")


_U = "(CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query(
    "segment_tracks",
    f"""WITH t AS (SELECT event_id AS track_id, 0.0::DOUBLE AS s, value AS e, CAST(greatest(round_even(value - 3, 0), 0) AS INT) + 1 AS n FROM events WHERE value > 0),
    m AS (SELECT *, unnest(range(0, CAST(ceil(e) AS INT))) AS i, 'main' AS list FROM t),
    q AS (SELECT *, unnest(range(0, n)) AS i, 'small' AS list FROM t),
    a AS (SELECT *, CASE WHEN n <= 4 OR row_number() OVER (PARTITION BY track_id ORDER BY md5('3|pick|' || track_id || '|' || i)) <= 4 THEN 'used' ELSE 'unused' END AS kind, 0.0 AS shift FROM m
          UNION ALL SELECT *, 'small_stride', 0.5 FROM q),
    b AS (SELECT *, greatest(0, s + i + shift + CASE WHEN n > 1 THEN {_U.format("'3|' || list || '|' || track_id || '|' || i")} / 2 - 0.25 ELSE 0 END) AS x FROM a),
    c AS (SELECT *, least(x + 3, e) AS y FROM b)
    SELECT track_id, kind, CAST(i AS INT) AS i, round(x, 6) AS sample_start, round(y, 6) AS sample_end FROM c
    WHERE (list = 'main' AND i = 0) OR (x <= e AND y - x >= CASE WHEN list = 'small' AND i = 0 THEN 1.5 ELSE 2.5 END)""",
)
def segment_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("track_id"), F.lit(0.0).alias("start"), F.col("value").alias("end"))
    return segmenting.segment_tracks(t).select("track_id", "kind", "i", F.round("sample_start", 6).alias("sample_start"), F.round("sample_end", 6).alias("sample_end"))


@query(
    "predict_windows",
    f"""WITH {EVENTS}, t AS (SELECT track_id, value * 2 AS s, value * 3 AS e FROM iv),
    w AS (SELECT *, unnest(range(0, CAST(greatest(floor(e - s - 3), 0) AS INT) + 1)) AS i FROM t),
    x AS (SELECT track_id, i, CASE WHEN e - s < 3 THEN greatest(0, (s + e - 3) / 2) ELSE s END + i AS a FROM w)
    SELECT track_id, CAST(i AS INT) AS i, round(a, 6) AS win_start, round(a + 3, 6) AS win_end FROM x""",
)
def predict_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_intervals(spark, sf_dir).select("track_id", (F.col("value") * 2).alias("start"), (F.col("value") * 3).alias("end"))
    return segmenting.predict_windows(t).select("track_id", "i", F.round("win_start", 6).alias("win_start"), F.round("win_end", 6).alias("win_end"))


@query(
    "fixed_chunks",
    """WITH d AS (SELECT event_id AS rec_id, value * 10 AS duration, CAST(ceil(value * 10 / 60) AS INT) AS whole FROM events),
    n AS (SELECT *, CASE WHEN duration - (whole - 1) * 60 < 20 THEN whole - 1 ELSE whole END AS n FROM d),
    m AS (SELECT rec_id, duration, n, unnest(range(0, n)) AS i FROM n WHERE n > 1),
    w AS (SELECT rec_id, duration, unnest(range(0, CAST(greatest(ceil(duration / 3), 1) AS INT))) AS i FROM d WHERE duration > 0)
    SELECT rec_id, 'minute' AS kind, CAST(i AS INT) AS i, round(i * 60, 6) AS a, round(CASE WHEN i = n - 1 THEN duration ELSE (i + 1) * 60 END, 6) AS b FROM m
    UNION ALL SELECT rec_id, 'flush', CAST(i AS INT), round(greatest(0, least(i * 3, duration - 3)), 6), round(least(greatest(0, least(i * 3, duration - 3)) + 3, duration), 6) FROM w""",
)
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").select(F.col("event_id").alias("rec_id"), (F.col("value") * 10).alias("duration"))
    m = segmenting.minute_chunks(r).select("rec_id", F.lit("minute").alias("kind"), "i", F.round("chunk_start", 6).alias("a"), F.round("chunk_end", 6).alias("b"))
    w = segmenting.fixed_windows(r).select("rec_id", F.lit("flush").alias("kind"), "i", F.round("win_start", 6).alias("a"), F.round("win_end", 6).alias("b"))
    return m.unionByName(w)


@query(
    "even_split",
    f"""WITH {EVENTS}, t AS (SELECT track_id, value AS e, CAST(greatest(ceil(value / 6), 1) AS INT) AS n FROM iv),
    p AS (SELECT *, unnest(range(0, n)) AS part FROM t)
    SELECT track_id, CAST(part AS INT) AS part, round(part * (e / n), 6) AS "start", round((part + 1) * (e / n), 6) AS "end" FROM p""",
)
def even_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_intervals(spark, sf_dir).select("track_id", F.lit(0.0).alias("start"), F.col("value").alias("end"))
    return segmenting.even_split(t).select("track_id", "part", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


# ---- labels


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names as aliases of their keys; a region's name overrides a nation's of the same name."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("alias"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("code"))
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("alias"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("code"))
    return labels.alias_map((n, 1), (r, 2))


_ALIAS_SQL = """raw AS (SELECT replace(lower(n_name), ' ', '-') AS alias, 'n' || n_nationkey AS code, 1 AS priority FROM nation
  UNION ALL SELECT replace(lower(r_name), ' ', '-'), 'r' || r_regionkey, 2 FROM region),
  am AS (SELECT alias, code FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY priority DESC, code DESC) AS k FROM raw) WHERE k = 1)"""


@query("alias_to_code", f"""WITH {_ALIAS_SQL}, t AS (SELECT p_partkey, p_type, n_name FROM part JOIN nation ON n_nationkey = p_partkey % 30)
  SELECT p_partkey, coalesce(code, n_name) AS code FROM t LEFT JOIN am ON replace(lower(n_name), ' ', '-') = alias
  UNION ALL SELECT p_partkey, coalesce(code, p_type) FROM part LEFT JOIN am ON replace(lower(p_type), ' ', '-') = alias""")
def alias_to_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    am, part, nation = _aliases(spark, sf_dir), table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    a = part.join(nation, F.col("n_nationkey") == F.col("p_partkey") % 30)
    one = labels.to_code(a, "n_name", am).select("p_partkey", "code")
    return one.unionByName(labels.to_code(part, "p_type", am).select("p_partkey", "code"))


@query("code_aliases", """WITH am AS (SELECT replace(lower(p_name), ' ', '-') AS alias, max(p_brand) AS code FROM part GROUP BY 1)
  SELECT code, list_sort(list(alias)) AS aliases, min(alias) AS display_name FROM am GROUP BY code""")
def code_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("alias"), F.col("p_brand").alias("code"))
    return labels.code_aliases(labels.alias_map((names, 1)))


#: Merges of part types for these queries: by the first word of the type.
_MERGE_SQL = "SELECT DISTINCT p_type AS label, split_part(p_type, ' ', 1) AS target FROM part WHERE p_size % 3 = 0"


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size % 3 = 0").select(F.col("p_type").alias("label"), F.split("p_type", " ")[0].alias("target")).distinct()


@query("relabel_counts", f"""WITH m AS ({_MERGE_SQL}) SELECT coalesce(target, p_type) AS label, count(DISTINCT p_partkey) AS n_tracks, count(DISTINCT p_brand) AS n_recs
  FROM part LEFT JOIN m ON p_type = label GROUP BY 1""")
def relabel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("label", F.col("p_type"))
    return labels.label_report(labels.relabel(parts, "label", _merges(spark, sf_dir)), "label", "p_partkey", "p_brand")


_COUNTS_SQL = "SELECT p_type AS label, count(*) AS n_samples, count(DISTINCT p_brand) AS n_recs, count(*) FILTER (p_partkey % 7 = 0) AS n_val FROM part GROUP BY p_type"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("label")).agg(
        F.count("*").alias("n_samples"), F.countDistinct("p_brand").alias("n_recs"), F.count_if(F.col("p_partkey") % 7 == 0).alias("n_val")
    )


@query("label_select", f"""WITH m AS ({_MERGE_SQL}), c AS ({_COUNTS_SQL}) SELECT coalesce(target, c.label) AS label, CAST(sum(n_samples) AS BIGINT) AS n_samples, CAST(sum(n_recs) AS BIGINT) AS n_recs, CAST(sum(n_val) AS BIGINT) AS n_val
  FROM c LEFT JOIN m USING (label) GROUP BY 1 HAVING sum(n_samples) > 20 AND sum(n_recs) > 10 AND sum(n_val) > 2""")
def label_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.select_training(_counts(spark, sf_dir), _merges(spark, sf_dir), 20, 10, 2)


def _event_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Event types and a few more as labels; purchases merge into clicks, errors are left out, views are trained."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("label")).distinct()
    more = e.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ["bird", "noise", "wind", "rain", "human", "sheep"]))).alias("label"))
    merges = e.where("label = 'purchase'").select("label", F.lit("click").alias("target"))
    return e.unionByName(more), e.where("label = 'error'"), merges, e.where("label = 'view'")


@query(
    "label_remap",
    """WITH l AS (SELECT DISTINCT event_type AS label FROM events UNION SELECT unnest(['bird', 'noise', 'wind', 'rain', 'human', 'sheep'])),
    g AS (SELECT label, CASE WHEN label = 'purchase' THEN 'click' ELSE label END AS goal FROM l WHERE label <> 'error'),
    n AS (SELECT goal, row_number() OVER (ORDER BY goal) - 1 AS i FROM (SELECT DISTINCT goal FROM g)),
    x AS (SELECT l.label, g.goal, n.i, CASE WHEN g.goal IS NULL OR l.label = 'bird' THEN NULL WHEN l.label IN ('wind','vehicle','dog','rain','static','noise','cat') THEN 'noise' WHEN l.label IN ('human','sheep') THEN 'human' ELSE 'bird' END AS grp
          FROM l LEFT JOIN g USING (label) LEFT JOIN n USING (goal))
    SELECT label, x.goal AS target, CAST(CASE WHEN x.goal IS NULL THEN -1 WHEN label = 'view' OR q.i IS NULL OR grp = label THEN x.i ELSE q.i END AS INT) AS target_i,
      CAST(CASE WHEN label = 'view' AND grp = 'bird' THEN q.i END AS INT) AS extra_i FROM x LEFT JOIN n q ON x.grp = q.goal""",
)
def label_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_, excluded, merges, trained = _event_labels(spark, sf_dir)
    return labels.remap(all_, excluded, merges, trained)


@query("excluded_labels", """SELECT DISTINCT event_type AS label FROM events WHERE event_type NOT IN ('view', 'purchase')""")
def excluded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_, _, merges, trained = _event_labels(spark, sf_dir)
    return labels.excluded_labels(all_, trained, merges.withColumn("target", F.lit("view")))


@query("label_difference", """SELECT p_type AS label, 'removed' AS change FROM (SELECT p_type FROM part WHERE p_size < 25 EXCEPT SELECT p_type FROM part WHERE p_size >= 20)
  UNION ALL SELECT p_type, 'added' FROM (SELECT p_type FROM part WHERE p_size >= 20 EXCEPT SELECT p_type FROM part WHERE p_size < 25)
  UNION ALL SELECT p_brand, 'removed' FROM (SELECT p_brand FROM part WHERE p_size < 4 EXCEPT SELECT p_brand FROM part WHERE p_size >= 49)""")
def label_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    t = p.select(F.col("p_type").alias("label"), "p_size")
    b = p.select(F.col("p_brand").alias("label"), "p_size")
    one = labels.label_difference(t.where("p_size < 25"), t.where("p_size >= 20"))
    return one.unionByName(labels.label_difference(b.where("p_size < 4"), b.where("p_size >= 49")).where("change = 'removed'"))


# ---- splits and balance


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples of their customers, tagged by priority."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("bin_id"), F.col("o_orderpriority").alias("tag"))


_SPLIT_SQL = """sm AS (SELECT o_orderkey AS sample_id, o_custkey AS bin_id, o_orderpriority AS tag FROM orders),
  bn AS (SELECT bin_id, min(tag) AS owner, count(DISTINCT sample_id) AS n FROM sm {where} GROUP BY bin_id),
  li AS (SELECT owner, count(DISTINCT sample_id) AS os, count(DISTINCT sm.bin_id) AS ob FROM sm JOIN bn ON sm.bin_id = bn.bin_id AND tag = owner GROUP BY owner),
  s1 AS (SELECT bn.*, os, ob, coalesce(sum(n) OVER b, 0) AS s, row_number() OVER w - 1 AS b FROM bn JOIN li USING (owner)
         WINDOW w AS (PARTITION BY owner ORDER BY md5('1|' || bin_id), bin_id), b AS (PARTITION BY owner ORDER BY md5('1|' || bin_id), bin_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s2 AS (SELECT *, s < greatest(1, os * 0.15::DOUBLE) OR b < greatest(1, ob * 0.15::DOUBLE) AS v FROM s1),
  s3 AS (SELECT *, sum(CASE WHEN v THEN n ELSE 0 END) OVER w AS vs, sum(v::INT) OVER w AS vb FROM s2 WINDOW w AS (PARTITION BY owner ORDER BY md5('1|' || bin_id), bin_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  sp AS (SELECT bin_id, owner, CASE WHEN v THEN 'validation' WHEN s - vs < greatest(1, os * 0.05::DOUBLE) OR b - vb < greatest(1, ob * 0.05::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM s3)"""


@query("split_leakfree", f"WITH {_SPLIT_SQL.format(where='')} SELECT * FROM sp")
def split_leakfree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_leakfree(_samples(spark, sf_dir))


@query("split_leaks", """WITH s AS (SELECT user_id, CASE WHEN event_id % 40 = 0 THEN 'test' ELSE 'train' END AS split FROM events)
  SELECT user_id, list_sort(list(DISTINCT split)) AS splits FROM s GROUP BY user_id HAVING count(DISTINCT split) > 1""")
def split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 40 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"))
    return splitting.split_leaks(e, "user_id")


@query(
    "split_from_list",
    f"WITH {_SPLIT_SQL.format(where='WHERE bin_id % 5 <> 0')} SELECT bin_id, split FROM sp UNION ALL SELECT DISTINCT bin_id, 'listed' FROM sm WHERE bin_id % 5 = 0",
)
def split_from_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    listed = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("bin_id"), F.lit("listed").alias("split"))
    return splitting.split_from_list(s.select("bin_id").distinct(), listed, s)


_DOC_TAGS_SQL = "SELECT doc_id AS sample_id, source AS tag FROM documents"


@query(
    "undersample",
    f"""WITH s AS ({_DOC_TAGS_SQL} UNION ALL SELECT doc_id, lang FROM documents), c AS (SELECT tag, count(*) AS n FROM s GROUP BY tag),
    t AS (SELECT min(n) * 0.75::DOUBLE AS goal FROM (SELECT n FROM c ORDER BY n DESC LIMIT 9)),
    r AS (SELECT sample_id, {_U.format("'1|' || tag || '|' || sample_id")} >= CASE WHEN n > goal THEN (n - goal) / n ELSE 0 END AS lives FROM s JOIN c USING (tag), t)
    SELECT sample_id FROM r GROUP BY sample_id HAVING bool_and(lives)""",
)
def undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    s = d.select(F.col("doc_id").alias("sample_id"), F.col("source").alias("tag")).unionByName(d.select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("tag")))
    return splitting.undersample(s)


@query(
    "oversample",
    """WITH s AS (SELECT event_id AS sample_id, event_type AS tag, event_id % 3 AS priority FROM events), u AS (SELECT * FROM s WHERE priority = 0 AND tag <> 'click' OR sample_id % 9 = 0),
    c AS (SELECT tag, count(*) AS n FROM u GROUP BY tag), t AS (SELECT 2 * min(n) AS target FROM (SELECT n FROM c ORDER BY n DESC LIMIT 9)),
    t2 AS (SELECT min(n) AS target FROM (SELECT n FROM c ORDER BY n DESC LIMIT 1)),
    r AS (SELECT p.*, row_number() OVER (PARTITION BY p.tag ORDER BY priority, md5('1|' || p.tag || '|' || sample_id), sample_id) AS k, target - n AS deficit
          FROM s p JOIN c ON p.tag = c.tag, (SELECT min(n) AS target FROM (SELECT n FROM c ORDER BY n DESC LIMIT 9)) WHERE priority > 0)
    SELECT sample_id, tag, CAST(priority AS BIGINT) AS priority FROM r WHERE k <= deficit
    UNION ALL SELECT count(*), 'used', count(DISTINCT tag) FROM u""",
)
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select(F.col("event_id").alias("sample_id"), F.col("event_type").alias("tag"), (F.col("event_id") % 3).alias("priority"))
    used = s.where("priority = 0 and tag <> 'click' or sample_id % 9 = 0")
    out = splitting.oversample(used.select("sample_id", "tag"), s.where("priority > 0"))
    return out.unionByName(used.agg(F.count("*").alias("sample_id"), F.lit("used").alias("tag"), F.countDistinct("tag").alias("priority")).select("sample_id", "tag", "priority"))


@query("folds", f"""SELECT user_id, CAST(CASE WHEN {_U.format("'1|hold|' || user_id")} < 0.2 THEN -1 ELSE floor({_U.format("'1|fold|' || user_id")} * 5) END AS INT) AS fold FROM (SELECT DISTINCT user_id FROM events)""")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.folds(table(spark, sf_dir, "events"), "user_id")


@query("interleave", """WITH t AS (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY md5('1|' || doc_id), doc_id) AS INT) AS turn FROM documents)
  SELECT * FROM t WHERE turn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY source))""")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.interleave(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], stop_on_empty=True)


@query("uniform_classes", f"""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT doc_id, d.lang FROM documents d JOIN c ON d.lang = c.lang
  WHERE {_U.format("'1|' || doc_id")} < (SELECT min(n) FROM c) / n::DOUBLE""")
def uniform_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.uniform_classes(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"]).select("doc_id", "lang")


@query(
    "mixup_pairs",
    f"""WITH e AS (SELECT vec_id, embedding, label, CAST(floor({_U.format("'1|run|' || vec_id")} * 64) AS INT) AS run FROM embeddings),
    a AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY md5('1|' || vec_id), vec_id) AS k FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY md5('2|' || vec_id), vec_id) AS k FROM e),
    p AS (SELECT a.vec_id, b.vec_id AS partner, 0.2 + 0.6 * {_U.format("'1|mix|' || a.vec_id")} AS share, a.label AS l1, b.label AS l2, a.embedding AS x, b.embedding AS y FROM a JOIN b USING (run, k))
    SELECT vec_id, partner, round(share, 6) AS share, CASE WHEN share >= 0.5 THEN l1 ELSE l2 END AS label, CAST(i - 1 AS INT) AS i, round(share * x[i]::DOUBLE + (1 - share) * y[i]::DOUBLE, 6) AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM p)""",
)
def mixup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = splitting.mixup_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    long_ = m.select("vec_id", "partner", F.round("share", 6).alias("share"), "label", F.posexplode("embedding").alias("i", "v"))
    return long_.withColumn("v", F.round("v", 6))


# ---- grid

#: Customers as points in a box of 4 by 3 degrees, squares of 0.1 by 0.09 degrees under its lower left part.
_POINTS_SQL = """pt AS (SELECT c_custkey AS point_id, 172.0::DOUBLE + (c_custkey * 7919 % 40000) / 10000.0::DOUBLE AS lng, -43.0::DOUBLE + (c_custkey * 104729 % 30000) / 10000.0::DOUBLE AS lat FROM customer),
  sq AS (SELECT p_partkey AS square_id, 172.0::DOUBLE + ((p_partkey - 1) % 25) * 0.1::DOUBLE AS x0, -43.0::DOUBLE + floor((p_partkey - 1) / 25) * 0.09::DOUBLE AS y0 FROM part),
  sb AS (SELECT *, x0 + 0.1::DOUBLE AS x1, y0 + 0.09::DOUBLE AS y1 FROM sq),
  hit AS (SELECT point_id, arg_min(square_id, (x0, y0, square_id)) AS square_id FROM pt JOIN sb ON lng BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY point_id),
  mc AS (SELECT square_id, c.c_mktsegment AS code, month(o_orderdate) AS month, count(*) AS n FROM hit JOIN customer c ON point_id = c_custkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
  mz AS (SELECT k.square_id, k.code, CAST(m.month AS INT) AS month, coalesce(n, 0) AS n FROM (SELECT DISTINCT square_id, code FROM mc) k CROSS JOIN (SELECT unnest(range(1, 13)) AS month) m LEFT JOIN mc ON mc.square_id = k.square_id AND mc.code = k.code AND mc.month = m.month),
  nb AS (SELECT a.square_id, b.square_id AS nb_id FROM sb a JOIN sb b ON a.square_id <> b.square_id AND abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) < 0.16 AND abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) < 0.11),
  mg AS (SELECT square_id, code, month, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM mz UNION ALL SELECT nb.square_id, code, month, n FROM nb JOIN mz ON mz.square_id = nb_id) GROUP BY ALL)"""


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    points = c.select(
        F.col("c_custkey").alias("point_id"),
        (F.lit(172.0) + F.col("c_custkey") * 7919 % 40000 / F.lit(10000.0)).alias("lng"),
        (F.lit(-43.0) + F.col("c_custkey") * 104729 % 30000 / F.lit(10000.0)).alias("lat"),
    )
    i = F.col("p_partkey") - 1
    squares = p.select(F.col("p_partkey").alias("square_id"), (F.lit(172.0) + i % 25 * F.lit(0.1)).alias("x0"), (F.lit(-43.0) + F.floor(i / 25) * F.lit(0.09)).alias("y0"))
    return points, squares.withColumn("x1", F.col("x0") + 0.1).withColumn("y1", F.col("y0") + 0.09)


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, squares = _grid(spark, sf_dir)
    hit = grid.points_in_squares(points, squares)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_mktsegment").alias("code"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("point_id"), F.month("o_orderdate").alias("month"))
    return grid.monthly_counts(hit.join(c.hint("merge"), "point_id").join(o.hint("merge"), "point_id").select("square_id", "code", "month"))


@query("point_in_square", f"WITH {_POINTS_SQL} SELECT * FROM hit")
def point_in_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.points_in_squares(*_grid(spark, sf_dir))


@query("occurrence_by_month", f"WITH {_POINTS_SQL} SELECT * FROM mz")
def occurrence_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir)


@query("neighbours", f"WITH {_POINTS_SQL} SELECT * FROM nb")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.neighbours(_grid(spark, sf_dir)[1])


@query("neighbour_sum", f"WITH {_POINTS_SQL} SELECT * FROM mg")
def neighbour_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.merge_neighbours(_monthly(spark, sf_dir), grid.neighbours(_grid(spark, sf_dir)[1]))


@query("rare_species", f"WITH {_POINTS_SQL} SELECT square_id, code, CAST(sum(n) AS BIGINT) AS total FROM mg GROUP BY ALL HAVING sum(n) <= 12")
def rare_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.rare_species(neighbour_sum(spark, sf_dir), 12)


@query("species_present", f"WITH {_POINTS_SQL}, t AS (SELECT square_id, code FROM mg GROUP BY ALL HAVING sum(n) > 0) SELECT square_id, list_sort(list(code)) AS codes FROM t GROUP BY square_id")
def species_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.species_present(neighbour_sum(spark, sf_dir))


@query("mark_present", f"""WITH {_POINTS_SQL}, mk AS (SELECT square_id, 'MARKED' AS code FROM sb WHERE square_id % 50 = 1), al AS (SELECT * FROM mk UNION SELECT nb_id, code FROM nb JOIN mk USING (square_id))
  SELECT square_id, code, month, n FROM mz UNION ALL SELECT square_id, code, CAST(month AS INT), 1 FROM al CROSS JOIN (SELECT unnest(range(1, 13)) AS month)""")
def mark_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    squares = _grid(spark, sf_dir)[1]
    marks = squares.where("square_id % 50 = 1").select("square_id", F.lit("MARKED").alias("code"))
    return grid.mark_present(_monthly(spark, sf_dir), marks, grid.neighbours(squares))


@query("square_regions", f"""WITH {_POINTS_SQL}, rg AS (SELECT r_name AS code, 172.0::DOUBLE + r_regionkey * 0.5 AS rx0, 172.7::DOUBLE + r_regionkey * 0.5 AS rx1 FROM region)
  SELECT square_id, min(code) AS region FROM sb LEFT JOIN rg ON (x0 + x1) / 2 BETWEEN rx0 AND rx1 AND (y0 + y1) / 2 BETWEEN -42.6 AND -41.5 GROUP BY square_id""")
def square_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("code"), (F.lit(172.0) + F.col("r_regionkey") * F.lit(0.5)).alias("x0"), (F.lit(172.7) + F.col("r_regionkey") * F.lit(0.5)).alias("x1"), F.lit(-42.6).alias("y0"), F.lit(-41.5).alias("y1")
    )
    return grid.square_regions(_grid(spark, sf_dir)[1], r)


@query(
    "new_squares",
    f"""WITH RECURSIVE {_POINTS_SQL},
    rest AS MATERIALIZED (SELECT point_id AS row_no, lng, lat FROM pt WHERE point_id NOT IN (SELECT point_id FROM hit)),
    fold AS (SELECT 0 AS k, arg_min(row_no, row_no) AS row_no, [{{'x': arg_min(lng, row_no), 'y': arg_min(lat, row_no)}}] AS made FROM rest
      UNION ALL
      SELECT f.k + 1, n.row_no, list_append(f.made, {{'x': n.lng, 'y': n.lat}}) FROM fold f,
        LATERAL (SELECT row_no, lng, lat FROM rest r WHERE r.row_no > f.row_no
          AND len(list_filter(f.made, lambda m: r.lng BETWEEN m.x - 0.05 AND m.x + 0.05 AND r.lat BETWEEN m.y - 0.045 AND m.y + 0.045)) = 0 ORDER BY row_no LIMIT 1) n)
    SELECT row_no AS square_id, m.x - 0.05 AS x0, m.y - 0.045 AS y0, m.x + 0.05 AS x1, m.y + 0.045 AS y1
    FROM (SELECT row_no, made[len(made)] AS m FROM fold WHERE row_no IS NOT NULL)""",
)
def new_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, squares = _grid(spark, sf_dir)
    rest = points.join(grid.points_in_squares(points, squares), "point_id", "left_anti").withColumnRenamed("point_id", "row_no")
    return grid.new_squares(rest, 0.1, 0.09)


@query("nested_grid", f"""WITH {_POINTS_SQL} SELECT * FROM mz""")
def nested_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested counts, unfolded again."""
    codes = grid.nested_counts(_monthly(spark, sf_dir)).select("square_id", F.explode("species_per_month").alias("code", "m"))
    return codes.select("square_id", "code", F.explode("m").alias("month", "n"))


# ---- arrays


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("x", arrays.doubles("embedding"))


_X = "list_transform(embedding, lambda v: v::DOUBLE)"


def _places(df: DataFrame, key: str, **arrays_: F.Column) -> DataFrame:
    """A row for every place of arrays of one length, so that all of them are compared."""
    zipped = F.arrays_zip(*[c.alias(n) for n, c in arrays_.items()])
    return df.select(key, F.posexplode(zipped).alias("i", "z")).select(key, "i", *[F.round(F.col("z")[n], 6).alias(n) for n in arrays_])


_LONG_SQL = "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings"


@query(
    "array_minmax",
    f"""WITH l AS ({_LONG_SQL}), f AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd FROM l WINDOW w AS (PARTITION BY vec_id))
    SELECT vec_id, i, round(2 * ((v - lo) / (hi - lo + 1e-6)) - 1, 6) AS scaled, round((v - lo) / (hi - lo), 6) AS unit, round((v - m) / sd, 6) AS z FROM f""",
)
def array_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _places(_emb(spark, sf_dir), "vec_id", scaled=arrays.minmax(x), unit=arrays.unit_minmax(x), z=arrays.standardize(x))


@query(
    "power_to_db",
    f"""WITH l AS (SELECT vec_id, i, 10 * log10(greatest(v, 1e-10)) AS d FROM ({_LONG_SQL})) SELECT vec_id, i, round(greatest(d, max(d) OVER (PARTITION BY vec_id) - 80), 6) AS db FROM l""",
)
def power_to_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(_emb(spark, sf_dir), "vec_id", db=arrays.power_to_db(F.col("x")))


@query("array_stats", """WITH l AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
  SELECT label, CAST(i AS INT) AS i, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM l GROUP BY label, i""")
def array_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = arrays.elementwise_stats(table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return s.select("label", "i", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("ema", """WITH RECURSIVE e AS (SELECT vec_id, embedding AS x, 1 AS i, abs(embedding[1]::DOUBLE) AS m FROM embeddings
    UNION ALL SELECT vec_id, x, i + 1, 0.96 * m + 0.04 * abs(x[i + 1]::DOUBLE) FROM e WHERE i < len(x))
  SELECT vec_id, CAST(i - 1 AS INT) AS i, round(m, 6) AS ema, round(pow(abs(x[i]::DOUBLE) / pow(1e-6 + m, 0.98) + 2, 0.5) - sqrt(2), 6) AS pcen FROM e""")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir).withColumn("a", F.transform("x", lambda v: F.abs(v)))
    return _places(e, "vec_id", ema=arrays.ema(F.col("a"), block=24), pcen=arrays.pcen(F.col("a")))


@query(
    "nan_filter",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN vec_id % 5 = 0 THEN 'nan'::DOUBLE WHEN vec_id % 7 = 0 THEN 'inf'::DOUBLE WHEN vec_id % 11 = 0 THEN 0.5::DOUBLE ELSE v::DOUBLE * 4 END) AS x FROM embeddings)
    SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN true ELSE len(list_filter(x, lambda v: abs(v) > 1.00002)) > 0 END AS out_of_range,
    vec_id % 5 = 0 OR vec_id % 7 = 0 AS not_finite, vec_id % 5 = 0 OR vec_id % 7 = 0 OR vec_id % 11 = 0 AS constant FROM e""",
)
def nan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    x = F.transform("x", lambda v: F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 7 == 0, F.lit(float("inf"))).when(k % 11 == 0, F.lit(0.5)).otherwise(v * 4))
    return arrays.quality_flags(_emb(spark, sf_dir).select("vec_id", x.alias("x")), "x").drop("x")


@query(
    "multi_hot",
    """WITH d AS (SELECT doc_id, source, TRY_CAST(substr(source, 4) AS INT) AS si, CASE lang WHEN 'fr' THEN 20 WHEN 'de' THEN 21 WHEN 'es' THEN 22 END AS li FROM documents)
    SELECT doc_id, list_transform(range(0, 24), lambda i: CASE WHEN i = si THEN 1 WHEN i = li THEN 1 ELSE 0 END) AS y, coalesce(si, li) AS first_index, coalesce(source, 'noise') AS first_tag FROM d""",
)
def multi_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    names = {**{f"src{i}": i for i in range(20)}, "fr": 20, "de": 21, "es": 22, "en": -1}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    idx = arrays.label_indices(F.concat_ws("\n", F.lit("unknown"), "lang", "source"), m)
    tags = F.array(F.lit("noise"), F.col("source"))
    return d.select("doc_id", arrays.multi_hot(idx, 24).alias("y"), F.array_min(idx).alias("first_index"), arrays.first_tag(tags).alias("first_tag"))


# ---- evaluation: ten pseudo-probabilities per embedding, from its first ten values of each block


def _preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, track_id, k, y_true, y, probs, pre``: shares of ten labels in the squares of a half of all places each; tracks of four rows.

    A label has every tenth place of a half. Shares are rounded to 6 places.
    """
    e = _emb(spark, sf_dir)
    half = F.floor(F.size("x") / 2).cast("int")

    def block(first: F.Column, n: F.Column) -> F.Column:
        squares = F.transform(F.slice("x", first, n), lambda v, j: F.struct(F.pmod(j, F.lit(10)).alias("i"), (v * v).alias("v")))
        add = lambda some: F.aggregate(some, F.lit(0.0), lambda s, w: s + w)
        raw = arrays.let(squares, lambda q: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: add(F.transform(F.filter(q, lambda s: s["i"] == i), lambda s: s["v"]))))
        return arrays.let(raw, lambda r: arrays.let(add(r), lambda t: F.transform(r, lambda v: F.round(v / t, 6))))

    y = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when((i == F.col("label")) | ((F.col("vec_id") % 4 == 0) & (i == (F.col("label") + 3) % 10)), 1).otherwise(0))
    return e.select(
        F.col("vec_id").alias("row_id"), F.floor(F.col("vec_id") / 4).alias("track_id"), (F.col("vec_id") % 4).alias("k"), F.col("label").alias("y_true"), y.alias("y"), block(F.lit(1), half).alias("probs"), block(half + 1, F.size("x") - half).alias("pre")
    )


_RAW = """list_transform(range(0, 10), lambda i: coalesce(list_sum(list_transform(list_filter(range({a}, {b}), lambda j: (j - ({a})) % 10 = i),
    lambda j: embedding[j]::DOUBLE * embedding[j]::DOUBLE)), 0))"""
_PREDS_SQL = f"""sq AS (SELECT vec_id, label, {_RAW.format(a="1", b="len(embedding) // 2 + 1")} AS r, {_RAW.format(a="len(embedding) // 2 + 1", b="len(embedding) + 1")} AS q FROM embeddings),
  pr AS (SELECT vec_id AS row_id, vec_id // 4 AS track_id, vec_id % 4 AS k, label AS y_true,
  list_transform(range(0, 10), lambda i: CASE WHEN i = label OR (vec_id % 4 = 0 AND i = (label + 3) % 10) THEN 1 ELSE 0 END) AS y,
  list_transform(r, lambda v: round(v / list_sum(r), 6)) AS probs, list_transform(q, lambda v: round(v / list_sum(q), 6)) AS pre FROM sq),
  dc AS (SELECT *, CASE WHEN list_max(probs) > 0.2 THEN list_position(probs, list_max(probs)) - 1 ELSE -1 END AS pred_i,
         CASE WHEN list_max(pre) > 0.2 THEN list_position(pre, list_max(pre)) - 1 ELSE -1 END AS pre_i FROM pr),
  cl AS (SELECT CAST(a AS INT) AS true_i, CAST(b AS INT) AS pred_i FROM (SELECT unnest(range(0, 10)) AS a), (SELECT unnest(range(-1, 10)) AS b)),
  cm AS (SELECT cl.*, coalesce(n, 0) AS n FROM cl LEFT JOIN (SELECT y_true AS true_i, pred_i, count(*) AS n FROM dc GROUP BY ALL) USING (true_i, pred_i)),
  cp AS (SELECT cl.*, coalesce(n, 0) AS n FROM cl LEFT JOIN (SELECT y_true AS true_i, pre_i AS pred_i, count(*) AS n FROM dc GROUP BY ALL) USING (true_i, pred_i))"""


@query("confusion", f"WITH {_PREDS_SQL} SELECT * FROM cm")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_preds(spark, sf_dir), 10, 0.2)


@query("confusion_pct", f"WITH {_PREDS_SQL} SELECT *, round(CASE WHEN sum(n) OVER w > 0 THEN n * 100.0 / sum(n) OVER w ELSE 0 END, 6) AS percent FROM cm WINDOW w AS (PARTITION BY true_i)")
def confusion_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.row_percent(confusion(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query(
    "label_rates",
    f"""WITH {_PREDS_SQL}, r AS (SELECT l.true_i AS label_i, CAST((SELECT n FROM cm WHERE true_i = l.true_i AND pred_i = l.true_i) AS BIGINT) AS tp,
      CAST((SELECT sum(n) FROM cm WHERE true_i = l.true_i) AS BIGINT) AS actual, CAST((SELECT sum(n) FROM cm WHERE pred_i = l.true_i) AS BIGINT) AS predicted, CAST((SELECT sum(n) FROM cm) AS BIGINT) AS total
      FROM (SELECT DISTINCT true_i FROM cl) l)
    SELECT label_i, tp, predicted - tp AS fp, actual - tp AS fn, total - predicted - actual + tp AS tn, round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END, 6) AS precision,
      round(CASE WHEN actual > 0 THEN tp / actual ELSE 0 END, 6) AS recall, round(CASE WHEN predicted + actual > 0 THEN 2 * tp / (predicted + actual) ELSE 0 END, 6) AS f1 FROM r""",
)
def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.label_rates(confusion(spark, sf_dir))
    return r.select("label_i", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "multi_confusion",
    f"""WITH {_PREDS_SQL}, l AS (SELECT row_id, y, probs, unnest(range(0, 10)) AS i FROM pr), z AS (SELECT *, y[i + 1] AS yi, probs[i + 1] AS p FROM l),
    tr AS (SELECT row_id, i AS true_i FROM z WHERE yi = 1),
    m AS (SELECT true_i, i AS pred_i FROM z JOIN tr USING (row_id) WHERE yi = 0 AND p >= 0.2 UNION ALL SELECT i, CASE WHEN p >= 0.2 THEN i ELSE -1 END FROM z WHERE yi = 1),
    rk AS (SELECT row_id, i, p, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, i) AS k FROM z),
    b AS (SELECT row_id, CASE WHEN a.i = 0 AND s.p <> 0 THEN s.i ELSE a.i END AS i, CASE WHEN a.i = 0 AND s.p <> 0 THEN s.p ELSE a.p END AS p, a.p AS top FROM rk a JOIN rk s USING (row_id) WHERE a.k = 1 AND s.k = 2),
    n AS (SELECT tr.true_i, b.i AS pred_i FROM b JOIN tr USING (row_id) WHERE top < 0.2 AND b.p >= 0.15 AND NOT EXISTS (SELECT 1 FROM tr t WHERE t.row_id = b.row_id AND t.true_i = b.i))
    SELECT 'main' AS kind, CAST(true_i AS INT) AS true_i, CAST(pred_i AS INT) AS pred_i, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT 'none', CAST(true_i AS INT), CAST(pred_i AS INT), count(*) FROM n GROUP BY ALL""",
)
def multi_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, none = evaluate.multi_confusion(_preds(spark, sf_dir), 0.2, 0, 0.15)
    both = main.withColumn("kind", F.lit("main")).unionByName(none.withColumn("kind", F.lit("none")))
    return both.groupBy("kind", "true_i", "pred_i").agg(F.count("*").alias("n"))


@query(
    "track_vote",
    f"""WITH {_PREDS_SQL}, l AS (SELECT track_id, unnest(range(0, 10)) AS i, unnest(probs) AS p FROM pr), a AS (SELECT track_id, i, round(avg(p), 9) AS mean, max(p) AS mx FROM l GROUP BY ALL),
    v AS (SELECT track_id, pred_i AS i, count(*) AS votes FROM dc WHERE pred_i >= 0 GROUP BY ALL), j AS (SELECT a.*, coalesce(votes, 0) AS votes FROM a LEFT JOIN v USING (track_id, i)),
    r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY mean DESC, i) AS km, row_number() OVER (PARTITION BY track_id ORDER BY mx DESC, i) AS kx, row_number() OVER (PARTITION BY track_id ORDER BY votes DESC, mean DESC, i) AS kv FROM j)
    SELECT track_id, 'mean' AS how, CAST(CASE WHEN mean > 0.2 THEN i ELSE -1 END AS INT) AS pred_i, round(mean, 8) AS p FROM r WHERE km = 1
    UNION ALL SELECT track_id, 'max', CAST(CASE WHEN mx > 0.2 THEN i ELSE -1 END AS INT), round(mx, 8) FROM r WHERE kx = 1
    UNION ALL SELECT track_id, 'vote', CAST(CASE WHEN votes > 0 OR mean > 0.2 THEN i ELSE -1 END AS INT), round(mean, 8) FROM r WHERE kv = 1""",
)
def track_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, out = _preds(spark, sf_dir), None
    for how in ("mean", "max", "vote"):
        one = evaluate.track_decision(w, how, 0.2).select("track_id", F.lit(how).alias("how"), "pred_i", F.round("p", 8).alias("p"))  # all the places that a mean of four shares has
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "macro_f1",
    f"""WITH {_PREDS_SQL}, l AS (SELECT unnest(range(0, 10)) AS i, unnest(y)::DOUBLE AS y, unnest(probs) AS p FROM pr), h AS (SELECT *, CASE WHEN p > 0.15 THEN 1.0::DOUBLE ELSE 0 END AS hp FROM l),
    s AS (SELECT i, sum(hp * y) AS tp, sum(hp * (1 - y)) AS fp, sum((1 - hp) * y) AS fn, sum(p * y) AS stp, sum(p * (1 - y)) AS sfp, sum((1 - p) * y) AS sfn, sum((1 - p) * (1 - y)) AS stn FROM h GROUP BY i)
    SELECT round(avg(2 * tp / (2 * tp + fp + fn + 1e-16)), 6) AS macro_f1, round(avg(1 - 2 * stp / (2 * stp + sfp + sfn + 1e-16)), 6) AS soft_f1_cost,
      round(avg((1 - 2 * stp / (2 * stp + sfp + sfn + 1e-16) + 1 - 2 * stn / (2 * stn + sfp + sfn + 1e-16)) / 2), 6) AS double_soft_f1_cost FROM s""",
)
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.f1_scores(_preds(spark, sf_dir), 0.15)
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query(
    "prec_at_k",
    f"""WITH {_PREDS_SQL}, l AS (SELECT row_id, unnest(range(0, 10)) AS i, unnest(y) AS y, unnest(probs) AS p FROM pr), f AS (SELECT * FROM l WHERE i <> 0),
    t AS (SELECT row_id, i FROM f WHERE y > 0 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY i) <= 3), q AS (SELECT row_id, i FROM f WHERE p > 0 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY p DESC, i) <= 3)
    SELECT round((SELECT count(*) FROM t JOIN q USING (row_id, i)) / greatest((SELECT count(*) FROM t), 1), 6) AS precision_at_k""",
)
def prec_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.precision_at_k(_preds(spark, sf_dir), 3, 0).select(F.round("precision_at_k", 6).alias("precision_at_k"))


@query(
    "pr_threshold",
    f"""WITH {_PREDS_SQL}, l AS (SELECT y_true, unnest(range(0, 10)) AS label_i, unnest(probs) AS p FROM pr), b AS (SELECT label_i, p, count(*) FILTER (y_true = label_i) AS pos, count(*) AS n FROM l GROUP BY ALL),
    c AS (SELECT label_i, p, sum(pos) OVER w AS tp, sum(n) OVER w AS pred, sum(pos) OVER (PARTITION BY label_i) AS total FROM b WINDOW w AS (PARTITION BY label_i ORDER BY p DESC)),
    f AS (SELECT *, round(2 * tp / (pred + total), 9) AS f1 FROM c WHERE total > 0), r AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY label_i ORDER BY f1 DESC, p) = 1)
    SELECT CAST(i AS INT) AS label_i, round(coalesce(p, 0), 6) AS threshold, round(coalesce(f1, 0), 6) AS f1 FROM (SELECT unnest(range(0, 12)) AS i) LEFT JOIN r ON i = label_i""",
)
def pr_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_thresholds(_preds(spark, sf_dir), 12).select("label_i", F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))


@query(
    "ensemble",
    f"""WITH {_PREDS_SQL} SELECT row_id, i, round(probs[i] * 0.75 + pre[i] * 0.25, 8) AS mean, round(greatest(probs[i] * 3, pre[i]), 7) AS top FROM (SELECT *, unnest(range(1, 11)) AS i FROM pr)""",
)
def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    both, w = [F.col("probs"), F.col("pre")], [3.0, 1.0]
    every = F.posexplode(F.arrays_zip(arrays.weighted_average(both, w).alias("m"), arrays.weighted_max(both, w).alias("t"))).alias("i", "at")
    return _preds(spark, sf_dir).select("row_id", every).select("row_id", (F.col("i") + 1).cast("long").alias("i"), F.round("at.m", 8).alias("mean"), F.round("at.t", 7).alias("top"))


@query(
    "two_stage",
    f"""WITH {_PREDS_SQL}, l AS (SELECT track_id, unnest(range(0, 10)) AS i, unnest(probs) AS p, unnest(pre) AS q FROM pr), a AS (SELECT track_id, i, round(avg(p), 9) AS p, round(avg(q), 9) AS q FROM l GROUP BY ALL),
    x AS (SELECT track_id, i, p FROM a WHERE track_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY p DESC, i) = 1), y AS (SELECT track_id, i, q FROM a WHERE track_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY q DESC, i) = 1)
    SELECT coalesce(x.track_id, y.track_id) AS track_id, CAST(CASE WHEN p > 0.18 THEN x.i WHEN q > 0.18 THEN y.i ELSE -1 END AS INT) AS pred_i FROM x FULL JOIN y ON x.track_id = y.track_id""",
)
def two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _preds(spark, sf_dir)
    main = evaluate.track_decision(p.where("track_id % 3 <> 0"), "mean", 0.18)
    pre = evaluate.track_decision(p.where("track_id % 5 <> 0").withColumn("probs", F.col("pre")), "mean", 0.18)
    return evaluate.two_stage(main, pre, 0.18)


@query(
    "compare_models",
    f"""WITH {_PREDS_SQL}, w1 AS (SELECT true_i, pred_i FROM cm WHERE n > 0 AND pred_i NOT IN (-1, 0) AND pred_i <> true_i QUALIFY row_number() OVER (PARTITION BY true_i ORDER BY n DESC, pred_i) = 1),
    w2 AS (SELECT true_i, pred_i FROM cp WHERE n > 0 AND pred_i NOT IN (-1, 0) AND pred_i <> true_i QUALIFY row_number() OVER (PARTITION BY true_i ORDER BY n DESC, pred_i) = 1),
    a AS (SELECT true_i, CAST(sum(n) AS BIGINT) AS t, CAST(sum(n) FILTER (pred_i = true_i) AS BIGINT) AS h, CAST(sum(n) FILTER (pred_i = -1) AS BIGINT) AS z FROM cm GROUP BY 1), b AS (SELECT true_i, CAST(sum(n) AS BIGINT) AS t, CAST(sum(n) FILTER (pred_i = true_i) AS BIGINT) AS h, CAST(sum(n) FILTER (pred_i = -1) AS BIGINT) AS z FROM cp GROUP BY 1)
    SELECT true_i, a.t AS total_1, a.h AS hits_1, CASE WHEN a.t > 0 THEN round_even(100.0::DOUBLE * a.h / a.t, 0) ELSE 0 END AS accuracy_1, CASE WHEN a.t > 0 THEN round_even(100.0::DOUBLE * a.z / a.t, 0) ELSE 0 END AS none_share_1, w1.pred_i AS worst_1,
      b.t AS total_2, b.h AS hits_2, CASE WHEN b.t > 0 THEN round_even(100.0::DOUBLE * b.h / b.t, 0) ELSE 0 END AS accuracy_2, CASE WHEN b.t > 0 THEN round_even(100.0::DOUBLE * b.z / b.t, 0) ELSE 0 END AS none_share_2, w2.pred_i AS worst_2, a.h - b.h AS diff
    FROM a JOIN b USING (true_i) LEFT JOIN w1 USING (true_i) LEFT JOIN w2 USING (true_i)""",
)
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _preds(spark, sf_dir)
    return evaluate.compare_models(evaluate.confusion(p, 10, 0.2), evaluate.confusion(p.withColumn("probs", F.col("pre")), 10, 0.2), 0)


@query(
    "losses",
    f"""WITH {_PREDS_SQL}, c AS (SELECT row_id, unnest(y)::DOUBLE AS y, least(greatest(unnest(probs), 1e-7), 1 - 1e-7) AS p FROM pr),
    r AS (SELECT row_id, avg(-((y * 0.9 + 0.05) * ln(p) + (1 - (y * 0.9 + 0.05)) * ln(1 - p))) AS bce, sum(-(y * 0.9 + 0.01) * ln(p)) AS ce FROM c GROUP BY row_id) SELECT round(avg(bce), 6) AS bce, round(avg(ce), 6) AS ce FROM r""",
)
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.losses(_preds(spark, sf_dir), 0.1).select(F.round("bce", 6).alias("bce"), F.round("ce", 6).alias("ce"))


@query("label_distribution", "SELECT CAST(i AS INT) AS label_i, count(label) AS n FROM (SELECT unnest(range(0, 12)) AS i) LEFT JOIN embeddings ON label = i GROUP BY i")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.label_distribution(table(spark, sf_dir, "embeddings").select(F.col("label").alias("label_i")), 12)


@query(
    "class_weights",
    """WITH d AS (SELECT CAST(i AS INT) AS label_i, count(doc_id) AS n FROM (SELECT unnest(range(0, 24)) AS i) LEFT JOIN documents ON source = 'src' || i GROUP BY i)
    SELECT label_i, n, round(CASE WHEN n > 0 THEN least(greatest((SELECT sum(n) FROM d) / (SELECT count(*) FROM d WHERE n > 0) / n, 0.25), 4) ELSE 0 END, 6) AS weight FROM d""",
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.substring("source", 4, 3).cast("int").alias("label_i"))
    return evaluate.class_weights(evaluate.label_distribution(d, 24)).withColumn("weight", F.round("weight", 6))


@query(
    "share_histogram",
    """WITH s AS (SELECT event_type, CAST(round_even(least(value / 60, 1) * 10, 0) AS INT) AS bucket FROM events)
    SELECT k.event_type, CAST(b AS INT) AS bucket, count(s.bucket) AS n FROM (SELECT DISTINCT event_type FROM events) k CROSS JOIN (SELECT unnest(range(0, 11)) AS b) LEFT JOIN s ON s.event_type = k.event_type AND s.bucket = b GROUP BY ALL""",
)
def share_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.least(F.col("value") / 60, F.lit(1.0)).alias("share"))
    return evaluate.share_histogram(e, "event_type", "share")


# ---- export, models, folds, features


@query(
    "anonymised_export",
    """WITH r AS (SELECT c_custkey AS rec_id, c_mktsegment AS device_id, round((c_custkey * 7919 % 400)::DOUBLE / 100, 1) AS lat, round((c_custkey * 104729 % 300)::DOUBLE / 100, 1) AS lng FROM customer),
    s AS (SELECT *, row_number() OVER (ORDER BY device_id, lat, lng) AS site_id FROM (SELECT DISTINCT device_id, lat, lng FROM r)),
    t AS (SELECT o_custkey AS rec_id, o_orderkey AS track, round(CASE WHEN o_totalprice > 100000 THEN -1 ELSE o_totalprice END, 2) AS freq, o_orderpriority AS label FROM orders)
    SELECT rec_id, CAST(site_id AS INT) AS site_id, lat, lng, track AS start, track AS "end", freq AS min_freq, freq AS max_freq, label FROM r JOIN s USING (device_id, lat, lng) LEFT JOIN t USING (rec_id)""",
)
def anonymised_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select(k.alias("rec_id"), F.col("c_mktsegment").alias("device_id"), (k * 7919 % 400 / F.lit(100.0)).alias("lat"), (k * 104729 % 300 / F.lit(100.0)).alias("lng"))
    o = table(spark, sf_dir, "orders")
    low = F.when(F.col("o_totalprice") <= 100000, F.col("o_totalprice"))
    t = o.select(F.col("o_custkey").alias("rec_id"), F.col("o_orderkey").alias("start"), F.col("o_orderkey").alias("end"), low.alias("min_freq"), low.alias("max_freq"), F.col("o_orderpriority").alias("label"))
    out = writers.anonymised(r, t)
    each = out.select("rec_id", "site_id", "lat", "lng", F.explode_outer("tracks").alias("t"))
    return each.select("rec_id", "site_id", "lat", "lng", "t.start", "t.end", F.round("t.min_freq", 2).alias("min_freq"), F.round("t.max_freq", 2).alias("max_freq"), "t.label")


def _documents_as_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("split"), F.col("source").alias("label"), F.col("n_chars").alias("rec_id"))


@query(
    "training_summary",
    """WITH c AS (SELECT lang, source, count(*) AS n_samples, count(DISTINCT n_chars) AS n_recs FROM documents GROUP BY ALL),
    i AS (SELECT DISTINCT lang, source, n_chars FROM documents)
    SELECT i.lang AS split, i.source AS label, n_samples, n_recs, n_chars AS rec_id
    FROM i JOIN c ON i.lang IS NOT DISTINCT FROM c.lang AND i.source IS NOT DISTINCT FROM c.source""",
)
def training_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.training_summary(_documents_as_samples(spark, sf_dir))


@query("training_recordings", """SELECT DISTINCT lang AS split, source AS label, n_chars AS rec_id FROM documents WHERE n_chars IS NOT NULL""")
def training_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.training_recordings(_documents_as_samples(spark, sf_dir))


@query("linear_scores")
def linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = models.with_class_weight(models.with_vector(table(spark, sf_dir, "embeddings"), "embedding"), "label", 10)
    return models.score(models.fit_linear(e.where("vec_id % 5 <> 0"), weight="weight"), e, ["vec_id", "label"])


@query("forest_scores")
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = models.with_vector(table(spark, sf_dir, "embeddings"), "embedding")
    return models.score(models.fit_forest(e.where("vec_id % 5 <> 0")), e, ["vec_id", "label"])


@query("cross_fold")
def cross_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.cross_fold(models.with_vector(table(spark, sf_dir, "embeddings"), "embedding"), "vec_id", "label")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signals of a recording per user and day, their seconds those of the day over 100."""
    iv = event_intervals(spark, sf_dir)
    day = F.floor(F.col("start") / 86400)
    start = (F.col("start") - day * 86400) / 100
    return iv.select(
        (F.col("rec_id") * 100000 + day % 100000).alias("rec_id"),
        F.col("track_id").alias("signal_id"),
        "track_id",
        start.alias("start"),
        (start + F.col("value") / 8).alias("end"),
        (F.lit(200.0) + F.col("track_id") % 40 * 100).alias("f_lo"),
        (F.lit(900.0) + F.col("track_id") % 37 * 150).alias("f_hi"),
        F.col("value").alias("mass"),
        F.lit(900.0).alias("duration"),
        (F.col("label") == "view").alias("is_bird"),
    )


def _rounded(name: str, places: int) -> Column:
    """A column as SQL rounds it: the product with the power of ten is rounded, where F.round takes the double's decimal digits."""
    return (F.round(F.col(name) * 10.0**places) / 10.0**places).alias(name)


@query("merge_tracks")
def merge_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds_.merge_tracks(_boxes(spark, sf_dir))


#: As in _boxes, with bands on the mel scale.
_BOXES_SQL = f"""{EVENTS}, d AS (SELECT *, CAST(floor("start" / 86400) AS BIGINT) AS day FROM iv),
  bx AS (SELECT rec_id * 100000 + day % 100000 AS rec_id, track_id, ("start" - day * 86400) / 100 AS a, ("start" - day * 86400) / 100 + value / 8 AS b, label = 'view' AS is_bird,
    2595.0 * log10(1.0 + (200.0 + track_id % 40 * 100) / 700.0) AS low, 2595.0 * log10(1.0 + (900.0 + track_id % 37 * 150) / 700.0) AS top FROM d)"""


@query(
    "absorb_tracks",
    f"""WITH RECURSIVE {_BOXES_SQL}, r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY a, track_id) AS i FROM bx),
    f AS (SELECT rec_id, i, track_id, a, b, low, top, NULL::BIGINT AS gone, NULL::DOUBLE AS gone_a, NULL::DOUBLE AS gone_b FROM r WHERE i = 1
      UNION ALL
      SELECT x.rec_id, x.i, CASE WHEN how = 'stay' THEN x.track_id ELSE n.track_id END, CASE WHEN how = 'stay' THEN x.a ELSE n.a END,
        CASE WHEN how = 'stay' THEN CASE WHEN in_band THEN greatest(x.b, n.b) ELSE x.b END ELSE n.b END, CASE WHEN how = 'stay' THEN x.low ELSE n.low END, CASE WHEN how = 'stay' THEN x.top ELSE n.top END,
        CASE WHEN how = 'new' THEN x.track_id END, CASE WHEN how = 'new' THEN x.a END, CASE WHEN how = 'new' THEN x.b END
      FROM (SELECT y.*, CASE WHEN shared > 0.5 * (y.b - y.a) AND 0.5 * (y.b - y.a) > 0 THEN 'swap' WHEN shared > 0 AND (shared > 0.5 * y.n_len OR in_band) THEN 'stay' ELSE 'new' END AS how
            FROM (SELECT f.rec_id, n.i, f.track_id, f.a, f.b, f.low, f.top, n.b - n.a AS n_len, least(f.b, n.b) - greatest(f.a, n.a) AS shared,
                    least(f.top, n.top) - greatest(f.low, n.low) > 0.5 * (n.top - n.low) AND 0.5 * (n.top - n.low) > 0 AS in_band FROM f JOIN r n ON n.rec_id = f.rec_id AND n.i = f.i + 1) y) x
        JOIN r n ON n.rec_id = x.rec_id AND n.i = x.i)
    SELECT rec_id, gone AS track_id, round(gone_a, 4) AS "start", round(gone_b, 4) AS "end" FROM f WHERE gone IS NOT NULL
    UNION ALL SELECT rec_id, track_id, round(a, 4), round(b, 4) FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY i DESC) AS k FROM f) WHERE k = 1""",
)
def absorb_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = folds_.absorb_tracks(_boxes(spark, sf_dir))
    return t.select("rec_id", "track_id", _rounded("start", 4), _rounded("end", 4))


@query(
    "trim_others",
    f"""WITH {_BOXES_SQL}, bs AS (SELECT rec_id, list({{'a': a, 'b': b, 'c': false}} ORDER BY a, track_id) AS birds FROM bx WHERE is_bird GROUP BY rec_id),
    t AS (SELECT bx.rec_id, track_id, is_bird, list_reduce(list_prepend({{'a': a, 'b': b, 'c': false}}, CASE WHEN is_bird THEN [] ELSE coalesce(birds, []) END),
        lambda s, k: CASE WHEN s.a < k.b AND k.a < s.b THEN CASE WHEN k.a - s.a >= s.b - k.b THEN {{'a': s.a, 'b': k.a, 'c': true}} ELSE {{'a': k.b, 'b': s.b, 'c': true}} END ELSE s END) AS r
      FROM bx LEFT JOIN bs ON bs.rec_id = bx.rec_id)
    SELECT rec_id, track_id, round(r.a, 4) AS "start", round(r.b, 4) AS "end", r.c AS cut FROM t WHERE NOT r.c OR r.b - r.a >= 1""",
)
def trim_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = folds_.trim_others(_boxes(spark, sf_dir))
    return t.select("rec_id", "track_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "cut")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a short signal of 64 samples, repeated 32 times."""
    e = table(spark, sf_dir, "embeddings")
    x = F.flatten(F.array_repeat(F.col("embedding"), 32))
    return e.select("vec_id", F.lit(8000).alias("rate"), x.alias("samples"), F.when(F.col("label") == 1, F.lit("bittern")).otherwise(F.lit("")).alias("tag"))


@query("mel_features")
def mel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.mel_features(_segments(spark, sf_dir), "vec_id", n_fft=512, hop=128, bands=20, seconds=0.25, hi=4000.0, breaks=(1000.0, 700.0))


@query("band_energy")
def band_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.band_energy(_segments(spark, sf_dir), "vec_id", n_fft=512, hop=128)


@query("detect_signals")
def detect_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.detect_signals(_segments(spark, sf_dir), "vec_id", n_fft=256, hop=64, frame_times=1.5, bin_times=0.9, min_seconds=0.01, min_hz=30.0)


@query("remove_shared_peaks")
def remove_shared_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = features.band_energy(_segments(spark, sf_dir), "vec_id", n_fft=256, hop=32).withColumnRenamed("vec_id", "track_id")
    return folds_.remove_shared_peaks(e, 32 / 8000)


@query(
    "mix_noise",
    """WITH a AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS s FROM embeddings),
    j AS (SELECT a.vec_id, a.s, b.s AS n, 3.0 + a.vec_id % 28 AS snr FROM a JOIN a b ON b.vec_id = a.vec_id // 2 * 2 + 1 - a.vec_id % 2),
    p AS (SELECT *, sqrt((list_sum(list_transform(s, lambda v: v * v)) / len(s)) / (list_sum(list_transform(n, lambda v: v * v)) / len(n) * pow(10, snr / 10))) AS scale FROM j)
    SELECT vec_id, CAST(i - 1 AS INT) AS i, round(s[i] + n[i] * scale * CASE WHEN vec_id % 3 = 0 THEN -1 ELSE 1 END, 6) AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM p)""",
)
def mix_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    i = F.col("vec_id")
    pair = e.withColumn("other", F.floor(i / 2) * 2 + 1 - i % 2).join(e.select(i.alias("other"), F.col("embedding").alias("noise")), "other")
    mixed = features.mix_noise(F.col("embedding"), F.col("noise"), F.lit(3.0) + i % 28, i % 3 == 0)
    return _places(pair, "vec_id", v=mixed)


# ---- filters and reports


@query(
    "sample_filters",
    """WITH e AS (SELECT event_id, value, [CAST(event_id % 5 AS INT), CAST(event_id % 3 AS INT)] AS raw FROM events),
    x AS (SELECT event_id, value, list_sort(list_distinct(raw)) AS idx, 40 * value AS lo, 60 * value AS hi FROM e)
    SELECT event_id, list_filter(idx, lambda i: i <> 4) AS idx FROM x WHERE idx <> [0] AND value > 1.5 AND value < 60 AND hi >= 100 AND lo <= 2000 AND list_contains(idx, 1)""",
)
def sample_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    idx = F.array_sort(F.array_distinct(F.array((i % 5).cast("int"), (i % 3).cast("int"))))
    e = table(spark, sf_dir, "events").select(i, "value", F.lit(0.0).alias("start"), F.col("value").alias("end"), idx.alias("label_idx"), (F.lit(40) * F.col("value")).alias("min_freq"), (F.lit(60) * F.col("value")).alias("max_freq"))
    e = filters.longer_than(filters.generic_only(filters.labelled(e), 0), 1.5)
    e = filters.in_band(filters.signal_share(e, 0.0, 60.0, "value"), 100.0, 2000.0)
    return filters.with_label(e, 1).select("event_id", filters.without_labels(F.col("label_idx"), 4).alias("idx"))


@query("batches", f"""WITH r AS (SELECT doc_id, CAST(floor({_U.format("'1|run|' || doc_id")} * 64) AS INT) AS run FROM documents)
  SELECT doc_id, run, CAST(floor((row_number() OVER (PARTITION BY run ORDER BY md5('1|' || doc_id), doc_id) - 1) / 4) AS INT) AS batch FROM r""")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.batches(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 4)


@query("random_track", f"""WITH t AS (SELECT event_id AS rec_id, value AS duration, greatest(0, {_U.format("'1|track|' || event_id")} * (value - 3)) AS s FROM events)
  SELECT rec_id, round(s, 6) AS "start", round(least(s + 3, duration), 6) AS "end" FROM t""")
def random_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").select(F.col("event_id").alias("rec_id"), F.col("value").alias("duration"))
    return filters.random_track(r).select("rec_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(
    "tighten",
    """WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS o, len(embedding) AS n FROM embeddings),
    s AS (SELECT *, round(sum(v) OVER (PARTITION BY vec_id ORDER BY o ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), 9) AS total FROM l),
    b AS (SELECT vec_id, o FROM s WHERE o + 8 <= n OR o = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY total DESC, o) = 1),
    f AS (SELECT vec_id, coalesce(abs(stddev_pop(v) / nullif(avg(v), 0)) < 1, true) AS rejected FROM l GROUP BY vec_id)
    SELECT vec_id, round(o * 0.1::DOUBLE, 6) AS "start", round((o + 8) * 0.1::DOUBLE, 6) AS "end", rejected FROM b JOIN f USING (vec_id)""",
)
def tighten(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = intervals.tighten(_emb(spark, sf_dir), "vec_id", "x", 8, 0.1, 1.0)
    return t.select("vec_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "rejected")


@query("label_audit", """WITH d AS (SELECT lang, CASE WHEN doc_id % 5 = 0 THEN source || chr(10) || lang ELSE source END AS t FROM documents)
  SELECT lang, list_sort(list(DISTINCT t) FILTER (NOT contains(t, chr(10)))) AS texts, count(*) FILTER (contains(t, chr(10))) AS n_multi FROM d GROUP BY lang""")
def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("source", F.lit("\n"), "lang")).otherwise(F.col("source"))
    return labels.label_audit(d.select("lang", text.alias("source")), "source", "lang")


@query("most_confused", f"WITH {_PREDS_SQL} SELECT true_i, pred_i, n FROM cm WHERE n > 0 AND pred_i NOT IN (-1, true_i) QUALIFY row_number() OVER (PARTITION BY true_i ORDER BY n DESC, pred_i) = 1")
def most_confused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.most_confused(confusion(spark, sf_dir))


@query("folder_accuracy", f"""WITH {_PREDS_SQL} SELECT count(*) AS n, count(*) FILTER (y_true = pred_i) AS hits, count(*) FILTER ((y_true IN (1, 2, 3)) = (pred_i IN (1, 2, 3))) AS bird_hits FROM dc""")
def folder_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _preds(spark, sf_dir).select(F.col("y_true").alias("label_i"), evaluate.decide(F.col("probs"), 0.2).alias("pred_i"))
    return evaluate.folder_accuracy(d, [1, 2, 3])


@query(
    "species_result",
    f"""WITH {_PREDS_SQL}, l AS (SELECT row_id, unnest(range(0, 10)) AS i, unnest(probs) AS p FROM pr), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, i) AS k FROM l)
    SELECT row_id, string_agg('s' || i || '=' || CAST(round_even(p * 100, 0) AS INT), ',' ORDER BY k) AS result FROM r WHERE p > 0.2 OR k = 1 GROUP BY row_id""",
)
def species_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(f"s{i}") for i in range(10)])
    r = evaluate.species_result(F.col("probs"), names, 0.2)
    return _preds(spark, sf_dir).select("row_id", F.array_join(F.transform(r, lambda s: F.concat(s["name"], F.lit("="), s["percent"].cast("string"))), ",").alias("result"))


@query(
    "signal_layout",
    f"""WITH RECURSIVE {_BOXES_SQL}, r AS MATERIALIZED (SELECT 'u' || rec_id % 97 AS tags, rec_id, a, b - a AS len, row_number() OVER (PARTITION BY rec_id % 97 ORDER BY rec_id, a) AS i FROM bx),
    f AS (SELECT tags, i, rec_id, a, 0 AS file_no, 0.0::DOUBLE AS "offset", len AS filled FROM r WHERE i = 1
      UNION ALL SELECT f.tags, n.i, n.rec_id, n.a, CASE WHEN f.filled >= 10 THEN f.file_no + 1 ELSE f.file_no END, CASE WHEN f.filled >= 10 THEN 0 ELSE f.filled END,
        n.len + CASE WHEN f.filled >= 10 THEN 0 ELSE f.filled END FROM f JOIN r n ON n.tags = f.tags AND n.i = f.i + 1)
    SELECT tags, rec_id, round(a, 5) AS "start", file_no, round("offset", 5) AS "offset" FROM f""",
)
def signal_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    out = folds_.file_layout(b.select(F.concat(F.lit("u"), (F.col("rec_id") % 97).cast("string")).alias("tags"), "rec_id", "start", "end"))
    return out.select("tags", "rec_id", _rounded("start", 5), "file_no", _rounded("offset", 5))


@query("new_events", """SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3)""")
def new_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return incremental.unprocessed(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")
