"""More named queries over the supplied tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.operators import evaluate, grid, labels, segmenting, splitting
from wavegrid.plans.queries import _POINTS_SQL, _PREDS_SQL, _U, _grid, _monthly, _preds, confusion, pr_threshold, query
from wavegrid.sources import readers
from wavegrid.sources.tables import event_intervals, table

_SEEN_SQL = "seen AS (SELECT square_id, c.c_mktsegment AS code, o_orderdate AS obs_date FROM orders JOIN customer c ON o_custkey = c_custkey LEFT JOIN hit ON point_id = c_custkey)"


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = grid.points_in_squares(*_grid(spark, sf_dir))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_mktsegment").alias("code"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("point_id"), F.col("o_orderdate").alias("obs_date"))
    return o.join(c, "point_id").join(hit, "point_id", "left").select("square_id", "code", "obs_date")


@query("latest_observation", f"WITH {_POINTS_SQL}, {_SEEN_SQL} SELECT max(obs_date) AS latest_obs_date FROM seen WHERE square_id IS NOT NULL AND code IS NOT NULL")
def latest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.latest_observation(_seen(spark, sf_dir))


@query(
    "grid_export",
    f"""WITH {_POINTS_SQL}, {_SEEN_SQL} SELECT square_id, code, CAST(month AS INT) AS month, n, (SELECT max(obs_date) FROM seen WHERE square_id IS NOT NULL) AS latest_obs_date, 'orders' AS source FROM mz""",
)
def grid_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested export, unfolded again."""
    out = grid.grid_export(_monthly(spark, sf_dir), _seen(spark, sf_dir), "orders")
    long_ = out.select("square_id", "latest_obs_date", "source", F.explode("species_per_month").alias("code", "m"))
    return long_.select("square_id", "code", F.explode("m").alias("month", "n"), "latest_obs_date", "source")


@query(
    "row_losses",
    f"""WITH {_PREDS_SQL}, c AS (SELECT row_id, y_true, generate_subscripts(y, 1) AS j, unnest(y)::DOUBLE AS y, unnest(probs) AS x, least(greatest(unnest(probs), 1e-7), 1 - 1e-7) AS p FROM pr),
    w AS (SELECT *, CASE WHEN y > 0 THEN CASE WHEN j % 2 = 1 THEN 0.75 ELSE 1.0 END ELSE 0 END AS wy, CASE WHEN y > 0 OR j % 3 = 0 THEN 1 ELSE 0 END AS m, x * 8 - 2 AS z FROM c)
    SELECT row_id, round(-avg(CASE WHEN wy > 0 THEN wy * ln(p + 1e-7) ELSE ln(1 - p + 1e-7) END), 6) AS weighted_bce,
      round(avg(y * ln(1 + exp(-z)) + (1 - y) * ln(1 + exp(z))), 6) AS sigmoid_bce, round(-avg((1 - y) * ln(1 - p + 1e-7) * m + y * ln(p + 1e-7)), 6) AS masked_ce FROM w GROUP BY row_id""",
)
def row_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _preds(spark, sf_dir)
    y, probs = F.col("y"), F.col("probs")
    weights = F.transform(y, lambda v, i: F.when(v > 0, F.when(i % 2 == 0, F.lit(0.75)).otherwise(F.lit(1.0))).otherwise(F.lit(0.0)))
    possible = F.transform(y, lambda v, i: F.when((v > 0) | (i % 3 == 2), 1).otherwise(0))
    logits = F.transform(probs, lambda v: v * 8 - 2)
    all_ = {"weighted_bce": evaluate.weighted_bce(weights, probs), "sigmoid_bce": evaluate.sigmoid_bce(y, logits), "masked_ce": evaluate.masked_ce(y, possible, probs)}
    return p.select("row_id", *[F.round(c, 6).alias(n) for n, c in all_.items()])


@query(
    "threshold_summary",
    f"""WITH {_PREDS_SQL}, l AS (SELECT y_true, unnest(range(0, 10)) AS label_i, unnest(probs) AS p FROM pr), b AS (SELECT label_i, p, count(*) FILTER (y_true = label_i) AS pos, count(*) AS n FROM l GROUP BY ALL),
    c AS (SELECT label_i, p, sum(pos) OVER w AS tp, sum(n) OVER w AS pred, sum(pos) OVER (PARTITION BY label_i) AS total FROM b WINDOW w AS (PARTITION BY label_i ORDER BY p DESC)),
    f AS (SELECT *, round(2 * tp / (pred + total), 9) AS f1 FROM c WHERE total > 0), r AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY label_i ORDER BY f1 DESC, p) = 1),
    t AS (SELECT round(coalesce(p, 0), 6) AS threshold FROM (SELECT unnest(range(0, 12)) AS i) LEFT JOIN r ON i = label_i) SELECT round(avg(threshold), 6) AS mean, round(median(threshold), 6) AS median FROM t""",
)
def threshold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = evaluate.threshold_summary(pr_threshold(spark, sf_dir))
    return t.select(F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


_TOTALS_SQL = "SELECT sum(n) AS t, sum(n) FILTER (true_i = pred_i) AS h, sum(n) FILTER (true_i <> pred_i AND pred_i NOT IN (-1, 0)) AS e FROM {m} WHERE true_i <> 9"


@query(
    "compare_totals",
    f"""WITH {_PREDS_SQL}, a AS ({_TOTALS_SQL.format(m='cm')}), b AS ({_TOTALS_SQL.format(m='cp')})
    SELECT CAST(a.t AS BIGINT) AS total_1, CAST(a.h AS BIGINT) AS hits_1, CAST(a.e AS BIGINT) AS errors_1, CAST(b.t AS BIGINT) AS total_2, CAST(b.h AS BIGINT) AS hits_2, CAST(b.e AS BIGINT) AS errors_2,
    round(abs((a.h - b.h) / a.t) - abs((a.e - b.e) / a.t), 6) AS score, CASE WHEN a.h > b.h THEN 'first' ELSE 'second' END AS better FROM a, b""",
)
def compare_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _preds(spark, sf_dir)
    second = evaluate.confusion(p.withColumn("probs", F.col("pre")), 10, 0.2)
    return evaluate.compare_totals(confusion(spark, sf_dir), second, 0, (9,)).withColumn("score", F.round("score", 6))


@query(
    "weighted_prec_at_k",
    f"""WITH {_PREDS_SQL}, l AS (SELECT row_id, unnest(range(0, 10)) AS i, unnest(y) AS y, unnest(probs) AS p FROM pr),
    t AS (SELECT row_id, i FROM l WHERE y > 0 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY i) <= 3), q AS (SELECT row_id, i FROM l WHERE p > 0 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY p DESC, i) <= 3)
    SELECT round((SELECT sum(1 + i / 10) FROM t JOIN q USING (row_id, i)) / (SELECT sum(1 + i / 10) FROM t), 6) AS precision_at_k""",
)
def weighted_prec_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.precision_at_k(_preds(spark, sf_dir), 3, None, [1 + i / 10 for i in range(10)]).select(F.round("precision_at_k", 6).alias("precision_at_k"))


@query(
    "signal_windows",
    """WITH t AS (SELECT event_id AS track_id, 0.5::DOUBLE AS s, 0.5 + value AS e FROM events), w AS (SELECT *, unnest(range(0, CAST(greatest(ceil(e - s - 3) - 1, 0) AS INT) + 1)) AS i FROM t)
    SELECT track_id, CAST(i AS INT) AS i, round(s + i, 6) AS win_start, round(least(s + i + 3, e), 6) AS win_end FROM w""",
)
def signal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("track_id"), F.lit(0.5).alias("start"), (F.col("value") + 0.5).alias("end"))
    w = segmenting.signal_windows(t)
    return w.select("track_id", "i", F.round("win_start", 6).alias("win_start"), F.round("win_end", 6).alias("win_end"))


@query(
    "leaks_without_oversampled",
    """WITH s AS (SELECT user_id, CASE WHEN event_id % 40 = 0 THEN 'test' ELSE 'train' END AS split FROM events WHERE event_id % 80 <> 0)
    SELECT user_id, list_sort(list(DISTINCT split)) AS splits FROM s GROUP BY user_id HAVING count(DISTINCT split) > 1""",
)
def leaks_without_oversampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.when(k % 40 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"), (k % 80 == 0).alias("low_sample"))
    return splitting.split_leaks(e, "user_id", "low_sample")


@query("without_oversampled", "SELECT event_id, user_id FROM events WHERE NOT (event_id % 80 = 0 AND value > 1)")
def without_oversampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.when(F.col("event_id") % 80 == 0, F.col("value") > 1)
    return splitting.without_oversampled(table(spark, sf_dir, "events").withColumn("low_sample", low)).select("event_id", "user_id")


@query("keyed_share", f"SELECT event_id FROM events WHERE {_U.format("'1|share|' || event_id")} < 0.03::DOUBLE")
def keyed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.keyed_share(table(spark, sf_dir, "events").select("event_id"), ["event_id"], 0.03)


@query(
    "composite_keys",
    """SELECT doc_id, array_to_string(list_sort(list_filter([source, lang], lambda x: x IS NOT NULL)), '-') AS tags_key,
    CAST(doc_id AS VARCHAR) || coalesce('-' || source, '') AS bin_id, CASE WHEN lang = 'en' THEN 1 WHEN source IS NOT NULL THEN 7 END AS label_i, lower(trim(source)) IN ('yes', 'true', 't', 'y', '1', 'src1') IS TRUE AND source <> 'src1' AS flag FROM documents""",
)
def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    tags = F.filter(F.array("source", "lang"), lambda x: x.isNotNull())
    index = lambda on, i: F.when(on, F.array(F.lit(i), F.lit(i + 1))).otherwise(F.array().cast("array<int>"))
    label = labels.choose_label(index(F.col("lang") == "en", 1), index(F.col("source").isNotNull(), 7))
    flag = F.coalesce(readers.to_bool(F.col("source")), F.lit(False))
    return d.select("doc_id", labels.tags_key(tags).alias("tags_key"), labels.bin_id(F.col("doc_id"), F.array("source")).alias("bin_id"), label.alias("label_i"), flag.alias("flag"))


@query(
    "initial_sidecars",
    """WITH m AS (SELECT c_custkey AS id, c_mktsegment AS file, c_nationkey AS code, [c_nationkey + 20, c_nationkey] AS other FROM customer),
    k AS (SELECT n_nationkey AS code, n_name AS label FROM nation WHERE n_nationkey % 4 <> 0)
    SELECT m.id, file, k.label AS what, CAST(m.code AS VARCHAR) AS code, 'initial' AS state, m.id || '_1' AS track_id, coalesce(o1.label, '-') || ',' || coalesce(o2.label, '-') AS others
    FROM m JOIN k ON m.code = k.code LEFT JOIN k o1 ON o1.code = other[1] LEFT JOIN k o2 ON o2.code = other[2]""",
)
def initial_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey")
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rec_id"), F.col("c_mktsegment").alias("filename"), k.cast("string").alias("code"), F.array((k + 20).cast("string"), k.cast("string")).alias("other_labels"))
    codes = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))
    s = labels.initial_sidecars(m, codes)
    others = F.array_join(F.transform("other_tags", lambda t: F.coalesce(t["what"], F.lit("-"))), ",")
    return s.select("id", "file", F.col("tag.what").alias("what"), F.col("tag.ebird_id").alias("code"), "state", F.get("tracks", F.lit(0))["id"].alias("track_id"), others.alias("others"))


@query(
    "manifest_bounds",
    """SELECT e.event_id AS rec_id, 'set/' || e.event_type || '/' || e.event_id || '.txt' AS file, o.o_custkey::DOUBLE AS "start", o.o_custkey + 3.0::DOUBLE AS "end" FROM events e JOIN orders o ON e.event_id = o.o_orderkey WHERE e.event_type = 'click'""",
)
def manifest_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("rec_id"), F.concat(F.lit("set/"), "event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".txt")).alias("file"))
    at = F.col("o_custkey").cast("double")
    m = table(spark, sf_dir, "orders").select(F.concat(F.lit("click/"), F.col("o_orderkey").cast("string"), F.lit(".flac")).alias("filename"), at.alias("start"), (at + 3).alias("end"))
    return labels.bounds_from_manifest(e, m)


@query(
    "export_names",
    """SELECT CAST(n_nationkey AS INT) AS label_i, n_name AS label, CASE WHEN n_nationkey % 3 > 0 THEN 'c' || n_regionkey END AS code,
    CASE WHEN n_nationkey % 3 > 0 AND n_regionkey <> 2 THEN r_name ELSE n_name END AS name FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    code = F.concat(F.lit("c"), F.col("n_regionkey").cast("string"))
    codes = n.where("n_nationkey % 3 > 0").select(F.col("n_name").alias("label"), code.alias("code"))
    names = table(spark, sf_dir, "region").where("r_regionkey <> 2").select(F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("code"), F.col("r_name").alias("name"))
    return labels.export_names(n.select(F.col("n_nationkey").cast("int").alias("label_i"), F.col("n_name").alias("label")), codes, names)


@query(
    "oversample_rounds",
    """WITH s AS (SELECT event_id AS sample_id, event_type || '-' || (event_id // 7 % 3) AS tag, event_id // 7 % 3 AS k FROM events),
    u AS (SELECT * FROM s WHERE tag LIKE 'click%' OR sample_id % CASE WHEN k = 2 THEN 300 ELSE 5 END = 0), c AS (SELECT tag, count(*) AS n FROM u GROUP BY tag),
    c9 AS (SELECT min(n) AS target FROM (SELECT n FROM c ORDER BY n DESC LIMIT 9)), d AS (SELECT tag, greatest(0, target - n) AS lack, target FROM c, c9),
    sp AS (SELECT p.sample_id, p.tag FROM s p JOIN d USING (tag) WHERE lack > 0 AND p.sample_id % 90 = 1 QUALIFY row_number() OVER (PARTITION BY p.tag ORDER BY md5('1|' || p.tag || '|' || sample_id), sample_id) <= lack),
    st AS (SELECT d.tag, d.lack - coalesce(g, 0) AS lack FROM d LEFT JOIN (SELECT tag, count(*) AS g FROM sp GROUP BY tag) q ON q.tag = d.tag WHERE d.lack - coalesce(g, 0) > target / 2),
    rp AS (SELECT sample_id, tag, sample_id % 20 AS set_no FROM s WHERE sample_id % 20 < 3), z AS (SELECT tag, set_no, count(*) AS n FROM rp GROUP BY ALL),
    r AS (SELECT z.*, set_no + 3 * i AS round FROM z, (SELECT unnest(range(0, 2)) AS i) WHERE tag IN (SELECT tag FROM z WHERE set_no = 0)),
    t AS (SELECT *, least(n, lack - coalesce(sum(n) OVER (PARTITION BY tag ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS take FROM r JOIN st USING (tag)),
    x AS (SELECT rp.sample_id, t.tag, round, take, row_number() OVER (PARTITION BY t.tag, round ORDER BY md5('1|' || round || '|' || t.tag || '|' || sample_id), sample_id) AS k FROM rp JOIN t ON rp.tag = t.tag AND rp.set_no = t.set_no WHERE take > 0)
    SELECT sample_id, tag, 0 AS round FROM sp UNION ALL SELECT sample_id, tag, CAST(round + 1 AS INT) FROM x WHERE k <= take""",
)
def oversample_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor(F.col("event_id") / 7) % 3
    tag = F.concat(F.col("event_type"), F.lit("-"), k.cast("string"))
    s = table(spark, sf_dir, "events").select(F.col("event_id").alias("sample_id"), tag.alias("tag"), k.alias("k"))
    used = s.where("tag like 'click%' or sample_id % case when k = 2 then 300 else 5 end = 0").select("sample_id", "tag")
    pools = s.where("sample_id % 90 = 1").select("sample_id", "tag", F.lit(0).alias("priority"))
    repeats = s.where("sample_id % 20 < 3").select("sample_id", "tag", (F.col("sample_id") % 20).cast("int").alias("set_no"))
    return splitting.oversample_rounds(used, pools, repeats, max_repeats=2)


@query(
    "mixup_soft",
    f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label, {_U.format("'1|chance|' || vec_id")} < 0.25 AS hit FROM embeddings)
    SELECT vec_id, count(*) AS n_places, hit AS mixed FROM (SELECT vec_id, hit, unnest(x) AS v FROM e) GROUP BY vec_id, hit""",
)
def mixup_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows are mixed, and that none is lost; the values are compared in a test."""
    y = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("int"))
    m = splitting.mixup(table(spark, sf_dir, "embeddings").withColumn("y", y), "vec_id", "embedding", "y")
    return m.select("vec_id", F.size("embedding").cast("long").alias("n_places"), (F.col("share") > 0).alias("mixed"))
