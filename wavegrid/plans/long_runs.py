"""Queries on recordings of any length, whole model runs and new files only, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.functions import arrays
from wavegrid.operators import features, frames, intervals, models, splitting
from wavegrid.plans.queries import _U, EVENTS, ORACLES, query
from wavegrid.sources.scratch import shared_dir, written
from wavegrid.sources.tables import event_intervals, table
from wavegrid.streaming import incremental


@query("merge_nearby_any_length", ORACLES["merge_nearby"])
def merge_nearby_any_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intervals.merge_nearby_any_length(event_intervals(spark, sf_dir), ["rec_id"], 60.0)
    return out.select("rec_id", "run", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n_merged")


@query(
    "covered_any_length",
    f"""WITH {EVENTS},
    m AS (SELECT *, max("end") OVER (PARTITION BY label ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv WHERE "start" < "end")
    SELECT label, round(sum(greatest(0, "end" - greatest("start", coalesce(before, "start")))), 3) AS covered FROM m GROUP BY label""",
)
def covered_any_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few labels hold all intervals."""
    out = intervals.covered_any_length(event_intervals(spark, sf_dir), ["label"])
    return out.select("label", F.round("covered", 3).alias("covered"))


@query("agreement_any_length", ORACLES["consecutive_agreement"])
def agreement_any_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return intervals.agreement_any_length(e, ["user_id"], ["ts", "event_id"], "event_type", "value", 5.0).select("event_id", "user_id", "event_type")


@query(
    "ema_over_rows",
    """WITH RECURSIVE x AS MATERIALIZED (SELECT event_type, event_id, value::DOUBLE AS v, row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE), ts, event_id) AS i FROM events WHERE value IS NOT NULL),
    l AS (SELECT event_type, list(v ORDER BY i) AS vs, list(event_id ORDER BY i) AS ids FROM x GROUP BY event_type),
    e AS (SELECT event_type, 1 AS i, vs[1] AS m FROM l UNION ALL SELECT e.event_type, e.i + 1, 0.96::DOUBLE * m + 0.04::DOUBLE * vs[e.i + 1] FROM e JOIN l USING (event_type) WHERE e.i < len(vs))
    SELECT x.event_type, x.event_id, round(m, 6) AS ema FROM e JOIN x USING (event_type, i)""",
)
def ema_over_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event type is a band, a day of its values a row of frames."""
    e = table(spark, sf_dir, "events").where("value is not null")
    days = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("value").cast("double").alias("v")))).alias("rows"))
    days = days.select("event_type", "day", F.col("rows.event_id").alias("ids"), F.col("rows.v").alias("values"))
    out = intervals.ema_over_rows(days, ["event_type"], ["day"], "values")
    out = out.select("event_type", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("ema").alias("m"))).alias("z"))
    return out.select("event_type", F.col("z.id").alias("event_id"), F.round("z.m", 6).alias("ema"))


#: The vectors of a label, one after another, as a recording of that many segments; frames of 16 samples every 8.
_FRAMES_SQL = """x AS MATERIALIZED (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id, p) - 1 AS i, count(*) OVER (PARTITION BY label) AS total
      FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings)),
    part AS (SELECT label, t, i - t * 8 + 8 AS j, v * (0.5 - 0.5 * cos(2 * pi() * (i - t * 8 + 8) / 16)) AS v FROM (SELECT *, unnest([i // 8 - 1, i // 8, i // 8 + 1]) AS t FROM x)
      WHERE i - t * 8 BETWEEN -8 AND 7 AND t BETWEEN 0 AND total // 8),
    mag AS (SELECT label, t, k, sqrt(pow(sum(v * cos(2 * pi() * j * k / 16)), 2) + pow(sum(v * sin(2 * pi() * j * k / 16)), 2)) AS m
      FROM part CROSS JOIN (SELECT unnest(range(9)) AS k) GROUP BY label, t, k)"""


def _label_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("segment_no"), F.lit(8000).alias("rate"), F.col("embedding").alias("samples"))


@query("recording_frames", f"""WITH {_FRAMES_SQL} SELECT label, CAST(t AS BIGINT) AS t, CAST(k AS INT) AS k, round(m, 5) AS m FROM mag""")
def recording_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames.recording_frames(_label_recordings(spark, sf_dir), "label", 16, 8, frames=500, kind="double")
    places = f.select("rec", "first_frame", "n_bins", F.posexplode("spectrum").alias("p", "m"))
    return places.select(F.col("rec").alias("label"), (F.col("first_frame") + F.expr("p div n_bins")).alias("t"), (F.col("p") % F.col("n_bins")).cast("int").alias("k"), F.round("m", 5).alias("m"))


@query(
    "bin_medians",
    f"""WITH {_FRAMES_SQL}, f AS (SELECT label, k, m::FLOAT::DOUBLE AS m FROM mag)
    SELECT label, CAST(k AS INT) AS k, round(median(m), 5) AS median FROM f GROUP BY label, k""",
)
def bin_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = frames.bin_medians(frames.recording_frames(_label_recordings(spark, sf_dir), "label", 16, 8, frames=500))
    return m.select(F.col("rec").alias("label"), F.posexplode("medians").alias("k", "m")).select("label", "k", F.round("m", 5).alias("median"))


def _swept(out: str, of: str, how: str, axis: str, back: int, on: int) -> str:
    """A window's largest or least cell along frames or bins, over the cells that exist."""
    by, order = ("k", "t") if axis == "t" else ("t", "k")
    return f"{out} AS MATERIALIZED (SELECT label, t, k, {how}(on_) OVER (PARTITION BY label, {by} ORDER BY {order} ROWS BETWEEN {back} PRECEDING AND {on} FOLLOWING) AS on_ FROM {of})"


#: Spectra of 64 samples every 16, cells over the medians, opened by 2 by 2, dilated by 3 frames and 4 bins, eroded by 3 frames; runs of bins that touch from frame to frame are one signal.
_SIGNALS_SQL = f"""x AS MATERIALIZED (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id, p) - 1 AS i, count(*) OVER (PARTITION BY label) AS total
      FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings)),
    part AS (SELECT label, t, i - t * 16 + 32 AS j, v * (0.5 - 0.5 * cos(2 * pi() * (i - t * 16 + 32) / 64)) AS v FROM (SELECT *, unnest([i // 16 - 2, i // 16 - 1, i // 16, i // 16 + 1, i // 16 + 2]) AS t FROM x)
      WHERE i - t * 16 BETWEEN -32 AND 31 AND t BETWEEN 0 AND total // 16),
    mag AS MATERIALIZED (SELECT label, t, k, sqrt(pow(sum(v * cos(2 * pi() * j * k / 64)), 2) + pow(sum(v * sin(2 * pi() * j * k / 64)), 2))::FLOAT::DOUBLE AS m
      FROM part CROSS JOIN (SELECT unnest(range(33)) AS k) GROUP BY label, t, k),
    raw AS MATERIALIZED (SELECT label, t, k, m > 1.5 * median(m) OVER (PARTITION BY label, t) AND m > 1.2 * median(m) OVER (PARTITION BY label, k) AS on_ FROM mag),
    {_swept("e1", "raw", "bool_and", "t", 1, 0)}, {_swept("e2", "e1", "bool_and", "k", 1, 0)}, {_swept("d1", "e2", "bool_or", "t", 0, 1)}, {_swept("d2", "d1", "bool_or", "k", 0, 1)},
    {_swept("d3", "d2", "bool_or", "t", 1, 1)}, {_swept("d4", "d3", "bool_or", "k", 1, 2)}, {_swept("e3", "d4", "bool_and", "t", 1, 1)},
    run AS MATERIALIZED (SELECT row_number() OVER () AS r, label, t, min(k) AS lo, max(k) + 1 AS hi FROM (SELECT label, t, k, k - row_number() OVER (PARTITION BY label, t ORDER BY k) AS g FROM e3 WHERE on_) GROUP BY label, t, g),
    link AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM run a JOIN run b ON b.label = a.label AND b.t = a.t + 1 AND a.lo <= b.hi AND b.lo <= a.hi),
    lk AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (SELECT r AS a, r AS b FROM run UNION SELECT reach.a, lk.b FROM reach JOIN lk ON lk.a = reach.b),
    whole AS (SELECT b AS r, min(a) AS c FROM reach GROUP BY b),
    box AS (SELECT label, c, min(t) AS t0, max(t) + 1 AS t1, min(lo) AS f0, max(hi) AS f1, sum(hi - lo) AS mass FROM run JOIN whole USING (r) GROUP BY label, c)"""


@query(
    "signals_across_segments",
    f"""WITH RECURSIVE {_SIGNALS_SQL} SELECT label, t0 * 16 / 8000 AS "start", t1 * 16 / 8000 AS "end", f0 * 125.0::DOUBLE AS f_lo, least(f1, 32) * 125.0::DOUBLE AS f_hi, CAST(mass AS BIGINT) AS mass
    FROM box WHERE t1 - t0 > 0.65 * 3 AND f1 - f0 > 4""",
)
def signals_across_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of a label as segments of one recording, in chunks of 512 frames."""
    return frames.detect_signals(_label_recordings(spark, sf_dir), "label", 64, 16, frame_times=1.5, bin_times=1.2, kernel=2, wide_seconds=0.006, high_hz=300.0, frames=512)


@query(
    "cross_fold_rates",
    f"""WITH f AS (SELECT label, CASE WHEN u < 0.2 THEN -1 ELSE CAST(floor((u - 0.2) / 0.8 * 5) AS INT) END AS fold FROM (SELECT label, {_U.format("'1|fold|' || (vec_id // 4)")} AS u FROM embeddings))
    SELECT fold, CAST(l.label AS INT) AS label_i, count(*) FILTER (f.label = l.label) AS n_true, count(*) AS n_rows FROM f, (SELECT DISTINCT label FROM embeddings) l GROUP BY ALL""",
)
def cross_fold_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the rates; what was predicted is compared in a test."""
    e = table(spark, sf_dir, "embeddings").withColumn("file", F.expr("vec_id div 4"))
    _, scored = models.cross_validated(e, "file", "embedding", 64, "label", depths=(2, 4))
    r = models.fold_rates(written(scored, "fold-scores"))
    return r.select("fold", "label_i", (F.col("tp") + F.col("fn")).alias("n_true"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_rows"))


@query("model_run", """SELECT DISTINCT vec_id // 4 AS track_id FROM embeddings""")
def model_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline is fitted, written, read, run over windows, and decides tracks; the decisions are compared in a test."""
    return model_decisions(spark, sf_dir, f"{shared_dir(spark)}/model-run-{uuid.uuid4().hex[:12]}").select("track_id")


def model_decisions(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    models.forest_pipeline("embedding", 64, "label", trees=10, depth=4).fit(e.where("vec_id % 5 <> 0")).write().overwrite().save(f"{at}/model")
    windows = e.select(F.expr("vec_id div 4").alias("track_id"), (F.col("vec_id") % 4).alias("k"), "embedding")
    return models.run_model(f"{at}/model", windows, f"{at}/predictions", "forest", "mean", 0.15)


@query(
    "incremental_months",
    """SELECT event_type, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, count(*) AS n FROM events GROUP BY ALL""",
)
def incremental_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries of the events, each run over by the stream as it arrives."""
    at = f"{shared_dir(spark)}/incremental-{uuid.uuid4().hex[:12]}"
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    by_month = lambda d: d.select("event_type", F.year("ts").alias("year"), F.month("ts").alias("month"))
    out = None
    for k in range(2):
        events.where(F.pmod("event_id", F.lit(2)) == k).write.mode("append").parquet(f"{at}/new")
        out = incremental.counts_of_new_files(spark, f"{at}/new", events.schema.simpleString()[7:-1].replace(":", " "), ["event_type", "year", "month"], by_month, f"{at}/counts", f"{at}/checkpoint")
    return out


#: Languages are labels with places, sources from 2 on have one by the extra map only.
_LABELS_SQL = """d AS (SELECT doc_id, lang, source, coalesce(TRY_CAST(substr(source, 4) AS INT), 0) AS s FROM documents),
    i AS (SELECT doc_id, list_filter([CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN -1 END, CASE WHEN s < 2 THEN 2 + s END], lambda v: v >= 0) AS own,
      list_filter([CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 6 END, CASE WHEN s BETWEEN 1 AND 7 THEN 4 + s % 3 END], lambda v: v >= 0) AS extra FROM d)"""


@query(
    "encode_labels",
    f"""WITH {_LABELS_SQL} SELECT doc_id, list_transform(range(0, 8), lambda p: CAST(list_contains(own, p) OR list_contains(extra, p) AS INT)) AS many,
    list_transform(range(0, 8), lambda p: CAST(p = coalesce(list_min(own), list_min(extra), -1) AS INT)) AS one FROM i""",
)
def encode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    pairs = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    own = pairs({"en": 0, "de": 1, "fr": -1, "src0": 2, "src1": 3})
    extra = pairs({"en": 5, "fr": 6} | {f"src{s}": 4 + s % 3 for s in range(1, 8)})
    text = F.concat_ws("\n", "lang", "source")
    return d.select("doc_id", arrays.encode_labels(text, own, extra, 8).alias("many"), arrays.encode_labels(text, own, extra, 8, multi=False).alias("one"))


@query(
    "offline_mix",
    f"""WITH e AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER () AS n FROM embeddings WINDOW w AS (ORDER BY md5('1|' || vec_id), vec_id)),
    p AS (SELECT a.vec_id, b.vec_id AS partner, 0.2::DOUBLE + 0.6::DOUBLE * {_U.format("'1|mix|' || a.vec_id")} AS share, a.embedding AS x, b.embedding AS y, a.label AS la, b.label AS lb
      FROM e a JOIN e b ON b.k = (a.k + 1) % a.n)
    SELECT vec_id, partner, round(share, 6) AS share, round(list_sum(list_transform(range(1, 65), lambda i: i * (share * x[i]::DOUBLE + (1 - share) * y[i]::DOUBLE))), 4) AS checksum,
      list_transform(range(0, 10), lambda i: round(CASE WHEN la = i THEN share ELSE 0 END + CASE WHEN lb = i THEN 1 - share ELSE 0 END, 6)) AS y,
      'l' || la || chr(10) || 'l' || lb AS text, 'a' || vec_id || chr(10) || 'b' || chr(10) || 'a' || partner || chr(10) || 'b' AS tracks, -1.0 AS lat, -1.0 AS lng FROM p""",
)
def offline_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("int"))
    e = table(spark, sf_dir, "embeddings").withColumns({"y": y, "text": F.concat(F.lit("l"), "label"), "tracks": F.concat(F.lit("a"), "vec_id", F.lit(" b")), "lat": F.lit(-41.0), "lng": F.lit(172.0)})
    m = splitting.offline_mix(e, "vec_id", "embedding", "y", "text", "tracks", run_rows=1 << 40)
    total = F.aggregate(F.transform("embedding", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return m.select("vec_id", "partner", F.round("share", 6).alias("share"), F.round(total, 4).alias("checksum"), F.transform("y", lambda v: F.round(v, 6)).alias("y"), "text", "tracks", "lat", "lng")


#: Spectra of single vectors at 8000 Hz: 5 frames of 32 samples every 16, zeros beyond the ends, 17 bins of 250 Hz.
_SHORT_SQL = """v AS (SELECT vec_id, label, {scale} AS x FROM embeddings),
    pl AS MATERIALIZED (SELECT vec_id, label, unnest(x) AS x, unnest(range(0, 64)) AS i FROM v),
    pt AS (SELECT vec_id, label, t, i - t * 16 + 16 AS j, x * (0.5 - 0.5 * cos(2 * pi() * (i - t * 16 + 16) / 32)) AS x FROM (SELECT *, unnest(range(0, 5)) AS t FROM pl) WHERE i - t * 16 BETWEEN -16 AND 15),
    pw AS MATERIALIZED (SELECT vec_id, label, t, k, pow(sum(x * cos(2 * pi() * j * k / 32)), 2) + pow(sum(x * sin(2 * pi() * j * k / 32)), 2) AS p FROM pt, (SELECT unnest(range(17)) AS k) GROUP BY ALL)"""


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("label") == 1, "bittern").when(F.col("label") == 2, "morepork").otherwise("")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8000).alias("rate"), F.col("embedding").alias("samples"), tag.alias("tag"))


@query(
    "band_energy_short",
    f"""WITH {_SHORT_SQL.format(scale="list_transform(embedding, lambda e: e::DOUBLE)")},
    bd AS (SELECT *, k * 250 AS f, CASE label WHEN 1 THEN [60, 300, 300, 600, 600, 11000] WHEN 2 THEN [400, 1500, 0, 400, 1500, 11000] ELSE [500, 5000, 0, 500, 5000, 11000] END AS e FROM pw)
    SELECT vec_id, CAST(t AS INT) AS t, round(coalesce(sqrt(avg(p) FILTER (f >= e[1] AND f < e[2])), 0), 5) AS bird, round(coalesce(sqrt(avg(p) FILTER (f >= e[3] AND f < e[4])), 0), 5) AS noise,
      round(coalesce(sqrt(avg(p) FILTER (f >= e[5] AND f < e[6])), 0), 5) AS upper FROM bd GROUP BY vec_id, t""",
)
def band_energy_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = features.band_energy(_short(spark, sf_dir), "vec_id", n_fft=32, hop=16)
    z = F.arrays_zip(F.col("bird_rms").alias("a"), F.col("noise_rms").alias("b"), F.col("upper_rms").alias("c"))
    return e.select("vec_id", F.posexplode(z).alias("t", "z")).select("vec_id", "t", *[F.round(F.col("z")[k], 5).alias(n) for k, n in zip("abc", ("bird", "noise", "upper"))])


@query(
    "mel_features_short",
    f"""WITH {_SHORT_SQL.format(scale="list_transform(embedding, lambda e: 2 * ((e::DOUBLE - list_min(embedding)::DOUBLE) / (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE + 1e-6)) - 1)")},
    m AS (SELECT br, b, (10 ** ((lo + (hi - lo) * b / 7) / 2595) - 1) * br AS hz FROM (SELECT br, 2595 * log10(1 + 100 / br) AS lo, 2595 * log10(1 + 4000 / br) AS hi FROM (SELECT unnest([1000.0::DOUBLE, 700.0]) AS br)), (SELECT unnest(range(0, 8)) AS b)),
    w AS (SELECT x.br, x.b, k, greatest(0, least((k * 250 - x.hz) / (y.hz - x.hz), (z.hz - k * 250) / (z.hz - y.hz))) * 2 / (z.hz - x.hz) AS w
      FROM m x JOIN m y ON y.br = x.br AND y.b = x.b + 1 JOIN m z ON z.br = x.br AND z.b = x.b + 2, (SELECT unnest(range(17)) AS k)),
    d AS (SELECT vec_id, br, b, t, 10 * log10(greatest(1e-10, sum(p * w))) AS db FROM pw JOIN w USING (k) GROUP BY ALL),
    e AS (SELECT *, greatest(db, max(db) OVER (PARTITION BY vec_id, br) - 80) AS g FROM d)
    SELECT vec_id, CAST((CASE br WHEN 1000 THEN 0 ELSE 6 END + b) * 5 + t AS INT) AS place, round(g - avg(g) OVER (PARTITION BY vec_id, br, b), 4) + 0.0 AS v FROM e""",
)
def mel_features_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.mel_features(_short(spark, sf_dir), "vec_id", n_fft=32, hop=16, bands=6, seconds=0.008, hi=4000.0, breaks=(1000.0, 700.0), number="double")
    return f.select("vec_id", F.posexplode("features").alias("place", "v")).select("vec_id", "place", (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query(
    "cross_fold_counts",
    f"""SELECT CAST(floor({_U.format("'1|fold|' || vec_id")} * 3) AS INT) AS fold, count(*) AS n FROM embeddings GROUP BY 1""",
)
def cross_fold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = models.with_vector(table(spark, sf_dir, "embeddings"), "embedding")
    return models.cross_fold(e, "vec_id", "label").select("fold", "n")
