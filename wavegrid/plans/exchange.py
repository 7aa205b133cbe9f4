"""Queries that write the supplied tables in outside formats and read them back with the library's readers, and small rules on whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.functions import arrays
from wavegrid.operators import evaluate, filters, intervals, labels, segmenting, splitting
from wavegrid.plans.queries import _PREDS_SQL, _U, confusion, query
from wavegrid.sources import readers, writers
from wavegrid.sources.scratch import shared_dir
from wavegrid.sources.tables import table


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


# ---- sources and sinks

#: Line items as tracks of their supplier's recording.
_LINES_SQL = """ln AS (SELECT 's' || s_suppkey AS rec_id, 60.0::DOUBLE + s_suppkey % 50 AS duration, 't' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS track_id, l_quantity AS "start",
    CASE WHEN l_linenumber % 5 <> 4 THEN l_quantity + l_linenumber * 6.0::DOUBLE END AS stop, CASE WHEN l_linenumber % 2 = 0 THEN 50.0::DOUBLE + l_linenumber END AS lo,
    100.0::DOUBLE * l_linenumber AS y, CASE WHEN l_linenumber % 3 = 0 THEN 1.0::DOUBLE ELSE 10.0::DOUBLE + l_linenumber END AS height, l_returnflag, l_linestatus FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
  tk AS (SELECT rec_id, track_id, "start", least(coalesce(stop, duration), duration) AS "end", coalesce(lo, CASE WHEN height <> 1 THEN y END) AS min_freq, CASE WHEN height <> 1 THEN y + height END AS max_freq,
    list_sort(list_distinct(CASE WHEN l_linestatus = 'O' THEN [l_returnflag, l_returnflag] ELSE [l_returnflag, 'code-' || l_returnflag] END)) AS tags, CASE WHEN l_returnflag = 'R' THEN ['auto'] ELSE [] END AS automatic_tags FROM ln)"""


def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    tag = lambda what, auto, code=None: F.struct(what.alias("what"), F.lit(1.0).alias("confidence"), F.lit(auto).alias("automatic"), (F.lit(None).cast("string") if code is None else code).alias("ebird_id"))
    flag = F.col("l_returnflag")
    second = F.when(F.col("l_linestatus") == "O", tag(flag, False)).otherwise(tag(flag, False, F.concat(F.lit("code-"), flag)))
    tags = F.concat(F.array(tag(flag, False), second), F.when(flag == "R", F.array(tag(F.lit("auto"), True))).otherwise(F.array().cast("array<struct<what:string,confidence:double,automatic:boolean,ebird_id:string>>")))
    position = F.struct((n * 100.0).alias("y"), F.when(n % 3 == 0, 1.0).otherwise(n + 10.0).alias("height"))
    t = F.struct(
        F.concat(F.lit("t"), "l_orderkey", F.lit("_"), n, F.lit("_"), "l_partkey").alias("id"),
        q.alias("start"),
        F.when(n % 5 != 4, q + n * 6.0).alias("end"),
        F.when(n % 2 == 0, n + 50.0).alias("minFreq"),
        F.array(position).alias("positions"),
        tags.alias("tags"),
    )
    rec = s.join(li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.collect_list(t).alias("all")), "s_suppkey")
    # odd recordings use the other name of the list, and a list of one place
    odd, place = F.col("s_suppkey") % 2 == 1, F.struct(F.lit(-41.5).alias("lat"), F.lit(172.5).alias("lng"))
    body = F.struct(
        F.concat(F.lit("s"), "s_suppkey").alias("id"),
        (F.col("s_suppkey") % 50 + 60.0).alias("duration"),
        F.lit("2020-01-02T03:04:05Z").alias("recordingDateTime"),
        F.when(odd, F.col("all")).alias("Tracks"),
        F.when(~odd, F.col("all")).alias("tracks_"),
        place.alias("location"),
    )
    text = F.replace(F.to_json(body), F.lit('"tracks_"'), F.lit('"tracks"'))
    text = F.when(odd, F.regexp_replace(text, r'"location":(\{[^}]*\})', r'"location":[$1]')).otherwise(text)
    at = _place(spark, "sidecars")
    rec.select(F.col("s_suppkey").alias("k"), text.alias("value")).write.partitionBy("k").text(at)
    return readers.sidecars(spark, at)


@query(
    "sidecar_recordings",
    f"""WITH {_LINES_SQL} SELECT rec_id, any_value(duration) AS duration, -41.5::DOUBLE AS lat, 172.5::DOUBLE AS lng, count(*) AS n_tracks FROM ln GROUP BY rec_id""",
)
def sidecar_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _sidecars(spark, sf_dir).where("not is_bad and rec_ts = timestamp'2020-01-02 03:04:05'")
    return r.select("rec_id", "duration", "lat", "lng", F.size("tracks").cast("long").alias("n_tracks"))


@query("sidecar_tracks", f"""WITH {_LINES_SQL} SELECT * FROM tk""")
def sidecar_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.tracks_of(_sidecars(spark, sf_dir))


@query("usable_tracks", f"""WITH {_LINES_SQL} SELECT rec_id, tags[1] AS tag, count(*) AS n FROM tk WHERE len(tags) = 1 AND tags[1] IN ('A', 'R') AND tags[1] <> 'A' GROUP BY ALL""")
def usable_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = readers.usable_tracks(readers.tracks_of(_sidecars(spark, sf_dir)), skip=("A",), accept=["A", "R"])
    return t.groupBy("rec_id", F.get("tags", F.lit(0)).alias("tag")).agg(F.count("*").alias("n"))


@query("last_recording", """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def last_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return readers.last_of_each(e, "user_id", "at").select("user_id", "event_id")


@query("read_sightings", """SELECT c_name || ' "x"' AS common_name, c_acctbal AS lat, c_custkey / 8.0::DOUBLE AS lng, DATE '2020-01-01' + CAST(c_custkey % 300 AS INT) AS obs_date FROM customer""")
def read_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, c = _place(spark, "sightings"), table(spark, sf_dir, "customer")
    rows = c.select(F.concat("c_name", F.lit(' "x"')).alias("COMMON NAME"), F.col("c_acctbal").alias("LATITUDE"), (F.col("c_custkey") / 8.0).alias("LONGITUDE"), F.expr("date_add(date'2020-01-01', cast(c_custkey % 300 as int))").alias("OBSERVATION DATE"))
    rows.write.option("sep", "\t").option("quote", "|").option("header", True).csv(at)
    return readers.sightings(spark, at).select("common_name", "lat", "lng", "obs_date")


@query("read_regions", """SELECT r_name AS code, r_regionkey * 1.5::DOUBLE AS x0, 2.0::DOUBLE AS y0, r_regionkey + 9.5::DOUBLE AS x1, 3.0::DOUBLE AS y1, list_sort(list(n_name)) AS species FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""")
def read_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, at = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"), _place(spark, "regions")
    k = F.col("r_regionkey")
    bounds = F.struct((k * 1.5).alias("minX"), (k + 9.5).alias("maxX"), F.lit(2.0).alias("minY"), F.lit(3.0).alias("maxY"))
    region = F.struct(F.struct(bounds.alias("bounds")).alias("info"))
    rows = r.join(n, F.col("n_regionkey") == k).groupBy("r_name", "r_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("species"))
    whole = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", F.struct(region.alias("region"), "species"))))).alias("value"))  # a handful of regions
    whole.write.text(at)
    return readers.regions(spark, at)


@query("read_squares", """SELECT p_partkey / 8.0::DOUBLE AS x0, -43.0::DOUBLE AS y0, p_partkey / 8.0::DOUBLE + 0.5 AS x1, -42.5::DOUBLE AS y1 FROM part""")
def read_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, x = _place(spark, "squares"), F.col("p_partkey") / 8.0
    corner = lambda a, b: F.concat(a.cast("string"), F.lit(","), F.lit(b), F.lit(",0"))
    outline = F.concat_ws(" ", corner(x, -43.0), corner(x + 0.5, -43.0), corner(x + 0.5, -42.5), corner(x, -43.0))
    table(spark, sf_dir, "part").select(F.concat(F.lit("<Placemark><Polygon><coordinates> "), outline, F.lit(" </coordinates></Polygon></Placemark>"))).write.text(at)
    return readers.squares_kml(spark, at).select("x0", "y0", "x1", "y1")


@query("read_clips", """SELECT 'f' || l_orderkey || '.wav' AS filename, l_returnflag AS label, l_quantity AS "start", l_quantity + l_linenumber AS "end" FROM lineitem
  UNION ALL SELECT 'f' || l_orderkey || '.wav', l_returnflag, l_quantity, l_quantity + l_linenumber FROM lineitem UNION ALL SELECT 'p' || l_orderkey || '.wav', l_linestatus, NULL, NULL FROM lineitem""")
def read_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the layouts, read to one shape."""
    li = table(spark, sf_dir, "lineitem")
    file, end = F.concat(F.lit("f"), "l_orderkey", F.lit(".wav")), F.col("l_quantity") + F.col("l_linenumber")
    out = None
    for layout, cols in (("timed", [file, "l_returnflag", "l_quantity", end]), ("named", ["l_quantity", end, file, "l_returnflag"]), ("plain", [F.concat(F.lit("p"), "l_orderkey", F.lit(".wav")), "l_linestatus"])):
        at = _place(spark, f"clips-{layout}")
        li.select(*[(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(cols)]).write.option("header", True).csv(at)
        one = readers.clip_manifest(spark, at, layout)
        out = one if out is None else out.unionByName(one)
    return out


@query("read_tiers", """SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'id' || l_orderkey ELSE 'made' END AS rec_id, 'f' || l_orderkey || '.wav' AS filename, l_returnflag AS code,
  CASE WHEN l_linenumber % 3 = 0 THEN ['x', l_linestatus] ELSE [] END AS other_labels, l_quantity AS "start", l_quantity + l_linenumber AS "end" FROM lineitem""")
def read_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, at = table(spark, sf_dir, "lineitem"), _place(spark, "tiers")
    other = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("\"['x', '"), "l_linestatus", F.lit("']\""))).otherwise(F.lit("[]"))
    own = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("id"), "l_orderkey"))
    li.select(F.concat_ws(",", own, F.concat(F.lit("f"), "l_orderkey", F.lit(".wav")), "l_returnflag", other, "l_quantity", F.col("l_quantity") + F.col("l_linenumber")).alias("value")).write.text(at)
    r = readers.tier_manifest(spark, at)
    # a made id is folder and line
    made = F.col("rec_id").startswith(at.rsplit("/", 1)[1] + "-")
    return r.withColumn("rec_id", F.when(made, F.lit("made")).otherwise(F.col("rec_id")))


@query("read_catalogue", """SELECT CAST(o_orderkey AS VARCHAR) AS rec_id, 'u' || o_orderkey AS url, 'f' || o_orderkey AS file,
  CASE WHEN o_orderkey % 4 <> 0 THEN make_timestamp(CAST(2000 + o_orderkey % 20 AS BIGINT), 5, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 17 END, CAST(o_orderkey % 24 AS BIGINT), 30, 0.0) END AS rec_ts,
  make_date(CAST(2000 + o_orderkey % 20 AS BIGINT), 5, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 17 END) AS rec_date, o_totalprice AS lat, CASE WHEN o_orderkey % 5 > 0 THEN 1.5::DOUBLE END AS lng, CAST(o_orderkey % 70 * 60 + o_orderkey % 60 AS DOUBLE) AS duration FROM orders""")
def read_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, at, k = table(spark, sf_dir, "orders"), _place(spark, "catalogue"), F.col("o_orderkey")
    date = F.concat((k % 20 + 2000).cast("string"), F.when(k % 3 == 0, "-05-00").otherwise("-05-17"))
    time = F.when(k % 4 == 0, F.lit("?")).otherwise(F.format_string("%02d:30", k % 24))
    rows = o.select(k.cast("string").alias("id"), F.concat(F.lit("u"), k).alias("url"), F.concat(F.lit("f"), k).alias("file-name"), date.alias("date"), time.alias("time"), F.col("o_totalprice").alias("lat"), F.when(k % 5 > 0, 1.5).alias("lng"), F.format_string("%d:%02d", k % 70, k % 60).alias("length"))
    rows.write.json(at)
    return readers.catalogue(spark, at).withColumn("rec_ts", F.col("rec_ts").cast("timestamp_ntz"))


@query("shard_round_trip", """SELECT label, count(*) AS n, round(sum(embedding[1]::DOUBLE), 5) AS total FROM embeddings WHERE vec_id % 3 = 0 GROUP BY label""")
def shard_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by split and tag in four parts with files of at most 100 rows; one split is read with the columns of one mode."""
    e, at = table(spark, sf_dir, "embeddings"), _place(spark, "shards")
    split = F.when(F.col("vec_id") % 3 == 0, "test").otherwise("train")
    writers.write_shards(e.select(F.expr("vec_id div 4").alias("rec_id"), "label", "embedding", F.col("embedding").alias("raw"), split.alias("split"), (F.col("label") % 3).alias("first_tag")), at, 4, by_tag=True, max_rows=100)
    back = readers.shards(spark, at, "embedding", "test")
    return back.drop("raw").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 5).alias("total"))


@query("predictions_round_trip", """SELECT vec_id AS row_id, label AS y_true FROM embeddings WHERE vec_id % 2 = 1""")
def predictions_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, at = table(spark, sf_dir, "embeddings"), _place(spark, "predictions")
    writers.write_predictions(e.select(F.col("vec_id").alias("row_id"), F.col("label").alias("y_true"), F.concat(F.lit("m"), F.col("vec_id") % 2).alias("model")), at)
    return readers.predictions(spark, at, "m1").select("row_id", "y_true")


@query("json_round_trip", """SELECT n_nationkey, n_name, n_regionkey FROM nation""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, at = table(spark, sf_dir, "nation"), _place(spark, "json")
    writers.write_json(n, at)
    return spark.read.schema(n.schema).json(at)


@query("coded_labels", """WITH c AS (SELECT s_suppkey, ['c', 'm', 'x', 'v', 'p', 'S'] AS l, s_suppkey % 6 AS a, s_suppkey // 6 % 6 AS b, s_suppkey // 36 % 6 AS d FROM supplier),
  n AS (SELECT s_suppkey, list_filter(list_transform([l[a + 1], l[b + 1], l[d + 1]], lambda x: CASE x WHEN 'c' THEN 'human' WHEN 'm' THEN 'human' WHEN 'v' THEN 'video-game' WHEN 'p' THEN 'noise' WHEN 'S' THEN 'silence' END), lambda x: x IS NOT NULL) AS r FROM c)
  SELECT s_suppkey, list_filter(r, lambda x, i: list_position(r, x) = i) AS meanings FROM n""")
def coded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    letter = lambda v: F.substring(F.lit("cmxvpS"), v.cast("int") + 1, F.lit(1))
    code = F.concat(letter(k % 6), letter(F.floor(k / 6) % 6), letter(F.floor(k / 36) % 6))
    return table(spark, sf_dir, "supplier").select("s_suppkey", readers.coded_labels(code).alias("meanings"))


# ---- filters

@query("bad_tracks", """WITH l AS (SELECT vec_id, [label, (label + 3) % 10] AS li, [vec_id % 10, vec_id // 10 % 10] AS pi FROM embeddings)
  SELECT vec_id FROM l WHERE list_has_any(li, [2, 3, 4]) AND list_has_any(pi, [0, 1]) AND NOT list_has_any(pi, [2, 3, 4])""")
def bad_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select(v, F.array(F.col("label"), (F.col("label") + 3) % 10).alias("label_idx"), F.array((v % 10).cast("int"), (F.floor(v / 10) % 10).cast("int")).alias("pred_idx"))
    return evaluate.bad_tracks(e, [2, 3, 4], [0, 1]).select("vec_id")


@query("finite_rows", """SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 7 <> 0 AND vec_id % 3 <> 0""")
def finite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    spoilt = lambda n, x: F.transform("embedding", lambda p, i: F.when((v % n == 0) & (i == 3), F.lit(x)).otherwise(p.cast("double")))
    e = table(spark, sf_dir, "embeddings").select(v, spoilt(5, float("nan")).alias("raw"), spoilt(7, float("inf")).alias("short_f"), F.transform("embedding", lambda p: F.when(v % 3 == 0, 0.0).otherwise(p.cast("double"))).alias("mid_f"))
    return filters.finite(e, "raw", ("short_f", "mid_f")).select("vec_id")


@query("exact_length", """SELECT doc_id FROM documents WHERE length(text) > 0 AND len(string_split(text, ' ')) <> 60""")
def exact_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0).withColumn("words", F.split("text", " ", -1))
    return filters.not_of_length(d, "words", 60).select("doc_id")


@query("length_agrees", """SELECT doc_id FROM documents WHERE abs(n_chars - 5.0 * len(string_split(text, ' '))) <= 50""")
def length_agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("decoded", F.size(F.split("text", " ", -1)) * 5.0).where("text is not null")
    return filters.length_agrees(d, "n_chars", "decoded", 50.0).select("doc_id")


@query("only_recordings", """SELECT p_partkey, CAST(p_partkey % 150 AS VARCHAR) AS rec_id FROM part WHERE p_partkey % 150 IN (SELECT s_suppkey FROM supplier)""")
def only_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/a/b/"), F.col("p_partkey") % 150, F.lit("-clip.wav")).alias("path"))
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("rec_id"))
    return filters.only_recordings(p, ids, "path").select("p_partkey", "rec_id")


@query("missing_from", """SELECT p_partkey AS bin_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)""")
def missing_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("bin_id"))
    return splitting.missing_from(recs, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("bin_id")))


@query("pick_rows", """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('1|' || event_id), event_id) AS r FROM events) WHERE r <= 25""")
def pick_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pick(table(spark, sf_dir, "events"), ["event_id"], 25, per=["event_type"]).select("event_type", "event_id")


@query("clip_samples", """WITH s AS (SELECT vec_id, embedding, CAST(floor((vec_id % 40) / 1000.0::DOUBLE * 1000.0::DOUBLE) AS INT) AS a, CAST(floor((vec_id % 40 + 10 + vec_id % 7) / 1000.0::DOUBLE * 1000.0::DOUBLE) AS INT) AS b FROM embeddings)
  SELECT vec_id, len(embedding[a + 1 : b]) AS n, round(list_sum(list_transform(embedding[a + 1 : b], lambda v: v::DOUBLE)), 5) AS total FROM s""")
def clip_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    spans = e.select("vec_id", ((F.col("vec_id") % 40) / F.lit(1000.0)).alias("start"), ((F.col("vec_id") % 40 + 10 + F.col("vec_id") % 7) / F.lit(1000.0)).alias("end"))
    out = filters.clips(e.select("vec_id", F.lit(1000.0).alias("rate"), F.col("embedding").alias("samples")), spans, "vec_id")
    return out.select("vec_id", F.size("samples").cast("long").alias("n"), F.round(arrays.array_sum(arrays.doubles("samples")), 5).alias("total"))


# ---- labels

@query("family_rule", """SELECT p_partkey, CASE WHEN contains(lower(p_name), '1') THEN '1' ELSE p_brand END AS label FROM part""")
def family_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", labels.family_rule(F.col("p_name"), "1", F.col("p_brand")).alias("label"))


_TAGS = ["bird", "wind", "human", "kea1", "tui1", "rain", "sheep"]
_TAGS_SQL = "['bird', 'wind', 'human', 'kea1', 'tui1', 'rain', 'sheep']"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with one or two tags."""
    k = F.col("event_id")
    names = F.array(*map(F.lit, _TAGS))
    tag = lambda v: F.get(names, (v % 7).cast("int"))
    return table(spark, sf_dir, "events").select(k, F.array_distinct(F.array(tag(k), tag(F.floor(k / 7)))).alias("tags"), tag(k).alias("label"))


_TAGGED_SQL = f"tg AS (SELECT event_id, list_distinct([{_TAGS_SQL}[event_id % 7 + 1], {_TAGS_SQL}[event_id // 7 % 7 + 1]]) AS tags, {_TAGS_SQL}[event_id % 7 + 1] AS label FROM events)"


@query(
    "track_flags",
    f"""WITH {_TAGGED_SQL} SELECT event_id, list_has_any(tags, ['kea1', 'tui1', 'bird']) AS is_bird, list_has_any(tags, ['kea1', 'tui1', 'bird', 'human', 'sheep']) AS is_animal,
    list_has_any(tags, ['wind', 'rain']) AS is_noise FROM tg""",
)
def track_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    bird, animal, noise = labels.track_flags(F.col("tags"), F.array(F.lit("kea1"), F.lit("tui1")))
    return _tagged(spark, sf_dir).select("event_id", bird.alias("is_bird"), animal.alias("is_animal"), noise.alias("is_noise"))


@query("evaluation_label", f"""WITH {_TAGGED_SQL} SELECT event_id, CASE WHEN label IN ('wind', 'rain') THEN 'noise' WHEN label IN ('human', 'sheep') THEN 'human' WHEN label = 'kea1' THEN 'kea1' ELSE 'bird' END AS label FROM tg""")
def evaluation_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("event_id", labels.evaluation_label(F.col("label"), ["kea1"]).alias("label"))


@query(
    "label_set",
    f"""WITH {_TAGGED_SQL}, c AS (SELECT DISTINCT CASE WHEN label = 'kea1' THEN 'kea' ELSE label END AS label FROM tg)
    SELECT 'all' AS mode, label FROM c UNION SELECT 'all', 'bird' UNION SELECT 'coarse', CASE WHEN label IN ('wind', 'rain') THEN 'noise' WHEN label IN ('human', 'sheep') THEN 'animal' ELSE 'bird' END FROM c
    UNION SELECT 'single', CASE WHEN label = 'tui1' THEN label WHEN label IN ('wind', 'rain') THEN 'noise' ELSE 'bird' END FROM c""",
)
def label_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, a = _tagged(spark, sf_dir), spark.createDataFrame([("kea1", "kea")], "alias string, code string")
    modes = {"all": {}, "coarse": {"generic": False}, "single": {"only": "tui1"}}
    out = None
    for mode, more in modes.items():
        one = labels.label_set(t, a, mode, **more).select(F.lit(mode).alias("mode"), "label")
        out = one if out is None else out.unionByName(one)
    return out


@query("label_members", """SELECT n_regionkey AS target_i, list_sort(list(n_name)) AS members FROM nation GROUP BY n_regionkey HAVING n_regionkey <> 2""")
def label_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return labels.label_members(n.select(F.when(F.col("n_regionkey") == 2, -1).otherwise(F.col("n_regionkey")).alias("target_i"), F.col("n_name").alias("label")))


@query(
    "possible_labels",
    """WITH p AS (SELECT c_custkey, c_custkey % 3 = 0 AS generic, CASE WHEN c_custkey % 11 > 0 THEN CAST(c_custkey % 20 AS DOUBLE) END AS lat, CAST(c_custkey % 7 AS DOUBLE) AS lng FROM customer)
    SELECT c_custkey, CASE WHEN NOT generic THEN [1, 1, 1, 1, 1] WHEN lat IS NULL OR (lat = 0 AND lng = 0) OR (lng BETWEEN 1 AND 4 AND lat BETWEEN 5 AND 12) THEN [0, 1, 0, 1, 0] ELSE [0, 1, 1, 1, 0] END AS mask FROM p""",
)
def possible_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    idx = F.when(k % 3 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    mask = labels.possible_labels(idx, 1, 5, F.when(k % 11 > 0, (k % 20).cast("double")), (k % 7).cast("double"), (1.0, 5.0, 4.0, 12.0), [1, 3], [1, 2, 3])
    return table(spark, sf_dir, "customer").select(k, mask.alias("mask"))


@query("generic_shared", """WITH e AS (SELECT vec_id, list_transform(range(0, 5), lambda i: CASE WHEN (vec_id >> i) & 1 = 1 THEN 1.0::DOUBLE ELSE 0 END) AS y FROM embeddings)
  SELECT vec_id, list_transform(range(0, 5), lambda i: CASE WHEN i = 2 AND list_sum(y) > y[3] THEN y[i + 1] * 0.5 ELSE y[i + 1] END) AS y FROM e""")
def generic_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.array(*[F.shiftright("vec_id", i).bitwiseAND(F.lit(1)).cast("double") for i in range(5)])
    return table(spark, sf_dir, "embeddings").select("vec_id", arrays.generic_shared(y, 2).alias("y"))


# ---- tracks and evaluation

@query("silent_end", """SELECT user_id, min(CAST(floor(epoch(ts) / 86400) AS BIGINT)) FILTER (value < 2) AS end_chunk FROM events GROUP BY user_id""")
def silent_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("chunk"), F.col("value").alias("lo"), F.when(F.col("value") < 2, F.col("value")).otherwise(F.col("value") + 1).alias("hi"))
    return intervals.silent_end(e, "user_id", "chunk", "lo", "hi")


@query(
    "at_least_long",
    f"""WITH t AS (SELECT event_id AS track_id, value AS a, value + (event_id % 30) / 10.0::DOUBLE AS b, 100.0::DOUBLE AS duration FROM events WHERE value IS NOT NULL),
    w AS (SELECT *, greatest(0, 1.5 - (b - a)) AS missing FROM t), s AS (SELECT *, greatest(0, least(a - missing * {_U.format("'3|pad|' || track_id")}, duration - 1.5)) AS s FROM w)
    SELECT track_id, round(CASE WHEN missing > 0 THEN s ELSE a END, 6) AS "start", round(CASE WHEN missing > 0 THEN least(s + 1.5, duration) ELSE b END, 6) AS "end" FROM s""",
)
def at_least_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    t = e.select(F.col("event_id").alias("track_id"), F.col("value").alias("start"), (F.col("value") + (F.col("event_id") % 30) / F.lit(10.0)).alias("end"), F.lit(100.0).alias("duration"))
    return segmenting.at_least(t, 1.5).select("track_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(
    "accuracy_by_share",
    f"""WITH {_PREDS_SQL}, c AS (SELECT label AS label_i, count(*) AS n FROM embeddings GROUP BY label)
    SELECT label_i, round(n / sum(n) OVER (), 6) AS share, round((SELECT sum(m.n) FROM cm m WHERE m.true_i = label_i AND m.pred_i = label_i) / nullif((SELECT sum(m.n) FROM cm m WHERE m.true_i = label_i), 0), 6) AS accuracy FROM c""",
)
def accuracy_by_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("label_i")).agg(F.count("*").alias("n"))
    out = evaluate.accuracy_by_share(confusion(spark, sf_dir), counts)
    return out.select("label_i", F.round("share", 6).alias("share"), F.round("accuracy", 6).alias("accuracy"))
