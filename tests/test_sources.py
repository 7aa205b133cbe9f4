"""Readers and writers on small files with awkward cases."""

import json

import pytest
from pyspark.sql import functions as F

from wavegrid.sources import readers, writers
from wavegrid.streaming import incremental


@pytest.fixture()
def folder(tmp_path):
    a = tmp_path / "a"
    a.mkdir()
    one = {
        "id": "r1", "deviceId": "d1", "groupId": "g", "recordingDateTime": "2023-05-01T06:00:00+12:00", "duration": 30.0, "location": {"lat": -43.5, "lng": 172.6},
        "signal": [[0.5, 1.0, 1000, 2000]],
        "Tracks": [
            {"id": "t1", "start": 1.0, "end": 40.0, "positions": [{"y": 500, "height": 1500}], "tags": [{"what": "Tui", "confidence": 1, "automatic": False, "ebird_id": "tui1"}, {"what": "bird", "automatic": True}]},
            {"id": "t2", "start": 2.0, "minFreq": 10, "maxFreq": 20, "positions": [{"y": 0, "height": 1}], "tags": [{"what": "unidentified", "automatic": False}]},
            {"id": "t3", "start": 3.0, "end": 4.0, "positions": [{"y": 0, "height": 1}], "tags": [{"what": "a"}, {"what": "b"}]},
        ],
    }
    two = {"id": "r2", "location": [{"lat": 1.0, "lng": 2.0}], "duration": 5, "tracks": [{"id": "t9", "start": 0, "end": 1, "tags": []}], "recordingDateTime": "never"}
    (a / "one.txt").write_text(json.dumps(one, indent=1))
    (a / "two.txt").write_text(json.dumps(two))
    (tmp_path / "bad.txt").write_text("{not json")
    (a / "one.mp3").write_bytes(b"x")
    (a / "one.wav").write_bytes(b"x")
    return tmp_path


def test_sidecars(spark, folder):
    r = readers.sidecars(spark, str(folder))
    rows = {x["rec_id"]: x for x in r.collect()}
    assert [x["is_bad"] for x in rows.values()].count(True) == 1
    assert rows["r1"]["lat"] == -43.5 and rows["r2"]["lng"] == 2.0 and rows["r2"]["rec_ts"] is None and rows["r1"]["rec_ts"].isoformat() == "2023-04-30T18:00:00"
    t = {x["track_id"]: x for x in readers.tracks_of(r).collect()}
    assert (t["t1"]["end"], t["t1"]["min_freq"], t["t1"]["max_freq"]) == (30.0, 500.0, 2000.0)
    assert (t["t2"]["end"], t["t2"]["min_freq"], t["t2"]["max_freq"]) == (30.0, 10.0, 20.0) and t["t3"]["min_freq"] is None
    assert t["t1"]["tags"] == ["tui1"] and t["t1"]["automatic_tags"] == ["bird"] and t["t9"]["tags"] == []
    assert [x["track_id"] for x in readers.usable_tracks(readers.tracks_of(r)).collect()] == ["t1"]
    media = {x["rec_id"]: x["media"] for x in readers.with_media(spark, r, str(folder)).collect()}
    assert media["r1"].endswith("one.wav") and media["r2"] is None


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, n int, v string")
    assert sorted(map(tuple, readers.last_of_each(df, "k", "n").collect())) == [("a", 3, "z"), ("b", 1, None)]


def test_tables_of_names(spark, tmp_path):
    p = tmp_path / "classes.csv"
    p.write_text(",CommonName,eBird,ScientificName,ExtraName\n0,Spotted Crake,spocra1,Porzana porzana ,Crake\n1,\"Tui, the\",tui1,Prosthemadera,\n")
    got = {(r["alias"], r["code"]) for r in readers.species_list(spark, str(p)).collect()}
    assert got == {("Spotted Crake", "spocra1"), ("Porzana porzana", "spocra1"), ("Crake", "spocra1"), ("Tui, the", "tui1"), ("Prosthemadera", "tui1")}
    s = tmp_path / "s.tsv"
    s.write_text("X\tCOMMON NAME\tLATITUDE\tLONGITUDE\tOBSERVATION DATE\n1\t|Tui \"big\"|\t-43.1\t172.2\t2020-03-04\n2\tKea\t\t1\tbad\n")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    rows = readers.sightings(spark, str(s)).collect()
    spark.conf.unset("spark.sql.ansi.enabled")
    assert rows[0]["common_name"] == 'Tui "big"' and rows[0]["obs_date"].isoformat() == "2020-03-04" and rows[1]["lat"] is None
    j = tmp_path / "r.json"
    j.write_text(json.dumps({"NZ": {"region": {"code": "NZ", "info": {"bounds": {"minX": 1, "maxX": 2, "minY": 3, "maxY": 4}}}, "species": ["tui1"]}}))
    assert [tuple(r) for r in readers.regions(spark, str(j)).collect()] == [("NZ", 1.0, 3.0, 2.0, 4.0, ["tui1"])]


def test_manifests(spark, tmp_path):
    d = tmp_path / "tier1"
    d.mkdir()
    (d / "m.csv").write_text("id7,a.wav,tui1,\"['x', 'y']\",0.5,2\nb.wav,kea1,[],1,3\nc.wav,kea1,oops,1,3\n")
    rows = readers.tier_manifest(spark, str(d / "m.csv")).collect()
    assert tuple(rows[0]) == ("id7", "a.wav", "tui1", ["x", "y"], 0.5, 2.0)
    assert rows[1]["rec_id"] == "tier1-1" and rows[1]["other_labels"] == [] and rows[2]["other_labels"] == []
    (tmp_path / "c.csv").write_text("start,end,file,label\n1,2,a.wav, tui\n")
    assert [tuple(r) for r in readers.clip_manifest(spark, str(tmp_path / "c.csv"), "named").collect()] == [("a.wav", "tui", 1.0, 2.0)]
    (tmp_path / "p.csv").write_text("file,label\na.wav,tui\n")
    assert [tuple(r) for r in readers.clip_manifest(spark, str(tmp_path / "p.csv"), "plain").collect()] == [("a.wav", "tui", None, None)]
    c = tmp_path / "clips" / "kea"
    c.mkdir(parents=True)
    (c / "big-kea-3.wav").write_bytes(b"x")
    assert [readers.clip_folder(spark, str(tmp_path / "clips"), how, "human").collect()[0]["label"] for how in ("parent", "stem", "fixed")] == ["kea", "big-kea", "human"]


def test_catalogue(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id":"1","date":"2020-05-00","time":"07:30","lat":1.5,"length":"1:05"}\n{"id":"2","date":"2020-05-02","time":"?","length":"1:00:01"}\n')
    a, b = readers.catalogue(spark, str(tmp_path / "x.json")).orderBy("rec_id").collect()
    assert a["rec_ts"].isoformat() == "2020-05-01T07:30:00" and a["duration"] == 65.0
    assert b["rec_ts"] is None and b["rec_date"].isoformat() == "2020-05-02" and b["duration"] == 3601.0 and b["lat"] is None


def test_shards(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 50).alias("rec_id"), F.when(F.col("id") % 50 < 40, "train").otherwise("test").alias("split"), F.concat(F.lit("t"), F.col("id") % 3).alias("first_tag"), F.array(F.col("id").cast("float")).alias("raw"), F.array(F.lit(1.0)).alias("embedding"))
    writers.write_shards(df, str(tmp_path / "s"), 4, by_tag=True, max_rows=100)
    back = readers.shards(spark, str(tmp_path / "s"), "raw", "test")
    assert back.count() == 200 and "embedding" not in back.columns and "raw" in back.columns
    files = back.select(F.input_file_name().alias("f"), "rec_id").distinct().groupBy("rec_id").agg(F.count_distinct(F.regexp_extract("f", r"part-(\d+)", 1)).alias("n"))
    assert files.where("n > 1").count() == 0


def test_failed_samples_are_kept_beside_the_shards(spark, tmp_path):
    rows = [(1, "train", [0.5], None), (2, "train", None, "no WAV file"), (3, "test", [0.25], None), (None, None, None, "")]
    df = spark.createDataFrame(rows, "rec_id long, split string, raw array<float>, error string")
    at = str(tmp_path / "s")
    for _ in range(2):  # written again, nothing is left of the first time
        writers.write_shards(df, at, 2)
        back = readers.shards(spark, at, "raw")
        assert sorted(r["rec_id"] for r in back.collect()) == [1, 3] and "error" not in back.columns
        assert sorted((r["rec_id"] or 0, r["error"]) for r in writers.failed_samples(spark, at).collect()) == [(0, ""), (2, "no WAV file")]
    writers.write_shards(df.where("error is null"), at, 2)
    assert writers.failed_samples(spark, at).count() == 0


def test_new_files_only(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    step = lambda d: d.withColumn("double", F.col("id") * 2)
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).write.mode("append").parquet(src)
        incremental.process_new_files(spark, src, "id long", step, out, cp).awaitTermination()
        assert sorted(r["double"] for r in spark.read.parquet(out).collect()) == list(range(0, (k + 1) * 20, 2))
    done = spark.range(5).withColumnRenamed("id", "k")
    assert incremental.unprocessed(spark.range(8).withColumnRenamed("id", "k"), done, "k").count() == 3


def test_stream_counts(spark, tmp_path):
    src = str(tmp_path / "seen")
    rows = [(1, "tui", "2020-01-01 10:00:00"), (1, "tui", "2020-01-01 11:00:00"), (2, "kea", "2020-02-01 00:00:00"), (9, "kea", "2020-06-01 00:00:00")]
    spark.createDataFrame(rows, "square_id long, code string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    s = incremental.monthly_counts_stream(spark.readStream.schema("square_id long, code string, ts timestamp").parquet(src))
    q = s.writeStream.format("memory").queryName("seen_counts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = {(r["square_id"], r["code"], r["month"], r["n"]) for r in spark.table("seen_counts").collect()}
    assert (1, "tui", 1, 2) in got and (2, "kea", 2, 1) in got


def test_rows_are_numbered_in_their_file_whatever_the_splits(spark, tmp_path):
    at = tmp_path / "s"
    at.mkdir()
    for name, n in (("a.tsv", 700), ("b.tsv", 90)):
        lines = ["COMMON NAME\tLATITUDE\tLONGITUDE\tOBSERVATION DATE"] + [f"bird {i}\t-41.{i}\t172.5\t2020-01-02" for i in range(n)]
        (at / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2000", "10000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = readers.sightings(spark, str(at)).collect()
            assert len(rows) == 790 and all(r["common_name"] == f"bird {r['row_no']}" for r in rows), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_squares_taxonomy_and_coded_labels(spark, tmp_path):
    mark = "<Placemark><name>{}</name><Polygon><outerBoundaryIs><coordinates>\n {} </coordinates></outerBoundaryIs></Polygon></Placemark>"
    body = mark.format("A", "172.0,-43.0,0 172.1,-43.0,0 172.1,-42.9,0 172.0,-43.0,0") + mark.format("none", "") + mark.format("B", "10,20 11,22")
    (tmp_path / "g.kml").write_text(f"<kml><Document>{body}</Document></kml>")
    got = sorted(tuple(r) for r in readers.squares_kml(spark, str(tmp_path / "g.kml")).collect())
    assert got == [("g.kml#0", 172.0, -43.0, 172.1, -42.9), ("g.kml#2", 10.0, 20.0, 11.0, 22.0)]
    (tmp_path / "t.csv").write_text("a,b,code,c,name,d,e,f,sci\n1,2,kea1,3,Kea,4,5,6,Nestor notabilis\n1,2,tui1,3,Tui,4,5,6,\n")
    rows = sorted(tuple(r) for r in readers.taxonomy(spark, str(tmp_path / "t.csv")).collect())
    assert rows == [("Kea", "kea1", 0), ("Nestor notabilis", "kea1", 1), ("Tui", "tui1", 0)]
    df = spark.createDataFrame([("cmv",), ("Sx",), (None,)], "code string")
    assert [r[0] for r in df.select(readers.coded_labels(df["code"])).collect()] == [["human", "video-game"], ["silence"], None]


def test_predictions_and_a_reader_with_a_step_of_its_own(spark, tmp_path):
    df = spark.createDataFrame([(1, "m1", 0.5), (2, "m2", 0.25)], "row_id long, model string, p double")
    writers.write_predictions(df, str(tmp_path / "p"))
    assert {tuple(r) for r in readers.predictions(spark, str(tmp_path / "p")).select("row_id", "model", "p").collect()} == {(1, "m1", 0.5), (2, "m2", 0.25)}
    assert readers.predictions(spark, str(tmp_path / "p"), "m2").count() == 1
    df.withColumn("embedding", df["p"]).write.parquet(str(tmp_path / "s"))
    assert readers.shards(spark, str(tmp_path / "s"), preprocess=lambda d: d.where("p > 0.3")).count() == 1


def test_mixup_with_beta_shares(spark):
    from wavegrid.operators import splitting

    df = spark.createDataFrame([(i, [float(i), 1.0], [1, 0] if i % 2 else [0, 1]) for i in range(400)], "k long, x array<double>, y array<int>")
    rows = splitting.mixup(df, "k", "x", "y", run_rows=100).collect()
    assert sorted(r["k"] for r in rows) == sorted(r["partner"] for r in rows) == list(range(400))
    for r in rows:
        assert abs(r["x"][0] - (r["share"] * r["k"] + (1 - r["share"]) * r["partner"])) < 1e-9 and abs(sum(r["y"]) - 1) < 1e-9
    shares = [r["share"] for r in rows if r["share"] > 0]
    # about a quarter is mixed; Beta(0.2, 0.2) lies near 0 and 1: half of it beyond 0.03 and 0.97
    assert 60 < len(shares) < 140 and 0.35 < sum(s < 0.03 or s > 0.97 for s in shares) / len(shares) < 0.85
    hard = splitting.mixup(df, "k", "x", "y", soft=False).collect()
    assert all(set(r["y"]) <= {0.0, 1.0} for r in hard)
