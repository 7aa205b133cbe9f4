"""Readers of the outside formats: sidecars, taxonomies, sightings, regions, manifests, catalogues, shards."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavegrid.operators.features import read_wav

#: Media suffixes, the first found of a recording is taken.
MEDIA = ["m4a", "wav", "mp3", "flac"]
#: What the letters of a coded label mean.
CODED = {"c": "human", "m": "human", "f": "human", "v": "video-game", "p": "noise", "b": "noise", "o": "other", "S": "silence", "U": "unknown"}


def _fields(names: str) -> T.StructType:
    return T.StructType.fromDDL(names)


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings from ``**/*.txt`` JSON files: ``rec_id, device_id, group_id, rec_ts, duration, lat, lng, tracks, signals, file, is_bad``.

    A file that isn't JSON gives a row with ``is_bad`` and its name. Location is an object or a list of one; tracks are under
    ``Tracks`` or ``tracks``; a duplicate id stays here, see :func:`last_of_each`.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    j = F.col("value")
    get = lambda p: F.get_json_object(j, p)
    first = lambda a, b: F.coalesce(get(a), get(b))
    tracks = F.from_json(first("$.Tracks", "$.tracks"), T.ArrayType(_track_type()))
    signals = F.from_json(get("$.signal"), T.ArrayType(T.ArrayType(T.DoubleType())))
    bad = F.try_parse_json(j).isNull()
    return text.select(
        get("$.id").alias("rec_id"),
        get("$.deviceId").alias("device_id"),
        get("$.groupId").alias("group_id"),
        F.try_to_timestamp(get("$.recordingDateTime")).alias("rec_ts"),
        get("$.duration").cast("double").alias("duration"),
        first("$.location.lat", "$.location[0].lat").cast("double").alias("lat"),
        first("$.location.lng", "$.location[0].lng").cast("double").alias("lng"),
        tracks.alias("tracks"),
        signals.alias("signals"),
        F.input_file_name().alias("file"),
        bad.alias("is_bad"),
    )


def _track_type() -> T.StructType:
    tag = _fields("what string, confidence double, automatic boolean, ebird_id string")
    position = _fields("y double, height double")
    return T.StructType(
        [
            *_fields("id string, start double, `end` double, minFreq double, maxFreq double").fields,
            T.StructField("positions", T.ArrayType(position)),
            T.StructField("tags", T.ArrayType(tag)),
        ]
    )


def tracks_of(recordings: DataFrame) -> DataFrame:
    """A row per track: bounds clamped to the recording, bands from the first position where not given, human and automatic tags apart."""
    t = recordings.where("not is_bad").select("rec_id", "duration", F.explode("tracks").alias("t"))
    p = F.get("t.positions", F.lit(0))
    given = lambda c, q: F.coalesce(F.col(f"t.{c}"), F.when(p["height"] != 1, q))
    human, machine = (F.transform(F.filter("t.tags", f), lambda x: F.coalesce(x["ebird_id"], x["what"])) for f in (lambda x: ~F.coalesce(x["automatic"], F.lit(False)), lambda x: F.coalesce(x["automatic"], F.lit(False))))
    end = F.least(F.coalesce("t.end", "duration"), F.coalesce("duration", "t.end"))
    return t.select(
        "rec_id",
        F.col("t.id").alias("track_id"),
        F.col("t.start").alias("start"),
        end.alias("end"),
        given("minFreq", p["y"]).alias("min_freq"),
        given("maxFreq", p["y"] + p["height"]).alias("max_freq"),
        F.array_sort(F.array_distinct(human)).alias("tags"),
        F.array_sort(F.array_distinct(machine)).alias("automatic_tags"),
    )


def usable_tracks(tracks: DataFrame, skip: tuple[str, ...] = ("unidentified", "other", "mammal"), accept: list[str] | None = None) -> DataFrame:
    """Tracks with exactly one human tag that is not a vague one, of the accepted ones if a list is given."""
    tag = F.get("tags", F.lit(0))
    ok = (F.size("tags") == 1) & ~tag.isin(*skip)
    return tracks.where(ok & tag.isin(accept) if accept is not None else ok)


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the one that comes last in ``order``."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select(key, "r.*").select(*df.columns)


def with_media(spark: SparkSession, recordings: DataFrame, folder: str) -> DataFrame:
    """Adds ``media``: the file beside the sidecar with its stem and the first suffix of :data:`MEDIA`; null without one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(MEDIA) + "}").load(folder).select("path")
    at = F.array_position(F.array(*map(F.lit, MEDIA)), F.lower(F.substring_index("path", ".", -1)))
    first = files.select(stem(F.col("path")).alias("_stem"), "path", at.alias("_at")).groupBy("_stem").agg(F.min_by("path", "_at").alias("media"))
    return recordings.withColumn("_stem", stem(F.col("file"))).join(first, "_stem", "left").drop("_stem")


def stem(path: Column) -> Column:
    """The path without scheme and suffix."""
    return F.regexp_replace(F.regexp_replace(path, r"^\w+:/+", "/"), r"\.[^./]*$", "")


def species_list(spark: SparkSession, path: str) -> DataFrame:
    """``alias, code, priority`` from a CSV with CommonName, eBird, ScientificName, ExtraName: every name is an alias."""
    c = spark.read.option("header", True).option("ignoreTrailingWhiteSpace", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    names = F.array(*[F.struct(F.col(n).alias("alias"), F.lit(p).alias("priority")) for p, n in enumerate(["ExtraName", "ScientificName", "CommonName"])])
    return c.select(F.col("eBird").alias("code"), F.explode(names).alias("a")).where("a.alias is not null").select("a.alias", "code", "a.priority")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows as read from files, with ``file`` and the row's number in it from 0, whatever splits the file is read in.

    A split is read in order, so a row's place is its place in the split after the rows of the file's earlier splits.
    """
    at = rows.withColumns({"file": F.input_file_name(), "_off": F.input_file_block_start(), "_at": F.monotonically_increasing_id()})
    splits = at.groupBy("file", "_off").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("_off").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return at.join(splits, ["file", "_off"]).select(*rows.columns, "file", (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))


def squares_kml(spark: SparkSession, path: str) -> DataFrame:
    """``square_id, x0, y0, x1, y1``: bounds of the first outline of each placemark of KML files, numbered in order; those without numbers are left out."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_file"), F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<Placemark.*?</Placemark>"), F.lit(0))).alias("_i", "v"))
    outline = F.regexp_extract("v", r"(?s)<coordinates>\s*(.*?)\s*</coordinates>", 1)
    points = F.transform(F.split(outline, r"\s+"), lambda p: F.transform(F.slice(F.split(p, ","), 1, 2), lambda x: x.try_cast("double")))
    x, y = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    b = text.select("_file", "_i", F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))
    return b.where("x0 is not null and y0 is not null").select(F.concat_ws("#", F.element_at(F.split("_file", "/"), -1), F.col("_i").cast("string")).alias("square_id"), "x0", "y0", "x1", "y1")


def taxonomy(spark: SparkSession, path: str, alias: int = 4, code: int = 2, other: int | None = 8) -> DataFrame:
    """``alias, code, priority`` from a taxonomy CSV whose columns are known by place (from 0): common name first, then the other name."""
    c = spark.read.option("header", True).csv(path)
    at = lambda i: F.trim(F.col(f"`{c.columns[i]}`"))
    names = [F.struct(at(alias).alias("alias"), F.lit(0).alias("priority"))] + ([F.struct(at(other).alias("alias"), F.lit(1).alias("priority"))] if other is not None else [])
    return c.select(at(code).alias("code"), F.explode(F.array(*names)).alias("a")).where("a.alias <> ''").select("a.alias", "code", "a.priority")


def sightings(spark: SparkSession, path: str) -> DataFrame:
    """``file, row_no, common_name, lat, lng, obs_date`` of a tab-separated export quoted by ``|``, columns found by their names."""
    c = numbered(spark.read.option("sep", "\t").option("quote", "|").option("header", True).csv(path), "row_no")
    return c.select(
        "file",
        "row_no",
        F.col("COMMON NAME").alias("common_name"),
        F.col("LATITUDE").cast("double").alias("lat"),
        F.col("LONGITUDE").cast("double").alias("lng"),
        F.to_date("OBSERVATION DATE").alias("obs_date"),
    )


def regions(spark: SparkSession, path: str) -> DataFrame:
    """``code, x0, y0, x1, y1, species`` from one JSON map of codes."""
    kind = "map<string,struct<region:struct<info:struct<bounds:struct<minX:double,maxX:double,minY:double,maxY:double>>>,species:array<string>>>"
    j = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("code", "v"))
    b = "v.region.info.bounds"
    return j.select("code", F.col(f"{b}.minX").alias("x0"), F.col(f"{b}.minY").alias("y0"), F.col(f"{b}.maxX").alias("x1"), F.col(f"{b}.maxY").alias("y1"), F.col("v.species").alias("species"))


def tier_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``rec_id, filename, code, other_labels, start, end`` of lines with five or six fields; the first is the id if there are six, else folder and line number make one."""
    lines = numbered(spark.read.text(path), "n").withColumn("folder", F.element_at(F.split("file", "/"), -2))
    f = F.from_csv("value", F.lit("a string, b string, c string, d string, e string, f string"), {"quote": '"', "escape": '"'})
    r = lines.where("trim(value) <> ''").select("n", "folder", f.alias("f")).withColumn("six", F.col("f.f").isNotNull())
    pick = lambda x, y: F.when(F.col("six"), F.col(f"f.{x}")).otherwise(F.col(f"f.{y}"))
    other = F.coalesce(F.from_json(F.regexp_replace(pick("d", "c"), "'", '"'), "array<string>"), F.array().cast("array<string>"))
    return r.select(
        F.when(F.col("six"), F.col("f.a")).otherwise(F.concat_ws("-", "folder", F.col("n").cast("string"))).alias("rec_id"),
        pick("b", "a").alias("filename"),
        pick("c", "b").alias("code"),
        other.alias("other_labels"),
        pick("e", "d").cast("double").alias("start"),
        pick("f", "e").cast("double").alias("end"),
    )


#: Columns of file, label, start and end in the four clip manifests.
CLIP_LAYOUTS = {"plain": (0, 1, None, None), "timed": (0, 1, 2, 3), "label_first": (1, 0, 2, 3), "named": (2, 3, 0, 1)}


def clip_manifest(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """``filename, label, start, end`` of a CSV with one of four layouts; without times the whole clip counts (nulls)."""
    file, label, start, end = CLIP_LAYOUTS[layout]
    c = spark.read.option("header", True).csv(path)
    col = lambda i, kind: F.lit(None).cast(kind) if i is None else F.trim(F.col(f"`{c.columns[i]}`")).cast(kind)
    return c.select(col(file, "string").alias("filename"), col(label, "string").alias("label"), col(start, "double").alias("start"), col(end, "double").alias("end"))


def with_durations(spark: SparkSession, clips: DataFrame, folder: str) -> DataFrame:
    """``clips`` (``filename, label, start, end``) with ``path`` and the measured ``duration`` of the file; ends that are missing or too late are set to it.

    Files are found under ``folder`` by name. Clips whose file is missing or can't be read keep their row with a null duration, and
    ``error`` says so. Each file is read once, whatever the number of its clips.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(folder)
    wanted = clips.select(F.element_at(F.split("filename", "/"), -1).alias("_name")).distinct()
    f = f.withColumn("_name", F.element_at(F.split("path", "/"), -1)).join(wanted, "_name", "left_semi")

    def measure(it):
        for pdf in it:
            rows = []
            for name, path, data in zip(pdf["_name"], pdf["path"], pdf["content"]):
                try:
                    rate, x = read_wav(data)
                    rows.append((name, path, len(x) / rate if rate else None, None if rate else "no sampling rate"))
                except (ValueError, KeyError, struct.error) as e:
                    rows.append((name, path, None, str(e)))
            yield pd.DataFrame(rows, columns=["_name", "path", "duration", "error"])

    found = f.select("_name", "path", "content").mapInPandas(measure, "_name string, path string, duration double, error string")
    found = found.groupBy("_name").agg(F.min(F.struct("path", "duration", "error")).alias("f"))  # of equal names the first path
    c = clips.withColumn("_name", F.element_at(F.split("filename", "/"), -1)).join(found, "_name", "left")
    error = F.when(F.col("f.path").isNull(), F.lit("no such file")).otherwise(F.col("f.error"))
    return c.withColumns({"end": F.least("end", "f.duration"), "path": F.col("f.path"), "duration": F.col("f.duration"), "error": error}).drop("_name", "f")


def clip_folder(spark: SparkSession, folder: str, label: str = "parent", fixed: str = "") -> DataFrame:
    """``path, label`` of WAV clips: label is the parent folder, the stem before its last ``-``, or fixed."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    how = {"parent": F.element_at(F.split("path", "/"), -2), "stem": F.regexp_extract(name, r"^(.*)-[^-]*\.[^.]*$", 1), "fixed": F.lit(fixed)}[label]
    return f.select("path", how.alias("label"))


def coded_labels(code: Column) -> Column:
    """The meanings of a coded label's letters, each once, in order of the letters; unknown letters count for nothing."""
    known = F.create_map(*[F.lit(x) for kv in CODED.items() for x in kv])
    return F.array_distinct(F.filter(F.transform(F.split(code, ""), lambda c: F.element_at(known, c)), lambda x: x.isNotNull()))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``rec_id, url, file, rec_ts, rec_date, lat, lng, duration`` of a catalogue's answers (JSON lines).

    Day "00" counts as "01"; a time that can't be read leaves the date alone; lengths are minutes and seconds.
    """
    kind = "id string, url string, `file-name` string, date string, time string, lat double, lng double, length string"
    c = spark.read.schema(kind).json(path)
    date = F.regexp_replace("date", r"-00$", "-01")
    parts = F.reverse(F.split("length", ":"))
    seconds = sum((F.coalesce(F.get(parts, F.lit(i)).cast("double"), F.lit(0.0)) * 60**i for i in range(3)), F.lit(0.0))
    return c.select(
        F.col("id").alias("rec_id"),
        "url",
        F.col("file-name").alias("file"),
        F.try_to_timestamp(F.concat_ws(" ", date, "time"), F.lit("yyyy-MM-dd HH:mm")).alias("rec_ts"),
        F.try_to_date(date).alias("rec_date"),
        "lat",
        "lng",
        seconds.alias("duration"),
    )


#: Columns read in each mode.
MODES = {"raw": ["raw"], "spectrogram": ["spectrogram"], "embedding": ["embedding"], "features": ["short_f", "mid_f"]}


def shards(spark: SparkSession, path: str, mode: str = "embedding", split: str | None = None, preprocess: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Written samples with the payload of one mode only; unreadable files are skipped, a split is read by its folder.

    ``preprocess`` is applied to what was read.
    """
    df = spark.read.option("ignoreCorruptFiles", True).parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    payload = {c for cs in MODES.values() for c in cs}
    out = df.select(*[c for c in df.columns if c not in payload or c in MODES[mode]])
    return preprocess(out) if preprocess else out


def predictions(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Predictions as written by :func:`wavegrid.sources.writers.write_predictions`, of all models or one."""
    df = spark.read.parquet(path)
    return df if model is None else df.where(F.col("model") == model)


def to_bool(text: Column) -> Column:
    """True for yes, true, t, y and 1 in any case, false for anything else, null for null."""
    return F.lower(F.trim(text)).isin("yes", "true", "t", "y", "1")
