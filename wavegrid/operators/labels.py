"""Label harmonisation: aliases to codes, merge tables, training selections, remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.operators.sizes import small

#: Labels counted as noise. Data sets with other names pass their own lists.
NOISE = ["wind", "vehicle", "dog", "rain", "static", "noise", "cat"]
#: Labels of people and livestock; ours, as a default that callers replace by lists of their own.
HUMAN = ["human", "sheep"]
GENERIC = "bird"


def alias_key(text: Column) -> Column:
    """Lower case, blanks to hyphens."""
    return F.replace(F.lower(text), F.lit(" "), F.lit("-"))


def alias_map(*sources: tuple[DataFrame, int]) -> DataFrame:
    """``alias, code`` from tables of these columns; of several codes of an alias the highest priority wins, then the smallest code."""
    rows = None
    for df, priority in sources:
        one = df.select(alias_key(F.col("alias")).alias("alias"), F.col("code"), F.lit(priority).alias("priority"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.where("alias is not null").groupBy("alias").agg(F.max_by("code", F.struct("priority", F.col("code"))).alias("code"))


def to_code(df: DataFrame, label: str, aliases: DataFrame, out: str = "code") -> DataFrame:
    """The code of each label, itself where no alias is known."""
    a = aliases.select(F.col("alias").alias("_alias"), F.col("code").alias("_code"))
    return df.join(a, alias_key(F.col(label)) == F.col("_alias"), "left").withColumn(out, F.coalesce("_code", F.col(label))).drop("_alias", "_code")


def code_aliases(aliases: DataFrame, order: str = "alias") -> DataFrame:
    """Each code's aliases in order; the first is its display name."""
    return aliases.groupBy("code").agg(F.array_sort(F.collect_list(order)).alias("aliases")).withColumn("display_name", F.get("aliases", F.lit(0)))


def relabel(df: DataFrame, label: str, merges: DataFrame) -> DataFrame:
    """Merged labels by a table ``label, target``; the one before stays as ``original``."""
    m = merges.select(F.col("label").alias("_l"), F.col("target").alias("_t"))
    out = df.join(m, F.col(label) == F.col("_l"), "left").withColumn("original", F.col(label))
    return out.withColumn(label, F.coalesce("_t", F.col(label))).drop("_l", "_t")


def family_rule(name: Column, family: str, otherwise: Column) -> Column:
    """Any name that contains the family's is that family."""
    return F.when(F.lower(name).contains(family), F.lit(family)).otherwise(otherwise)


def label_report(tracks: DataFrame, label: str = "label", track: str = "track_id", rec: str = "rec_id") -> DataFrame:
    return tracks.groupBy(label).agg(F.countDistinct(track).alias("n_tracks"), F.countDistinct(rec).alias("n_recs"))


def select_training(counts: DataFrame, merges: DataFrame, min_samples: int = 50, min_recs: int = 50, min_val: int = 2) -> DataFrame:
    """Labels (after merging) whose summed counts ``n_samples, n_recs, n_val`` are all above the limits."""
    merged = relabel(counts, "label", merges)
    sums = merged.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("n_samples", "n_recs", "n_val")])
    return sums.where((F.col("n_samples") > min_samples) & (F.col("n_recs") > min_recs) & (F.col("n_val") > min_val))


def excluded_labels(labels: DataFrame, training: DataFrame, merges: DataFrame, noise: list[str] = NOISE, human: list[str] = HUMAN) -> DataFrame:
    """Labels neither trained nor special, unless the label they merge into is kept. All tables have a column ``label``."""
    kept = training.select(F.col("label").alias("target"))
    keep = training.select("label").unionByName(merges.join(kept, "target", "left_semi").select("label")).distinct()
    special = [*noise, *human, GENERIC]
    return labels.where(~F.col("label").isin(special)).join(keep, "label", "left_anti")


def remap(labels: DataFrame, excluded: DataFrame, merges: DataFrame, trained: DataFrame, use_generic: bool = True, noise: list[str] = NOISE, human: list[str] = HUMAN) -> DataFrame:
    """``label, target, target_i, extra_i``: where each label goes among the new, sorted labels.

    Excluded labels go to -1. A label merges into its target if that is kept or new; merged labels leave the new list. Noise
    and human labels go to those groups where they exist. Other labels go to the generic one, but trained ones
    keep their own index and have the generic one as an extra. Null indices mean no extra.
    """
    m = merges.select(F.col("label").alias("_l"), "target")
    kept = labels.join(excluded, "label", "left_anti")
    goal = kept.join(m, F.col("label") == F.col("_l"), "left").select("label", F.coalesce("target", "label").alias("goal"))
    new = goal.select(F.col("goal").alias("label")).distinct()
    new = new.withColumn("i", (F.row_number().over(Window.orderBy("label")) - 1))  # a row per label
    groups = new.select(F.col("label").alias("_g"), F.col("i").alias("_gi"))
    group = F.when(F.col("label").isin(noise), F.lit("noise")).when(F.col("label").isin(human), F.lit("human")).otherwise(F.lit(GENERIC if use_generic else None))
    t = trained.select(F.col("label").alias("_t"))
    out = labels.join(goal, "label", "left").join(new.select(F.col("label").alias("goal"), "i"), "goal", "left")
    out = out.withColumn("_group", F.when(F.col("goal").isNotNull() & (F.col("label") != GENERIC), group))
    out = out.join(small(groups, 64), F.col("_group") == F.col("_g"), "left").join(t, F.col("label") == F.col("_t"), "left")
    own = F.col("_t").isNotNull() | F.col("_gi").isNull()
    is_generic = F.col("_group") == GENERIC
    target = F.when(F.col("goal").isNull(), F.lit(-1)).when(own | (F.col("_group") == F.col("label")), F.col("i")).otherwise(F.col("_gi"))
    extra = F.when(F.col("_t").isNotNull() & is_generic, F.col("_gi"))
    return out.select("label", F.when(F.col("goal").isNotNull(), F.col("goal")).alias("target"), target.cast("int").alias("target_i"), extra.cast("int").alias("extra_i"))


def label_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``label, change``: those only in ``a`` are removed, those only in ``b`` added."""
    gone = a.select("label").distinct().exceptAll(b.select("label").distinct()).withColumn("change", F.lit("removed"))
    return gone.unionByName(b.select("label").distinct().exceptAll(a.select("label").distinct()).withColumn("change", F.lit("added")))


def label_members(remapped: DataFrame) -> DataFrame:
    """The labels that landed on each target."""
    return remapped.where("target_i >= 0").groupBy("target_i").agg(F.array_sort(F.collect_set("label")).alias("members"))


def label_set(tracks: DataFrame, aliases: DataFrame, mode: str = "all", generic: bool = True, only: str | None = None, noise: list[str] = NOISE, human: list[str] = HUMAN) -> DataFrame:
    """The sorted labels of a run (``label``) from the labels of all data sets' tracks.

    ``coarse`` maps every label to bird, animal (the generic human group) or noise; ``single`` keeps ``only`` and calls
    the rest generic; otherwise labels become codes, and the generic one is added if wanted.
    """
    codes = to_code(tracks.select("label").where("label is not null").distinct(), "label", aliases).select(F.col("code").alias("label"))
    c = F.col("label")
    if mode == "coarse":
        codes = codes.select(F.when(c.isin(noise), F.lit("noise")).when(c.isin(human), F.lit("animal")).otherwise(F.lit(GENERIC)).alias("label"))
    elif mode == "single":
        codes = codes.select(F.when(c == only, c).when(c.isin(noise), F.lit("noise")).otherwise(F.lit(GENERIC)).alias("label"))
    if generic:
        codes = codes.unionByName(codes.sparkSession.range(1).select(F.lit(GENERIC).alias("label")))
    return codes.distinct()


def evaluation_label(label: Column, modelled: list[str], noise: list[str] = NOISE, human: list[str] = HUMAN, birds: Column | None = None) -> Column:
    """The label a true label counts as: the noise and human groups, itself if the model has it, else the generic one for birds."""
    group = F.when(label.isin(noise), F.lit("noise")).when(label.isin(human), F.lit("human")).when(label.isin(modelled), label)
    return group.otherwise(F.when(birds, F.lit(GENERIC)).otherwise(label)) if birds is not None else group.otherwise(F.lit(GENERIC))


def track_flags(tags: Column, birds: Column, noise: list[str] = NOISE, human: list[str] = HUMAN) -> tuple[Column, Column, Column]:
    """Whether a track has a bird, an animal or, if its tags are no animals, a noise; ``birds`` is an array of bird labels."""
    bird = F.arrays_overlap(tags, birds) | F.array_contains(tags, GENERIC)
    animal = bird | F.exists(tags, lambda t: t.isin(human))
    quiet = F.exists(tags, lambda t: t.isin(noise) & ~F.array_contains(birds, t) & ~t.isin(human))
    return bird, animal, quiet


def possible_labels(label_idx: Column, generic: int, n: int, lat: Column, lng: Column, box: tuple[float, float, float, float], inside: list[int], birds: list[int]) -> Column:
    """Mask of labels a row may have: for rows that are only generic, the list for the box (x0, y0, x1, y1) or unknown places inside it, all birds outside; ones for others."""
    only = (F.size(label_idx) == 1) & F.array_contains(label_idx, F.lit(generic))
    unknown = lat.isNull() | lng.isNull() | ((lat == 0) & (lng == 0))
    here = unknown | (lng.between(box[0], box[2]) & lat.between(box[1], box[3]))
    mask = lambda on: F.array(*[F.lit(int(i in on)) for i in range(n)])
    return F.when(~only, F.array_repeat(F.lit(1), n)).when(here, mask(set(inside))).otherwise(mask(set(birds)))


def label_audit(rows: DataFrame, text: str, target: str) -> DataFrame:
    """Texts that landed on each target, those with several labels apart."""
    many = F.col(text).contains("\n")
    return rows.groupBy(target).agg(F.array_sort(F.collect_set(F.when(~many, F.col(text)))).alias("texts"), F.count_if(many).alias("n_multi"))


def tags_key(tags: Column) -> Column:
    """The tags in order, joined by "-"."""
    return F.array_join(F.array_sort(tags), "-")


def bin_id(rec_id: Column, tags: Column) -> Column:
    """Recording and first tag, joined by "-"; without tags the recording alone."""
    return F.concat_ws("-", rec_id.cast("string"), F.get(tags, F.lit(0)))


def choose_label(label_idx: Column, extra_idx: Column) -> Column:
    """The smallest index of a row, or of its extra labels where it has none."""
    return F.coalesce(F.array_min(label_idx), F.array_min(extra_idx))


def initial_sidecars(manifest: DataFrame, codes: DataFrame) -> DataFrame:
    """Sidecars for a manifest (``rec_id, filename, code, other_labels``): ``id, file, tag, state, tracks, other_tags``.

    ``codes`` has ``code, label``, a label per code. Rows whose own code has no label are left out; other codes
    without one have a null label. Order and repeats of the other codes are kept.
    """
    own = manifest.join(codes.select("code", "label"), "code")
    others = manifest.select("rec_id", "filename", F.posexplode("other_labels").alias("_i", "_code"))
    named = others.join(codes.select(F.col("code").alias("_code"), F.col("label").alias("_label")), "_code", "left")
    tag = lambda what, code: F.struct(F.lit(False).alias("automatic"), F.col(what).alias("what"), F.col(code).alias("ebird_id"))
    lists = named.groupBy("rec_id", "filename").agg(F.array_sort(F.collect_list(F.struct("_i", tag("_label", "_code").alias("tag"))))["tag"].alias("other_tags"))
    out = own.join(lists, ["rec_id", "filename"], "left").withColumn("tag", tag("label", "code"))
    track = F.struct(F.concat(F.col("rec_id").cast("string"), F.lit("_1")).alias("id"), F.lit(0.0).alias("start"), F.array("tag").alias("tags"))
    none = F.array().cast(named.select(F.array(tag("_label", "_code"))).schema[0].dataType)
    return out.select(F.col("rec_id").alias("id"), F.col("filename").alias("file"), "tag", F.lit("initial").alias("state"), F.array(track).alias("tracks"), F.coalesce("other_tags", none).alias("other_tags"))


def bounds_from_manifest(recordings: DataFrame, manifest: DataFrame) -> DataFrame:
    """Recordings (``rec_id, file``) whose folder and stem the manifest (``filename, start, end``) lists, with its bounds; of repeated names the last start."""
    key = lambda c: F.regexp_extract(c, r"([^/]+/[^/]+?)(\.[^./]*)?$", 1)
    listed = manifest.groupBy(key(F.col("filename")).alias("_key")).agg(F.max(F.struct("start", "end")).alias("_b"))
    return recordings.withColumn("_key", key(F.col("file"))).join(listed, "_key").select(*recordings.columns, F.col("_b.start").alias("start"), F.col("_b.end").alias("end"))


def export_names(labels: DataFrame, codes: DataFrame, names: DataFrame) -> DataFrame:
    """``label_i, label, code, name`` of a label set (``label_i, label``): the name under which it is exported, else the label itself.

    ``codes`` has ``label, code``, ``names`` has ``code, name``; of several names the smallest.
    """
    one = names.groupBy("code").agg(F.min("name").alias("name"))
    c = codes.groupBy("label").agg(F.min("code").alias("code"))
    out = labels.join(c, "label", "left").join(one, "code", "left")
    return out.select("label_i", "label", "code", F.coalesce("name", "label").alias("name"))
