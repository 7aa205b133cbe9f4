"""Secret scans: patterns, and Markov models of random strings against ordinary identifiers; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.functions.arrays import let
from wavegrid.llm.common import materialize, refuse_reserved

#: The patterns, in the order in which kinds are listed, and the least length of the group that counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEYWORD = r"(?i)password|passwd|secret|token|api_?key"
KINDS = ("assign", "access", "hex", "markov")
LEAST_ASSIGNED = 6

#: Characters of a token. Symbol 0 is its beginning, others are numbered as they stand here.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
TOKEN = "[A-Za-z0-9+/_-]"
STATES = len(ALPHABET) + 1
SPAN = "array<struct<start:long,kind:int,end:long,value:string>>"


def _places(text: Column, pattern: str, value: int, block: int = 256) -> Column:
    """Matches of a pattern, left to right, as structs of code points: ``start, end`` and the ``value`` group.

    Lengths of what stands between matches are summed up block by block, as appending copies what is there.
    """
    whole, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    between = F.split(text, pattern, -1)
    steps = F.transform(F.arrays_zip(between.alias("gap"), whole.alias("hit"), values.alias("value")), lambda s: F.struct(F.length(s["gap"]).cast("long").alias("gap"), F.length(s["hit"]).cast("long").alias("size"), s["value"].alias("value")))
    steps = F.filter(steps, lambda s: s["size"].isNotNull())  # after the last match is one more gap
    kind = "array<struct<start:long,end:long,value:string>>"

    def one(state: Column, s: Column) -> Column:
        start = state["at"] + s["gap"]
        return F.struct((start + s["size"]).alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), (start + s["size"]).alias("end"), s["value"].alias("value"))).alias("out"))

    def add(state: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(state["at"].alias("at"), F.array().cast(kind).alias("out")), one)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(state["out"], d["out"]).alias("out")))

    def runs(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(all_), F.lit(block)), lambda p: F.slice(all_, p, block))
        return F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out")), add, lambda s: F.flatten(s["out"]))

    return let(steps, lambda a: F.when(F.size(a) > 0, runs(a)).otherwise(F.array().cast(kind)))


def _spans(text: Column, kind: str, pattern: str, hint: Column, least: int = 1, value: int = 0) -> Column:
    found = let(_places(text, pattern, value), lambda m: F.filter(m, lambda s: F.length(s["value"]) >= least))
    number = F.lit(KINDS.index(kind))
    made = F.transform(found, lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.when(hint, made.cast(SPAN)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each pattern. Runs of too few characters can't begin anew inside themselves, so the least length stands in the pattern; not for
    ``assign``, where a value that is too short still uses up its characters.
    """
    return {
        "assign": _spans(text, "assign", ASSIGN, text.rlike(KEYWORD), LEAST_ASSIGNED, 2),
        "access": _spans(text, "access", ACCESS, text.contains("AKIA")),
        "hex": _spans(text, "hex", HEX, text.rlike(HEX)),
    }


def _unassigned(text: Column) -> Column:
    """The text with blanks in the place of every assignment, of the same length."""
    gaps, hits = F.split(text, ASSIGN, -1), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))
    masked = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")), lambda s: F.concat(s["g"], F.coalesce(F.repeat(F.lit(" "), F.length(s["h"])), F.lit("")))), "")
    return F.when(text.rlike(KEYWORD), masked).otherwise(text)


def _fresh(token: Column) -> Column:
    """Whether a token holds none of the other kinds."""
    return ~(token.contains("AKIA") & token.rlike(ACCESS)) & ~token.rlike(HEX)


def _steps(token: Column) -> Column:
    """Places in the weights of each character of a token after the one before it."""
    symbols = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(symbols, lambda a: F.zip_with(F.slice(F.concat(F.array(F.lit(0)), a), 1, F.size(a)), a, lambda p, q: p * STATES + q))


def labelled_samples(docs: DataFrame, least: int = 8) -> DataFrame:
    """``token, secret``: every distinct token of ``least`` characters once. Values that patterns find are secrets, tokens elsewhere ordinary identifiers.

    What stands among both counts as a secret.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base_spans(text)
    values = F.transform(F.concat(*base.values()), lambda s: s["value"])
    found = F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(TOKEN + f"{{{least},}}"), F.lit(0))))
    plain = F.filter(F.regexp_extract_all(_unassigned(text), F.lit(TOKEN + f"{{{least},}}"), F.lit(0)), _fresh)
    mark = lambda a, yes: F.transform(F.array_distinct(a), lambda t: F.struct(t.alias("token"), F.lit(yes).alias("secret")))
    every = docs.select(F.explode(F.concat(mark(found, True), mark(plain, False))).alias("s"))
    return every.groupBy("s.token").agg(F.max("s.secret").alias("secret"))


def fit(samples: DataFrame, uniform: float = 0.5, add: float = 0.5) -> DataFrame:
    """One row: ``weights``, the log-likelihood ratio of each character after each other one, random strings against identifiers.

    ``samples`` has ``token`` and ``secret``; rows with either null are left out. Transitions of identifiers are smoothed by
    ``add``, those of random strings in addition by a share ``uniform`` of the uniform distribution. Without samples of a class
    its distribution is uniform. The table has as many rows as there are pairs of symbols.
    """
    steps = samples.where("token is not null and secret is not null").select("secret", F.explode(_steps(F.col("token"))).alias("step"))
    counts = steps.groupBy("step").agg(F.count_if("secret").alias("n1"), F.count_if(~F.col("secret")).alias("n0"))
    every = samples.sparkSession.range(STATES * STATES).select(F.col("id").cast("int").alias("step")).where(F.col("step") % STATES > 0)
    table = every.join(counts, "step", "left").select("step", F.expr(f"step div {STATES}").alias("before"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n1", "n0")])
    sums = table.groupBy("before").agg(F.sum("n1").alias("s1"), F.sum("n0").alias("s0"))
    k = len(ALPHABET)
    share = lambda n, s: (F.col(n) + add) / (F.col(s) + add * k)
    ratio = F.log((1 - uniform) * share("n1", "s1") + uniform / k) - F.log(share("n0", "s0"))
    rows = table.join(sums, "before").select("step", ratio.alias("w"))
    # places of symbol 0 after another are unused
    filler = samples.sparkSession.range(STATES).select((F.col("id") * STATES).cast("int").alias("step"), F.lit(0.0).alias("w"))
    kept = F.transform(F.array_sort(F.collect_list(F.struct("step", "w"))), lambda s: s["w"])
    return rows.unionByName(filler).agg(kept.alias("weights"))


def score(token: Column, weights: Column) -> Column:
    """Log-likelihood ratio of a whole token."""
    return let(weights, lambda w: F.aggregate(_steps(token), F.lit(0.0), lambda s, i: s + F.get(w, i)))


def find_secrets(docs: DataFrame, model: DataFrame, least: int = 16, min_ratio: float = 12.0, min_distinct: int = 8) -> DataFrame:
    """Adds ``assign, access, hex, markov``: arrays of ``start, kind, end, value``, in code points, of the whole text.

    The first three are matches of the patterns. ``markov`` has tokens of ``least`` characters, outside of those, whose
    log-likelihood ratio by ``model`` (of :func:`fit`) is at least ``min_ratio``, with ``min_distinct`` different
    characters: rows of one letter are rare, too, but no secrets. Everything is worked out in the row; no shuffle.

    A null text is empty and has no spans. Repeated rows are each scanned by themselves, other columns stay but for the
    four names, which are replaced. Empty tables give no rows. Texts of any length are scanned whole.
    """
    refuse_reserved(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    pattern = TOKEN + f"{{{least},}}"
    weights = F.col("__wg_weights")
    out = docs.withColumns(base_spans(text)).withColumn("__wg_weights", model.select("weights").scalar())

    def secret(s: Column) -> Column:
        varied = F.size(F.array_distinct(F.split(s["value"], ""))) >= min_distinct
        return _fresh(s["value"]) & varied & (score(s["value"], weights) >= min_ratio)

    found = let(_unassigned(text), lambda t: F.when(t.rlike(pattern), F.filter(_places(t, pattern, 0), secret)).otherwise(F.array().cast("array<struct<start:long,end:long,value:string>>")))
    number = F.lit(KINDS.index("markov"))
    kept = F.transform(found, lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return out.withColumn("markov", kept).drop("__wg_weights")


def listed(*spans: Column) -> Column:
    """``kind:start:end`` of all spans, by start and then kind as listed, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.transform(F.concat(*spans), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_model(docs: DataFrame) -> DataFrame:
    """Fitted on all documents, written."""
    return materialize(fit(materialize(labelled_samples(docs), "secret-samples")), "secret-model")
