"""URL filtering by a cascade of Bloom filters, in DataFrame operations only.

Every url has a few candidate keys: the host and its parent domains with as many labels as some rule's host,
each followed by the starts of its path that are as long as some rule's path. Whether a candidate is a listed
key is answered by a cascade: level 0 encodes the listed keys, level 1 those keys of the corpus that pass level
0 without being listed, level 2 the listed keys that pass level 1, and so on until no key is left over. Over
the corpus's whole key universe the answer is exact and needs no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.llm.common import ascii_lower, materialize, quoted, set_apart


@dataclass(frozen=True)
class Level:
    bits: bytes
    n_bits: int
    n_hashes: int
    seed: int


class TooLarge(ValueError):
    """A level would exceed ``max_bits``."""


def _positions(key: Column, n_bits: int, n_hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(n_bits)) for i in range(n_hashes)]


def _size(n: int, fpr: float, max_bits: int) -> tuple[int, int]:
    """Bits and hashes of a filter over ``n`` keys."""
    n_hashes = max(1, round(-math.log2(fpr)))
    n_bits = -(-max(64, math.ceil(n * n_hashes / math.log(2))) // 8) * 8
    if n_bits > max_bits:
        raise TooLarge(f"{n} keys need {n_bits} bits, over max_bits={max_bits}: use listed_by_join() for such lists")
    return n_bits, n_hashes


def _level(keys: DataFrame, n: int, fpr: float, seed: int, max_bits: int) -> Level:
    """A filter over ``key``; its size follows from the count of keys and is checked."""
    n_bits, n_hashes = _size(n, fpr, max_bits)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), n_bits, n_hashes, seed))).alias("p"))
    words = (
        at.groupBy(F.shiftright("p", 3).alias("byte"))
        .agg(F.bit_or(F.expr("shiftleft(1, cast(p & 7 as int))")).alias("v"))
        .collect()  # n_bits / 8 rows at most
    )
    bits = bytearray(n_bits // 8)
    for r in words:
        bits[r["byte"]] = r["v"]
    return Level(bytes(bits), n_bits, n_hashes, seed)


def _passes(key: Column, level: Level) -> Column:
    def bit(p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.lit(level.bits), (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.pow(F.lit(2), p.bitwiseAND(F.lit(7))).cast("int")) != 0

    return reduce(lambda a, b: a & b, [bit(p) for p in _positions(key, level.n_bits, level.n_hashes, level.seed)])


def contains(key: Column, levels: list[Level]) -> Column:
    """Whether the key is listed; exact for every key of the universe the cascade was built over."""
    out = F.lit(False)
    for i in reversed(range(len(levels))):
        out = _passes(key, levels[i]) & (F.lit(True) if i == len(levels) - 1 else ~out)
    return out


def build_cascade(listed: DataFrame, universe: DataFrame, fpr: float = 0.01, max_bits: int = 1 << 23, seed: int = 7) -> list[Level]:
    """Levels of the cascade for ``listed`` (a column ``key``) over ``universe`` (a column ``key``, repeats allowed).

    Nulls are no keys. An empty list has no levels: nothing is listed. The universe is read once; what passes the
    first level without being listed is written, and further levels choose from that. Each level's keys pass the levels
    before it, so sizes fall by the factor ``fpr`` with each pair of levels.
    """
    listed = listed.select("key").where("key is not null").distinct()
    levels: list[Level] = []
    kept, others = listed, None
    while n := kept.count():
        levels.append(_level(kept, n, fpr, seed + len(levels), max_bits))
        if others is None:
            others = universe.select("key").where(F.col("key").isNotNull() & _passes(F.col("key"), levels[0])).distinct().join(listed, "key", "left_anti")
            others = materialize(others, "url-false-positives")
        else:
            others = others.where(_passes(F.col("key"), levels[-1]))
        kept, others = others, kept
    return levels


def listed_by_join(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """The keys that are listed, by a shuffled semi join: the way beyond ``max_bits``."""
    return keys.join(listed.select("key").distinct(), "key", "left_semi")


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``; both are empty where the url is null or has no ``://``."""
    u = F.coalesce(F.col(quoted(url)), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = rest.substr(F.length(raw) + 1, F.length(rest) + 1)
    return pages.withColumn("host", ascii_lower(raw)).withColumn("path", F.regexp_extract(tail, r"^[^?#]*", 0))


def _candidates(rules: list[tuple[str, str, str]]) -> Column:
    """Candidate keys of a row with ``host`` and ``path``, the longest first."""
    labels = sorted({h.count(".") + 1 for _, h, _ in rules}, reverse=True)
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)
    parts = F.split("host", r"\.")
    out = []
    for n in labels:
        suffix = F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), "."))
        for m in lengths:
            out.append(F.concat(suffix, F.when(F.length("path") >= m, F.substring("path", 1, m))))
    known = F.filter(F.array(*out), lambda k: k.isNotNull())
    return F.reverse(F.array_sort(F.transform(known, lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))))


def _filter_by_join(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rule`` and ``verdict`` for rows with ``host`` and ``path``: the longest listed candidate of each distinct pair is joined back."""
    listed = pages.sparkSession.createDataFrame([(h + p, a == "block") for a, h, p in rules], "key string, blocked boolean")
    blocked = listed.groupBy("key").agg(F.max("blocked").alias("blocked"))
    asked = pages.select("host", "path").distinct().select("host", "path", F.explode(_candidates(rules)).alias("c")).select("host", "path", "c.n", F.col("c.k").alias("key"))
    hits = listed_by_join(asked, listed).groupBy("host", "path").agg(F.max(F.struct("n", "key"))["key"].alias("key")).join(blocked, "key")
    hits = hits.select(F.col("host").alias("__wg_host"), F.col("path").alias("__wg_path"), F.col("key").alias("__wg_hit"), F.col("blocked").alias("__wg_blocked"))
    out = pages.join(hits, F.expr("host = __wg_host and path = __wg_path"), "left")
    verdict = F.when(F.col("__wg_blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("rule", F.col("__wg_hit")).withColumn("verdict", verdict).drop("__wg_host", "__wg_path", "__wg_hit", "__wg_blocked")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", fpr: float = 0.01, max_bits: int = 1 << 23) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules`` are (action, host, path), the action ``block`` or ``allow``, the path starting with ``/``. A rule
    fits its host and all subdomains if the path starts with the rule's; the longest host and path wins. Without
    a fitting rule no listed key covers the url: ``rule`` is null and the verdict ``allow``. Null urls, urls
    without ``://`` and empty tables are allowed; repeated rows stay; other columns are kept, but columns
    of the four names are replaced. Where a level of the cascade would exceed ``max_bits``, candidate keys are
    looked up by shuffled joins instead.
    """
    spark: SparkSession = pages.sparkSession
    pages, named = set_apart(pages, {"__wg_url": url}, ["host", "path", "rule", "verdict"])
    pages = with_host_path(pages, "__wg_url")
    if not rules:
        return named(pages.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit("allow")))
    universe = pages.select("host", "path").distinct().select(F.explode(_candidates(rules)["k"]).alias("key"))
    cascades = {}
    try:
        for action in ("block", "allow"):
            keys = sorted({h + p for a, h, p in rules if a == action})
            _size(len(keys), fpr, max_bits)
            listed = spark.range(1).select(F.explode(F.array(*map(F.lit, keys)).cast("array<string>")).alias("key"))
            cascades[action] = build_cascade(listed, universe, fpr, max_bits)
    except TooLarge:
        return named(_filter_by_join(pages, rules))
    hits = F.filter(_candidates(rules), lambda c: contains(c["k"], cascades["block"]) | contains(c["k"], cascades["allow"]))
    out = pages.withColumn("__wg_hit", F.when(F.size(hits) > 0, F.element_at(hits, 1)["k"]))
    blocked = F.when(F.col("__wg_hit").isNotNull() & contains(F.col("__wg_hit"), cascades["block"]), F.lit("block")).otherwise(F.lit("allow"))
    return named(out.withColumn("rule", F.col("__wg_hit")).withColumn("verdict", blocked).drop("__wg_hit"))
