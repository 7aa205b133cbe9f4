"""Merkle manifests of a table: levels of parent-linked nodes, climbed by a recursive query that folds tampered leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.llm.common import ascii_lower, materialize, maybe_broadcast, partitions

#: Nodes that one parent holds.
FAN = 16
#: The tree over the subroots; those of the sources are numbered from 0.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def row_digest(columns: list[Column]) -> Column:
    """sha256 (32 bytes) of the columns one after another: ``-`` for null, else the byte count, ``:`` and the value as text."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[part(c.cast("string")) for c in columns]).cast("binary"), 256))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _digest_of(kids: Column) -> Column:
    """H of digests that stand one after another: of their hex text."""
    return F.unhex(F.sha2(_hex(kids).cast("binary"), 256))


def leaf_rows(docs: DataFrame, fields: tuple[str, ...] = FIELDS, text: str = "text", every: int = 5) -> DataFrame:
    """``doc_id, source, leaf, tampered`` (digests; ``tampered`` null where nothing changes) and ``pick``, which tells equal rows apart.

    Tampered are rows where ``every`` divides the crc32 of the id in decimals: A-Z of their text are lower-cased.
    """
    at = {f: docs[f"`{f}`"] for f in fields}
    leaf = row_digest([at[f] for f in fields])
    hit = F.coalesce(F.crc32(at["doc_id"].cast("string").cast("binary")) % every == 0, F.lit(False)) & at[text].rlike("[A-Z]")
    other = F.when(hit, row_digest([ascii_lower(at[f]) if f == text else at[f] for f in fields]))
    return docs.select(at["doc_id"].alias("doc_id"), at["source"].alias("source"), leaf.alias("leaf"), other.alias("tampered"), F.monotonically_increasing_id().alias("pick"))


def placed(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds ``tree`` (number of the group by ``by``, null first), ``pos`` (place in the group by ``order``, nulls first), ``n`` (its rows).

    Ranges of the order are sorted each in its task and numbered there; what is added up over tasks is a row for each
    range and group. ``order`` must tell all rows apart, so that a group of any size is cut into ranges.
    """
    ranged = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    ranged = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-ranges")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    runs = ranged.groupBy(F.col(by).alias("of"), part.alias("part")).agg(F.count("*").alias("rows"), F.min(inside).alias("first"))
    runs = materialize(runs, "merkle-runs")
    groups = materialize(_numbered(runs.groupBy("of").agg(F.sum("rows").alias("n"))), "merkle-groups")
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("shift", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first"))
    facts = offsets.alias("r").join(groups.alias("g"), F.expr("r.of <=> g.of")).select("r.of", "r.part", "r.shift", "g.tree", "g.n")
    facts = materialize(facts, "merkle-offsets")
    out = ranged.withColumn("part", part).withColumn("inside", inside).alias("x").join(maybe_broadcast(facts, 64).alias("f"), F.expr(f"x.part = f.part and x.`{by}` <=> f.of"))
    return out.select(*[f"x.{c}" for c in rows.columns], "f.tree", (F.col("x.inside") + F.col("f.shift")).alias("pos"), "f.n")


def _numbered(groups: DataFrame) -> DataFrame:
    """``of, n`` with ``tree``: places of the groups in order, null first, as sums over sorted ranges."""
    s = materialize(groups.repartitionByRange("of").sortWithinPartitions("of").withColumn("at", F.monotonically_increasing_id()), "merkle-names")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = s.groupBy(part.alias("p")).agg(F.count("*").alias("c"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = sizes.select("p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("shift"))
    return s.join(sizes, part == F.col("p")).select("of", "n", (inside + F.col("shift")).alias("tree"))


def _parents(nodes: DataFrame, level: int, more: list[str]) -> DataFrame:
    """Nodes of the next level from ``tree, pos, n, hash`` of trees with more than one: their children's digests in order (``kids``), what else is kept of each (``rows``)."""
    many = nodes.where("n > 1")
    got = many.groupBy("tree", F.expr(f"pos div {FAN}").alias("pos"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"))
    got = got.agg(F.array_sort(F.collect_list(F.struct("pos", "hash", *more))).alias("rows"))  # at most FAN rows
    kids = F.expr("cast(array_join(transform(rows, r -> hex(r.hash)), '') as string)")
    got = got.withColumn("kids", F.unhex(kids)).withColumn("hash", _digest_of(F.col("kids"))).withColumn("level", F.lit(level))
    return got if more else got.drop("rows")


def _tower(base: DataFrame, more: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels above ``base`` (written tables), and the last node of each tree: ``tree, level, pos, hash``."""
    levels, tops, at = [], [base.where("n = 1").select("tree", F.lit(0).alias("level"), "pos", "hash")], base
    while at.where("n > 1").limit(1).count():
        at = materialize(_parents(at, len(levels) + 1, [] if levels else more), f"merkle-{name}")
        levels.append(at)
        tops.append(at.where("n = 1").select("tree", "level", "pos", "hash"))
    return levels, reduce(DataFrame.unionByName, tops)


def _linked(nodes: DataFrame, trees: int) -> DataFrame:
    """Adds the parent of each node (``up_tree, up_level, up_pos``; null for the root) and the place in it.

    A tree's last node is a leaf of the tree over all subroots.
    """
    inner, to_top = F.col("n") > 1, (F.col("tree") != TOP) & F.lit(trees > 1)
    step = lambda a, b: F.when(inner, a).when(to_top, b)
    return nodes.withColumns(
        {
            "up_tree": step(F.col("tree"), F.lit(TOP).cast("long")),
            "up_level": step(F.col("level") + 1, F.lit(1)),
            "up_pos": step(F.expr(f"pos div {FAN}"), F.expr(f"tree div {FAN}")),
            "place": step(F.expr(f"cast(pos % {FAN} as int)"), F.expr(f"cast(tree % {FAN} as int)")),
        }
    )


#: Every row climbs with the up to FAN leaves that share their path: a step puts each one's digest in its place among
#: the parent's children and hashes anew, and appends the other children to the proof that they share.
CLIMB = f"""
WITH RECURSIVE climb(tree, run, folded, proof, up_tree, up_level, up_pos, place) AS (
  SELECT tree, run, folded, cast('' AS BINARY), up_tree, up_level, up_pos, place FROM {{starts}}
  UNION ALL
  SELECT c.tree, c.run,
    transform(c.folded, f -> unhex(sha2(cast(lower(hex(overlay(n.kids PLACING f FROM c.place * 32 + 1))) AS BINARY), 256))),
    concat(c.proof, substr(n.kids, 1, c.place * 32), substr(n.kids, c.place * 32 + 33)),
    n.up_tree, n.up_level, n.up_pos, n.place
  FROM climb c JOIN {{nodes}} n ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_pos = n.pos
)
SELECT tree, run, folded, proof FROM climb WHERE up_tree IS NULL LIMIT ALL"""


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, text: str = "text") -> DataFrame:
    """``doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row, with the proof itself (``proof``, digests on end).

    A tree of :data:`FAN` children a node for each source, and one over the sources' last nodes. All levels are written as
    rows linked to their parents; :data:`CLIMB` ascends from the runs of leaves to the root. Of a run's leaves each is
    folded by itself, while the proof above the run, the same for all of them, is carried once: proofs of single leaves,
    some 500 bytes a level, would be shuffled anew at every level.

    ``docs`` needs the columns ``fields``; others are ignored. Any of the columns may be null; a null source is a source
    of its own, the first; a null id comes first in its source and is never tampered. Equal ids follow each other by
    their leaves; of rows equal in all fields each is a leaf with a proof of its own. A table with one row has the leaf
    for its root and an empty proof. Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = materialize(leaf_rows(docs, fields, text), "merkle-leaves")
    leaves = placed(rows, "source", ["doc_id", "leaf", "pick"])
    leaves = materialize(leaves.withColumnRenamed("leaf", "hash").drop("pick"), "merkle-placed")
    levels, subroots = _tower(leaves, ["doc_id", "source", "tampered"], "levels")
    subroots = materialize(subroots, "merkle-subroots")
    trees = subroots.count()
    base = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), "hash")
    tops, last = _tower(base, [], "tops")
    root = last.select(_hex(F.col("hash")).alias("root")).scalar()
    wanted = ["tree", "level", "pos", "n", "kids"]
    single = leaves.where("n = 1")
    some = F.struct("pos", "hash", "doc_id", "source", "tampered")
    alone = single.select("tree", F.lit(0).alias("level"), "pos", "n", F.array(some).alias("rows"), F.col("hash").alias("kids"))
    runs = levels[0].select(*wanted, "rows").unionByName(alone) if levels else alone
    runs = _linked(runs, trees)
    inside = F.expr("transform(rows, (r, i) -> overlay(kids PLACING coalesce(r.tampered, r.hash) FROM i * 32 + 1))")
    first = F.when(F.col("level") == 0, inside).otherwise(F.transform(inside, _digest_of))
    starts = runs.select("tree", F.col("pos").alias("run"), first.alias("folded"), "up_tree", "up_level", "up_pos", "place")
    if levels or tops:
        nodes = reduce(DataFrame.unionByName, [x.select(*wanted) for x in [*levels[1:], *tops] or levels])
        nodes = maybe_broadcast(materialize(_linked(nodes, trees), "merkle-nodes"), 32 * FAN + 64)
        # the recursion's rows of all levels are read in as many tasks as its starts have partitions
        done = spark.sql(CLIMB, starts=starts.repartition(partitions(spark)), nodes=nodes)
    else:
        done = starts.withColumn("proof", F.lit(b""))
    ends = subroots.select(F.col("tree").alias("of_tree"), _hex(F.col("hash")).alias("subroot"))
    out = runs.alias("r").join(done.alias("d"), F.expr("r.tree = d.tree and r.pos = d.run"))
    out = out.select("r.tree", "r.kids", "d.folded", "d.proof", F.posexplode("r.rows").alias("i", "leaf"))
    out = out.join(maybe_broadcast(ends, 128), F.col("tree") == F.col("of_tree"))
    others = F.expr("concat(substr(kids, 1, i * 32), substr(kids, i * 32 + 33), proof)")
    out = out.select(
        F.col("leaf.doc_id").alias("doc_id"),
        F.col("leaf.source").alias("source"),
        _hex(F.col("leaf.hash")).alias("leaf"),
        "subroot",
        root.alias("root"),
        others.alias("proof"),
        _hex(F.get("folded", F.col("i"))).alias("folded_root"),
    )
    proved = out.withColumn("proof_sha256", F.sha2(_hex(F.col("proof")).cast("binary"), 256))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))
