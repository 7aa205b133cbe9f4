"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.common import materialize, maybe_broadcast, partitions, tidy


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest one that these edges connect it to; smallest nodes have none."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_ = lo != hi
        if not open_.any():
            break
        np.minimum.at(label, hi[open_], lo[open_])
        while not np.array_equal(nxt := label[label], label):
            label = nxt
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _columns(batches, n: int) -> list[np.ndarray]:
    got = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(n)] for b in batches]
    return [np.concatenate(c) for c in zip(*got)] if got else [np.zeros(0, dtype=np.int64)] * n


def _edges(a: np.ndarray, b: np.ndarray):
    a, b = contract(a, b)
    tidy()
    if len(a):
        yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _smallest(u: np.ndarray, v: np.ndarray, with_self: bool) -> np.ndarray:
    """For each edge the smallest neighbour of its first node, or that node itself if it is smaller still."""
    order = np.argsort(u, kind="stable")
    s = u[order]
    start = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
    least = np.minimum.reduceat(v[order], start)
    out = np.empty(len(u), dtype=np.int64)
    out[order] = np.repeat(least, np.diff(np.append(start, len(u))))
    return np.minimum(out, u) if with_self else out


def _large(batches):
    """Larger neighbours of a node go to its smallest one; of a node in several parts that one comes along."""
    u, v, w = _columns(batches, 3)
    if len(u):
        m = np.minimum(_smallest(u, v, True), w)
        yield from _edges(v[v > u], m[v > u])


def _small(batches):
    """A node and its smaller neighbours go to the smallest."""
    u, v, w = _columns(batches, 3)
    if len(u):
        m = np.minimum(_smallest(u, v, False), w)
        yield from _edges(np.concatenate([u, v]), np.concatenate([m, m]))


def _stamp(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _by_node(edges: DataFrame, hub_edges: int) -> DataFrame:
    """``a, b, w`` dealt out by ``a``. Edges of a node that has more than ``hub_edges`` go to several tasks, with its smallest neighbour as ``w``."""
    degree = edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("w"))  # summed in each task first
    hubs = materialize(degree.where(F.col("n") > hub_edges), "cc-hubs")
    some = edges.join(maybe_broadcast(hubs, 32), "a", "left")
    part = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / hub_edges))).otherwise(F.lit(0).cast("long"))
    none = F.lit(2**63 - 1)
    return some.select("a", "b", F.coalesce("w", none).alias("w"), part.alias("part")).repartition(partitions(edges.sparkSession), "a", "part")


def connected_components(edges: DataFrame, hub_edges: int = 5_000) -> DataFrame:
    """``a, b`` (long) to ``node, component``: the smallest node each can reach. Nodes without edges are not listed.

    A round joins every node's larger neighbours to its smallest one, then its smaller ones: a shuffle each. What a task
    makes it contracts to edges to smallest nodes first. Rounds go on until nothing changes; their number grows with the
    logarithm of the number of nodes, and each ends in a written table. A node with more than ``hub_edges`` edges, and more
    than four tasks' even share of them, is dealt to several tasks.
    """
    kind, n = "a long, b long", partitions(edges.sparkSession)
    e = materialize(edges.select("a", "b").where("a <> b"), "cc-edges")
    stamp, now = None, _stamp(e)
    while now[0] and now != stamp:
        stamp = now
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("s")).select("s.a", "s.b")
        if now[0] > hub_edges:
            many = max(hub_edges, 4 * now[0] // n)
            large = materialize(_by_node(both, many).select("a", "b", "w").mapInArrow(_large, kind), "cc-large")
            small = _by_node(large, many).select("a", "b", "w").mapInArrow(_small, kind)
        else:
            alone = lambda x: x.withColumn("w", F.lit(2**63 - 1)).repartition(n, "a")
            small = alone(alone(both).mapInArrow(_large, kind)).mapInArrow(_small, kind)
        e = materialize(small, "cc-edges")
        now = _stamp(e)
    rooted = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component"))))
    return e.select(rooted.alias("s")).select("s.node", "s.component").distinct()
