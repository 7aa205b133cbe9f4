"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.sources.scratch import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every node that has a link: the smallest node reachable.

    In each round a node takes the smallest label among its neighbours, and then that label's own label, so that chains are
    gone through in steps that double. Rounds go on until nothing changes; minima are taken partially before the shuffle, so a
    node of many links is no burden to one task. Links with a null end are none.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("nb")).where("node is not null and nb is not null")
    both = written(both.unionByName(both.select(F.col("nb").alias("node"), F.col("node").alias("nb"))).distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least(F.min("nb"), F.col("node")).alias("component")), "labels")
    while True:
        of_nb = labels.select(F.col("node").alias("nb"), F.col("component").alias("near"))
        least = both.join(of_nb, "nb").groupBy("node").agg(F.min("near").alias("near"))
        # a label's own node learns of smaller labels, too
        told = labels.join(least, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        told = written(told, "labels")
        hooks = told.where("component < old").groupBy(F.col("old").alias("node")).agg(F.min("component").alias("hook"))
        hooked = told.join(hooks, "node", "left").select("node", "old", F.coalesce(F.least("component", "hook"), "component").alias("component"))
        hooked = written(hooked, "labels")
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = written(hooked.join(up, "component", "left").select("node", "old", F.coalesce("next", "component").alias("component")), "labels")
        if not new.where("component <> old").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")
