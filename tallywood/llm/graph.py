"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_spread, settle

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for every node of edges (a, b).

    Each round gives a node the smallest label among its own and its neighbours', then the
    label of that label (pointer jumping), until nothing changes; a chain of n nodes takes
    about log n rounds. Labels only fall, so a round that is computed again is no matter. The label
    of a large component is held by many nodes; its next label reaches them by a bounded broadcast.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), 2 * edges.count())
    most = both.count()
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), most)
    hubs = hot_keys(both, "b")
    for _ in range(MAX_ROUNDS):
        near = join_spread(both, labels.withColumnRenamed("node", "b"), "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = settle(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), most)
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next")).where("next <> label")
        after = settle(join_spread(lower, jump, "label").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), most)
        changed = after.where("label <> old").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
