"""Connected components of an edge table by min labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, looked_up

def components(edges: DataFrame) -> DataFrame:
    """id and label, the smallest id reachable, of every id in edges (a, b); edges from an id to itself give no row.

    A round gives each id the smallest label next to it and then that label's own label, so paths
    shorten by about half a round. Every round is kept in the checkpoint folder; only counts reach
    the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("label")))
    while True:
        # Many rows may ask for one id or one label.
        near = looked_up(both, "b", "a", labels, "id", "inner").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.id == near.a).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # A label that is its own needs no look-up.
        up = labels.filter("label <> id").select(F.col("id").alias("up"), F.col("label").alias("top"))
        after = cut(looked_up(lower, "label", "id", up, "up").select("id", "old", F.least("label", F.coalesce("top", "label")).alias("label")))
        if after.filter("label <> old").isEmpty():
            return after.select("id", "label")
        labels = after.select("id", "label")
