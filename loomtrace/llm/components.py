"""Connected components of a graph of pairs, by tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """(v, label): for each end of the pairs (a, b), the smallest end that it reaches.

    Each round, a node takes the smallest label among its own and its neighbours',
    then the label of that label, so labels travel in doubling steps. Rounds are
    cut by written tables; minima are pre-aggregated, so a hot node moves few rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = stage(both.distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        near = labels.join(seen, "v").select("v", "label", F.least("label", "near").alias("near"))
        near = stage(near, "labels")
        jump = near.select(F.col("v").alias("near"), F.col("near").alias("far"))
        new = stage(near.join(jump, "near", "left").select("v", F.least("near", F.coalesce("far", "near")).alias("label"), (F.col("label") != F.least("near", F.coalesce("far", "near"))).alias("moved")), "labels")
        if not new.where("moved").limit(1).count():
            return new.select("v", "label")
        labels = new.select("v", "label")
