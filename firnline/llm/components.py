"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.staging import release, stage


def components(links: DataFrame) -> DataFrame:
    """`links` has a and b; returns v and label, the smallest vertex of v's component.

    Each pass takes the smallest label among a vertex and its neighbours and then follows the
    label's own label, so the distance to the smallest vertex shrinks by more than half. Labels
    are staged between passes; minima are combined before the shuffle, so a vertex with many links
    costs no more than others.
    """
    both = stage(
        links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    labels = stage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("label", "_near"), both["b"] == F.col("v"))
            .groupBy("a").agg(F.min("_near").alias("_near"))
        )
        lower = stage(
            labels.join(near, F.col("v") == F.col("a")).select(
                "v", F.least("label", "_near").alias("label"), F.col("label").alias("_old")
            )
        )
        of_label = lower.select(F.col("v").alias("_l"), F.col("label").alias("_jump"))
        jumped = stage(
            lower.join(of_label, F.col("label") == F.col("_l"), "left").select(
                "v", F.least("label", F.coalesce("_jump", "label")).alias("label"), "_old"
            )
        )
        release(links.sparkSession, labels, lower)
        labels = jumped.select("v", "label")
        if not jumped.where(F.col("label") != F.col("_old")).limit(1).count():
            release(links.sparkSession, both)
            return labels
