"""Connected components of a table of links, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import Stage


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b): root is the smallest id reachable.

    Each pass takes the smallest label among neighbours, then the label of that label,
    so chains shorten by half or more; the loop ends when no label changes. Labels are
    staged, so a lost executor costs one pass. No ids reach the driver.
    """
    ends = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "id"))
    while True:
        near = ends.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "root", F.least("root", "near").alias("low"))
        lower = stage(lower)
        jump = labels.select(F.col("id").alias("low"), F.col("root").alias("next"))
        new = lower.join(jump, "low").select("id", F.least("low", "next").alias("root"), (F.least("low", "next") != F.col("root")).alias("moved"))
        new = stage(new)
        stage.drop(lower)
        stage.drop(labels)
        labels = new
        if not labels.filter("moved").limit(1).count():
            return labels.select("id", "root")
