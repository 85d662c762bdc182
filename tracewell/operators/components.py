"""Connected components of rows that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import big_join, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) of links (node, key): nodes that share a key, directly or through others.

    Labels are lowered in turns, over keys and over nodes, until none changes; both turns are partial
    aggregates, the labels of a round are stored, and only the number of changes reaches the driver.
    """
    links = materialise(links.select("node", "key").distinct(), "links")
    labels = materialise(links.select("node").distinct().withColumn("component", F.col("node")), "labels")
    while True:
        of_key = big_join(links, labels, "node").groupBy("key").agg(F.min("component").alias("c"))
        lowered = materialise(big_join(links, of_key, "key").groupBy("node").agg(F.min("c").alias("c")), "lowered")
        joined = big_join(labels, lowered, "node").select("node", F.least("component", "c").alias("component"), (F.col("c") < F.col("component")).alias("changed"))
        after = materialise(joined, "labels")
        labels = after.select("node", "component")
        if not after.filter("changed").limit(1).count():
            return labels
