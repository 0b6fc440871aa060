"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut

#: Links that a task of a round takes at least before more tasks than cores are used.
LINKS_A_TASK = 100_000


def components(links: DataFrame) -> DataFrame:
    """`node`, `label` of every node in links (`a`, `b`); the label is the least node it reaches.

    Each round takes the least label among a node's neighbours and then the label of that
    label, so long chains shorten by half. Every round is checkpointed; only the number of
    changes comes to the driver. Hubs are safe: neighbours' labels are minima, aggregated
    map-side, and the label table has one row for each node. Rounds over few links take no more
    tasks than there are cores, as starting one costs more than its rows; over many links they
    take all shuffle partitions.
    """
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, math.ceil(2 * links.count() / LINKS_A_TASK))
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct().coalesce(tasks))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).coalesce(tasks)
    labels = cut(least.select("node", F.least("node", "low").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")).coalesce(tasks)
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        moved = cut(lower.join(jump, "low").select("node", "old", F.least("low", "further").alias("label")).coalesce(tasks))
        if moved.where("old <> label").limit(1).count() == 0:
            return moved.select("node", "label")
        labels = moved.select("node", "label")
