"""Connected components of a link table, by hooking to the least neighbour and jumping over labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smsight.llm.frames import written


def components(links: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(``node``, ``label``) for every node of ``links`` (``a``, ``b``); the label is one node of the component.

    Every round a node takes the least label among itself and its neighbours, then the label of that label. Labels only
    fall, so the rounds end, after about as many as the logarithm of the longest chain. Each round is written to the
    shared folder; (by ``keep``); hot nodes are summed up on the map side first. Repeated links and links of a node with itself change
    nothing; an empty table gives an empty one.
    """
    edges = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = keep(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                     .select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("label", "near").alias("hook"), F.col("label").alias("old"))
        above = labels.select(F.col("node").alias("hook"), F.col("label").alias("jump"))
        step = keep(hooked.join(above, "hook").select(
            "node", F.least("hook", "jump").alias("label"), (F.least("hook", "jump") != F.col("old")).alias("moved")), "labels")
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            return labels
