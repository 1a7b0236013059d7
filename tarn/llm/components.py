"""Connected components by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import drop_stage, stage


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component. ``nodes``: node; ``edges``: a, b.

    Every round each node of the graph hooks onto its smallest lower neighbour, hooks are followed to their ends by
    doubling, and the graph shrinks to those ends: edges within one are gone, parallel ones fall together. So the
    work falls from round to round, also around nodes with very many edges. Only whether edges are left comes to the
    driver. Rounds are stored: a lost executor repeats one at most, and plans stay short.
    """
    labels = stage(nodes.select("node", F.col("node").alias("label")))
    links = _ordered(edges.select("a", "b"))
    while not links.isEmpty():
        ends = _followed(stage(links.groupBy("b").agg(F.min("a").alias("end")).withColumnRenamed("b", "of")))
        renamed = stage(labels.join(ends, F.col("label") == F.col("of"), "left").select("node", F.coalesce("end", "label").alias("label")))
        shorter = links
        for side in "ab":
            shorter = shorter.join(ends, F.col(side) == F.col("of"), "left").withColumn(side, F.coalesce("end", side)).select("a", "b")
        shorter = _ordered(shorter)
        for old in (labels, links, ends):
            drop_stage(old)
        labels, links = renamed, shorter
    drop_stage(links)
    return labels


def _ordered(edges: DataFrame) -> DataFrame:
    """Edges between different nodes, once each, the smaller node first."""
    different = edges.where(F.col("a") != F.col("b"))
    return stage(different.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _followed(hooks: DataFrame) -> DataFrame:
    """``of, end``: where the hooks that start at each node end. Hooks lead downwards, so they do end."""
    while True:
        further = hooks.select(F.col("of").alias("next"), F.col("end").alias("beyond"))
        doubled = stage(
            hooks.join(further, F.col("end") == F.col("next"), "left").select(
                "of", F.coalesce("beyond", "end").alias("end"), F.col("beyond").isNotNull().alias("moved")
            )
        )
        moved = not doubled.where("moved").isEmpty()
        drop_stage(hooks)
        hooks = doubled.select("of", "end")
        if not moved:
            return hooks
