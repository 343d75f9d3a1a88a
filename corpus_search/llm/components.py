"""Connected components of a table of links, without ever leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_search.llm.tables import Stage


def components(stage: Stage, links: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node that each linked node is connected with.

    Every round gives a node the smallest label among its own and its neighbours', then the label of
    that label. Labels are aggregated in the tasks before they are shuffled, so that a node with
    many links is no hot key; a round is a written table.
    """
    ends = links.select(F.col("left").alias("node"), F.col("right").alias("other"))
    edges = stage.put(ends.unionAll(ends.select("other", "node").toDF("node", "other")).distinct(), f"edges_{name}")
    labels = edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component"))
    labels, turn = stage.put(labels, f"labels_{name}_0"), 0
    while True:
        turn += 1
        near = (
            edges.join(labels.toDF("other", "component"), "other")
            .groupBy("node")
            .agg(F.min("component").alias("near"))
        )
        better = labels.join(near, "node").select(
            "node", "component", F.least("component", "near").alias("goal")
        )
        jump = labels.toDF("goal", "beyond")
        after = better.join(jump, "goal", "left").select(
            "node", F.least("goal", F.coalesce("beyond", "goal")).alias("component"),
            (F.least("goal", F.coalesce("beyond", "goal")) != F.col("component")).alias("changed"),
        )
        after = stage.put(after, f"labels_{name}_{turn}")
        labels = after.select("node", "component")
        if after.filter("changed").isEmpty():
            return labels


def merged(stage: Stage, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """`labels` after further links. These are taken between the components so far, so that many
    links between the same two are one edge."""
    ends = links.select(F.explode(F.array("left", "right")).alias("node")).distinct()
    new = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    labels = stage.put(labels.select("node", "component").unionAll(new), f"known_{name}")
    between = (
        links.select("left", "right")
        .join(labels.toDF("left", "a"), "left")
        .join(labels.toDF("right", "b"), "right")
        .filter("a != b")
        .select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"))
        .distinct()
    )
    tops = components(stage, between, name).toDF("component", "top")
    joined = labels.join(tops, "component", "left")
    return stage.put(joined.select("node", F.coalesce("top", "component").alias("component")), f"merged_{name}")
