"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a minimum per node and a join back; links, labels and components stay distributed, and the driver sees
one count and one checksum a round.  Each round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.staging import Stage


def _toward_minimum(links: DataFrame) -> DataFrame:
    """(u, v, m): every (u, v) with the smallest neighbour of u."""
    return links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u")


def connected_components(stage: Stage, links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, label) for every node that is not its component's smallest; label is the smallest."""
    now, _ = stage.put_counted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                               .filter("u != v").distinct(), "u", "v")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        near = _toward_minimum(large)
        small = near.select("u", F.col("m").alias("v")).union(near.filter("v != m").select("v", "m")).distinct()
        nxt, mark = stage.put_counted(small, "u", "v")
        stage.drop(now)
        now = nxt
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = mark


def joined_labels(stage: Stage, labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` after further links (a, b): only the labels that they join are walked again."""
    def of(col: str) -> DataFrame:
        return labels.select(F.col("node").alias(col), F.col("label").alias(f"l{col}"))

    ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    top = connected_components(stage, ends)
    lifted = labels.join(top.select(F.col("node").alias("label"), F.col("label").alias("higher")), "label", "left")
    return lifted.select("node", F.coalesce("higher", "label").alias("label")).unionByName(top)
