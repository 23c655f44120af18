"""Connected components of a link table, as Spark joins (alternating large and small stars).

Each round joins and groups the links once and is written to the shared folder, so lineage
stays short and nothing but a count of changed links reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import staged


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step: link a node's (larger or smaller) neighbours to its smallest one."""
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:       # neighbours above the node
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:           # neighbours below it, and the node itself
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            joined.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (columns a, b); component: smallest node.

    Links of a node with itself and repeated links are harmless; an empty table gives none.
    """
    now = staged(links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        now = staged(_star(_star(now, True), False), "links")
        # the rounds are over when every node points to one smaller node that points nowhere
        seen = now.agg(F.count(F.lit(1)), F.count_distinct("a"),
                       F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.groupBy("a").agg(F.min("b").alias("component"))
    return roots.select(F.col("a").alias("node"), "component").union(
        roots.select(F.col("component").alias("node"), "component").distinct())
