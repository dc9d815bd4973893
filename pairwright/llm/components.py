"""Connected components of a link table by alternating large-star and small-star.

Every round joins the links with the smallest neighbour of each node; both
sides of the join are plain tables, so a node with very many links is split by
the skew rule. Each round is cut by a checkpoint. Nothing but two numbers a
round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.session import checkpoint_root


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).checkpoint()


def _star(pairs: DataFrame, emit_self: bool) -> DataFrame:
    """Each v of (u, v) linked with u's smallest neighbour; (a, b) with a > b."""
    mins = _smallest(pairs).withColumn("m", F.least("u", "m"))
    out = pairs.join(mins, "u")
    if emit_self:
        own = mins.select(F.col("u").alias("a"), F.col("m").alias("b"))
        return out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own).where("a > b").distinct()
    return out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node reachable.

    Loops, nulls and repeated links are ignored; no links give no rows.
    """
    checkpoint_root(links.sparkSession)
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct().checkpoint()
    before = _state(links)
    while before[0]:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, emit_self=False)
        links = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")).checkpoint(), emit_self=True).checkpoint()
        after = _state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
