"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a grouped minimum and an equi-join, written to the shared folder; it ends when a
round changes no edge. Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namemine.llm.shared import stage_table
from namemine.session import never_broadcast


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with the smallest neighbour of u, itself included, as ``m``."""
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(never_broadcast(smallest), "u").withColumn("m", F.least("u", "m"))


def _star_round(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v), u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _to_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _to_smallest(large)
    hops = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hops.unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: two columns of one orderable type. Result: ``node, component`` (the smallest
    node of its component) for every node that has an edge to another one; a loop edge or a
    repeated edge changes nothing, and no edge gives no row."""
    u, v = edges.columns
    now = stage_table(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        after = stage_table(_star_round(now), "edges")
        then = _state(after)
        now = after
        if then == state:
            break
        state = then
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
