"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    return both.join(_least(both), F.col("u") == F.col("at")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    least = _least(down)
    moved = down.join(least, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("at").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node with a link; component is the least node reachable.

    links: u, v (long). Each round groups and joins by node and is written to the
    scratch folder; a node with very many links only ever sends its least
    neighbour. Ends when a round changes nothing.
    """
    now, told, turn = scratch.save(links.select("u", "v").filter("u <> v").distinct(), f"{name}-0"), None, 0
    while True:
        turn += 1
        now = scratch.save(_small_star(_large_star(now)), f"{name}-{turn}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if turn > 1:
            scratch.drop(f"{name}-{turn - 2}")
        if state == told:
            break
        told = state
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return scratch.save(leaves.unionByName(leaves.select(F.col("component").alias("node"), "component")).distinct(), f"{name}-of")
