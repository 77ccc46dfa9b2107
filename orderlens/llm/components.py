"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.session import keep


def _least(links: DataFrame) -> DataFrame:
    """(u, v) -> per u its smallest neighbour or itself, beside each link."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return links.join(least, "u")


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    out = _least(_both(links)).filter("v > u and v != m")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    held = _least(down.distinct())
    out = held.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        held.select("u", F.col("m").alias("v"))
    )
    return out.filter("u != v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every linked node with the smallest node it can reach.

    Each round is two aggregations and two joins of the link table with itself by
    node; a node with very many links is a hot join key, which the adaptive
    planner splits. Rounds grow with the logarithm of the longest path, and the
    links never outnumber the input. Links of a node to itself and null ends are
    ignored; a node without links does not appear.
    """
    now = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct()
    now, mark = keep(now), None
    while True:
        now = keep(_small_star(_large_star(now)))
        state = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == mark:
            break
        mark = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
