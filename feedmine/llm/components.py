"""Connected components of a table of links, by alternating large and small stars.

A large star links every greater neighbour of a node to the least node around it, a small star does
so for the lesser ones. The links turn into one star per component after about log(n) rounds.
Each round is written to the shared checkpoint folder, so a lost executor costs no earlier round;
nothing but a count and a sum of hashes reaches the driver, and the rounds end when a round
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmine.llm.common import materialize


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))


def _to_least(around: DataFrame) -> DataFrame:
    """``around`` (u, v) with ``m``, the least of u and all its v. A node with very many neighbours has one
    row on the other side of the join, so its own rows can be split over tasks."""
    least = around.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("w"), F.least("u", "least").alias("m"))
    return around.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def large_star(links: DataFrame) -> DataFrame:
    return _to_least(_both_ways(links)).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = _to_least(down)
    return (stars.select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(stars.select("u", "m")).where("a <> b").distinct())


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` for every node in ``links`` (a, b): the least node of its component."""
    links = materialize(links.where("a <> b"))
    state = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).cast("decimal(38,0)"))).first()
        if tuple(now) == state or now[0] == 0:
            break
        state = tuple(now)
        links = materialize(small_star(large_star(links)))
    leaves = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return leaves.union(leaves.select("root", "root").distinct())
