"""Connected components of a table of links, by alternating large and small stars.

Each round replaces links by links to smaller numbers without changing what is connected: a
large star ties every greater neighbour of a node to the node's least neighbour, a small star
does so for the lesser ones. It ends when each component is one star around its least node. No
links ever reach the driver, rounds are cut by tables in the shared folder, and a hub's least
neighbour is broadcast to its links (see ``lookup``), so stars around hot nodes don't gather in
one task. Rounds go on until nothing changes; their number grows with the logarithm of the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_folder, lookup, new_folder, written

def _state(links: DataFrame) -> tuple[int, int, int]:
    """Number of links and two exclusive-ors over them, which no number of links can overflow."""
    marks = [F.coalesce(F.bit_xor(F.xxhash64(F.lit(seed), "u", "v")), F.lit(0)) for seed in (1, 2)]
    return tuple(links.agg(F.count(F.lit(1)), *marks).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    found = lookup(both, least, ["u"], "n", F.col("v"))
    return found.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    found = lookup(links, least, ["u"], "n", F.col("v"))
    lesser = found.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lesser.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; the component is its least node."""
    links = links.filter(F.col(a) != F.col(b))
    spark = links.sparkSession
    at = new_folder(spark, "links")
    links = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links", at)
    state = _state(links)
    while state[0]:
        half, new = new_folder(spark, "links"), new_folder(spark, "links")
        links = written(_small_star(written(_large_star(links), "links", half)), "links", new)
        drop_folder(spark, at)
        drop_folder(spark, half)
        at, now = new, _state(links)
        if now == state:
            break
        state = now
    hubs = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs)
