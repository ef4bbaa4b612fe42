"""Connected components of a graph of links, by alternating large and small stars.

Every round is a pair of grouped minima and joins; the minima and the links of a round are written to the shared folder,
so that lineage stays short, lost executors cost one round at most, and Spark splits a node with most of the links
(both sides of the join are read, none is an aggregate). Nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the next links, the written minima they read)."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), least


def _small(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    return down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct(), least


def components(links: DataFrame) -> DataFrame:
    """links: (u, v), both of one orderable type, in any direction, repeats and loops allowed.

    Returns (node, root) of every node that has a link to another node; root is the least node of its component.
    """
    now = written(links.select("u", "v").filter("u <> v").distinct(), "links")
    mark = _mark(now)
    while True:
        for star in (_large, _small):
            links, least = star(now)
            after = written(links, "links")
            drop(now)
            drop(least)
            now = after
        after = _mark(now)
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
