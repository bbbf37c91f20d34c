"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few, spread_join


def _stars(links: DataFrame, rows: int) -> DataFrame:
    """One large-star and one small-star step. Links run from the larger to the smaller node; each step links all
    neighbours of a node to the smallest of them. Minima are aggregated before they are shuffled and joined back, and a
    hub's links are split over many tasks, so that a hub is never gathered in one."""
    both = few(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * rows)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = spread_join(both, few(least, 2 * rows), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    large = few(large, rows)
    least = few(large.groupBy("u").agg(F.min("v").alias("m")), rows)
    small = few(spread_join(large, least, "u"), rows).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and comp, the smallest node that it is connected to, of each node with a link.

    Links to oneself, repeated links and links with a null end are ignored; without links there are no rows. The number of steps grows with the logarithm of the longest chain;
    after each, the table is written to the checkpoint folder."""
    now = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if new == mark or not new[0]:
            break
        mark = new
        now = cut(few(_stars(few(now, new[0]), new[0]), new[0]))
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
