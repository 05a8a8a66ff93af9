"""Connected components of a link table, on Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import join_unique, materialize


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _round(links: DataFrame, n: int) -> DataFrame:
    """One large-star and one small-star step; links are ``n`` materialised rows (u, v) with u > v."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = (join_unique(both, _lowest(both), "u", rows=2 * n).filter(F.col("v") > F.col("u"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    large = materialize(large.filter("u > v").distinct(), n)
    small = join_unique(large, _lowest(large), "u", rows=n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(small.unionByName(_lowest(large).select("u", F.col("m").alias("v")))
                       .filter("u > v").distinct(), n)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component = the smallest node reached.

    Alternates large-star and small-star steps until the links no longer
    change; then every node points at its component's smallest node.  Links of
    a node to itself and null ends are ignored; no links give an empty table.
    """
    now = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .distinct())
    mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        now = _round(now, mark[0])
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
