"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoplan.llm import scratch


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> id, component: every id that has a link, with the smallest id it can reach.

    Each round points all neighbours of a vertex at the smallest of them, first the larger ones, then the smaller ones;
    rounds grow with the logarithm of the longest chain. Minima are aggregated before the shuffle, the joins back are
    plain, so that adaptive execution can split a hub. Each round is a written table; only its count and check sum
    reach the driver.
    """
    spark = links.sparkSession
    e = scratch.written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = scratch.written(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        now = _state(new)
        scratch.removed(spark, e)
        e = new
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
