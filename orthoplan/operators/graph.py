"""Connected components: within groups in one pass, or over a whole table of edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoplan.plans.tables import written


def components_by(edges: DataFrame, by: list[str]) -> DataFrame:
    """edges(by..., a, b) -> by..., id, component (the smallest id), each group in one task: a group is a sheet."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.select(*by).schema) + f", id {edges.schema['a'].dataType.simpleString()}, component {edges.schema['a'].dataType.simpleString()}"

    def unite(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in zip(pdf["a"], pdf["b"]):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
        return pd.DataFrame([(*key, x, find(x)) for x in list(parent)], columns=[*by, "id", "component"])

    return edges.groupBy(*by).applyInPandas(unite, schema)


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> id, component (the smallest id reachable), over a whole table.

    Every vertex is pointed at the smallest of its neighbours, first by its larger ones, then by its smaller ones, until
    nothing changes: a few rounds, that grow with the logarithm of the longest path. Each round is a written table; its
    count and check sum alone reach the driver. Single vertices come back as their own component.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    alone = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = state(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        up = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = written(down.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        before, seen = seen, state(e)
        if seen == before:
            break
    return alone.join(e.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))
