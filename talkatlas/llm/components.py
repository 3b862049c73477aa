"""Connected components of a distributed edge table, by alternating star contractions.

Large-star hangs every larger neighbour on a vertex's smallest one, small-star the
smaller ones; both keep components and soon leave stars around the smallest ids.
Neighbourhoods are only ever aggregated (min) and joined, never collected; each
round is written to the shared folder, so a lost executor repeats one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import store

MAX_ROUNDS = 60


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of edges (a, b) but each component's smallest; a != b."""
    e = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = _state(e)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = store(small, "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("v"), F.col("v").alias("component"))
