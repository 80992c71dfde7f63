"""Shared pieces: written intermediate tables (as the whole library has them) and distributed components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import call, clear, forget, shared_dir, stash

__all__ = ["call", "clear", "connected_components", "forget", "shared_dir", "stash"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node id reachable from each node of ``edges`` (columns ``a``, ``b``).

    Alternates large-star and small-star steps on an edge table that is never
    larger than twice its start. Centres with very many neighbours only pass
    through partial aggregates and plain equi-joins, which adaptive execution
    splits. Returns ``(node, component)`` for nodes that have an edge; self
    loops and null ends are ignored; an empty table gives an empty result.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = stash(e)
    mark = None
    for _ in range(max_rounds):
        # large star: larger neighbours of u move to the least of u's neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        # small star: u and its smaller neighbours move to the least of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, stash(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        forget(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
