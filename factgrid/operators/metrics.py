"""Evaluation figures as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.records import number_rows
from .search import holding


def retrieval_quality(expected: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """``recall, mrr, n`` of ``expected (query_id, id)`` in ``ranked (query_id, id, rank)``."""
    hit = expected.join(ranked.where(F.col("rank") <= k), ["query_id", "id"], "left")
    return hit.agg(F.avg(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)).alias("recall"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n"))


def overlap(a: DataFrame, b: DataFrame, k: int = 5) -> DataFrame:
    """Share of common ids in the top ``k`` of two rankings, per query."""
    lists = [r.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("id").alias(n)) for r, n in ((a, "x"), (b, "y"))]
    return lists[0].join(lists[1], "query_id").select("query_id", (F.size(F.array_intersect("x", "y")) / k).alias("overlap"))


def latency(df: DataFrame, value: str) -> DataFrame:
    """``mean, median, p95, n``; p95 is the element at place floor(0.95 * (n - 1)) of the sorted values. No values, no row.

    Values are sorted by range, so that each has its place without one task
    seeing all of them; only those at the wanted places are read for a figure.
    """
    own = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    placed = number_rows(own.orderBy("v").withColumn("__at", F.monotonically_increasing_id()), "__at").withColumnRenamed("n", "place")
    one = placed.agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    last, at = F.col("n") - 1, F.col("place")
    low, high, far = F.floor(last / 2), F.ceil(last / 2), F.floor(F.lit(0.95) * last)
    few = placed.crossJoin(F.broadcast(one)).where(at.isin(low, high, far))  # one row
    out = few.groupBy("n", "mean").agg(F.avg(F.when(at.isin(low, high), F.col("v"))).alias("median"), F.max(F.when(at == far, F.col("v"))).alias("p95"))
    return out.select("mean", "median", "p95", "n")


def rates(df: DataFrame, flags: list[str]) -> DataFrame:
    """The share of true among the non-null values of each flag."""
    return df.agg(*[F.avg(F.col(f).cast("int")).alias(f) for f in flags])


def misses(judged: DataFrame) -> DataFrame:
    """Errors split by cause: ``retrieved`` and ``correct`` flags per question."""
    wrong = ~F.col("correct")
    return judged.agg(
        F.sum(wrong.cast("long")).alias("misses"),
        F.sum((wrong & ~F.col("retrieved")).cast("long")).alias("retrieval_misses"),
        F.sum((wrong & F.col("retrieved")).cast("long")).alias("extraction_failures"),
    )


def leaks(outputs: DataFrame, forbidden: DataFrame) -> DataFrame:
    """``query_id, value``: outputs (query_id, text) that hold a forbidden value (value), in any case."""
    named = forbidden.select("value", F.lower("value").alias("name")).where("name <> ''").distinct()
    return holding(outputs.select("query_id", F.lower("text").alias("q")), named, "query_id").join(named, "name").select("query_id", "value").distinct()
