"""Statistics of search terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily(log: DataFrame, k: int) -> DataFrame:
    """day, term, n, rank: the k most frequent terms of each day; ties by term. ``log`` has ts and term."""
    counts = log.groupBy(F.to_date("ts").alias("day"), "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("day").orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
