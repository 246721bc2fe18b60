"""Percentiles and largest values of measured times, without bringing a group's values together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialise


def nearest_ranks(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``<group>`` and, for each named share q, sorted[min(n - 1, floor(n q))] of the group's values; nulls are none.

    Equal values are counted first, so a group of any size is as many rows as it has
    values. These are range-partitioned and counted up within their part; the sums of
    the parts before, one row each, are added.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    parted = materialise(counted.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "values")
    sums = parted.groupBy("g", "part").agg(F.sum("c").alias("s"))
    all_before = W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("g", "part", F.coalesce(F.sum("s").over(all_before), F.lit(0)).alias("before"), F.sum("s").over(W.partitionBy("g")).alias("n"))
    upto = F.sum("c").over(W.partitionBy("part", "g").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    placed = parted.withColumn("upto", upto).join(F.broadcast(sums), ["g", "part"]).withColumn("upto", F.col("upto") + F.col("before"))
    picked = []
    for name, q in shares.items():
        place = F.least(F.col("n"), F.floor(F.col("n") * F.lit(q)) + 1)
        picked.append(F.max(F.when((F.col("upto") >= place) & (F.col("upto") - F.col("c") < place), F.col("v"))).alias(name))
    return placed.groupBy("g").agg(*picked).withColumnRenamed("g", group)


def summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``<group>, n, total, least, most, p50, p95`` of the times of each group."""
    sums = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return sums.join(nearest_ranks(rows, group, value, {"p50": 0.5, "p95": 0.95}), group, "left")


def slowest(rows: DataFrame, value: str, tie: str, n: int = 5) -> DataFrame:
    """The `n` rows with the largest values."""
    return rows.orderBy(F.col(value).desc(), tie).limit(n)
