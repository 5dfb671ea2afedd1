"""Choices that never break a tie by accident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given total order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def decided(df: DataFrame, key: list[str], value: str, weight: Column) -> DataFrame:
    """(key, state, value, candidates): CONFIRMED with the one heaviest value, or AMBIGUOUS with all that tie."""
    w = df.groupBy(*key, value).agg(weight.alias("_w"))
    top = w.withColumn("_top", F.max("_w").over(W.partitionBy(*key))).where("_w = _top")
    out = top.groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias("candidates"))
    return out.select(*key, F.when(F.size("candidates") == 1, "CONFIRMED").otherwise("AMBIGUOUS").alias("state"), F.when(F.size("candidates") == 1, F.col("candidates")[0]).alias(value), "candidates")


def one_to_one(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose a has no other b and whose b has no other a."""
    p = pairs.select(a, b).distinct()
    return p.withColumn("_a", F.count("*").over(W.partitionBy(a))).withColumn("_b", F.count("*").over(W.partitionBy(b))).where("_a = 1 AND _b = 1").select(a, b)


def top_k(df: DataFrame, key: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key with their place `rank`; the order must be total."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def thinned(df: DataFrame, key: list[str], most: int, *order: Column) -> DataFrame:
    """Of keys with more than `most` rows the rows floor(i * n / most), else all."""
    w = W.partitionBy(*key)
    r = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    slot = F.ceil(F.col("_i") * most / F.col("_n"))
    return r.where((F.col("_n") <= most) | ((slot < most) & (F.floor(slot * F.col("_n") / most) == F.col("_i")))).drop("_i", "_n")
