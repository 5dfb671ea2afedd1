"""Intervals: union length, islands, densest window, as-of and banded lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """Intervals merged where one begins no later than all before it end: (by, lo, hi)."""
    w = W.partitionBy(*by).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(F.col(lo) <= before, 0).otherwise(1))
    numbered = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy(*by, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def union_length(df: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    return islands(df, by, lo, hi).groupBy(*by).agg(F.sum(F.col(hi) - F.col(lo)).alias("covered"), F.count("*").alias("islands"))


def densest_window(df: DataFrame, by: list[str], x: str, width: float) -> DataFrame:
    """The start of the window [x, x + width] that holds most points; the leftmost of several."""
    w = W.partitionBy(*by).orderBy(x).rangeBetween(W.currentRow, width)
    counted = df.withColumn("_n", F.count("*").over(w))
    return counted.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(x).alias("x"))).alias("b")).select(*by, F.col("b.x").alias("start"), (-F.col("b.n")).alias("points"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, take: list[str]) -> DataFrame:
    """Each left row with the columns `take` of the right row that is last at or before it: one sort of both, no range join.

    Of right rows at the same time the one with the greatest `take` counts; right rows come before left ones.
    """
    taken = F.struct(F.col(at).alias("_at"), *take)
    both = left.withColumn("_side", F.lit(1)).withColumn("_taken", F.lit(None).cast(right.select(taken.alias("t")).schema["t"].dataType)).unionByName(right.select(*by, at, F.lit(0).alias("_side"), taken.alias("_taken")), allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy(at, "_side", "_taken").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn("_last", F.last("_taken", True).over(w)).where("_side = 1").select(*left.columns, *[F.col(f"_last.{c}").alias(c) for c in take])


def banded(df: DataFrame, bands: list[tuple[float, object]], key: str, name: str) -> DataFrame:
    """The value of the first band whose bound is at least the key; null above the last."""
    out = F.lit(None)
    for bound, value in sorted(bands, reverse=True):
        out = F.when(F.col(key) <= bound, F.lit(value)).otherwise(out)
    return df.withColumn(name, out)
