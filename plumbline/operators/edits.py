"""Replay of an edit log. A clamp at zero is not associative as a sum is, but as a function of the start it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clamped_fold(log: DataFrame, key: list[str], order: list[str], delta: str) -> DataFrame:
    """(key, metres, clamped, edits) after m = max(0, m + delta) over the log in order, from zero.

    After all edits m is the running sum less its least value so far (zero included), so two windows replace the loop.
    An edit was clamped where the running sum makes a new least below zero.
    """
    w = W.partitionBy(*key).orderBy(*order)
    run = log.withColumn("_sum", F.sum(delta).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    run = run.withColumn("_before", F.least(F.lit(0), F.min("_sum").over(w.rowsBetween(W.unboundedPreceding, -1)))).withColumn("_before", F.coalesce("_before", F.lit(0)))
    last = F.struct(*order)
    return run.groupBy(*key).agg(
        (F.max_by("_sum", last) - F.least(F.lit(0), F.min("_sum"))).alias("metres"),
        F.sum((F.col("_sum") < F.col("_before")).cast("int")).alias("clamped"),
        F.count("*").alias("edits"),
    )
