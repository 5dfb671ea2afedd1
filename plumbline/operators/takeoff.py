"""Quantities of runs: aggregation by identity, the journal behind it, disputes, conservation, coverage.

A run has an identity, a state (CONFIRMED, AMBIGUOUS or UNOWNED) and a measured length; sums are of whole units, so
they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_identity(runs: DataFrame, key: list[str], state: str, metres: str, sheet: str) -> DataFrame:
    """Per identity the metres of each state, runs, distinct sheets, and a state: what is confirmed decides first."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col(state) == s, F.col(metres))), F.lit(0))
    out = runs.groupBy(*key).agg(of("CONFIRMED").alias("confirmed"), of("AMBIGUOUS").alias("ambiguous"), of("UNOWNED").alias("unowned"), F.count("*").alias("runs"), F.countDistinct(sheet).alias("sheets"))
    return out.withColumn("state", F.when((F.col("confirmed") > 0) & (F.col("ambiguous") == 0), "CONFIRMED").when(F.col("confirmed") > 0, "PARTIAL").when(F.col("ambiguous") > 0, "AMBIGUOUS").otherwise("UNOWNED"))


def set_wide(rows: DataFrame, key: list[str], metres: str, sheet: str, ident: str) -> DataFrame:
    """Across sheets, with the sorted distinct sheets; null keys group together."""
    return rows.groupBy(*key).agg(F.sum(metres).alias("metres"), F.array_sort(F.collect_set(sheet)).alias("sheets"), F.countDistinct(ident).alias("pipes"))


def journal(claims: DataFrame, interval: list[str], owner: str, metres: str) -> DataFrame:
    """Claims with `counted`: an interval that one owner claims is counted for it, a disputed one for none."""
    n = F.size(F.collect_set(owner).over(W.partitionBy(*interval)))
    return claims.withColumn("owners", n).withColumn("counted", F.col("owners") == 1)


def disputes(claims: DataFrame, interval: list[str], owner: str) -> DataFrame:
    """Intervals with more than one owner, and the owners."""
    return claims.groupBy(*interval).agg(F.array_sort(F.collect_set(owner)).alias("alternatives")).where(F.size("alternatives") > 1)


def withheld(entries: DataFrame, identity: list[str], metres: str) -> DataFrame:
    """Per identity the confirmed metres, and those withheld because their interval is disputed."""
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col(metres))), F.lit(0))
    return entries.groupBy(*identity).agg(part(F.col("counted")).alias("confirmed"), part(~F.col("counted")).alias("ambiguous"), F.count("*").alias("entries"))


def conservation(runs: DataFrame, family: list[str], state: str, metres: str, ident: list[str]) -> DataFrame:
    """Per family whether confirmed, ambiguous and unowned metres make the total and no run is there twice."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col(state) == s, F.col(metres))), F.lit(0))
    once = runs.groupBy(*family, *ident).agg(F.count("*").alias("_k"), F.sum(F.when(F.col(state) == "CONFIRMED", F.col(metres))).alias("_c"), F.sum(F.when(F.col(state) == "AMBIGUOUS", F.col(metres))).alias("_a"), F.sum(F.when(F.col(state) == "UNOWNED", F.col(metres))).alias("_u"), F.sum(metres).alias("_m"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = once.groupBy(*family).agg(zero("_m").alias("total"), zero("_c").alias("confirmed"), zero("_a").alias("ambiguous"), zero("_u").alias("unowned"), F.sum((F.col("_k") > 1).cast("int")).alias("doubled"))
    return out.withColumn("holds", (F.col("total") == F.col("confirmed") + F.col("ambiguous") + F.col("unowned")) & (F.col("doubled") == 0))


def upper_median(values: Column) -> Column:
    """The element n div 2 of the sorted values, not an interpolated one."""
    s = F.sort_array(F.collect_list(values))
    return F.try_element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)


def weighted_median(df: DataFrame, key: list[str], value: str, weight: str) -> DataFrame:
    """The first value at which the running weight reaches half; weights are summed per value before the window."""
    per = df.groupBy(*key, value).agg(F.sum(weight).alias("_w"))
    w = W.partitionBy(*key)
    run = per.withColumn("_run", F.sum("_w").over(w.orderBy(value))).withColumn("_all", F.sum("_w").over(w))
    return run.where(F.col("_run") * 2 >= F.col("_all")).groupBy(*key).agg(F.min(value).alias(value), F.first("_all").alias("total"))


def modes(df: DataFrame, key: list[str], value: str, share: float, most: int) -> DataFrame:
    """Values that make up at least `share` of their key's rows, at most `most` of them, most common first, then least."""
    per = df.groupBy(*key, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*key)
    ranked = per.withColumn("_all", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), value)))
    return ranked.where((F.col("n") >= F.col("_all") * share) & (F.col("rank") <= most)).drop("_all")
