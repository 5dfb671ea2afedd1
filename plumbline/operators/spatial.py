"""Spatial joins over a uniform grid: cells make an equi-join, an exact predicate decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.geometry import boxes_overlap

BOX = ("x0", "y0", "x1", "y1")


def _cells(df: DataFrame, cell: float, reach: float = 0.0) -> DataFrame:
    """A row for each grid cell that the row's box, widened by `reach`, touches."""
    place = lambda v: F.floor(v / cell)
    return (
        df.withColumn("_cx", F.explode(F.sequence(place(F.col("x0") - reach), place(F.col("x1") + reach))))
        .withColumn("_cy", F.explode(F.sequence(place(F.col("y0") - reach), place(F.col("y1") + reach))))
    )


def box_join(left: DataFrame, right: DataFrame, cell: float, by: tuple[str, ...] = (), reach: float = 0.0) -> DataFrame:
    """Pairs of rows whose closed boxes come within `reach` on both axes and agree in the columns `by`.

    Both sides have x0, y0, x1, y1; the right side's columns get the prefix r_. A pair that shares several cells is kept
    only in the one that holds the lower corner of what they share, so no distinct is needed after the join.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    rbox = [F.col(f"r_{c}") for c in BOX]
    place = lambda v: F.floor(v / cell)
    rc = r.withColumn("_cx", F.explode(F.sequence(place(rbox[0]), place(rbox[2])))).withColumn("_cy", F.explode(F.sequence(place(rbox[1]), place(rbox[3]))))
    on = (F.col("l._cx") == F.col("r._cx")) & (F.col("l._cy") == F.col("r._cy"))
    for c in by:
        on = on & (F.col(f"l.{c}") == F.col(f"r.r_{c}"))
    lbox = (F.col("x0") - reach, F.col("y0") - reach, F.col("x1") + reach, F.col("y1") + reach)
    home = (F.col("l._cx") == place(F.greatest(lbox[0], rbox[0]))) & (F.col("l._cy") == place(F.greatest(lbox[1], rbox[1])))
    return _cells(left, cell, reach).alias("l").join(rc.alias("r"), on).where(boxes_overlap(lbox, tuple(rbox)) & home).drop("_cx", "_cy")


def nearest(pairs: DataFrame, key: list[str], distance: Column, ties: list[str]) -> DataFrame:
    """Of each key's pairs those at the least distance, with `n_tied`; a tie is kept whole, never broken."""
    w = W.partitionBy(*key)
    d = pairs.withColumn("_d", distance)
    d = d.withColumn("_least", F.min("_d").over(w)).where(F.col("_d") == F.col("_least"))
    return d.withColumn("n_tied", F.count("*").over(w)).drop("_least").withColumnRenamed("_d", "distance")


def mutual(choices: DataFrame, a: str, b: str) -> DataFrame:
    """Choices (a names b) that are returned (b names a), each pair once."""
    back = choices.select(F.col(a).alias(b), F.col(b).alias(a))
    return choices.select(a, b).join(back, [a, b]).where(F.col(a) < F.col(b)).distinct()


#: Rows of one place that are joined in one go.
PACK = 256


def met_by_place(left: DataFrame, right: DataFrame, place: list[str]) -> DataFrame:
    """left joined with right on the columns `place`; the right rows of a crowded place are dealt into packs of PACK rows, so that its pairs fall into many tasks.

    What is shuffled is left's rows once a pack, a small part of the pairs.
    """
    packed = right.withColumn("_pack", F.floor((F.row_number().over(W.partitionBy(*place).orderBy(F.xxhash64(*right.columns))) - 1) / PACK))
    packs = right.groupBy(*place).agg(F.floor((F.count("*") - 1) / PACK).alias("_last"))
    asks = left.join(packs, place).withColumn("_pack", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last"))).drop("_last")
    return asks.join(packed, [*place, "_pack"]).drop("_pack")
