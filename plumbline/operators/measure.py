"""Measures of pipes: what is drawn and bridged, less what lies in hatching or is counted for a twin; heights from levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds of intervals along a run, and what the sheet itself has settled about its scale.
DRAWN, BRIDGED, HATCHED, TWIN = "drawn", "bridged", "hatched", "twin"
SETTLED = ("VERIFIED", "TEXT_ONLY", "BAR_ONLY")
#: What a row is called that is measured under another scale.
UNSETTLED = {"CONFLICT": "SCALE_UNSETTLED", "FROM_THE_SET": "SCALE_FROM_THE_SET", "GIVEN_BY_HAND": "SCALE_GIVEN_BY_HAND"}


def swept(intervals: DataFrame, by: list[str]) -> DataFrame:
    """(by, inked, open, hatched, twin): lengths by a sweep over the ends of intervals (by, run, kind, lo, hi) on each run's axis.

    inked: drawn or bridged; hatched: inked within a hatch; twin: inked, outside hatches, beside the first edge of a double
    line; open: the rest of it. Intervals of a kind may overlap, each place counts once. One sort by run, four running sums.
    """
    kinds = (DRAWN, BRIDGED, HATCHED, TWIN)
    steps = F.array(*[F.struct(F.least("lo", "hi").alias("at"), F.lit(1).alias("way")), F.struct(F.greatest("lo", "hi").alias("at"), F.lit(-1).alias("way"))])
    ends = intervals.where("lo <> hi").select(*by, "run", "kind", F.explode(steps).alias("s")).groupBy(*by, "run", F.col("s.at").alias("at")).agg(*[F.sum(F.when(F.col("kind") == k, F.col("s.way")).otherwise(0)).alias(k) for k in kinds])
    w = W.partitionBy(*by, "run").orderBy("at")
    ends = ends.select(*by, "at", (F.lead("at").over(w) - F.col("at")).alias("len"), *[(F.sum(k).over(w) > 0).alias(k) for k in kinds])
    inked = F.col(DRAWN) | F.col(BRIDGED)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("len"))), F.lit(0))
    return ends.groupBy(*by).agg(total(inked).alias("inked"), total(inked & ~F.col(HATCHED) & ~F.col(TWIN)).alias("open"), total(inked & F.col(HATCHED)).alias("hatched"), total(inked & ~F.col(HATCHED) & F.col(TWIN)).alias("twin"))


def heights(levels: DataFrame, by: list[str]) -> DataFrame:
    """(by, tag, height): of levels (by, tag, value, unit) the first tag with two different values in one known unit; the span of its values in metres.

    A tag whose levels are in two units or in none says nothing; a run that passes a level twice is not claimed to.
    """
    tags = levels.groupBy(*by, "tag").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_distinct("unit").alias("units"), F.count_if(F.col("unit").isNull()).alias("unknown"), F.min("unit").alias("unit"))
    good = tags.where("lo < hi AND units = 1 AND unknown = 0")
    height = F.round((F.col("hi") - F.col("lo")) / F.when(F.col("unit") == "mm", 1000.0).otherwise(1.0), 3)
    return good.groupBy(*by).agg(F.min(F.struct("tag", height.alias("height"))).alias("t")).select(*by, "t.tag", "t.height")


def measured(intervals: DataFrame, scales: DataFrame, levels: DataFrame, by: list[str], sheet: str) -> DataFrame:
    """Each pipe's lengths in points and metres, its height, total and state.

    scales: (sheet, scale_state, m_per_pt). NO_SCALE: there is no metre; IN_HATCHED_AREA: nothing of it is open; a scale that is not the sheet's own
    gives its name to the row; else CONFIRMED. `sheet` is one of `by`.
    """
    m = swept(intervals, by).join(scales.select(sheet, "scale_state", "m_per_pt"), sheet, "left").join(heights(levels, by), by, "left")
    known = F.col("scale_state").isin(*SETTLED, *UNSETTLED)
    scale = F.when(known, F.col("m_per_pt"))
    other = F.coalesce(*[F.when(F.col("scale_state") == k, v) for k, v in UNSETTLED.items()], F.lit("CONFIRMED"))
    horizontal = F.round(F.col("open") * scale, 3)
    return m.select(
        *by, "inked", "open", "hatched", "twin", horizontal.alias("horizontal_m"), F.col("height").alias("vertical_m"), F.col("tag").alias("level_tag"),
        F.round(F.round(F.col("open") * scale, 3) + F.coalesce("height", F.lit(0.0)), 3).alias("total_m"),
        F.when(scale.isNull(), "NO_SCALE").when((F.col("open") <= 0) & (F.col("inked") > 0), "IN_HATCHED_AREA").otherwise(other).alias("state"),
    )
