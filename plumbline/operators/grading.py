"""Grading of answers against their keys: numbers within a tolerance, parts, sets, orders, drawn lengths. Scores are from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.text import number

#: Of a length that is off: the score is nothing at so many tolerances.
FADES = 5


def within(given: Column, want: Column, tolerance: Column) -> Column:
    """Whether a number is right within a share of what is wanted; of a wanted 0 within the tolerance itself."""
    return F.when(want == 0, F.abs(given) <= F.greatest(tolerance, F.lit(0.0001))).otherwise(F.abs(given - want) / F.abs(want) <= tolerance)


def parts(given: DataFrame, key: DataFrame, by: list[str], numeric: bool = False) -> DataFrame:
    """(by, attempt, score, passed, wrong): the share of the key's parts that are right, for choices, pairs, buckets, steps and rooms.

    key: by, part, value, and with `numeric` tolerance; given: by, attempt, part, value. Numbers may be written with a decimal comma. What the
    key does not ask for counts nothing; a key without parts grades nobody, an attempt at it has no row.
    """
    tries = given.select(*by, "attempt").distinct()
    asked = tries.join(key.withColumnRenamed("value", "want"), by)
    both = asked.join(given.select(*by, "attempt", "part", "value"), [*by, "attempt", "part"], "left")
    right = F.coalesce(within(number(F.col("value")), number(F.col("want")), F.col("tolerance")) if numeric else F.col("value") == F.col("want"), F.lit(False))
    g = both.withColumn("right", right).groupBy(*by, "attempt").agg(F.count_if("right").alias("hits"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(~F.col("right"), F.col("part")))).alias("wrong"))
    return g.select(*by, "attempt", (F.col("hits") / F.col("n")).alias("score"), (F.col("hits") == F.col("n")).alias("passed"), "wrong")


def sets(given: DataFrame, key: DataFrame, by: list[str], least: float = 1.0) -> DataFrame:
    """(by, attempt, score, passed, missed, extra): what is both chosen and right, of what is either; given: by, attempt, item, key: by, item."""
    tries = given.select(*by, "attempt").distinct()
    want = tries.join(key.select(*by, "item").distinct(), by).withColumn("wanted", F.lit(True))
    got = given.where("item IS NOT NULL").select(*by, "attempt", "item").distinct().withColumn("chosen", F.lit(True))
    both = want.join(got, [*by, "attempt", "item"], "full")
    g = both.groupBy(*by, "attempt").agg(F.count_if(F.col("wanted") & F.col("chosen")).alias("hits"), F.count("*").alias("n"), F.count_if(F.col("chosen").isNull()).alias("missed"), F.count_if(F.col("wanted").isNull()).alias("extra"))
    return g.select(*by, "attempt", (F.col("hits") / F.col("n")).alias("score"), (F.col("hits") >= least * F.col("n")).alias("passed"), "missed", "extra")


def orders(given: DataFrame, key: DataFrame, by: list[str]) -> DataFrame:
    """(by, attempt, score, passed): the share of the key's neighbours that stand one after the other in the answer; passed if it is the same from end to end.

    given: by, attempt, place, item; key: by, place, item.
    """
    w = lambda *c: W.partitionBy(*by, *c).orderBy("place")
    next_to = lambda d, *c: d.select(*by, *c, "item", F.lead("item").over(w(*c)).alias("next"), F.row_number().over(w(*c)).alias("n"))
    want, got = next_to(key), next_to(given, "attempt")
    tries = given.select(*by, "attempt").distinct()
    pairs = tries.join(want.where("next IS NOT NULL").select(*by, "item", "next").distinct(), by)
    found = got.where("next IS NOT NULL").select(*by, "attempt", "item", "next").distinct().withColumn("there", F.lit(True))
    share = pairs.join(found, [*by, "attempt", "item", "next"], "left").groupBy(*by, "attempt").agg((F.count_if("there") / F.count("*")).alias("share"))
    same = tries.join(want.select(*by, "n", "item"), by).join(got.select(*by, "attempt", "n", F.col("item").alias("own")), [*by, "attempt", "n"], "full").groupBy(*by, "attempt").agg(F.bool_and(F.coalesce(F.col("item") == F.col("own"), F.lit(False))).alias("passed"))
    return tries.join(share, [*by, "attempt"], "left").join(same, [*by, "attempt"], "left").select(*by, "attempt", F.coalesce("share", F.lit(1.0)).alias("score"), "passed")


def lengths(runs: DataFrame, key: DataFrame, by: list[str]) -> DataFrame:
    """(by, attempt, metres, score, passed): drawn polylines, summed in the key's scale, against the wanted metres.

    runs: by, attempt, run, place, x, y; key: by, metres, m_per_unit, tolerance. Full marks within the tolerance, then less with the distance, none at FADES tolerances.
    """
    w = W.partitionBy(*by, "attempt", "run").orderBy("place")
    leg = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    drawn = runs.withColumn("leg", leg).groupBy(*by, "attempt").agg(F.sum("leg").alias("units"))
    g = drawn.join(key.withColumnRenamed("metres", "want"), by).withColumn("metres", F.col("units") * F.col("m_per_unit"))
    off = F.when(F.col("want") == 0, 0.0).otherwise(F.abs(F.col("metres") - F.col("want")) / F.abs("want"))
    ok = within(F.col("metres"), F.col("want"), F.col("tolerance"))
    return g.select(*by, "attempt", F.round("metres", 6).alias("metres"), F.round(F.when(ok, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - off / (F.col("tolerance") * FADES))), 6).alias("score"), ok.alias("passed"))
