"""Bundles: stacked labels over parallel runs, settled by what all bundles of a sheet allow together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.rounds import until_still
from plumbline.sources.shared import stored


def _narrowed(d: DataFrame, members: DataFrame) -> DataFrame:
    """One round of both rules, all read from the snapshot d (piece, system).

    A piece that can only be one system takes it from the others of each of its bundles; a system that only one piece of
    a bundle can be belongs to that piece. Both are counts by (bundle, system), so no two pieces are ever paired.
    """
    sized = d.join(d.groupBy("piece").agg(F.count("*").alias("_size")), "piece")
    seats = members.join(sized, "piece")
    counts = seats.groupBy("bundle", "system").agg(F.count("*").alias("_takers"), F.count_if(F.col("_size") == 1).alias("_settled"))
    own = F.when(F.col("_size") == 1, 1).otherwise(0)
    said = seats.join(counts, ["bundle", "system"]).groupBy("piece", "system").agg(
        F.bool_or(F.col("_settled") - own > 0).alias("_struck"),
        F.bool_or((F.col("_takers") == 1) & (F.col("_size") > 1)).alias("_forced"),
    )
    forced = said.where("_forced").groupBy("piece").agg(F.count("*").alias("_n"))
    kept = said.join(forced, "piece", "left").where("NOT _struck AND (_n IS NULL OR (_n = 1 AND _forced))")
    return kept.select("piece", "system")


def domains(members: DataFrame, named: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """(piece, systems, state) for each piece of members (bundle, piece): what it can be, given named (bundle, system).

    A piece can be what every bundle that reaches it names, and of that what is pinned (piece, system) for it, if anything is.
    Then all-different constraints narrow it in snapshot rounds until nothing changes, so no order of rows decides. SETTLED: one system is
    left; OPEN: several, the sheet is symmetric in them; CONTRADICTED: none, and nothing is claimed. Repeated rows and nulls do no harm.
    """
    members = stored(members.select("bundle", "piece").dropna().distinct(), "bundle-members")
    named = named.select("bundle", "system").dropna().distinct()
    reach = members.groupBy("piece").agg(F.count("*").alias("_bundles"))
    d = members.join(named, "bundle").groupBy("piece", "system").agg(F.count("*").alias("_n")).join(reach, "piece").where("_n = _bundles").select("piece", "system")
    if pinned is not None:
        pinned = pinned.select("piece", "system").dropna().distinct()
        d = d.join(pinned.select("piece").distinct(), "piece", "left_anti").unionByName(d.join(pinned, ["piece", "system"], "left_semi"))
    d = until_still(d, lambda s, _: _narrowed(s, members), lambda s: s.count(), "bundle-domains")  # domains only shrink
    out = members.select("piece").distinct().join(d, "piece", "left").groupBy("piece").agg(F.array_sort(F.collect_set("system")).alias("systems"))
    return out.withColumn("state", F.when(F.size("systems") == 1, "SETTLED").when(F.size("systems") > 1, "OPEN").otherwise("CONTRADICTED"))
