"""Drawn things that are no pipes: outlines of thin objects, compound symbols, marks of risers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import graph, interval, spatial
from plumbline.operators.rounds import until_still
from plumbline.sources.shared import stored

#: Outlines: how many times longer than wide, how much of a run its twin covers, within how many pen widths; spacings that recur.
ELONGATION, COVER, PENS = 20.0, 0.8, 2.0
SPREAD, REPEATS, SHARE, PARALLEL = 0.15, 4, 0.1, 0.999
#: Figures: strokes this close (pt) belong together; ink that many times the diagonal; least ink and largest span of a figure.
GAP, INK, LEAST_INK, SPAN = 3.0, 6.0, 40.0, 200.0
#: Marks of risers (pt): sizes, concentric ones are one, reach of a label's end, and of an unlabelled mark; smaller ones need a label.
MARK, CONCENTRIC, LABEL_REACH, PIPE_REACH, ALONE = (1.5, 14.0), 3.0, 15.0, 1.5, 4.0


def _boxed(df: DataFrame) -> DataFrame:
    """df with its line as l0..l3 and its box as x0, y0, x1, y1."""
    line = df.withColumns({f"l{k}": F.col(c).cast("double") for k, c in enumerate(("x0", "y0", "x1", "y1"))})
    return line.withColumns({"x0": F.least("l0", "l2"), "y0": F.least("l1", "l3"), "x1": F.greatest("l0", "l2"), "y1": F.greatest("l1", "l3")})


def recurring(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mid, slack, n): values that come back: clusters in one dimension, each from its least value to SPREAD above it.

    Clusters begin one after the other, each at the least value beyond the one before, in rounds over all keys at once; there are
    at most as many as steps of SPREAD between the least and the largest value. Those with REPEATS values and SHARE of all count.
    """
    values = stored(values.select(*by, value), "values")
    first = values.groupBy(*by).agg(F.min(value).alias("from")).withColumn("k", F.lit(0))

    def step(starts: DataFrame, k: int) -> DataFrame:
        last = starts.where(F.col("k") == k - 1)
        more = values.join(last, by).where(F.col(value) > F.col("from") * (1 + SPREAD)).groupBy(*by).agg(F.min(value).alias("from"))
        return starts.unionByName(more.withColumn("k", F.lit(k)))

    starts = until_still(first, step, lambda s: s.count(), "clusters")
    placed = interval.as_of(values, starts.withColumn(value, F.col("from")), by, value, ["k"])
    w = W.partitionBy(*by, "k")
    placed = placed.withColumn("i", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w)).withColumn("all", F.count("*").over(W.partitionBy(*by)))
    bands = placed.groupBy(*by, "k", "n", "all").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col(value))).alias("mid"))
    return bands.where((F.col("n") >= REPEATS) & (F.col("n") >= SHARE * F.col("all"))).select(*by, "mid", F.greatest(F.col("hi") - F.col("mid"), F.col("mid") - F.col("lo")).alias("slack"), "n")


def outlines(segments: DataFrame, by: list[str], cell: float) -> DataFrame:
    """(by, id, twin, gap, recurs): confirmed runs that are a side of something thin, with their parallel twin of the same pen.

    segments: by, id, x0, y0, x1, y1, width, state. The twin covers COVER of the run, is as long, and is nearer than PENS of the
    family's pen and the run's length by ELONGATION; of several the one with the least id. Both sides are found, each from its own place.
    """
    s = _boxed(segments).withColumn("length", F.hypot(F.col("l2") - F.col("l0"), F.col("l3") - F.col("l1"))).where("length > 0")
    s = s.withColumn("_pen", F.max("width").over(W.partitionBy(*by))).where("_pen > 0").withColumn("reach", F.least(F.col("length") / ELONGATION, PENS * F.col("_pen")))
    own = s.where((F.col("state") == "CONFIRMED") & (F.col("length") >= ELONGATION / 2))
    wide = own.withColumns({"x0": F.col("x0") - F.col("reach"), "y0": F.col("y0") - F.col("reach"), "x1": F.col("x1") + F.col("reach"), "y1": F.col("y1") + F.col("reach")})
    p = spatial.box_join(wide, s, cell, by=tuple(by)).where((F.col("id") != F.col("r_id")) & (F.col("r_length") >= COVER * F.col("length")))
    ux, uy = (F.col("l2") - F.col("l0")) / F.col("length"), (F.col("l3") - F.col("l1")) / F.col("length")
    vx, vy = (F.col("r_l2") - F.col("r_l0")) / F.col("r_length"), (F.col("r_l3") - F.col("r_l1")) / F.col("r_length")
    mx, my = (F.col("r_l0") + F.col("r_l2")) / 2 - F.col("l0"), (F.col("r_l1") + F.col("r_l3")) / 2 - F.col("l1")
    along = lambda x, y: (F.col(x) - F.col("l0")) * ux + (F.col(y) - F.col("l1")) * uy
    a, b = along("r_l0", "r_l1"), along("r_l2", "r_l3")
    shared = F.least(F.greatest(a, b), F.col("length")) - F.greatest(F.least(a, b), F.lit(0.0))
    p = p.withColumn("gap", F.round(F.abs(my * ux - mx * uy), 6)).where((F.abs(ux * vx + uy * vy) >= PARALLEL) & (F.col("gap") > 1e-6) & (F.col("gap") <= F.col("reach")) & (shared >= COVER * F.col("length")))
    twins = stored(p.groupBy(*by, "id").agg(F.min(F.struct(F.col("r_id").alias("twin"), "gap")).alias("t")).select(*by, "id", "t.twin", "t.gap"), "outlines")
    bands = recurring(twins, by, "gap").withColumnRenamed("n", "times")
    hit = twins.join(bands, by, "left").groupBy(*by, "id", "twin", "gap").agg(F.coalesce(F.bool_or(F.abs(F.col("gap") - F.col("mid")) <= F.col("slack")), F.lit(False)).alias("recurs"))
    return hit


def demoted(segments: DataFrame, by: list[str], cell: float) -> DataFrame:
    """segments with `state` AMBIGUOUS and `reason` where a run is a side of an outline, so that its length leaves the quantities."""
    found = outlines(segments, by, cell).select(*by, "id", F.lit(True).alias("_side"))
    out = segments.join(found, [*by, "id"], "left")
    return out.withColumn("reason", F.when(F.col("_side"), "reads_as_a_drawn_outline")).withColumn("state", F.when(F.col("_side"), "AMBIGUOUS").otherwise(F.col("state"))).drop("_side")


def figures(strokes: DataFrame, by: list[str], cell: float) -> DataFrame:
    """(by, figure, strokes, ink, x0, y0, x1, y1, is_figure): strokes grouped by nearness of their boxes, and whether the group stands still and fills its box.

    The groups are components of the contacts of boxes; one of a single stroke is there too. ids must not repeat.
    """
    s = stored(_boxed(strokes).select(*by, "id", "x0", "y0", "x1", "y1", F.hypot(F.col("l2") - F.col("l0"), F.col("l3") - F.col("l1")).alias("length")), "strokes")
    box = s.select(*by, "id", "x0", "y0", "x1", "y1")
    near = spatial.box_join(box, box, cell, by=tuple(by), reach=GAP).where("id < r_id").select(F.col("id").alias("a"), F.col("r_id").alias("b"))
    group = s.join(graph.components(near), "id", "left").withColumn("figure", F.coalesce("component", "id"))
    g = group.groupBy(*by, "figure").agg(F.count("*").alias("strokes"), F.round(F.sum("length"), 3).alias("ink"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")])
    diagonal = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return g.withColumn("is_figure", (F.col("ink") >= LEAST_INK) & (diagonal > 1e-6) & (diagonal <= SPAN) & (F.col("ink") >= INK * diagonal))


def covering(points: DataFrame, symbols: DataFrame, by: list[str], cell: float, slack: float = 1.0) -> DataFrame:
    """(by, point, symbols): the symbols of another pen whose box, widened by `slack`, holds the point; points: by, point, pen, x, y; symbols: by, figure, pen, box."""
    p = points.withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")})
    return spatial.box_join(p, symbols, cell, by=tuple(by), reach=slack).where("pen <> r_pen").groupBy(*by, "point").agg(F.array_sort(F.collect_set("r_figure")).alias("symbols"))


def risers(marks: DataFrame, labels: DataFrame, pipes: DataFrame, by: list[str], cell: float) -> DataFrame:
    """(by, riser, layer, size, marks, designation, source, times): closed marks that stand for vertical pipes.

    marks: by, id, layer and box; labels: by, label, designation, times and the place x, y of its leader's end; pipes: by, id, designation and line.
    Marks whose centres lie within CONCENTRIC, step by step, are one riser, named by the least id. A label names the nearest riser within LABEL_REACH; of
    several names at the same distance none counts (source `ambiguous`). A riser without a label takes the name of the only designation that passes
    within PIPE_REACH of it, if a label names a mark of its layer and rounded size; else its name is null.
    """
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    m = marks.withColumn("size", size).where(F.col("size").between(*MARK)).select(*by, "id", "layer", "size", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    m = stored(m, "marks")
    dot = lambda d: d.withColumns({"x0": F.col("cx"), "y0": F.col("cy"), "x1": F.col("cx"), "y1": F.col("cy")})
    close = spatial.box_join(dot(m), dot(m), cell, by=tuple(by), reach=CONCENTRIC).where((F.col("id") < F.col("r_id")) & (F.hypot(F.col("cx") - F.col("r_cx"), F.col("cy") - F.col("r_cy")) <= CONCENTRIC))
    g = m.join(graph.components(close.select(F.col("id").alias("a"), F.col("r_id").alias("b"))), "id", "left").withColumn("riser", F.coalesce("component", "id"))
    r = g.groupBy(*by, "riser").agg(F.min("layer").alias("layer"), F.max("size").alias("size"), F.count("*").alias("marks"), F.min_by("cx", "id").alias("cx"), F.min_by("cy", "id").alias("cy")).withColumn("kind", F.round("size"))
    r = stored(r, "risers")
    at = labels.withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")})
    reach = spatial.box_join(at, dot(r), cell, by=tuple(by), reach=LABEL_REACH).withColumn("d", F.hypot(F.col("x") - F.col("r_cx"), F.col("y") - F.col("r_cy"))).where(F.col("d") <= LABEL_REACH)
    mine = spatial.nearest(reach, [*by, "label"], F.col("d"), []).where("n_tied = 1").select(*by, F.col("r_riser").alias("riser"), "designation", "times", "d")
    said = mine.withColumn("_best", F.min("d").over(W.partitionBy(*by, "riser"))).where("d = _best").groupBy(*by, "riser").agg(F.count_distinct("designation").alias("n"), F.min("designation").alias("designation"), F.max("times").alias("times"))
    named = r.join(said, [*by, "riser"], "left")
    kinds = named.where("n IS NOT NULL").select(*by, "layer", "kind").distinct().withColumn("known", F.lit(True))
    rest = named.where("n IS NULL").join(kinds, [*by, "layer", "kind"]).where(F.col("size") >= ALONE)
    around = rest.withColumn("R", F.col("size") / 2 + PIPE_REACH).withColumns({"x0": F.col("cx") - F.col("R"), "y0": F.col("cy") - F.col("R"), "x1": F.col("cx") + F.col("R"), "y1": F.col("cy") + F.col("R")}).select(*by, "riser", "R", "cx", "cy", "x0", "y0", "x1", "y1")
    met = spatial.box_join(around, _boxed(pipes), cell, by=tuple(by))
    dx, dy = F.col("r_l2") - F.col("r_l0"), F.col("r_l3") - F.col("r_l1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("cx") - F.col("r_l0")) * dx + (F.col("cy") - F.col("r_l1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))))
    met = met.where(F.hypot(F.col("r_l0") + F.coalesce(t, F.lit(0.0)) * dx - F.col("cx"), F.col("r_l1") + F.coalesce(t, F.lit(0.0)) * dy - F.col("cy")) <= F.col("R"))
    passing = met.groupBy(*by, "riser").agg(F.count_distinct("r_designation").alias("pn"), F.min("r_designation").alias("pipe"))
    out = named.join(passing, [*by, "riser"], "left")
    source = F.when(F.col("n") == 1, "label").when(F.col("n") > 1, "ambiguous").when(F.col("pn") == 1, "pipe")
    return out.select(*by, "riser", "layer", "size", "marks", F.when(F.col("n") == 1, F.col("designation")).when(F.col("n").isNull() & (F.col("pn") == 1), F.col("pipe")).alias("designation"), source.alias("source"), F.coalesce("times", F.lit(1)).alias("times"))
