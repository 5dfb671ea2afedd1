"""Geometry, text and formula functions applied to whole tables. Lengths are given in thousandths, as whole numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import formula
from plumbline.functions import geometry as G
from plumbline.functions import text as T
from plumbline.plans.base import query, table

SEG = "s AS (SELECT l_orderkey AS sheet, l_linenumber AS line, (l_partkey % 500)::DOUBLE AS x0, l_suppkey::DOUBLE AS y0, (l_partkey % 500)::DOUBLE + l_quantity AS x1, l_suppkey::DOUBLE + l_linenumber * 3 - 10 AS y1 FROM lineitem)"
MILLI = lambda c: F.floor(c * 1000 + 0.5)


def segments(spark, sf_dir):
    x, y = (F.col("l_partkey") % 500).cast("double"), F.col("l_suppkey").cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("line"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity")).alias("x1"), (y + F.col("l_linenumber") * 3 - 10).alias("y1"))




def _s():
    return tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))


@query(f"""WITH {SEG} SELECT sheet, count(*) AS segments, sum(CAST(floor(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) * 1000 + 0.5) AS BIGINT))::BIGINT AS length,
 min(CAST(floor(((degrees(atan2(y1 - y0, x1 - x0)) % 180) + 180) % 180 + 0.5) AS BIGINT))::BIGINT AS least_angle, min(x0)::BIGINT AS bx0, max(y1)::BIGINT AS by1 FROM s GROUP BY sheet""")
def segment_measures(spark, sf_dir):
    """Length, direction and bounding box of each sheet's segments."""
    return segments(spark, sf_dir).groupBy("sheet").agg(F.count("*").alias("segments"), F.sum(MILLI(G.length(*_s()))).alias("length"), F.min(F.floor(G.angle(*_s()) + 0.5)).alias("least_angle"), F.min("x0").cast("bigint").alias("bx0"), F.max("y1").cast("bigint").alias("by1"))


@query(f"""WITH {SEG}, d AS (SELECT sheet, line, greatest(0, least(1, coalesce(((250 - x0) * (x1 - x0) + (50 - y0) * (y1 - y0)) / nullif((x1 - x0) ** 2 + (y1 - y0) ** 2, 0), 0))) AS t, x0, y0, x1, y1 FROM s)
SELECT sheet, line, CAST(floor(sqrt((x0 + t * (x1 - x0) - 250) ** 2 + (y0 + t * (y1 - y0) - 50) ** 2) * 1000 + 0.5) AS BIGINT) AS distance FROM d""")
def distance_to_point(spark, sf_dir):
    """Distance of each segment from a point."""
    return segments(spark, sf_dir).select("sheet", "line", MILLI(G.point_segment(F.lit(250.0), F.lit(50.0), *_s())["d"]).alias("distance"))


@query(f"""WITH {SEG}, c AS (SELECT *, greatest(0, CASE WHEN x1 > x0 THEN (100 - x0) / (x1 - x0) ELSE 0 END, CASE WHEN y1 > y0 THEN (20 - y0) / (y1 - y0) WHEN y1 < y0 THEN (80 - y0) / (y1 - y0) ELSE 0 END) AS t0, least(1, CASE WHEN x1 > x0 THEN (300 - x0) / (x1 - x0) ELSE 1 END, CASE WHEN y1 > y0 THEN (80 - y0) / (y1 - y0) WHEN y1 < y0 THEN (20 - y0) / (y1 - y0) ELSE 1 END) AS t1 FROM s)
SELECT sheet, line, CAST(floor(t0 * 1000 + 0.5) AS BIGINT) AS t0, CAST(floor(t1 * 1000 + 0.5) AS BIGINT) AS t1 FROM c WHERE t0 <= t1 AND NOT (y0 = y1 AND (y0 < 20 OR y0 > 80))""")
def clipped_segments(spark, sf_dir):
    """The visible part of each segment within a rectangle."""
    c = segments(spark, sf_dir).withColumn("c", G.clip(*_s(), tuple(map(F.lit, (100.0, 20.0, 300.0, 80.0)))))
    return c.where("c IS NOT NULL").select("sheet", "line", MILLI(F.col("c.t0")).alias("t0"), MILLI(F.col("c.t1")).alias("t1"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS w, (p_partkey % 30 + 1)::DOUBLE AS h FROM part) SELECT id, CAST(w * h AS BIGINT) AS area, CAST(2 * (w + h) AS BIGINT) AS perimeter, CAST(w * h - CASE WHEN w > 3 AND h > 3 THEN 4 ELSE 0 END AS BIGINT) AS net, CAST(w * 500 AS BIGINT) AS cx, CAST(h * 500 AS BIGINT) AS cy, (1 < w AND 1 < h) OR 1 = w AND 1 <= h OR 1 = h AND 1 <= w AS inside FROM p""")
def ring_measures(spark, sf_dir):
    """Area, perimeter, area less a hole that lies inside, centroid, and whether a point is in the ring."""
    w, h = F.col("p_size").cast("double"), (F.col("p_partkey") % 30 + 1).cast("double")
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(pt(F.lit(0.0), F.lit(0.0)), pt(w, F.lit(0.0)), pt(w, h), pt(F.lit(0.0), h))
    hole = F.array(*[pt(F.lit(x), F.lit(y)) for x, y in ((1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0))])
    holes = F.when((w > 3) & (h > 3), F.array(hole)).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ring.alias("ring"), holes.alias("holes"))
    r = F.col("ring")
    return p.select("id", F.abs(G.signed_area(r)).cast("bigint").alias("area"), G.polyline_length(r, True).cast("bigint").alias("perimeter"), G.area_with_holes(r, F.col("holes")).cast("bigint").alias("net"), MILLI(G.centroid(r)["x"]).alias("cx"), MILLI(G.centroid(r)["y"]).alias("cy"), G.point_in_ring(F.lit(1.0), F.lit(1.0), r).alias("inside"))


@query("""SELECT p_partkey AS id, CAST(floor(p_size * 25.4 / 1000 * 1000 + 0.5) AS BIGINT) AS length_mm, CAST(floor(degrees(acos(greatest(-1, least(1, p_size / sqrt(p_size * p_size + 100.0))))) * 1000 + 0.5) AS BIGINT) AS angle, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 50 END AS metres FROM part""")
def converted_measures(spark, sf_dir):
    """Units, the angle at a vertex, and metres that need a scale."""
    s = F.col("p_size").cast("double")
    zero, ten = F.lit(0.0), F.lit(10.0)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), MILLI(G.convert(s, F.lit("in"), F.lit("m"))).alias("length_mm"), MILLI(G.vertex_angle(s, zero, zero, zero, s, ten)).alias("angle"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") * 50).alias("metres"))


@query(r"""SELECT p_partkey AS id, 'p_' || substr(sha1(p_brand || '|' || p_name || '|' || p_size), 1, 12) AS stable, regexp_replace(regexp_replace(p_brand, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS shape, regexp_replace(regexp_replace(p_brand, '[0-9]+', '9', 'g'), '[A-Za-z]+', 'A', 'g') AS pattern,
 translate(p_brand, 'OoIlSBZGq', '001158269') AS digits, list_filter(regexp_split_to_array(p_brand, '[-_/#. ]+'), lambda t: t <> '') AS tokens, split_part(p_brand, '#', 1) || '|DN' || p_size AS key FROM part""")
def label_texts(spark, sf_dir):
    """Ids by content, shapes, look-alike digits, tokens and identity keys of labels."""
    b = F.col("p_brand")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.stable_id("p", b, F.col("p_name"), F.col("p_size")).alias("stable"), T.shape(b).alias("shape"), T.compressed_pattern(b).alias("pattern"), T.digits_from_glyphs(b).alias("digits"), T.split_tokens(b).alias("tokens"), T.identity(b, F.col("p_size"))["key"].alias("key"))


@query(r"""WITH t AS (SELECT p_partkey AS id, (p_size % 4) || 'xKV' || p_partkey || ',' AS code, 'level VG' || CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END || p_size || CASE WHEN p_size % 3 = 0 THEN ',25' ELSE '' END AS note, '1 ' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ',5' AS number FROM part)
SELECT id, CAST(regexp_extract(code, '^([0-9]+)x', 1) AS INT) AS n, 'KV' || id AS rest, CASE WHEN id % 1 = 0 THEN CASE WHEN contains(note, ',') THEN CAST(regexp_extract(note, '([0-9]+),', 1) AS BIGINT) * 1000 + 250 ELSE CAST(regexp_extract(note, '[+-]([0-9]+)', 1) AS BIGINT) END * CASE WHEN contains(note, '-') THEN -1 ELSE 1 END END AS mm, (1000.5 + CAST(substr(number, 3, 3) AS INT))::DOUBLE AS number FROM t""")
def parsed_notes(spark, sf_dir):
    """Counts before codes, elevations with their unit inferred, numbers with decimal comma."""
    s, k = F.col("p_size"), F.col("p_partkey")
    code = F.concat((s % 4).cast("string"), F.lit("xKV"), k.cast("string"), F.lit(","))
    note = F.concat(F.lit("level VG"), F.when(s % 2 == 0, "+").otherwise("-"), s.cast("string"), F.when(s % 3 == 0, ",25").otherwise(""))
    num = F.concat(F.lit("1 "), F.lpad(s.cast("string"), 3, "0"), F.lit(",5"))
    return table(spark, sf_dir, "part").select(k.alias("id"), T.count_prefix(code)["n"].alias("n"), T.count_prefix(code)["rest"].alias("rest"), T.elevation(note)["mm"].alias("mm"), T.number(num).alias("number"))


@query("""SELECT p_partkey AS id, CASE split_part(p_name, ' ', 2) WHEN 'widget' THEN 'system' WHEN 'gizmo' THEN 'system' WHEN 'bolt' THEN 'component' WHEN 'ring' THEN 'component' WHEN 'gear' THEN 'component' ELSE CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'material' WHEN 'blue' THEN 'material' END END AS role FROM part""")
def role_of_description(spark, sf_dir):
    """The last word that says what a code is."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.role_from_words(F.col("p_name")).alias("role"))


@query("""SELECT p_partkey AS id, p_retailprice * p_size AS value, CASE WHEN p_size > 25 THEN p_size - 25 ELSE 0 END::DOUBLE AS over, CASE WHEN p_size = 10 THEN NULL ELSE 100.0 / (p_size - 10) END AS ratio, floor(p_retailprice / 7) AS whole, greatest(p_size, 20)::DOUBLE * 2 AS doubled FROM part""")
def calculated_columns(spark, sf_dir):
    """Formulas compiled to expressions; division by zero has no value, an unknown name only fails its own column."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    out, errors = formula.with_formulas(p, {"doubled": "most * 2", "most": "max(size; 20)", "value": "price * size", "over": "size - 25 if size > 25 else 0", "ratio": "100 / (size - 10)", "whole": "price // 7", "bad": "nothing + 1", "evil": "__import__('os')"})
    assert set(errors) == {"bad", "evil"}
    return out.select("id", "value", "over", "ratio", "whole", "doubled")
