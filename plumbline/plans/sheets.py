"""Queries over whole drawings: bundles, networks of strokes, leaders, outlines, symbols, risers, labels, scales, measures.

The drawings are made of line items: sixteen orders are a sheet, a line item is a stroke on a grid of ten points, its return flag the
pen. Labels, marks and texts are made of parts and customers in the same way. Whole numbers, so that SQL can say the same.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import bundles, figures, frontier, labels, leaders, measure, network, pairing, whole
from plumbline.plans.base import query, table
from plumbline.sources.shared import stored

#: Line items, each combination of keys once, and a number for each.
ITEMS = "li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ((l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber AS id, min(l_quantity) AS l_quantity, min(l_tax) AS l_tax, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL)"
#: Line items as strokes: sheet, pen, id and ends.
STROKES = f"""{ITEMS}, s AS (SELECT l_orderkey // 16 AS sheet, l_returnflag AS pen, id, 10 * (l_partkey % 8) AS x0, 10 * (l_suppkey % 8) AS y0,
 10 * (l_partkey % 8) + CASE WHEN l_linenumber % 2 = 0 THEN 10 * (1 + CAST(l_quantity AS BIGINT) % 3) ELSE 0 END AS x1, 10 * (l_suppkey % 8) + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 10 * (1 + CAST(l_quantity AS BIGINT) % 3) END AS y1 FROM li)"""


def items(spark, sf_dir, *also):
    """Line items, each once; with columns `also`, which hang on the keys, they are dealt by them."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[c for c, _ in also]]
    number = ((F.col("l_orderkey") * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    li = table(spark, sf_dir, "lineitem")
    li = li.withColumns(dict(also)).repartition(*[c for c, _ in also]) if also else li
    return li.groupBy(*keys).agg(*[F.min(c).alias(c) for c in ("l_quantity", "l_tax", "l_returnflag", "l_linestatus")]).withColumn("id", number)


def strokes(spark, sf_dir):
    step = 10 * (1 + F.col("l_quantity").cast("bigint") % 3)
    flat = F.col("l_linenumber") % 2 == 0
    x, y = 10 * (F.col("l_partkey") % 8), 10 * (F.col("l_suppkey") % 8)
    s = items(spark, sf_dir, ("sheet", F.expr("l_orderkey div 16"))).select("sheet", F.col("l_returnflag").alias("pen"), "id", x.alias("x0"), y.alias("y0"), F.when(flat, x + step).otherwise(x).alias("x1"), F.when(flat, y).otherwise(y + step).alias("y1"))
    return s


def pieces(spark, sf_dir):
    """Strokes cut where others touch them, each place once."""
    return whole.pieces(strokes(spark, sf_dir), ["sheet", "pen"], 0.5, 40.0)


def graph_of(spark, sf_dir):
    """The network's arms with crossings taken apart, written once."""
    return whole.graph(strokes(spark, sf_dir), ["sheet", "pen"], 0.5, 40.0)


#: The unit steps of all strokes, each once; where a stroke ends or another ends on it there is a node.
PIECES = f"""{STROKES}, p AS (SELECT DISTINCT sheet, pen, x, y FROM (SELECT sheet, pen, x0 AS x, y0 AS y FROM s UNION ALL SELECT sheet, pen, x1, y1 FROM s)),
c AS (SELECT s.sheet, s.pen, s.id, p.x, p.y, row_number() OVER (PARTITION BY s.sheet, s.pen, s.id ORDER BY p.x, p.y) AS k FROM s JOIN p ON p.sheet = s.sheet AND p.pen = s.pen AND p.x BETWEEN s.x0 AND s.x1 AND p.y BETWEEN s.y0 AND s.y1),
q AS (SELECT a.sheet, a.pen, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, min(a.id || '.' || a.k) AS id FROM c a JOIN c b ON a.sheet = b.sheet AND a.pen = b.pen AND a.id = b.id AND b.k = a.k + 1 GROUP BY ALL),
e AS (SELECT sheet, pen, id, x0 AS x, y0 AS y, CASE WHEN y0 = y1 THEN 'h' ELSE 'v' END AS way FROM q UNION ALL SELECT sheet, pen, id, x1, y1, CASE WHEN y0 = y1 THEN 'h' ELSE 'v' END FROM q),
d AS (SELECT *, count(*) OVER (PARTITION BY sheet, pen, x, y) AS n FROM e)"""


@query(f"""WITH {PIECES}, n AS (SELECT sheet, pen, x, y, n, CASE WHEN n = 4 THEN way END AS line, list_sort(list(id)) AS pieces FROM d GROUP BY ALL)
SELECT sheet, pen, x::DOUBLE AS x, y::DOUBLE AS y, count(*) AS nodes, max(len(pieces))::BIGINT AS arms, list_sort(list(array_to_string(pieces, ','))) AS pieces FROM n GROUP BY sheet, pen, x, y""")
def split_crossings(spark, sf_dir):
    """Places of the network with their nodes: where four pieces meet two and two straight across, it is two nodes and no junction."""
    a = graph_of(spark, sf_dir)
    n = a.groupBy("sheet", "pen", "x", "y", "node").agg(F.array_sort(F.collect_list("id")).alias("pieces"))
    return n.groupBy("sheet", "pen", "x", "y").agg(F.count("*").alias("nodes"), F.max(F.size("pieces")).cast("bigint").alias("arms"), F.array_sort(F.collect_list(F.array_join("pieces", ","))).alias("pieces"))


@query(f"""WITH RECURSIVE {PIECES}, l AS (SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON a.sheet = b.sheet AND a.pen = b.pen AND a.x = b.x AND a.y = b.y AND a.id <> b.id WHERE a.n = 2 OR (a.n = 4 AND a.way = b.way)),
r(id, top) AS (SELECT id, id FROM q UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.id)
SELECT sheet, pen, min(top) AS chain, count(DISTINCT top) AS pieces FROM r JOIN q USING (id) GROUP BY sheet, pen, id""")
def straight_chains(spark, sf_dir):
    """Each piece's chain and its size: chains end at junctions and go straight through crossings."""
    a = graph_of(spark, sf_dir)
    c = network.chains(a).join(a.select("id", "sheet", "pen").distinct(), "id")
    return c.join(c.groupBy("chain").agg(F.count("*").alias("pieces")), "chain").select("sheet", "pen", "chain", "pieces")


#: Pieces that a label names stand on first pieces of one stroke in three; other labels point at those of another third.
OWNED = """o AS (SELECT id || '.1' AS id FROM li WHERE l_suppkey % 3 = 0), f AS (SELECT id FROM q WHERE id NOT IN (SELECT id FROM o)), v AS (SELECT li.id || '.1' AS id, p_type AS label FROM li JOIN part ON p_partkey = l_partkey WHERE l_suppkey % 3 = 1)"""


def _owned(spark, sf_dir):
    a = graph_of(spark, sf_dir)
    li = items(spark, sf_dir).withColumn("id", F.concat(F.col("id").cast("string"), F.lit(".1")))
    own = li.where("l_suppkey % 3 = 0").select("id", F.lit(True).alias("own")).distinct()
    names = a.select("id").distinct().join(own, "id", "left").select("id", F.when(F.col("own"), "CONFIRMED").otherwise("UNOWNED").alias("state"))
    return a, names, li


@query(f"""WITH RECURSIVE {PIECES}, {OWNED}, l AS (SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON a.sheet = b.sheet AND a.pen = b.pen AND a.x = b.x AND a.y = b.y AND a.id <> b.id WHERE (a.n = 2 OR (a.n = 4 AND a.way = b.way)) AND a.id IN (SELECT id FROM f) AND b.id IN (SELECT id FROM f)),
r(id, label) AS (SELECT f.id, label FROM f JOIN v USING (id) UNION SELECT l.b, r.label FROM r JOIN l ON l.a = r.id)
SELECT id, list_sort(list(label)) AS labels FROM r GROUP BY id""")
def claimed_runs(spark, sf_dir):
    """Lines without a name that labels point at, as far as they go on without a junction."""
    a, names, li = _owned(spark, sf_dir)
    claims = li.where("l_suppkey % 3 = 1").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey")).select("id", F.col("p_type").alias("label"))
    return network.claimed(a, names, claims)


@query(f"""WITH RECURSIVE {PIECES}, {OWNED}, k AS (SELECT d.*, CASE WHEN n = 4 THEN way END AS line FROM d JOIN f USING (id)), l AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.sheet = b.sheet AND a.pen = b.pen AND a.x = b.x AND a.y = b.y AND a.id <> b.id AND a.line IS NOT DISTINCT FROM b.line),
r(id, top) AS (SELECT id, id FROM f UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.id), z AS (SELECT id, min(top) AS part FROM r GROUP BY id)
SELECT id, sum(abs(x1 - x0) + abs(y1 - y0)) OVER (PARTITION BY part)::DOUBLE AS reach FROM z JOIN q USING (id)""")
def unowned_reach(spark, sf_dir):
    """How much hangs together with each piece without a name, none of it named."""
    a, names, _ = _owned(spark, sf_dir)
    return frontier.unowned_reach(a, names)


def _named(spark, sf_dir):
    """(arms, names): labels stand on the first pieces of some strokes, ticks and evidence at some places."""
    a = graph_of(spark, sf_dir)
    li = items(spark, sf_dir).join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey")).where("l_suppkey % 3 = 0")
    seeds = li.select(F.concat(F.col("id").cast("string"), F.lit(".1")).alias("id"), F.substring("p_brand", 1, 7).alias("stem"), F.when(F.col("p_size") % 4 > 0, (F.col("p_size") % 3 + 1) * 10).cast("int").alias("dn"))
    degree = a.groupBy("node", "sheet", "x", "y").agg(F.count("*").alias("n"))
    mark = F.pmod(F.col("sheet") + F.col("x") / 10 * 3 + F.col("y") / 10 * 7, F.lit(5))
    ticks = degree.where((F.col("n") == 2) & (mark == 0)).select("node")
    evidence = degree.where((F.col("n") == 1) & (mark < 2)).select("node")
    return a, stored(network.propagated(a, seeds.join(a.select("id").distinct(), "id", "left_semi"), ticks, evidence), "named")


@query()
def propagated_names(spark, sf_dir):
    """Every piece's name by labels, chains and junctions. (No SQL: rounds of conflicting rules; held against a sequential fixpoint.)"""
    return _named(spark, sf_dir)[1].select("id", "state", "stem", "dn", "reason", F.transform("names", lambda x: F.concat_ws("|", x.stem, x.dn)).alias("candidates"))


@query()
def pipe_frontiers(spark, sf_dir):
    """Every edge of every named pipe, and why it stops there. (No SQL; each reason is tested on a drawing.)"""
    a, names = _named(spark, sf_dir)
    sheets = a.select("sheet").distinct().select("sheet", F.lit(110.0).alias("width"), F.lit(110.0).alias("height"))
    c = table(spark, sf_dir, "customer").join(sheets.agg(F.max("sheet").alias("most")).hint("broadcast")).select(F.pmod(F.col("c_custkey"), F.col("most") + 1).alias("sheet"), "c_custkey", "c_nationkey")
    x, y = (F.col("c_custkey") % 9 * 10 + 3).cast("double"), (F.col("c_nationkey") % 9 * 10 + 2).cast("double")
    points = c.where("c_nationkey % 2 = 0").select("sheet", F.col("c_custkey").cast("string").alias("what"), x.alias("x"), y.alias("y"))
    boxes = c.where("c_nationkey % 2 = 1").select("sheet", F.lit("symbols").alias("pen"), F.col("c_custkey").cast("string").alias("figure"), (x - 4).alias("x0"), (y - 4).alias("y0"), (x + 4).alias("x1"), (y + 4).alias("y1"))
    found = frontier.frontiers(a, names, sheets, points, boxes, a.where("length >= 30").select("id"))
    return found.select("pipe", "node", "reason", "kind", F.array_join("beyond", ",").alias("beyond"), F.round("reach", 3).alias("reach"))


def _seats(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    sheet = F.expr("l_orderkey div 16")
    piece = F.concat_ws("-", sheet, F.col("l_partkey") % 6)
    truth = F.concat(F.lit("S"), (F.col("l_partkey") % 6 * 5 + sheet) % 6)
    return li.select(F.col("l_orderkey").alias("bundle"), piece.alias("piece"), F.when((F.col("l_tax") == 0.08) & (F.col("l_suppkey") % 5 == 0), "S9").otherwise(truth).alias("system"), (F.col("l_linenumber") == 1).alias("alone"))


def _bundle_sql(rounds: int) -> str:
    """The rounds written out; one that finds nothing changes nothing, so more of them do no harm."""
    out = ["""WITH l AS (SELECT l_orderkey AS bundle, (l_orderkey // 16) || '-' || (l_partkey % 6) AS piece, CASE WHEN l_tax = 0.08 AND l_suppkey % 5 = 0 THEN 'S9' ELSE 'S' || ((l_partkey % 6 * 5 + l_orderkey // 16) % 6) END AS system, l_linenumber = 1 AS alone, l_orderkey % 16 AS place FROM lineitem),
m AS MATERIALIZED (SELECT DISTINCT bundle, piece FROM l), named AS (SELECT DISTINCT bundle, system FROM l), pins AS (SELECT DISTINCT piece, system FROM l WHERE alone AND place = 0),
r AS (SELECT piece, count(*) AS n FROM m GROUP BY piece), o AS (SELECT piece, system, count(*) AS n FROM m JOIN named USING (bundle) GROUP BY ALL),
d0 AS MATERIALIZED (SELECT o.piece, o.system FROM o JOIN r ON r.piece = o.piece AND r.n = o.n WHERE o.piece NOT IN (SELECT piece FROM pins) OR (o.piece, o.system) IN (SELECT piece, system FROM pins))"""]
    for k in range(rounds):
        out.append(f"""z{k} AS (SELECT piece, count(*) AS size FROM d{k} GROUP BY piece), t{k} AS (SELECT m.bundle, d{k}.piece, d{k}.system, size FROM m JOIN d{k} ON d{k}.piece = m.piece JOIN z{k} ON z{k}.piece = m.piece),
g{k} AS (SELECT bundle, system, count(*) AS takers, count(*) FILTER (size = 1) AS settled FROM t{k} GROUP BY ALL),
f{k} AS (SELECT t{k}.piece, t{k}.system, bool_or(settled - (size = 1)::INT > 0) AS struck, bool_or(takers = 1 AND size > 1) AS forced FROM t{k} JOIN g{k} USING (bundle, system) GROUP BY ALL),
h{k} AS (SELECT piece, count(*) AS n FROM f{k} WHERE forced GROUP BY piece), d{k + 1} AS MATERIALIZED (SELECT f{k}.piece, f{k}.system FROM f{k} LEFT JOIN h{k} USING (piece) WHERE NOT struck AND (n IS NULL OR (n = 1 AND forced)))""")
    return ", ".join(out) + f""" SELECT m.piece, list_sort(list(DISTINCT system) FILTER (system IS NOT NULL)) AS systems, CASE count(DISTINCT system) WHEN 1 THEN 'SETTLED' WHEN 0 THEN 'CONTRADICTED' ELSE 'OPEN' END AS state FROM (SELECT DISTINCT piece FROM m) m LEFT JOIN d{rounds} USING (piece) GROUP BY m.piece"""


@query(_bundle_sql(12).replace("list_sort(list(DISTINCT system) FILTER (system IS NOT NULL))", "coalesce(list_sort(list(DISTINCT system) FILTER (system IS NOT NULL)), [])"))
def bundle_domains(spark, sf_dir):
    """What each run of the sheets' bundles can be, by all-different rounds."""
    seats = _seats(spark, sf_dir)
    pins = seats.where("alone AND bundle % 16 = 0").select("piece", "system")
    return bundles.domains(seats.select("bundle", "piece"), seats.select("bundle", "system"), pins)


@query()
def paired_runs(spark, sf_dir):
    """A reference's runs against ours by sheet and brand: one to one, merged, split, the rest by rank. (No SQL; held against a sequential pairing.)"""
    li = items(spark, sf_dir).join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    run = li.select((F.col("l_orderkey") % 1000).alias("sheet"), F.substring("p_brand", 7, 1).alias("name"), "id", (F.col("l_quantity") + F.col("l_tax")).alias("m"), "l_linestatus")
    p = pairing.pair_runs(run.where("l_linestatus = 'F'"), run.where("l_linestatus <> 'F'"), ["sheet", "name"])
    return p.select("sheet", "name", "kind", F.array_join("reference", ",").alias("reference"), F.array_join("ours", ",").alias("ours"), "reference_m", "ours_m")


@query("""WITH i AS (SELECT l_orderkey AS sheet, l_linenumber % 3 AS pipe, l_suppkey % 2 AS run, CASE l_suppkey % 5 WHEN 2 THEN 'bridged' WHEN 3 THEN 'hatched' WHEN 4 THEN 'twin' ELSE 'drawn' END AS kind, l_partkey % 60 AS lo, l_partkey % 60 + CAST(l_quantity AS BIGINT) AS hi FROM lineitem),
e AS (SELECT sheet, pipe, run, kind, lo AS pos, 1 AS way FROM i WHERE lo <> hi UNION ALL SELECT sheet, pipe, run, kind, hi, -1 FROM i WHERE lo <> hi),
g AS (SELECT sheet, pipe, run, pos, sum(way) FILTER (kind = 'drawn') AS drawn, sum(way) FILTER (kind = 'bridged') AS bridged, sum(way) FILTER (kind = 'hatched') AS hatched, sum(way) FILTER (kind = 'twin') AS twin FROM e GROUP BY ALL),
w AS (SELECT sheet, pipe, lead(pos) OVER v - pos AS len, sum(drawn) OVER v > 0 AS a, sum(bridged) OVER v > 0 AS b, sum(hatched) OVER v > 0 AS h, sum(twin) OVER v > 0 AS t FROM g WINDOW v AS (PARTITION BY sheet, pipe, run ORDER BY pos)),
m AS (SELECT sheet, pipe, coalesce(sum(len) FILTER (coalesce(a, false) OR coalesce(b, false)), 0)::BIGINT AS inked, coalesce(sum(len) FILTER ((coalesce(a, false) OR coalesce(b, false)) AND NOT coalesce(h, false) AND NOT coalesce(t, false)), 0)::BIGINT AS open,
  coalesce(sum(len) FILTER ((coalesce(a, false) OR coalesce(b, false)) AND coalesce(h, false)), 0)::BIGINT AS hatched, coalesce(sum(len) FILTER ((coalesce(a, false) OR coalesce(b, false)) AND NOT coalesce(h, false) AND coalesce(t, false)), 0)::BIGINT AS twin FROM w GROUP BY ALL),
c AS (SELECT o_orderkey AS sheet, CASE o_orderpriority WHEN '1-URGENT' THEN 'VERIFIED' WHEN '2-HIGH' THEN 'TEXT_ONLY' WHEN '3-MEDIUM' THEN 'CONFLICT' WHEN '4-NOT SPECIFIED' THEN 'FROM_THE_SET' ELSE 'NONE' END AS scale_state, (o_custkey % 4 + 1) * 0.25::DOUBLE AS m_per_pt FROM orders),
t AS (SELECT l_orderkey AS sheet, l_linenumber % 3 AS pipe, l_returnflag AS tag, CAST(l_quantity AS BIGINT) * 100 AS value, CASE l_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'm' ELSE 'mm' END AS unit FROM lineitem),
k AS (SELECT sheet, pipe, tag, round((max(value) - min(value)) / CASE WHEN min(unit) = 'mm' THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END, 3) AS height FROM t GROUP BY sheet, pipe, tag HAVING min(value) < max(value) AND count(DISTINCT unit) = 1 AND count(*) FILTER (unit IS NULL) = 0),
v AS (SELECT sheet, pipe, min(tag) AS level_tag, arg_min(height, tag) AS height FROM k GROUP BY ALL),
j AS (SELECT m.*, scale_state, CASE WHEN scale_state <> 'NONE' THEN m_per_pt END AS scale, level_tag, height FROM m LEFT JOIN c USING (sheet) LEFT JOIN v USING (sheet, pipe))
SELECT sheet, pipe, inked, open, hatched, twin, round(open * scale, 3) AS horizontal_m, height AS vertical_m, level_tag, round(round(open * scale, 3) + coalesce(height, 0.0), 3) AS total_m,
CASE WHEN scale IS NULL THEN 'NO_SCALE' WHEN open <= 0 AND inked > 0 THEN 'IN_HATCHED_AREA' WHEN scale_state = 'CONFLICT' THEN 'SCALE_UNSETTLED' WHEN scale_state = 'FROM_THE_SET' THEN 'SCALE_FROM_THE_SET' ELSE 'CONFIRMED' END AS state FROM j""")
def measured_pipes(spark, sf_dir):
    """Each pipe's drawn and bridged length less what is hatched or a twin's, in the sheet's scale, with its height from levels."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), (F.col("l_linenumber") % 3).alias("pipe"), "l_suppkey", "l_partkey", F.col("l_quantity").cast("bigint").alias("q"), "l_returnflag")
    k = F.col("l_suppkey") % 5
    i = li.select("sheet", "pipe", (F.col("l_suppkey") % 2).alias("run"), F.when(k == 2, "bridged").when(k == 3, "hatched").when(k == 4, "twin").otherwise("drawn").alias("kind"), (F.col("l_partkey") % 60).alias("lo"), (F.col("l_partkey") % 60 + F.col("q")).alias("hi"))
    p = F.col("o_orderpriority")
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sheet"), F.when(p == "1-URGENT", "VERIFIED").when(p == "2-HIGH", "TEXT_ONLY").when(p == "3-MEDIUM", "CONFLICT").when(p == "4-NOT SPECIFIED", "FROM_THE_SET").otherwise("NONE").alias("scale_state"), ((F.col("o_custkey") % 4 + 1) * 0.25).alias("m_per_pt"))
    t = li.select("sheet", "pipe", F.col("l_returnflag").alias("tag"), (F.col("q") * 100).alias("value"), F.when(F.col("l_suppkey") % 7 == 1, "m").when(F.col("l_suppkey") % 7 > 1, "mm").alias("unit"))
    return measure.measured(i, c, t, ["sheet", "pipe"], "sheet")


def _blocks(spark, sf_dir):
    """Labels of 18 by 6 points beside the grid's points, with the ends of their underlines as places where a leader starts."""
    s = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 16").alias("sheet"), F.col("o_orderkey").alias("block"), (F.col("o_orderkey") % 8 * 10).cast("double").alias("x"), (F.col("o_custkey") % 8 * 10).cast("double").alias("y"), (F.col("o_orderstatus") != "P").alias("says"), (F.col("o_custkey") % 3).alias("k"))
    b = s.select("sheet", "block", (F.col("x") - 18).alias("x0"), (F.col("y") - 1).alias("y0"), F.col("x").alias("x1"), (F.col("y") + 5).alias("y1"), F.lit(6.0).alias("height"), "says")
    kind = F.when(F.col("k") == 0, "underline_end").when(F.col("k") == 1, "box_corner").otherwise("bbox_corner")
    at = s.select("sheet", "block", F.explode(F.array(F.struct((F.col("x") + F.col("k") * 0.5).alias("x"), "y", kind.alias("kind")), F.struct((F.col("x") - 18).alias("x"), "y", kind.alias("kind")))).alias("p")).select("sheet", "block", "p.*")
    return b, at


@query()
def discovered_leaders(spark, sf_dir):
    """Leaders of all labels: claims by five keys, growth to eight segments, shared segments to the strongest. (No SQL; held against a plain walker.)"""
    found, _ = leaders.discover(*_blocks(spark, sf_dir), pieces(spark, sf_dir).select("sheet", "pen", "id", "x0", "y0", "x1", "y1"), 20.0)
    return found.select("sheet", "leader", "block", F.array_join("path", ",").alias("path"), "x", "y", "length", "reason")


@query()
def leader_claims(spark, sf_dir):
    """Which label claims which line, with the claims that stay ambiguous. (No SQL; held against a plain version.)"""
    c = leaders.claims(*_blocks(spark, sf_dir), pieces(spark, sf_dir), 20.0)
    return c.select("sheet", "stroke", "end", "block", "state", *[F.col(f"rank.{k}").alias(k) for k in ("bends", "derived", "mute", "near", "kind")])


#: Line items as horizontal sides of one pen, a unit apart at the least.
SIDES = f"{ITEMS}, s AS (SELECT l_orderkey // 16 AS sheet, l_returnflag AS pen, id, l_partkey % 40 AS x0, (l_suppkey % 60)::DOUBLE AS y, l_partkey % 40 + 30 + CAST(l_quantity AS BIGINT) % 12 AS x1, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.5 END AS width, CASE WHEN l_linenumber % 4 = 0 THEN 'UNOWNED' ELSE 'CONFIRMED' END AS state FROM li)"


@query(f"""WITH {SIDES}, w AS (SELECT *, max(width) OVER (PARTITION BY sheet, pen) AS pw, x1 - x0 AS len FROM s),
p AS (SELECT a.sheet, a.pen, a.id, b.id AS twin, abs(a.y - b.y) AS gap FROM w a JOIN w b ON a.sheet = b.sheet AND a.pen = b.pen AND a.id <> b.id AND b.len >= 0.8 * a.len AND abs(a.y - b.y) > 0 AND abs(a.y - b.y) <= least(a.len / 20.0, 2 * a.pw) AND least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.8 * a.len WHERE a.state = 'CONFIRMED'),
t AS (SELECT sheet, pen, id, min(twin) AS twin, arg_min(gap, twin) AS gap FROM p GROUP BY ALL), n AS (SELECT sheet, pen, gap, count(*) AS n, sum(count(*)) OVER (PARTITION BY sheet, pen) AS total FROM t GROUP BY sheet, pen, gap)
SELECT t.sheet, t.pen, id, twin, t.gap::DOUBLE AS gap, n >= 4 AND n >= 0.1 * total AS recurs FROM t JOIN n USING (sheet, pen, gap)""")
def thin_outlines(spark, sf_dir):
    """Runs that are one side of something thin, with their twin, and whether their pen comes back to that spacing. (Gaps are whole here, so equal ones are a cluster.)"""
    x = F.col("l_partkey") % 40
    s = items(spark, sf_dir, ("sheet", F.expr("l_orderkey div 16"))).select("sheet", F.col("l_returnflag").alias("pen"), "id", x.alias("x0"), (F.col("l_suppkey") % 60).alias("y0"), (x + 30 + F.col("l_quantity").cast("bigint") % 12).alias("x1"), (F.col("l_suppkey") % 60).alias("y1"), F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.5).alias("width"), F.when(F.col("l_linenumber") % 4 == 0, "UNOWNED").otherwise("CONFIRMED").alias("state"))
    return figures.outlines(s, ["sheet", "pen"], 40.0)


#: Parts as strokes of symbols in cells of twenty points, some close together.
MARKS = "m AS (SELECT p_partkey // 40 AS sheet, p_partkey AS id, 20 * (p_partkey % 5) + p_size % 7 AS x, 20 * (p_size % 4) + p_partkey % 3 AS y, p_size % 9 + 4 AS w, CAST(floor(p_retailprice) AS BIGINT) % 8 + 3 AS h FROM part)"


@query(f"""WITH RECURSIVE {MARKS}, e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON a.sheet = b.sheet AND a.x - 3 <= b.x + b.w AND b.x - 3 <= a.x + a.w AND a.y - 3 <= b.y + b.h AND b.y - 3 <= a.y + a.h),
r(id, top) AS (SELECT id, id FROM m UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.id), c AS (SELECT id, min(top) AS figure FROM r GROUP BY id),
g AS (SELECT sheet, figure, count(*) AS strokes, round(sum(sqrt((w * w + h * h)::DOUBLE)), 3) AS ink, min(x)::DOUBLE AS x0, min(y)::DOUBLE AS y0, max(x + w)::DOUBLE AS x1, max(y + h)::DOUBLE AS y1 FROM c JOIN m USING (id) GROUP BY ALL)
SELECT *, ink >= 40 AND sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) <= 200 AND ink >= 6 * sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS is_figure FROM g""")
def compound_symbols(spark, sf_dir):
    """Strokes grouped by the contacts of their boxes, and whether a group fills its box as a drawn object does."""
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y = 20 * (k % 5) + s % 7, 20 * (s % 4) + k % 3
    m = table(spark, sf_dir, "part").select(F.expr("p_partkey div 40").alias("sheet"), k.alias("id"), x.alias("x0"), y.alias("y0"), (x + s % 9 + 4).alias("x1"), (y + F.col("p_retailprice").cast("bigint") % 8 + 3).alias("y1"))
    return figures.figures(m, ["sheet"], 24.0)


@query()
def riser_marks(spark, sf_dir):
    """Closed marks as risers, named by the labels that point at them or by the pipe they stand on. (No SQL; tested by cases.)"""
    k, s = F.col("p_partkey"), F.col("p_size")
    cx, cy, size = (k % 12 * 20 + k % 3).cast("double"), (s % 9 * 20).cast("double"), (s % 10 + 2).cast("double")
    m = table(spark, sf_dir, "part").select(F.expr("p_partkey div 40").alias("sheet"), k.alias("id"), F.substring("p_brand", 7, 1).alias("layer"), (cx - size / 2).alias("x0"), (cy - size / 2).alias("y0"), (cx + size / 2).alias("x1"), (cy + size / 2).alias("y1"))
    o = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 320").alias("sheet"), F.col("o_orderkey").alias("label"), F.concat(F.lit("KV|"), F.col("o_custkey") % 3).alias("designation"), (F.col("o_custkey") % 4 + 1).cast("int").alias("times"), (F.col("o_orderkey") % 12 * 20 + 5).cast("double").alias("x"), (F.col("o_custkey") % 9 * 20 - 3).cast("double").alias("y"))
    p = strokes(spark, sf_dir).select(F.expr("sheet div 20").alias("sheet"), "id", F.concat(F.lit("VS|"), F.col("pen")).alias("designation"), *[(F.col(c) * 2).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return figures.risers(m, o, p, ["sheet"], 40.0).drop("size")


def _label_rows(spark, sf_dir):
    """Rows of labels by customer and part: codes in several patterns, sizes, levels and notes."""
    p = table(spark, sf_dir, "part").select(F.expr("p_partkey div 4 % 50").alias("sheet"), F.expr("p_partkey div 4").alias("block"), (F.col("p_partkey") % 4).cast("int").alias("row"), "p_partkey", "p_size", "p_name")
    k, s = F.col("p_partkey"), F.col("p_size")
    text = (
        F.when(k % 9 == 0, F.concat(F.lit("KV"), k % 7, F.lit("-"), s)).when(k % 9 == 1, F.concat(F.lit("VS/"), s)).when(k % 9 == 2, s.cast("string")).when(k % 9 == 3, F.concat(s, F.lit(" (L)")))
        .when(k % 9 == 4, F.concat(s % 4 + 2, F.lit("xVV"), k % 3, F.lit("-"), F.lit(22))).when(k % 9 == 5, F.concat(F.lit("KV1-"), s, F.lit(", VV1-"), s)).when(k % 9 == 6, F.concat(F.lit("VG+1,"), s))
        .when(k % 9 == 7, F.concat(F.lit("S"), k % 5, F.lit("-P"), s % 3)).otherwise(F.col("p_name"))
    )
    return p.select("sheet", "block", "row", text.alias("text"), (s % 3 * 10.0).alias("x0"), (s % 3 * 10.0 + 60).alias("x1"))


@query()
def read_designations(spark, sf_dir):
    """Designations of all labels with their dimension, inline or from a row below. (No SQL; held against a plain reader.)"""
    return labels.designations(_label_rows(spark, sf_dir))


@query("""WITH l AS (SELECT p_partkey % 50 AS file, upper(p_type || '|' || p_brand || '-V' || p_size || 'A') AS layer FROM part), k AS (SELECT DISTINCT file, word FROM (SELECT file, unnest(regexp_split_to_array(layer, '[^A-Z0-9]+')) AS word FROM l) WHERE length(word) >= 3 AND regexp_matches(word, '[A-Z]') AND regexp_matches(word, '[0-9]')),
w AS (SELECT p_partkey % 50 AS file, 'g' || (p_partkey % 20) AS family, substr('V' || (p_partkey % 50 + 1) || 'A', 1, p_partkey % 3) || '?' || substr('V' || (p_partkey % 50 + 1) || 'A', p_partkey % 3 + 2) AS word FROM part),
j AS (SELECT w.file, w.family, w.word, count(DISTINCT substr(k.word, instr(w.word, '?'), 1)) AS n, min(substr(k.word, instr(w.word, '?'), 1)) AS c FROM w JOIN k ON k.file = w.file AND length(k.word) = length(w.word) AND k.word LIKE replace(w.word, '?', '_') WHERE length(w.word) >= 4 GROUP BY ALL)
SELECT file, family, min(c) AS char, list_sort(list(DISTINCT replace(word, '?', c))) AS words FROM j WHERE n = 1 GROUP BY file, family HAVING count(DISTINCT c) = 1""")
def named_characters(spark, sf_dir):
    """Unreadable characters named by the layers' own words, through an index of one-gap forms; unanimous by family."""
    p = table(spark, sf_dir, "part")
    layers = p.select((F.col("p_partkey") % 50).alias("file"), F.concat("p_type", F.lit("|"), "p_brand", F.lit("-V"), "p_size", F.lit("A")).alias("layer"))
    code, k = F.concat(F.lit("V"), F.col("p_partkey") % 50 + 1, F.lit("A")), (F.col("p_partkey") % 3).cast("int")
    words = p.select((F.col("p_partkey") % 50).alias("file"), F.concat(F.lit("g"), F.col("p_partkey") % 20).alias("family"), F.concat(F.substr(code, F.lit(1), k), F.lit("?"), F.substr(code, k + 2)).alias("word"))
    return labels.named_from_vocabulary(words, labels.vocabulary(layers, ["file"], "layer"), ["file"])


@query("""WITH r AS (SELECT p_partkey // 30 AS sheet, p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'KV' || p_size WHEN 1 THEN p_name WHEN 2 THEN 'VS' || (p_partkey % 9) || ' ' || p_name ELSE 'W' || p_size END AS text, (p_partkey % 3) * 40 AS x0, (p_size % 10) * 9 AS y0, (p_partkey % 3) * 40 + 20 AS x1 FROM part),
i AS (SELECT sheet, id, regexp_extract(text, '^([A-Z]+[0-9]+) (.*)$', 1) AS code, regexp_extract(text, '^([A-Z]+[0-9]+) (.*)$', 2) AS description, NULL::BIGINT AS other FROM r WHERE regexp_matches(text, '^[A-Z]{1,4}[0-9]{0,3} ')),
n AS (SELECT c.sheet, c.id, c.text AS code, o.text AS description, o.id AS other, row_number() OVER (PARTITION BY c.sheet, c.id ORDER BY greatest(o.x0 - c.x1, 0), o.id) AS k FROM r c JOIN r o ON o.sheet = c.sheet AND o.id <> c.id AND o.x0 > c.x1 - 0.1 AND abs(o.y0 - c.y0) <= 3.6 AND greatest(o.x0 - c.x1, 0) <= 72 WHERE length(c.text) <= 12 AND NOT contains(c.text, ' '))
SELECT * FROM i UNION ALL SELECT sheet, id, code, description, other FROM n WHERE k = 1 AND regexp_matches(description, '[A-Za-z]')""")
def legend_entries(spark, sf_dir):
    """Codes with their descriptions, in the same row or in the nearest one to the right on the same baseline."""
    k, s = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 4 == 0, F.concat(F.lit("KV"), s)).when(k % 4 == 1, F.col("p_name")).when(k % 4 == 2, F.concat(F.lit("VS"), k % 9, F.lit(" "), "p_name")).otherwise(F.concat(F.lit("W"), s))
    x, y = k % 3 * 40, s % 10 * 9
    r = table(spark, sf_dir, "part").select(F.expr("p_partkey div 30").alias("sheet"), k.alias("id"), text.alias("text"), x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 6).alias("y1"))
    return labels.legend_pairs(r, ["sheet"])


@query("""WITH r AS (SELECT o_orderkey AS sheet, CASE WHEN o_custkey % 5 = 0 THEN 'SKALA 1:' || (o_custkey % 3 + 1) * 50 WHEN o_custkey % 5 = 1 THEN '1:5O' WHEN o_custkey % 5 = 2 THEN 'as in drawing 1:100 of the other set' WHEN o_custkey % 5 = 3 THEN '1:50 (1:100)' ELSE 'no scale' END AS text, o_custkey % 5 AS k, o_custkey % 3 AS j FROM orders),
t AS (SELECT sheet, CASE k WHEN 0 THEN [(j + 1) * 50] WHEN 1 THEN [50] WHEN 3 THEN [50, 100] ELSE [] END::INTEGER[] AS ratios FROM r),
l AS (SELECT l_orderkey AS sheet, count(*) AS n, min(l_linenumber) AS lo, max(l_linenumber) AS hi, max(l_suppkey % 2) AS odd FROM lineitem GROUP BY l_orderkey),
b AS (SELECT sheet, CASE WHEN n >= 3 THEN 1.0::DOUBLE / 56.0 END AS bar FROM l),
f AS (SELECT t.sheet, ratios, bar, list_sort([(abs(x * 25.4 / 72 / 1000 - bar), x * 25.4 / 72 / 1000) FOR x IN ratios IF bar IS NOT NULL AND abs(x * 25.4 / 72 / 1000 - bar) / bar <= 0.03]) AS fit FROM t LEFT JOIN b USING (sheet))
SELECT sheet, CASE WHEN len(fit) > 0 THEN 'VERIFIED' WHEN bar IS NOT NULL AND len(ratios) > 0 THEN 'CONFLICT' WHEN bar IS NOT NULL THEN 'BAR_ONLY' WHEN len(ratios) = 1 THEN 'TEXT_ONLY' WHEN len(ratios) > 1 THEN 'CONFLICT' ELSE 'NONE' END AS scale_state,
round(CASE WHEN len(fit) > 0 THEN fit[1][2] WHEN bar IS NOT NULL THEN bar WHEN len(ratios) = 1 THEN ratios[1] * 25.4 / 72 / 1000 END, 9)::DOUBLE AS m_per_pt, ratios FROM f""")
def discovered_scales(spark, sf_dir):
    """Each sheet's scale from its texts and the labels of its bar: read, compared, and settled or not."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 5)
    text = F.when(F.col("k") == 0, F.concat(F.lit("SKALA 1:"), (F.col("o_custkey") % 3 + 1) * 50)).when(F.col("k") == 1, "1:5O").when(F.col("k") == 2, "as in drawing 1:100 of the other set").when(F.col("k") == 3, "1:50 (1:100)").otherwise("no scale")
    rows = o.select(F.col("o_orderkey").alias("sheet"), text.alias("text"))
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    bar = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.lit(1).alias("line"), (place * 56.0).alias("x"), place.cast("string").alias("text"))
    return labels.scales(rows.select("sheet"), rows, bar, ["sheet"]).withColumn("m_per_pt", F.round("m_per_pt", 9))
