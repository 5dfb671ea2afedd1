"""Queries through sources, sinks, tools, streams and single functions that the other modules do not run."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators.tools import TOOLS
from plumbline.plans.base import query, table
from plumbline.plans.filters import only
from plumbline.plans.sheets import STROKES, strokes
from plumbline.plans.takeoff import runs
from plumbline.sources import artifacts
from plumbline.sources.shared import shared_dir


@query("""WITH c AS (SELECT p_partkey AS id, p_partkey % 50 AS x0, p_size AS y0, p_partkey % 31 AS x1, p_size * 2 AS y1, p_partkey % 17 AS x2, p_size % 7 AS y2, p_partkey % 11 AS x3, p_size % 13 AS y3 FROM part), t AS (SELECT *, k, k / 8.0::DOUBLE AS t FROM c, (SELECT unnest(range(9)) AS k))
SELECT id, k::INT AS k, round(x0 * (1 - t) ** 3 + 3 * x1 * t * (1 - t) ** 2 + 3 * x2 * t * t * (1 - t) + x3 * t ** 3, 6) AS x, round(y0 * (1 - t) ** 3 + 3 * y1 * t * (1 - t) ** 2 + 3 * y2 * t * t * (1 - t) + y3 * t ** 3, 6) AS y FROM t""")
def flattened_curves(spark, sf_dir):
    """Curves as nine points each."""
    k, s = F.col("p_partkey"), F.col("p_size")
    curve = G.flatten_bezier([((k % 50).cast("double"), s.cast("double")), ((k % 31).cast("double"), (s * 2).cast("double")), ((k % 17).cast("double"), (s % 7).cast("double")), ((k % 11).cast("double"), (s % 13).cast("double"))])
    c = table(spark, sf_dir, "part").select(k.alias("id"), F.posexplode(curve).alias("k", "p"))
    return c.select("id", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(f"""WITH {STROKES}, n AS (SELECT *, lead(id) OVER w AS other, lead(x0) OVER w AS a0, lead(y0) OVER w AS b0, lead(x1) OVER w AS a1, lead(y1) OVER w AS b1 FROM s WINDOW w AS (PARTITION BY sheet, pen ORDER BY id))
SELECT sheet, pen, id, other, (y0 = y1) = (b0 = b1) AND abs(CASE WHEN y0 = y1 THEN b0 - y0 ELSE a0 - x0 END) <= 0.3 AS collinear FROM n WHERE other IS NOT NULL""")
def collinear_strokes(spark, sf_dir):
    """Whether a stroke lies on the line of the one before it."""
    w = W.partitionBy("sheet", "pen").orderBy("id")
    n = strokes(spark, sf_dir).select("*", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("id", "x0", "y0", "x1", "y1")]).where("n_id IS NOT NULL")
    ends = lambda p: tuple(F.col(f"{p}{c}").cast("double") for c in ("x0", "y0", "x1", "y1"))
    return n.select("sheet", "pen", "id", F.col("n_id").alias("other"), G.collinear(ends(""), ends("n_"), 3.0, 0.3).alias("collinear"))


@query("""SELECT o_orderkey AS item, o_orderpriority AS layer FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'""")
def visible_items(spark, sf_dir):
    """What a view shows: the chosen state, any customer, and no layer that is switched off."""
    o = only(table(spark, sf_dir, "orders"), o_orderstatus="F", o_custkey=None)
    return o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("layer"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, coalesce(CAST(round(value * 100) AS BIGINT), 0) AS cents FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000 OR lag(event_type) OVER w = 'purchase' THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM n)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS events, sum(cents)::BIGINT AS cents, CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' ELSE 'pause' END AS closed_by FROM v GROUP BY user_id, visit""")
def visits(spark, sf_dir):
    """Visits that end by a pause or a purchase; the stateful stream gives the same rows."""
    from plumbline.streaming import visits as V

    return V.visits(table(spark, sf_dir, "events"))


QUANTITIES = "q AS (SELECT p_type AS designation, l_suppkey % 20 AS page, sum(CAST(l_quantity AS BIGINT))::BIGINT AS metres FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def _quantities(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    return li.groupBy(F.col("p_type").alias("designation"), (F.col("l_suppkey") % 20).alias("page")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("metres"))


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {QUANTITIES} SELECT page::INT AS page, count(*) AS rows, sum(metres)::BIGINT AS metres FROM q GROUP BY page")
def sheet_files(spark, sf_dir):
    """Quantities written by sheet and read again, sheet by sheet."""
    path = _folder(spark, "by-sheet")
    artifacts.write_by_sheet(_quantities(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy(F.col("page").cast("int").alias("page")).agg(F.count("*").alias("rows"), F.sum("metres").alias("metres"))


@query(f"WITH {QUANTITIES} SELECT designation || ';' || page || ';' || replace(printf('%.2f', metres / 4.0), '.', ',') AS line, count(*) AS n FROM q GROUP BY ALL")
def csv_lines(spark, sf_dir):
    """The lines of a quantity file: semicolons, decimal commas, two decimals."""
    path = _folder(spark, "csv")
    artifacts.write_csv(_quantities(spark, sf_dir).select("designation", "page", (F.col("metres") / 4).alias("metres")), path)
    return spark.read.text(path).where("value <> 'designation;page;metres'").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(f"WITH {QUANTITIES} SELECT 'quantities' AS artifact, count(*) AS rows, true AS whole FROM q UNION ALL SELECT 'scales', count(*), true FROM orders")
def document_manifest(spark, sf_dir):
    """A document's artifacts as its manifest and its files say: every file has a hash, and the rows that were meant are there."""
    path = _folder(spark, "document")
    frames = {"quantities": _quantities(spark, sf_dir), "scales": table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")}
    manifest = artifacts.write_document(frames, path)
    rows = spark.read.text([f"{path}/{n}" for n in frames]).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("artifact")).groupBy("artifact").agg(F.count("*").alias("rows"))
    files = manifest.groupBy("artifact").agg((F.count_if(F.length("sha256") == 64) == F.count("*")).alias("whole"))
    return rows.join(files, "artifact")


@query("""SELECT p_brand AS designation, p_size AS dn, sum(CAST(l_quantity AS BIGINT))::BIGINT AS metres FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO' GROUP BY ALL""")
def tool_pipes(spark, sf_dir):
    """The tool `pipes` with one argument; the others are no filter."""
    return TOOLS.call(spark, sf_dir, "pipes", system="PROMO")


@query("""SELECT l_orderkey AS sheet, count(*) AS runs FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#2' GROUP BY ALL""")
def tool_sheets_of(spark, sf_dir):
    """The tool `sheets_of`: where a designation stands."""
    return TOOLS.call(spark, sf_dir, "sheets_of", designation="brand#2")


@query("""SELECT p_type AS "key", sum(CAST(l_quantity AS BIGINT))::BIGINT AS metres, count(*) AS runs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type""")
def tool_quantities(spark, sf_dir):
    """The tool `quantities`, grouped by system."""
    return TOOLS.call(spark, sf_dir, "quantities", by="system")


@query("""SELECT l_partkey AS id, sum(CAST(l_quantity AS BIGINT))::BIGINT AS metres, count(DISTINCT l_orderkey) AS sheets, 'found' AS state FROM lineitem WHERE l_partkey IN (3, 5, 8, 13) GROUP BY ALL UNION ALL SELECT -1, NULL, 0, 'there is no such pipe'""")
def tool_measure(spark, sf_dir):
    """The tool `measure` for a list of pipes; one that is not there is an answer that says so."""
    return TOOLS.call(spark, sf_dir, "measure", ids=[3, 5, 8, 13, -1])


@query("""SELECT 'erase' AS kind, 'Brand#2' AS designation, 7::INT AS metres, sum(CAST(l_quantity AS BIGINT)) >= 7 AS accepted, CASE WHEN sum(CAST(l_quantity AS BIGINT)) < 7 THEN 'less than that is there' END AS reason FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#2'""")
def tool_proposal(spark, sf_dir):
    """The tool `propose_erase`: a proposal, checked against what is there, that changes nothing."""
    return TOOLS.call(spark, sf_dir, "propose_erase", designation="Brand#2", metres=7)


@query("""WITH k AS (SELECT p_partkey % 20 AS ex, p_partkey // 20 AS part, p_size AS want FROM part WHERE p_partkey < 100), a AS (SELECT DISTINCT o_custkey % 20 AS ex, o_custkey AS attempt FROM orders),
v AS (SELECT l_orderkey, l_linenumber FROM lineitem), g AS (SELECT o_custkey % 20 AS ex, o_custkey AS attempt, o_orderkey % 5 AS part, max(o_orderkey % 50 + 1) AS value FROM orders GROUP BY ALL),
j AS (SELECT a.ex, a.attempt, k.part, coalesce(abs(value - want) / want::DOUBLE <= 0.5, false) AS ok FROM a JOIN k ON k.ex = a.ex LEFT JOIN g ON g.ex = a.ex AND g.attempt = a.attempt AND g.part = k.part)
SELECT ex, attempt, round(count(*) FILTER (ok) / count(*), 6) AS score, bool_and(ok) AS passed, coalesce(list_sort(list(part) FILTER (NOT ok)), []) AS wrong FROM j GROUP BY ALL""")
def graded_steps(spark, sf_dir):
    """Calculations of five steps, each graded for itself within half of what is wanted."""
    from plumbline.operators import grading

    k, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    key = p.where("p_partkey < 100").select((k % 20).alias("ex"), F.expr("p_partkey div 20").alias("part"), F.col("p_size").cast("string").alias("value"), F.lit(0.5).alias("tolerance"))
    o = table(spark, sf_dir, "orders")
    given = o.groupBy((F.col("o_custkey") % 20).alias("ex"), F.col("o_custkey").alias("attempt"), (F.col("o_orderkey") % 5).alias("part")).agg(F.max(F.col("o_orderkey") % 50 + 1).cast("string").alias("value"))
    return grading.parts(given, key, ["ex"], numeric=True).withColumn("score", F.round("score", 6))


@query("""WITH k AS (SELECT p_partkey % 20 AS ex, p_partkey // 20 AS place, p_size % 5 AS item FROM part WHERE p_partkey < 100), g AS (SELECT o_custkey % 20 AS ex, o_custkey AS attempt, o_orderkey AS place, o_orderkey % 5 AS item FROM orders),
kw AS (SELECT *, lead(item) OVER w AS nxt, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY ex ORDER BY place)), gw AS (SELECT *, lead(item) OVER w AS nxt, row_number() OVER w AS n FROM g WINDOW w AS (PARTITION BY ex, attempt ORDER BY place)), t AS (SELECT DISTINCT ex, attempt FROM g),
s AS (SELECT t.ex, t.attempt, count(f.item) / count(*) AS share FROM t JOIN (SELECT DISTINCT ex, item, nxt FROM kw WHERE nxt IS NOT NULL) p ON p.ex = t.ex LEFT JOIN (SELECT DISTINCT ex, attempt, item, nxt FROM gw WHERE nxt IS NOT NULL) f ON f.ex = t.ex AND f.attempt = t.attempt AND f.item = p.item AND f.nxt = p.nxt GROUP BY ALL),
q AS (SELECT ex, attempt, string_agg(item::VARCHAR, ',' ORDER BY place) AS own FROM g GROUP BY ALL), z AS (SELECT ex, string_agg(item::VARCHAR, ',' ORDER BY place) AS want FROM k GROUP BY ALL)
SELECT t.ex, t.attempt, round(coalesce(share, 1.0), 6) AS score, own = want AS passed FROM t LEFT JOIN s ON s.ex = t.ex AND s.attempt = t.attempt JOIN q ON q.ex = t.ex AND q.attempt = t.attempt JOIN z ON z.ex = t.ex""")
def graded_orders(spark, sf_dir):
    """Sequences graded by the neighbours that they have in common with the key."""
    from plumbline.operators import grading

    k = F.col("p_partkey")
    key = table(spark, sf_dir, "part").where("p_partkey < 100").select((k % 20).alias("ex"), F.expr("p_partkey div 20").alias("place"), (F.col("p_size") % 5).cast("bigint").alias("item"))
    given = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("ex"), F.col("o_custkey").alias("attempt"), F.col("o_orderkey").alias("place"), (F.col("o_orderkey") % 5).alias("item"))
    return grading.orders(given, key, ["ex"]).withColumn("score", F.round("score", 6))


@query("""WITH k AS (SELECT DISTINCT p_partkey % 20 AS ex, p_size % 9 AS item FROM part WHERE p_partkey < 100), g AS (SELECT DISTINCT o_custkey % 20 AS ex, o_custkey AS attempt, o_orderkey % 9 AS item FROM orders), t AS (SELECT DISTINCT ex, attempt FROM g),
w AS (SELECT t.ex, t.attempt, k.item FROM t JOIN k ON k.ex = t.ex), j AS (SELECT coalesce(w.ex, g.ex) AS ex, coalesce(w.attempt, g.attempt) AS attempt, w.item AS want, g.item AS got FROM w FULL JOIN g ON g.ex = w.ex AND g.attempt = w.attempt AND g.item = w.item)
SELECT ex, attempt, round(count(*) FILTER (want = got) / count(*), 6) AS score, count(*) FILTER (want = got) >= 0.5 * count(*) AS passed, count(*) FILTER (got IS NULL) AS missed, count(*) FILTER (want IS NULL) AS extra FROM j GROUP BY ALL""")
def graded_choices(spark, sf_dir):
    """Sets of marks graded by what they share with the key, passed from half."""
    from plumbline.operators import grading

    key = table(spark, sf_dir, "part").where("p_partkey < 100").select((F.col("p_partkey") % 20).alias("ex"), (F.col("p_size") % 9).cast("bigint").alias("item"))
    given = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("ex"), F.col("o_custkey").alias("attempt"), (F.col("o_orderkey") % 9).alias("item"))
    return grading.sets(given, key, ["ex"], 0.5).withColumn("score", F.round("score", 6))


@query("""WITH r AS (SELECT o_custkey % 20 AS ex, o_custkey AS attempt, o_orderkey % 2 AS run, o_orderkey AS place, (o_orderkey % 40) * 3 AS x, (o_orderkey % 30) * 4 AS y FROM orders), l AS (SELECT *, sqrt(((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2)::DOUBLE) AS leg FROM r WINDOW w AS (PARTITION BY ex, attempt, run ORDER BY place)),
d AS (SELECT ex, attempt, sum(coalesce(leg, 0)) * 0.5 AS metres FROM l GROUP BY ALL), k AS (SELECT DISTINCT p_partkey % 20 AS ex, 100.0::DOUBLE + 20 * (p_partkey % 20) AS want FROM part WHERE p_partkey < 20)
SELECT d.ex, attempt, round(metres, 6) AS metres, round(CASE WHEN abs(metres - want) / want <= 0.1 THEN 1.0 ELSE greatest(0.0, 1 - abs(metres - want) / want / 0.5) END, 6)::DOUBLE AS score, abs(metres - want) / want <= 0.1 AS passed FROM d JOIN k USING (ex)""")
def graded_lengths(spark, sf_dir):
    """Drawn runs summed in the scale and graded by how far off they are."""
    from plumbline.operators import grading

    o = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("ex"), F.col("o_custkey").alias("attempt"), (o % 2).alias("run"), o.alias("place"), (o % 40 * 3).alias("x"), (o % 30 * 4).alias("y"))
    key = table(spark, sf_dir, "part").where("p_partkey < 20").select((F.col("p_partkey") % 20).alias("ex"), (100.0 + 20 * (F.col("p_partkey") % 20)).alias("metres"), F.lit(0.5).alias("m_per_unit"), F.lit(0.1).alias("tolerance"))
    return grading.lengths(runs, key, ["ex"])
