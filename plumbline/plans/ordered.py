"""Queries over an order: latest rows, islands, windows, rankings, replayed edits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import choose, edits, interval
from plumbline.plans.base import query, table


@query("""SELECT o_custkey AS drawing, o_orderkey AS reading, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_reading(spark, sf_dir):
    """The newest reading of each drawing, by date, then id."""
    o = choose.latest(table(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return o.select(F.col("o_custkey").alias("drawing"), F.col("o_orderkey").alias("reading"), F.col("o_orderstatus").alias("status"))


@query("""WITH c AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_type = 'signup' GROUP BY user_id), s AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY user_id), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id AS page, coalesce(c.v, s.v) AS scale, CASE WHEN c.v IS NOT NULL THEN 'CALIBRATED' WHEN s.v IS NOT NULL THEN 'READ' ELSE 'NONE' END AS source FROM u LEFT JOIN c USING (user_id) LEFT JOIN s USING (user_id)""")
def page_calibration(spark, sf_dir):
    """The newest calibration beats the scale that was read, which beats none."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.col("user_id").alias("page")).agg(F.max_by(F.when(F.col("event_type") == "signup", F.col("value")), F.when(F.col("event_type") == "signup", F.struct("ts", "event_id"))).alias("c"), F.max(F.when(F.col("event_type") == "view", F.col("value"))).alias("s"))
    return g.select("page", F.coalesce("c", "s").alias("scale"), F.when(F.col("c").isNotNull(), "CALIBRATED").when(F.col("s").isNotNull(), "READ").otherwise("NONE").alias("source"))


@query("""SELECT l_partkey AS drawing, l_returnflag AS layer, max(l_linenumber) + 1 AS next FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL""")
def next_number(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("drawing"), F.col("l_returnflag").alias("layer")).agg((F.max("l_linenumber") + 1).alias("next"))


@query("""WITH s AS (SELECT l_partkey AS run, l_suppkey AS lo, l_suppkey + CAST(l_quantity AS BIGINT) AS hi FROM lineitem), f AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY run ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY run ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM f), u AS (SELECT run, island, max(hi) - min(lo) AS len FROM i GROUP BY ALL)
SELECT run, sum(len)::BIGINT AS covered, count(*) AS islands FROM u GROUP BY run""")
def interval_union(spark, sf_dir):
    """The length that the intervals of a run cover together."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("run"), F.col("l_suppkey").alias("lo"), (F.col("l_suppkey") + F.col("l_quantity").cast("bigint")).alias("hi"))
    return interval.union_length(s, ["run"], "lo", "hi")


@query("""WITH c AS (SELECT l_suppkey AS edge, l_partkey AS x, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_partkey RANGE BETWEEN CURRENT ROW AND 40 FOLLOWING) AS n FROM lineitem)
SELECT edge, min(x) AS start, any_value(n) AS points FROM (SELECT *, max(n) OVER (PARTITION BY edge) AS top FROM c) WHERE n = top GROUP BY edge""")
def densest_window(spark, sf_dir):
    """Where the 40 wide window with most points begins."""
    return interval.densest_window(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("edge"), F.col("l_partkey").alias("x")), ["edge"], "x", 40)


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS pen, l_partkey AS x FROM lineitem), g AS (SELECT pen, lead(x) OVER (PARTITION BY pen ORDER BY x) - x AS gap FROM d) SELECT pen, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL""")
def consecutive_gaps(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pen"), F.col("l_partkey").alias("x")).distinct()
    return d.withColumn("gap", F.lead("x").over(W.partitionBy("pen").orderBy("x")) - F.col("x")).where("gap IS NOT NULL").groupBy("pen", "gap").agg(F.count("*").alias("n"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS heading FROM events""")
def heading_carry_forward(spark, sf_dir):
    """The last heading above each row."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), True).over(w).alias("heading"))


@query("""WITH f AS (SELECT l_suppkey AS family, l_returnflag AS pen, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(least(n, 250)) OVER (PARTITION BY pen ORDER BY n DESC, family ROWS UNBOUNDED PRECEDING) AS used FROM f) SELECT pen, family, n, used::BIGINT AS used FROM r WHERE used <= 5000""")
def ranked_with_budget(spark, sf_dir):
    """Families by size while the budget lasts; none counts for more than the cap."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("family"), F.col("l_returnflag").alias("pen")).agg(F.count("*").alias("n"))
    w = W.partitionBy("pen").orderBy(F.desc("n"), "family").rowsBetween(W.unboundedPreceding, W.currentRow)
    return f.withColumn("used", F.sum(F.least("n", F.lit(250))).over(w)).where("used <= 5000").select("pen", "family", "n", "used")


@query("""SELECT reason, n FROM (SELECT p_type || ' ' || p_size AS reason, count(*) AS n FROM part GROUP BY ALL) ORDER BY n DESC, reason LIMIT 8""")
def top_reasons(spark, sf_dir):
    """A top eight; ties go by name."""
    return table(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_type", "p_size").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(8)


@query("""WITH r AS (SELECT l_suppkey // 5 AS sheet, l_orderkey * 10 + l_linenumber AS item, row_number() OVER (PARTITION BY l_suppkey // 5 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey // 5) AS n FROM lineitem), k AS (SELECT sheet, n, unnest(range(900)) AS k FROM (SELECT DISTINCT sheet, n FROM r))
SELECT sheet, item, i::BIGINT AS place FROM r JOIN k USING (sheet) WHERE i = k.k * r.n // 900 AND r.n > 900 UNION ALL SELECT sheet, item, i::BIGINT FROM r WHERE n <= 900""")
def thinned_items(spark, sf_dir):
    """Nine hundred items of each sheet that has more, evenly spaced; all items of the others."""
    r = table(spark, sf_dir, "lineitem").withColumn("sheet", F.expr("l_suppkey div 5"))
    w = W.partitionBy("sheet").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    r = r.withColumn("place", (F.row_number().over(w) - 1).cast("bigint"))
    return choose.thinned(r, ["sheet"], 900, F.col("place")).select("sheet", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), "place")


@query("""WITH d AS (SELECT o_orderkey AS id, o_custkey AS number, o_orderpriority AS discipline, nullif(o_orderstatus, 'P') AS revision, o_orderdate AS dated FROM orders)
SELECT a.id AS older, b.id AS newer, CASE WHEN a.revision <> b.revision THEN 'revision' ELSE 'date' END AS reason, CASE WHEN a.revision <> b.revision THEN 90 ELSE 80 END AS confidence
FROM d a JOIN d b USING (number, discipline) WHERE a.id <> b.id AND CASE WHEN a.revision IS NOT NULL AND b.revision IS NOT NULL AND a.revision <> b.revision THEN a.revision < b.revision ELSE a.dated < b.dated END""")
def version_pairs(spark, sf_dir):
    """Pairs of versions of one sheet in one discipline that can be ordered: by revision, else by date."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("number"), F.col("o_orderpriority").alias("discipline"), F.nullif("o_orderstatus", F.lit("P")).alias("revision"), F.col("o_orderdate").alias("dated"))
    a, b = d.select(*[F.col(c).alias(f"a_{c}") for c in d.columns]), d.select(*[F.col(c).alias(f"b_{c}") for c in d.columns])
    differ = F.coalesce(F.col("a_revision") != F.col("b_revision"), F.lit(False))
    j = a.join(b, (F.col("a_number") == F.col("b_number")) & (F.col("a_discipline") == F.col("b_discipline")) & (F.col("a_id") != F.col("b_id")))
    return j.where(F.when(differ, F.col("a_revision") < F.col("b_revision")).otherwise(F.col("a_dated") < F.col("b_dated"))).select(F.col("a_id").alias("older"), F.col("b_id").alias("newer"), F.when(differ, "revision").otherwise("date").alias("reason"), F.when(differ, 90).otherwise(80).alias("confidence"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN -CAST(round(value) AS BIGINT) WHEN 'purchase' THEN CAST(round(value) AS BIGINT) ELSE 0 END AS delta, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('error', 'purchase')),
f AS (SELECT user_id, n, greatest(0, delta) AS metres, CASE WHEN delta < 0 THEN 1 ELSE 0 END AS clamped FROM e WHERE n = 1 UNION ALL SELECT f.user_id, e.n, greatest(0, f.metres + e.delta), f.clamped + CASE WHEN f.metres + e.delta < 0 THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, arg_max(metres, n)::BIGINT AS metres, max(clamped)::BIGINT AS clamped, max(n)::BIGINT AS edits FROM f GROUP BY user_id""")
def replayed_edits(spark, sf_dir):
    """Metres after all corrections of a document in order; erasing more than there is leaves zero."""
    e = table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')")
    delta = F.round("value").cast("bigint") * F.when(F.col("event_type") == "error", -1).otherwise(1)
    return edits.clamped_fold(e.select("user_id", "ts", "event_id", delta.alias("delta")), ["user_id"], ["ts", "event_id"], "delta").select("user_id", "metres", "clamped", "edits")


@query("""WITH e AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, ts, event_id AS seen FROM events WHERE event_type = 'view')
SELECT e.event_id, e.user_id, max(seen) AS seen FROM e LEFT JOIN p ON p.user_id = e.user_id AND p.ts <= e.ts AND NOT EXISTS (SELECT 1 FROM p q WHERE q.user_id = e.user_id AND q.ts <= e.ts AND q.ts > p.ts) GROUP BY ALL""")
def as_of_view(spark, sf_dir):
    """The last view before each purchase: an as-of join."""
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen"))
    return interval.as_of(left, right, ["user_id"], "ts", ["seen"]).select("event_id", "user_id", "seen")


@query("""SELECT o_custkey AS sheet, count(*) AS revisions, max(o_orderkey) AS head, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY o_custkey""")
def revision_history(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sheet")).agg(F.count("*").alias("revisions"), F.max("o_orderkey").alias("head"), F.countDistinct("o_orderstatus").alias("states"))
