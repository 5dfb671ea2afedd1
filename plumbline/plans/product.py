"""Product analytics and money over events: experiments, heatmaps, funnels, ledgers. Money is in whole hundredths."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import choose, takeoff
from plumbline.plans.base import query, table

VARIANT = "CASE WHEN ('0x' || substr(sha256('exp:' || user_id), 1, 8))::BIGINT / 4294967295 < 0.5 THEN 'B' ELSE 'A' END"


def bounds(hits, n):
    """Wilson's 95 per cent interval in thousandths."""
    z, p = 1.96, hits / n
    mid, half, below = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.floor((mid - half) / below * 1000 + 0.5), F.floor((mid + half) / below * 1000 + 0.5)


@query(f"""WITH s AS (SELECT DISTINCT user_id || '-' || date_trunc('day', ts)::DATE AS session, {VARIANT} AS variant, user_id, date_trunc('day', ts) AS d FROM events WHERE event_type = 'view'),
g AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS d FROM events WHERE event_type = 'purchase'), c AS (SELECT variant, count(*)::DOUBLE AS n, count(g.user_id)::DOUBLE AS k FROM s LEFT JOIN g ON s.user_id = g.user_id AND s.d = g.d GROUP BY variant)
SELECT variant, n::BIGINT AS exposed, k::BIGINT AS converted, CAST(floor((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n) * 1000 + 0.5) AS BIGINT) AS low, CAST(floor((k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n) * 1000 + 0.5) AS BIGINT) AS high FROM c""")
def experiment_readout(spark, sf_dir):
    """Sessions exposed and converted per variant, with Wilson bounds."""
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    seen = e.where("event_type = 'view'").select("user_id", "d", T.variant("exp", F.col("user_id").cast("string"), 0.5).alias("variant")).distinct()
    goal = e.where("event_type = 'purchase'").select("user_id", "d", F.lit(1).alias("goal")).distinct()
    c = seen.join(goal, ["user_id", "d"], "left").groupBy("variant").agg(F.count("*").alias("exposed"), F.count("goal").alias("converted"))
    low, high = bounds(F.col("converted").cast("double"), F.col("exposed").cast("double"))
    return c.select("variant", "exposed", "converted", low.alias("low"), high.alias("high"))


@query("""SELECT least(19, greatest(0, CAST(floor(least(1, greatest(0, value / 100)) * 20) AS INT))) AS col, least(9, greatest(0, CAST(floor(CAST(props->>'$.k' AS INT) / 100.0 * 10) AS INT))) AS row, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY ALL""")
def click_heatmap(spark, sf_dir):
    """Clicks in a grid of 20 by 10; places outside are clamped to its edge."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))
    y = F.get_json_object("props", "$.k").cast("int") / F.lit(100.0)
    bin_of = lambda v, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(v * n).cast("int")))
    return table(spark, sf_dir, "events").where("event_type = 'click'").groupBy(bin_of(x, 20).alias("col"), bin_of(y, 10).alias("row")).agg(F.count("*").alias("clicks"))


@query("""SELECT CAST(props->>'$.k' AS INT) AS path, count(*) AS clicks FROM events WHERE event_type = 'click' AND coalesce(props->>'$.k', '') <> '' GROUP BY ALL""")
def clicks_per_path(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'click'").groupBy(F.get_json_object("props", "$.k").cast("int").alias("path")).agg(F.count("*").alias("clicks")).where("path IS NOT NULL")


@query("""SELECT event_id, user_id, event_type, CAST(round(least(1, greatest(0, value / 100)) * 10000) AS BIGINT) AS x FROM events WHERE event_type IN ('click', 'view', 'purchase')""")
def accepted_events(spark, sf_dir):
    """Events of known names, their place clamped to the page; unknown names are dropped."""
    from plumbline.streaming.events import accepted

    return accepted(table(spark, sf_dir, "events")).select("event_id", "user_id", "event_type", F.round(F.col("x") * 10000).cast("bigint").alias("x"))


@query("""SELECT date_trunc('day', ts)::DATE AS day, count(*) FILTER (event_type = 'view') AS readings, count(*) FILTER (event_type = 'error') AS failed, count(DISTINCT user_id) AS owners, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY ALL""")
def daily_timeline(spark, sf_dir):
    """Per day; days without events are not there."""
    of = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(of("view").alias("readings"), of("error").alias("failed"), F.countDistinct("user_id").alias("owners"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


@query("""WITH p AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'purchase') AS b, list_sort(list(CAST(round(value * 100) AS BIGINT))) AS v FROM events GROUP BY user_id)
SELECT user_id AS owner, s AS started, b AS finished, v[len(v) // 2 + 1] AS median FROM p""")
def owner_overview(spark, sf_dir):
    """Per owner what was started and finished, and the upper median."""
    of = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("owner")).agg(of("signup").alias("started"), of("purchase").alias("finished"), takeoff.upper_median(F.round(F.col("value") * 100).cast("bigint")).alias("median"))


@query("""WITH k AS (SELECT CAST(props->>'$.k' AS INT) % 10 AS course, event_type, user_id FROM events), n AS (SELECT course, event_type AS step, count(*) AS stuck FROM k WHERE event_type <> 'purchase' GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY stuck DESC, step) AS rank FROM n),
c AS (SELECT course, count(DISTINCT user_id) AS people, count(*) FILTER (event_type = 'purchase') AS completed FROM k GROUP BY course) SELECT course, people, completed, step, stuck, rank FROM c JOIN t USING (course) WHERE rank <= 2""")
def course_funnel(spark, sf_dir):
    """Per course people, completions and the two steps where most are stuck."""
    k = table(spark, sf_dir, "events").withColumn("course", F.get_json_object("props", "$.k").cast("int") % 10)
    c = k.groupBy("course").agg(F.countDistinct("user_id").alias("people"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("completed"))
    n = k.where("event_type <> 'purchase'").groupBy("course", F.col("event_type").alias("step")).agg(F.count("*").alias("stuck"))
    return c.join(choose.top_k(n, ["course"], 2, F.desc("stuck"), F.col("step")), "course")


@query("""WITH m AS (SELECT max(ts) AS now FROM events), e AS (SELECT event_type, ts >= now - INTERVAL 7 DAY AS week, ts >= now - INTERVAL 15 DAY AS half FROM events, m)
SELECT event_type || ' this week' AS item, count(*) AS n FROM e WHERE week GROUP BY ALL UNION ALL SELECT event_type || ' this half', count(*) FROM e WHERE half AND event_type = 'error' GROUP BY ALL""")
def attention_queue(spark, sf_dir):
    """What wants attention within windows of time; only what is not zero."""
    e = table(spark, sf_dir, "events")
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("now"))))
    week = e.where(F.expr("ts >= now - INTERVAL 7 DAYS")).groupBy(F.concat("event_type", F.lit(" this week")).alias("item")).agg(F.count("*").alias("n"))
    half = e.where(F.expr("ts >= now - INTERVAL 15 DAYS AND event_type = 'error'")).groupBy(F.concat("event_type", F.lit(" this half")).alias("item")).agg(F.count("*").alias("n"))
    return week.unionByName(half)


LEDGER = "l AS (SELECT event_id, user_id AS owner, ts, CASE event_type WHEN 'purchase' THEN 'charge' WHEN 'error' THEN 'refund' ELSE 'credit' END AS kind, CAST(props->>'$.k' AS INT) AS ref, CAST(round(value * 100) AS BIGINT) * CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END AS cents FROM events)"


def ledger(spark, sf_dir):
    t = F.col("event_type")
    kind = F.when(t == "purchase", "charge").when(t == "error", "refund").otherwise("credit")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("owner"), "ts", kind.alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("ref"), (F.round(F.col("value") * 100).cast("bigint") * F.when(t == "purchase", -1).otherwise(1)).alias("cents"))


@query(f"WITH {LEDGER} SELECT owner, sum(cents)::BIGINT AS balance, count(*) AS entries FROM l GROUP BY owner")
def ledger_balance(spark, sf_dir):
    """A balance is the sum of its entries; none is stored."""
    return ledger(spark, sf_dir).groupBy("owner").agg(F.sum("cents").alias("balance"), F.count("*").alias("entries"))


@query(f"WITH {LEDGER}, c AS (SELECT owner, ref, min(event_id) AS charge, sum(cents)::BIGINT AS cents FROM l WHERE kind = 'charge' GROUP BY ALL) SELECT owner, ref, charge, -cents AS refund FROM c WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.kind = 'refund' AND l.owner = c.owner AND l.ref = c.ref)")
def refunds_due(spark, sf_dir):
    """Charges that were not refunded yet; a reference is refunded once at most."""
    l = ledger(spark, sf_dir)
    c = l.where("kind = 'charge'").groupBy("owner", "ref").agg(F.min("event_id").alias("charge"), F.sum("cents").alias("cents"))
    return c.join(l.where("kind = 'refund'").select("owner", "ref"), ["owner", "ref"], "left_anti").select("owner", "ref", "charge", (-F.col("cents")).alias("refund"))


@query(f"""WITH {LEDGER}, r AS (SELECT *, sum(cents) OVER (PARTITION BY owner ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT owner, count(*) FILTER (kind = 'charge' AND run < 0) AS refused, min(run)::BIGINT AS lowest FROM r GROUP BY owner""")
def charges_without_cover(spark, sf_dir):
    """Charges that the balance before them does not cover."""
    from pyspark.sql import Window as W

    r = ledger(spark, sf_dir).withColumn("run", F.sum("cents").over(W.partitionBy("owner").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)))
    return r.groupBy("owner").agg(F.count(F.when((F.col("kind") == "charge") & (F.col("run") < 0), 1)).alias("refused"), F.min("run").alias("lowest"))


@query("""SELECT o_custkey AS partner, sum(CASE WHEN date_diff('month', TIMESTAMP '1995-01-01', o_orderdate) BETWEEN 0 AND 35 AND o_orderstatus <> 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) // 10 ELSE 0 END)::BIGINT AS commission_c, count(*) AS sales FROM orders GROUP BY o_custkey""")
def partner_commission(spark, sf_dir):
    """A tenth of active sales within 36 whole months."""
    months = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    cents = F.expr("cast(round(o_totalprice * 100) as bigint) div 10")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("partner")).agg(F.sum(F.when(months.between(0, 35) & (F.col("o_orderstatus") != "P"), cents).otherwise(F.lit(0))).alias("commission_c"), F.count("*").alias("sales"))


@query("""SELECT l_orderkey AS drawing, count(*) AS pages, sum(CASE WHEN l_quantity <= 10 THEN 100 WHEN l_quantity <= 30 THEN 180 ELSE 260 END + least(3, CAST(l_extendedprice AS BIGINT) // 20000) * 25)::BIGINT AS price FROM lineitem GROUP BY l_orderkey""")
def price_quote(spark, sf_dir):
    """Pages by size class, with capped steps for their ink."""
    band = F.when(F.col("l_quantity") <= 10, 100).when(F.col("l_quantity") <= 30, 180).otherwise(260)
    steps = F.least(F.lit(3), F.floor(F.round("l_extendedprice") / 20000))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("drawing")).agg(F.count("*").alias("pages"), F.sum(band + steps * 25).alias("price"))


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) <= 3600 * 4 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, count(DISTINCT n) AS sessions, count(*) AS events FROM s GROUP BY user_id""")
def sessions(spark, sf_dir):
    """Sessions that end with a gap of four hours."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = lambda c: F.unix_seconds(F.date_trunc("second", c).cast("timestamp"))
    e = table(spark, sf_dir, "events").withColumn("_gap", seconds(F.col("ts")) - seconds(F.lag("ts").over(w)))
    return e.groupBy("user_id").agg(F.count(F.when(F.col("_gap").isNull() | (F.col("_gap") > 3600 * 4), 1)).alias("sessions"), F.count("*").alias("events"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    """One-day windows, the same code as on a stream."""
    from plumbline.streaming.events import daily

    return daily(table(spark, sf_dir, "events"))
