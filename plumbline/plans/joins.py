"""Joins: spatial, nearest, mutual, one-to-one, diffs, semi and anti."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import choose, interval, spatial
from plumbline.plans.base import query, table

#: How the tables stand for a drawing's plane: a part is a box or label, a supplier an anchor.
BOXES = "b AS (SELECT p_partkey AS id, p_partkey % 500 AS x0, (p_partkey * 7) % 300 AS y0, p_partkey % 500 + p_size % 9 AS x1, (p_partkey * 7) % 300 + p_size % 5 AS y1, p_type AS pen FROM part)"
ANCHORS = "a AS (SELECT s_suppkey AS id, (s_suppkey * 37) % 500 AS x, (s_suppkey * 13) % 300 AS y FROM supplier)"


def boxes(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(k.alias("id"), (k % 500).alias("x0"), ((k * 7) % 300).alias("y0"), (k % 500 + s % 9).alias("x1"), ((k * 7) % 300 + s % 5).alias("y1"), F.col("p_type").alias("pen"))


def anchors(spark, sf_dir):
    k = F.col("s_suppkey")
    x, y = (k * 37) % 500, (k * 13) % 300
    return table(spark, sf_dir, "supplier").select(k.alias("id"), x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"))


@query(f"""WITH {BOXES} SELECT l.id AS id, r.id AS other FROM b l JOIN b r ON l.pen = r.pen AND l.id < r.id AND l.x0 <= r.x1 AND r.x0 <= l.x1 AND l.y0 <= r.y1 AND r.y0 <= l.y1""")
def overlapping_boxes(spark, sf_dir):
    """Boxes of one pen that overlap: a grid join with an exact predicate."""
    b = boxes(spark, sf_dir)
    return spatial.box_join(b, b, 16, by=("pen",)).where("id < r_id").select("id", F.col("r_id").alias("other"))


@query(f"""WITH {BOXES}, {ANCHORS}, d AS (SELECT b.id AS label, a.id AS anchor, greatest(b.x0 - a.x, a.x - b.x1, 0) ** 2 + greatest(b.y0 - a.y, a.y - b.y1, 0) ** 2 AS d FROM b JOIN a ON a.x BETWEEN b.x0 - 15 AND b.x1 + 15 AND a.y BETWEEN b.y0 - 15 AND b.y1 + 15),
m AS (SELECT *, min(d) OVER (PARTITION BY label) AS least FROM d) SELECT label, anchor, CAST(d AS BIGINT) AS distance2, count(*) OVER (PARTITION BY label) AS tied FROM m WHERE d = least""")
def nearest_anchor(spark, sf_dir):
    """The anchor nearest to each label within reach; ties stay ties. Boxes and places are compared once each, and only what is nearest is joined with its anchors."""
    labels, box = boxes(spark, sf_dir), list(spatial.BOX)
    at = anchors(spark, sf_dir).select("id", F.col("x0").alias("ax"), F.col("y0").alias("ay"))
    places = at.groupBy("ax", "ay").agg(F.count("*").alias("n")).select("*", F.col("ax").alias("x0"), F.col("ay").alias("y0"), F.col("ax").alias("x1"), F.col("ay").alias("y1"))
    p = spatial.box_join(labels.select(*box).distinct(), places, 32, reach=15)
    dx, dy = F.greatest(F.col("x0") - F.col("r_x0"), F.col("r_x0") - F.col("x1"), F.lit(0)), F.greatest(F.col("y0") - F.col("r_y0"), F.col("r_y0") - F.col("y1"), F.lit(0))
    near = spatial.nearest(p, box, dx * dx + dy * dy, []).select(*box, F.col("distance").alias("d"), F.col("r_ax").alias("ax"), F.col("r_ay").alias("ay"), F.col("r_n").alias("n"))
    own = spatial.nearest(labels.select(F.col("id").alias("label"), *box).join(near, box), ["label"], F.col("d"), [])
    tied = own.withColumn("tied", F.sum("n").over(W.partitionBy("label"))).select("label", F.col("distance").cast("bigint").alias("distance2"), "tied", "ax", "ay")
    return spatial.met_by_place(tied, at, ["ax", "ay"]).select("label", F.col("id").alias("anchor"), "distance2", "tied")


ENDS = "e AS (SELECT p_partkey AS id, (p_partkey * 31) % 997 AS x, p_type AS pen FROM part), c AS (SELECT l.id AS a, r.id AS b, abs(l.x - r.x) AS d FROM e l JOIN e r ON l.pen = r.pen AND l.id <> r.id AND abs(l.x - r.x) <= 6), n AS (SELECT a, arg_min(b, (d, b)) AS b FROM c GROUP BY a)"


def named(spark, sf_dir):
    """What end each free end names: the nearest of its pen within a gap. Of a place only its two least ends can be named, so places are paired and not ends."""
    k = F.col("p_partkey")
    e = table(spark, sf_dir, "part").select(k.alias("id"), ((k * 31) % 997).alias("x"), F.col("p_type").alias("pen")).dropna().distinct()
    two = choose.top_k(e, ["pen", "x"], 2, F.col("id")).groupBy("pen", "x").agg(F.min("id").alias("first"), F.max(F.when(F.col("rank") == 2, F.col("id"))).alias("second"))
    place = two.select("pen", "x", "first", F.col("x").alias("x0"), F.lit(0).alias("y0"), F.col("x").alias("x1"), F.lit(0).alias("y1"))
    around = spatial.box_join(place, place, 12, by=("pen",), reach=6).where("x <> r_x").groupBy("pen", "x").agg(F.min(F.struct(F.abs(F.col("x") - F.col("r_x")).alias("d"), F.col("r_first").alias("b"))).alias("beside"))
    here = F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    c = e.join(two, ["pen", "x"]).join(around, ["pen", "x"], "left")
    c = c.select(F.col("id").alias("a"), F.when(here.isNotNull(), F.struct((F.col("x") - F.col("x")).alias("d"), here.alias("b"))).otherwise(F.col("beside")).alias("n")).where("n IS NOT NULL")
    return c.groupBy("a").agg(F.min("n").alias("n")).select("a", F.col("n.b").alias("b"))


@query(f"WITH {ENDS} SELECT n.a, n.b FROM n JOIN n m ON n.b = m.a AND m.b = n.a WHERE n.a < n.b")
def mutual_nearest(spark, sf_dir):
    """Ends that name each other bridge a gap."""
    return spatial.mutual(named(spark, sf_dir), "a", "b")


@query(f"WITH {ENDS}, k AS (SELECT b, count(*) AS claims FROM n GROUP BY b) SELECT n.a, n.b FROM n JOIN k USING (b) WHERE claims = 1 AND NOT EXISTS (SELECT 1 FROM n m WHERE m.a = n.b AND m.b = n.a)")
def uncontested_claims(spark, sf_dir):
    """Claims that are not returned but that nobody contests."""
    n = named(spark, sf_dir)
    alone = n.withColumn("_k", F.count("*").over(W.partitionBy("b"))).where("_k = 1").select("a", "b")
    return alone.join(n.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")


@query("""WITH p AS (SELECT DISTINCT l_orderkey * 100 + CAST(l_quantity AS BIGINT) AS a, l_partkey * 100 + CAST(l_quantity AS BIGINT) AS b FROM lineitem)
SELECT a, b FROM (SELECT *, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM p) WHERE na = 1 AND nb = 1""")
def one_to_one_match(spark, sf_dir):
    """Rows and groups that have only each other."""
    p = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_quantity").cast("bigint")).alias("a"), (F.col("l_partkey") * 100 + F.col("l_quantity").cast("bigint")).alias("b"))
    return choose.one_to_one(p, "a", "b")


@query("""WITH w AS (SELECT l_orderkey AS block, l_suppkey AS run, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY block) AS top FROM w), c AS (SELECT block, list_sort(list(run)) AS candidates FROM t WHERE n = top GROUP BY block)
SELECT block, CASE WHEN len(candidates) = 1 THEN 'CONFIRMED' ELSE 'AMBIGUOUS' END AS state, CASE WHEN len(candidates) = 1 THEN candidates[1] END AS run, candidates FROM c""")
def decided_owner(spark, sf_dir):
    """The run with most claims on a block, or all that tie."""
    return choose.decided(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block"), F.col("l_suppkey").alias("run")), ["block"], "run", F.count("*"))


@query("""SELECT s_suppkey AS layer, min_by(code, rank * 100 + length(code)) AS code, min(rank) AS rank FROM (SELECT s_suppkey, code, CASE WHEN s_name = code THEN 0 WHEN ends_with(s_name, code) THEN 1 WHEN contains(s_name, code) THEN 2 END AS rank FROM supplier, (VALUES ('07'), ('7'), ('Supplier#000000003')) c(code)) WHERE rank IS NOT NULL GROUP BY ALL""")
def best_rank(spark, sf_dir):
    """The code that fits a layer's name best: exact, at its end, anywhere."""
    codes = spark.createDataFrame([("07",), ("7",), ("Supplier#000000003",)], "code string")
    rank = F.when(F.col("s_name") == F.col("code"), 0).when(F.expr("endswith(s_name, code)"), 1).when(F.expr("contains(s_name, code)"), 2)
    j = table(spark, sf_dir, "supplier").join(F.broadcast(codes), F.expr("contains(s_name, code)")).withColumn("rank", rank)
    return j.groupBy(F.col("s_suppkey").alias("layer")).agg(F.min_by("code", F.col("rank") * 100 + F.length("code")).alias("code"), F.min("rank").alias("rank"))


@query("""WITH s AS (SELECT DISTINCT l_partkey AS pen, least(l_suppkey, l_suppkey + l_linenumber - 4) AS lo, greatest(l_suppkey, l_suppkey + l_linenumber - 4) AS hi, CAST(round(l_discount * 100) AS INT) AS y FROM lineitem) SELECT pen, count(*) AS segments, sum(hi - lo)::BIGINT AS ink FROM s GROUP BY pen""")
def distinct_segments(spark, sf_dir):
    """Segments without exact repeats, whichever way they were drawn."""
    a, b = F.col("l_suppkey"), F.col("l_suppkey") + F.col("l_linenumber") - 4
    s = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pen"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.round(F.col("l_discount") * 100).cast("int").alias("y")).distinct()
    return s.groupBy("pen").agg(F.count("*").alias("segments"), F.sum(F.col("hi") - F.col("lo")).alias("ink"))


@query("""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS pen, l_suppkey AS lo, l_suppkey + CAST(l_quantity AS BIGINT) AS hi FROM lineitem)
SELECT a.id, max(least(a.hi, b.hi) - greatest(a.lo, b.lo))::BIGINT AS shared FROM s a JOIN s b ON a.pen = b.pen AND b.id < a.id AND least(a.hi, b.hi) > greatest(a.lo, b.lo) GROUP BY a.id""")
def duplicate_overlaps(spark, sf_dir):
    """How much of a segment an earlier one of its pen already covers; reported, not taken off."""
    s = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("pen"), F.col("l_suppkey").alias("lo"), (F.col("l_suppkey") + F.col("l_quantity").cast("bigint")).alias("hi"))
    b = s.select(F.col("id").alias("b_id"), "pen", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    shared = F.least("hi", "b_hi") - F.greatest("lo", "b_lo")
    return s.join(b, "pen").where((F.col("b_id") < F.col("id")) & (shared > 0)).groupBy("id").agg(F.max(shared).alias("shared"))


@query("""WITH r AS (SELECT l_partkey AS place, l_suppkey AS reading, max(CAST(l_quantity AS BIGINT)) AS score, min(l_orderkey) AS first FROM lineitem GROUP BY ALL) SELECT place, reading, score FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, first, reading) AS n FROM r) WHERE n = 1""")
def one_reading_per_place(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("place"), F.col("l_suppkey").alias("reading")).agg(F.max(F.col("l_quantity").cast("bigint")).alias("score"), F.min("l_orderkey").alias("first"))
    return choose.latest(r, ["place"], F.desc("score"), F.col("first"), F.col("reading")).select("place", "reading", "score")


@query("""WITH v(name, ord, x0, y0, x1, y1) AS (VALUES ('plan', 1, 0, 0, 250, 150), ('detail', 0, 100, 50, 180, 120), ('legend', 2, 240, 0, 500, 300))
SELECT p_partkey AS id, min_by(name, ord) AS viewport FROM part JOIN v ON p_partkey % 500 BETWEEN x0 AND x1 AND (p_partkey * 7) % 300 BETWEEN y0 AND y1 GROUP BY p_partkey""")
def viewport_of_point(spark, sf_dir):
    """The viewport whose ring holds a point, its edge included; the lowest order wins."""
    ring = lambda x0, y0, x1, y1: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    views = [("plan", 1, ring(0, 0, 250, 150)), ("detail", 0, ring(100, 50, 180, 120)), ("legend", 2, ring(240, 0, 500, 300))]
    x, y = (F.col("p_partkey") % 500).cast("double"), ((F.col("p_partkey") * 7) % 300).cast("double")
    best = F.lit(None).cast("string")
    for name, _, r in sorted(views, key=lambda v: -v[1]):
        best = F.when(G.point_in_ring(x, y, r), name).otherwise(best)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), best.alias("viewport")).where("viewport IS NOT NULL")


DIFF = """b AS (SELECT p_brand || '-' || l_partkey || '-' || l_linenumber AS designation, sum(CAST(l_quantity AS BIGINT)) FILTER (l_shipdate < TIMESTAMP '2000-01-01') AS before, sum(CAST(l_quantity AS BIGINT)) FILTER (l_shipdate >= TIMESTAMP '2000-01-01') AS after FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


@query(f"""WITH {DIFF} SELECT designation, before::BIGINT AS before, after::BIGINT AS after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN abs(after - before) * 20 > before THEN 'changed' ELSE 'unchanged' END AS change FROM b""")
def revision_diff(spark, sf_dir):
    """What changed between two revisions; a change needs five per cent."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    side = lambda c, name: li.where(c).groupBy(F.concat_ws("-", "p_brand", "l_partkey", "l_linenumber").alias("designation")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias(name))
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    j = side(F.col("l_shipdate") < cut, "before").join(side(F.col("l_shipdate") >= cut, "after"), "designation", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.abs(F.col("after") - F.col("before")) * 20 > F.col("before"), "changed").otherwise("unchanged")
    return j.select("designation", "before", "after", change.alias("change"))


@query("""WITH a AS (SELECT l_partkey AS id, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT l_partkey AS id, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT coalesce(a.id, b.id) AS id, (coalesce(b.q, 0) - coalesce(a.q, 0))::BIGINT AS diff FROM a FULL JOIN b ON a.id = b.id WHERE abs(coalesce(b.q, 0) - coalesce(a.q, 0)) > 5""")
def two_file_compare(spark, sf_dir):
    """Two files by name, what a side lacks as zero, small differences left out."""
    li = table(spark, sf_dir, "lineitem")
    side = lambda flag, name: li.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("id")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias(name))
    j = side("A", "a").join(side("R", "b"), "id", "full_outer").select("id", (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("diff"))
    return j.where("abs(diff) > 5")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'removed' WHEN o_orderkey % 5 = 0 THEN 'changed' END AS touched FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0""")
def touched_entities(spark, sf_dir):
    """Entities added, removed or changed between two documents, compared by a hash of all their columns."""
    before = table(spark, sf_dir, "orders")
    after = before.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    h = lambda df, name: df.select(F.col("o_orderkey").alias("id"), F.xxhash64(*df.columns).alias(name))
    j = h(before, "a").join(h(after, "b"), "id", "full_outer")
    return j.select("id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").alias("touched")).where("touched IS NOT NULL")


@query("""SELECT c_custkey AS sheet, c_name AS number FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)""")
def unread_sheets(spark, sf_dir):
    read = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(read, "c_custkey", "left_anti").select(F.col("c_custkey").alias("sheet"), F.col("c_name").alias("number"))


@query("""SELECT p_partkey AS label, p_brand AS designation FROM part WHERE p_size > 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)""")
def labels_without_pipe(spark, sf_dir):
    """Labels with a dimension that never reached a pipe."""
    got = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").where("p_size > 10").join(got, "p_partkey", "left_anti").select(F.col("p_partkey").alias("label"), F.col("p_brand").alias("designation"))


@query("""SELECT p_partkey AS label, p_brand AS designation FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 50)""")
def reached_labels(spark, sf_dir):
    got = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' AND l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(got, "p_partkey", "left_semi").select(F.col("p_partkey").alias("label"), F.col("p_brand").alias("designation"))


@query("""SELECT p_partkey AS part, p_size AS size, CASE WHEN p_size <= 10 THEN 30 WHEN p_size <= 25 THEN 45 WHEN p_size <= 45 THEN 60 END AS minutes FROM part""")
def banded_lookup(spark, sf_dir):
    """The first band whose bound is at least the size; none above the last."""
    return interval.banded(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").alias("size")), [(10, 30), (25, 45), (45, 60)], "size", "minutes")


@query("""WITH m AS (SELECT a.p_partkey AS want, b.p_partkey AS article, b.p_retailprice AS price, CASE WHEN a.p_name = b.p_name THEN 2 WHEN split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) THEN 1 ELSE 0 END AS hits, abs(a.p_size - b.p_size) AS off FROM part a JOIN part b ON a.p_type = b.p_type AND abs(a.p_size - b.p_size) <= 1)
SELECT want, article, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY want ORDER BY hits DESC, price, article) AS rank FROM m) WHERE rank <= 6""")
def article_match(spark, sf_dir):
    """The six best articles for each want: same kind, dimension within one, by words in common, price.

    The six cheapest of each kind and dimension, of those with the second word, and of those with the name hold whatever a want can get: if the narrower
    ones are fewer than six, all of them are there, so what they take from a wider six is no more than they fill themselves. No want meets all articles of its kind.
    """
    order = (F.col("p_retailprice").asc_nulls_last(), F.col("p_partkey").asc_nulls_last())
    p = table(spark, sf_dir, "part").withColumn("second", F.split_part("p_name", F.lit(" "), F.lit(2)))
    kinds = p.select(F.col("p_type").alias("w_type"), F.col("p_size").alias("w_size"), F.col("p_name").alias("w_name"), F.col("second").alias("w_second")).distinct()
    near = kinds.withColumn("off", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("a_size", F.col("w_size") + F.col("off")).drop("off")
    found = None
    for hits, key in ((0, []), (1, ["second"]), (2, ["second", "p_name"])):
        some = choose.top_k(p.dropna(subset=["p_type", "p_size", *key]), ["p_type", "p_size", *key], 6, *order).drop("rank")
        on = (F.col("w_type") == F.col("p_type")) & (F.col("a_size") == F.col("p_size"))
        for c in key:
            on = on & (F.col({"second": "w_second", "p_name": "w_name"}[c]) == F.col(c))
        met = near.join(some, on).withColumn("hits", F.lit(hits))
        if hits < 2:
            met = met.where(~F.coalesce(F.col("w_second") == F.col("second") if hits == 0 else F.col("w_name") == F.col("p_name"), F.lit(False)))
        found = met if found is None else found.unionByName(met)
    kind = ["w_type", "w_size", "w_name"]
    best = choose.top_k(found, kind, 6, F.desc("hits"), *order).select(*kind, "p_partkey", "p_retailprice", "hits")
    same = (F.col("a_type") == F.col("w_type")) & (F.col("a_size") == F.col("w_size")) & F.col("a_name").eqNullSafe(F.col("w_name"))
    wants = p.select(F.col("p_partkey").alias("want"), F.col("p_type").alias("a_type"), F.col("p_size").alias("a_size"), F.col("p_name").alias("a_name")).join(best, same)
    return choose.top_k(wants, ["want"], 6, F.desc("hits"), *order).select("want", F.col("p_partkey").alias("article"), "hits", "rank")


@query("""WITH v AS (SELECT l_orderkey AS pen, p_type AS system, count(*) AS n, count(DISTINCT l_suppkey) AS drawings FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY pen) AS a FROM v)
SELECT pen, arg_max(system, (n, system)) AS system, max(n) AS n FROM s WHERE n >= 3 AND n * 100 >= a * 80 AND drawings >= 2 GROUP BY pen""")
def pen_memory(spark, sf_dir):
    """What a pen stood for in the project: enough statements, share and drawings."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    v = li.join(p, F.expr("l_partkey = p_partkey")).groupBy(F.col("l_orderkey").alias("pen"), F.col("p_type").alias("system")).agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("drawings"))
    s = v.withColumn("_all", F.sum("n").over(W.partitionBy("pen"))).where("n >= 3 AND n * 100 >= _all * 80 AND drawings >= 2")
    return s.groupBy("pen").agg(F.max_by("system", F.struct("n", "system")).alias("system"), F.max("n").alias("n"))


@query("""SELECT p_name || p_size AS code, min(p_type) AS role FROM part GROUP BY ALL HAVING count(DISTINCT p_type) = 1""")
def legend_without_conflict(spark, sf_dir):
    """Codes that have one role on all sheets."""
    return table(spark, sf_dir, "part").groupBy(F.concat("p_name", F.col("p_size").cast("string")).alias("code")).agg(F.min("p_type").alias("role"), F.countDistinct("p_type").alias("_n")).where("_n = 1").drop("_n")


@query("""WITH l AS (SELECT l_partkey * 10000 + l_suppkey AS situation, min(l_linenumber) AS answer FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL HAVING count(DISTINCT l_linenumber) = 1), c AS (SELECT l_orderkey AS case_id, l_partkey * 10000 + l_suppkey AS situation, list(DISTINCT l_linenumber) AS candidates FROM lineitem GROUP BY ALL)
SELECT case_id, situation, answer FROM c JOIN l USING (situation) WHERE list_contains(candidates, answer)""")
def apply_lessons(spark, sf_dir):
    """A lesson settles a case only with an answer that is among the case's own candidates."""
    li = table(spark, sf_dir, "lineitem")
    lesson = li.where("l_returnflag = 'A'").groupBy((F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("situation")).agg(F.min("l_linenumber").alias("answer"), F.countDistinct("l_linenumber").alias("_n")).where("_n = 1").drop("_n")
    case = li.groupBy(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("situation")).agg(F.collect_set("l_linenumber").alias("candidates"))
    return case.join(lesson, "situation").where(F.expr("array_contains(candidates, answer)")).select("case_id", "situation", "answer")


@query("""SELECT DISTINCT l_partkey AS pipe, o_orderkey AS anchor, c_custkey AS designation, n_nationkey AS leader FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def evidence_chain(spark, sf_dir):
    """From a pipe through its anchors to designations and leaders."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.expr("o_orderkey = l_orderkey"), "left").join(t("customer"), F.expr("o_custkey = c_custkey"), "left").join(t("nation"), F.expr("n_nationkey = c_nationkey"), "left")
    return j.select(F.col("l_partkey").alias("pipe"), F.col("o_orderkey").alias("anchor"), F.col("c_custkey").alias("designation"), F.col("n_nationkey").alias("leader")).distinct()


@query("""SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'sheet' AS kind, l_orderkey AS a, l_partkey AS b FROM lineitem UNION SELECT 'owner', o_custkey, o_orderkey FROM orders UNION SELECT 'place', c_nationkey, c_custkey FROM customer) GROUP BY kind""")
def evidence_edges(spark, sf_dir):
    """The typed edges of the evidence, each once."""
    e = lambda t, k, a, b: table(spark, sf_dir, t).select(F.lit(k).alias("kind"), F.col(a).cast("bigint").alias("a"), F.col(b).alias("b"))
    all_edges = e("lineitem", "sheet", "l_orderkey", "l_partkey").unionByName(e("orders", "owner", "o_custkey", "o_orderkey")).unionByName(e("customer", "place", "c_nationkey", "c_custkey"))
    return all_edges.distinct().groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_partkey AS name, sum(CAST(l_quantity AS BIGINT)) AS r FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL), o AS (SELECT l_partkey AS name, sum(CAST(l_quantity AS BIGINT)) AS o FROM lineitem WHERE l_linenumber IN (2, 3) GROUP BY ALL),
j AS (SELECT coalesce(r.name, o.name) AS name, coalesce(r, 0) AS r, coalesce(o, 0) AS o, r IS NULL AS wrong FROM r FULL JOIN o ON r.name = o.name)
SELECT CASE WHEN wrong THEN 'WRONG' WHEN o = 0 THEN 'MISSED' WHEN o * 10 > r * 11 THEN 'OVER' WHEN o * 10 >= r * 9 THEN 'FULL' ELSE 'PARTIAL' END AS verdict, count(*) AS names, sum(least(r, o))::BIGINT AS owned, sum(greatest(0, o - r))::BIGINT AS false_metres FROM j GROUP BY ALL""")
def accuracy_join(spark, sf_dir):
    """Own metres against the reference's by name, with verdicts."""
    li = table(spark, sf_dir, "lineitem")
    side = lambda c, n: li.where(c).groupBy(F.col("l_partkey").alias("name")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias(n))
    j = side("l_linenumber <= 2", "r").join(side("l_linenumber IN (2, 3)", "o"), "name", "full_outer").withColumn("wrong", F.col("r").isNull()).fillna(0, ["r", "o"])
    v = F.when(F.col("wrong"), "WRONG").when(F.col("o") == 0, "MISSED").when(F.col("o") * 10 > F.col("r") * 11, "OVER").when(F.col("o") * 10 >= F.col("r") * 9, "FULL").otherwise("PARTIAL")
    return j.groupBy(v.alias("verdict")).agg(F.count("*").alias("names"), F.sum(F.least("r", "o")).alias("owned"), F.sum(F.greatest(F.lit(0), F.col("o") - F.col("r"))).alias("false_metres"))


@query("""WITH a AS (SELECT l_partkey AS name, CAST(l_quantity AS BIGINT) AS len, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_partkey AS name, CAST(l_quantity AS BIGINT) AS len, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R')
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.n IS NULL THEN 'extra' WHEN b.n IS NULL THEN 'missing' WHEN a.len = b.len THEN 'same' WHEN b.len < a.len THEN 'short' ELSE 'long' END AS verdict, count(*) AS pairs FROM a FULL JOIN b ON a.name = b.name AND a.n = b.n GROUP BY ALL""")
def run_pairing(spark, sf_dir):
    """Runs of two readings paired by rank of length within a name."""
    w = W.partitionBy("l_partkey").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber")
    li = table(spark, sf_dir, "lineitem")
    side = lambda f, c: li.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("name"), F.row_number().over(w).alias("n"), F.col("l_quantity").cast("bigint").alias(c))
    j = side("A", "a").join(side("R", "b"), ["name", "n"], "full_outer")
    v = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "same").when(F.col("b") < F.col("a"), "short").otherwise("long")
    return j.groupBy("name", v.alias("verdict")).agg(F.count("*").alias("pairs"))
