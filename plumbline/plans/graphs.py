"""Graph queries over the network of suppliers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import graph
from plumbline.plans.base import query, table

#: The network: every line item is a segment of its order's drawing and joins two of the drawing's joints.
A, B = "l_orderkey * 10 + l_partkey % 8", "l_orderkey * 10 + l_suppkey % 8"
EDGES = f"e AS (SELECT DISTINCT {A} AS a, {B} AS b FROM lineitem)"
BOTH = "u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


def edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.expr(A).alias("a"), F.expr(B).alias("b")).distinct()


@query(f"""WITH RECURSIVE {EDGES}, {BOTH}, r(id, top) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.top FROM r JOIN u ON u.a = r.id) SELECT id, min(top) AS component FROM r GROUP BY id""")
def connected_components(spark, sf_dir):
    return graph.components(edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES}, {BOTH}, r(id, top) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.top FROM r JOIN u ON u.a = r.id), c AS (SELECT id, min(top) AS component FROM r GROUP BY id)
SELECT component, count(*) AS vertices, CASE WHEN count(*) FILTER (id % 10 >= 3) > 2 * count(*) FILTER (id % 10 < 3) THEN 'AMBIGUOUS' ELSE 'CONFIRMED' END AS state FROM c GROUP BY component""")
def flow_bound(spark, sf_dir):
    """A run whose flowed part is more than twice what is labelled is not certain."""
    c = graph.components(edges(spark, sf_dir))
    flowed, labelled = F.count(F.when(F.col("id") % 10 >= 3, 1)), F.count(F.when(F.col("id") % 10 < 3, 1))
    return c.groupBy("component").agg(F.count("*").alias("vertices"), F.when(flowed > 2 * labelled, "AMBIGUOUS").otherwise("CONFIRMED").alias("state"))


@query(f"""WITH RECURSIVE {EDGES}, {BOTH}, s AS (SELECT min(a) AS id FROM e), r(id, hops) AS (SELECT id, 0 FROM s UNION SELECT u.b, r.hops + 1 FROM r JOIN u ON u.a = r.id WHERE r.hops < 8) SELECT id, min(hops) AS hops FROM r GROUP BY id""")
def reachable_set(spark, sf_dir):
    """What can be reached from the first vertex, and in how many hops. (A drawing has eight joints, so the SQL may stop at eight.)"""
    e = edges(spark, sf_dir)
    return graph.shortest_paths(e, e.agg(F.min("a")).first()[0]).select("id", "hops")


@query(f"""WITH RECURSIVE {EDGES}, {BOTH}, s AS (SELECT min(a) AS id FROM e), r(id, hops, path) AS (SELECT id, 0, [id] FROM s UNION SELECT u.b, r.hops + 1, list_append(r.path, u.b) FROM r JOIN u ON u.a = r.id WHERE r.hops < 8 AND NOT list_contains(r.path, u.b)), m AS (SELECT *, min(hops) OVER (PARTITION BY id) AS least FROM r)
SELECT id, hops, min(path) AS path FROM m WHERE hops = least GROUP BY ALL""")
def fewest_hop_path(spark, sf_dir):
    """Of the shortest paths from the first vertex the least."""
    e = edges(spark, sf_dir)
    return graph.shortest_paths(e, e.agg(F.min("a")).first()[0])


@query(f"""WITH {EDGES}, {BOTH}, d AS (SELECT a AS id, count(DISTINCT b) AS degree FROM u WHERE a <> b GROUP BY a) SELECT id FROM d WHERE degree <= 1""")
def free_ends(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir)).where("degree <= 1").select("id")


@query("""SELECT l_orderkey AS node, count(DISTINCT p_size) AS sizes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(DISTINCT p_size) >= 2""")
def size_frontiers(spark, sf_dir):
    """Nodes where two dimensions meet."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    return j.groupBy(F.col("l_orderkey").alias("node")).agg(F.countDistinct("p_size").alias("sizes")).where("sizes >= 2")


@query("""WITH m AS (SELECT DISTINCT l_partkey AS pipe, l_orderkey AS node FROM lineitem) SELECT DISTINCT x.pipe AS a, y.pipe AS b FROM m x JOIN m y USING (node) WHERE x.pipe < y.pipe""")
def adjacent_pipes(spark, sf_dir):
    """Pipes that share a node."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pipe"), F.col("l_orderkey").alias("node")).distinct()
    return graph.neighbours_by_shared(m, "pipe", "node")


@query(f"""WITH RECURSIVE {EDGES}, {BOTH}, two AS (SELECT a AS id FROM u WHERE a <> b GROUP BY a HAVING count(DISTINCT b) = 2), i AS (SELECT a, b FROM u WHERE a IN (SELECT id FROM two) AND b IN (SELECT id FROM two)), r(id, top) AS (SELECT id, id FROM two UNION SELECT i.b, r.top FROM r JOIN i ON i.a = r.id) SELECT id, min(top) AS chain FROM r GROUP BY id""")
def degree_two_chains(spark, sf_dir):
    """Runs of vertices that have exactly two neighbours."""
    return graph.chains(edges(spark, sf_dir))


@query(f"""WITH RECURSIVE same AS (SELECT DISTINCT p_type || ':' || ({A}) AS a, p_type || ':' || ({B}) AS b FROM lineitem JOIN part ON p_partkey = l_partkey), u AS (SELECT a, b FROM same UNION SELECT b, a FROM same), r(id, top) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.top FROM r JOIN u ON u.a = r.id), c AS (SELECT id, min(top) AS pipe FROM r GROUP BY id)
SELECT pipe, count(*) AS pieces, list_sort(list(id)) AS members FROM c GROUP BY pipe""")
def physical_pipes(spark, sf_dir):
    """Connected pieces of one identity make a pipe."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    end = lambda x: F.concat_ws(":", "p_type", F.expr(x))
    c = graph.components(j.select(end(A).alias("a"), end(B).alias("b")).distinct())
    return c.groupBy(F.col("component").alias("pipe")).agg(F.count("*").alias("pieces"), F.array_sort(F.collect_list("id")).alias("members"))


@query("""SELECT l_orderkey AS pen, min(p_type) AS identity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey HAVING count(DISTINCT p_type) = 1 AND count(*) >= 2""")
def uniform_pen_identity(spark, sf_dir):
    """Pens with two anchors or more that all agree."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    return j.groupBy(F.col("l_orderkey").alias("pen")).agg(F.min("p_type").alias("identity"), F.countDistinct("p_type").alias("_k"), F.count("*").alias("_n")).where("_k = 1 AND _n >= 2").drop("_k", "_n")


@query("""WITH v AS (SELECT l_orderkey AS leader, p_type AS family, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY leader) AS total FROM v) SELECT leader, family, n FROM s WHERE total >= 3 AND n * 100 >= total * 80""")
def usage_vote(spark, sf_dir):
    """Families that hold four fifths of a leader's votes."""
    from pyspark.sql import Window as W

    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    v = j.groupBy(F.col("l_orderkey").alias("leader"), F.col("p_type").alias("family")).agg(F.count("*").alias("n"))
    return v.withColumn("_t", F.sum("n").over(W.partitionBy("leader"))).where("_t >= 3 AND n * 100 >= _t * 80").drop("_t")


@query("""WITH s AS (SELECT l_orderkey AS label, l_linenumber AS segment, p_size AS dn, l_suppkey AS level, l_quantity AS dist, CASE WHEN l_suppkey % 10 = 3 THEN 0 WHEN p_size % 10 = 5 THEN 1 WHEN l_quantity < 10 THEN 2 ELSE 3 END AS rank FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT label, min_by(segment, (rank, dist, segment)) AS segment, CASE min(rank) WHEN 0 THEN 'LEVEL' WHEN 1 THEN 'DIMENSION' WHEN 2 THEN 'POSITION' ELSE 'NEAREST' END AS signal, min(rank) = 3 AS review FROM s GROUP BY label""")
def downstream_choice(spark, sf_dir):
    """The segment a label describes: level beats dimension beats position beats nearest."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    rank = F.when(F.col("l_suppkey") % 10 == 3, 0).when(F.col("p_size") % 10 == 5, 1).when(F.col("l_quantity") < 10, 2).otherwise(3)
    g = j.withColumn("rank", rank).groupBy(F.col("l_orderkey").alias("label")).agg(F.min_by("l_linenumber", F.struct("rank", "l_quantity", "l_linenumber")).alias("segment"), F.min("rank").alias("_r"))
    return g.select("label", "segment", F.when(F.col("_r") == 0, "LEVEL").when(F.col("_r") == 1, "DIMENSION").when(F.col("_r") == 2, "POSITION").otherwise("NEAREST").alias("signal"), (F.col("_r") == 3).alias("review"))
