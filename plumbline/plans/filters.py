"""Lookups: filters that are only set when asked, totals over all matches, lists that are cut where the list is the feature."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plumbline.plans.base import query, table
from plumbline.plans.takeoff import RUNS, runs


def only(df, **wanted):
    """Rows that equal each wanted value; None, blank and 0 mean no filter. Text is compared without case."""
    for name, v in wanted.items():
        if v not in (None, "", 0):
            df = df.where(F.upper(name) == v.upper() if isinstance(v, str) else F.col(name) == v)
    return df


@query(f"""WITH {RUNS}, m AS (SELECT part AS id, designation, dn, sum(metres)::BIGINT AS metres FROM runs WHERE upper(system) = 'SMALL' AND dn = 11 GROUP BY ALL)
SELECT *, (SELECT sum(metres)::BIGINT FROM m) AS total FROM m ORDER BY metres DESC, id LIMIT 200""")
def find_pipes(spark, sf_dir):
    """Pipes of a system and dimension, longest first; the total covers all matches, the list has 200 at most."""
    m = only(runs(spark, sf_dir), system="small", dn=11, designation="").groupBy(F.col("part").alias("id"), "designation", "dn").agg(F.sum("metres").alias("metres"))
    total = m.agg(F.sum("metres").alias("total"))
    return m.orderBy(F.desc("metres"), "id").limit(200).join(F.broadcast(total))


@query("""SELECT p_brand AS designation, p_name AS text, count(*) AS n FROM part WHERE contains(upper(p_name), 'RING') GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 300""")
def find_designations(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(F.upper("p_name").contains("RING"))
    return p.groupBy(F.col("p_brand").alias("designation"), F.col("p_name").alias("text")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "designation", "text").limit(300)


@query("""SELECT 'pipe' AS kind, l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_partkey % 500 <= 120 AND l_partkey % 500 + l_quantity >= 100 AND l_suppkey BETWEEN 10 AND 20
UNION ALL SELECT 'label', p_partkey FROM part WHERE p_partkey % 500 <= 120 AND p_partkey % 500 + p_size >= 100 AND p_size BETWEEN 10 AND 20 UNION ALL SELECT 'anchor', s_suppkey FROM supplier WHERE s_suppkey BETWEEN 100 - 95 AND 20 AND s_nationkey BETWEEN 10 AND 20""")
def in_rectangle(spark, sf_dir):
    """What a rectangle holds: pipes and labels by overlap of boxes, anchors by their point."""
    from plumbline.functions.geometry import boxes_overlap, in_box

    box = tuple(map(F.lit, (100, 10, 120, 20)))
    li, p, s = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    x = F.col("l_partkey") % 500
    pipes = li.where(boxes_overlap((x, F.col("l_suppkey"), x + F.col("l_quantity"), F.col("l_suppkey")), box)).select(F.lit("pipe").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    y = F.col("p_partkey") % 500
    labels = p.where(boxes_overlap((y, F.col("p_size"), y + F.col("p_size"), F.col("p_size")), box)).select(F.lit("label").alias("kind"), F.col("p_partkey").alias("id"))
    anchors = s.where(in_box(F.col("s_suppkey"), F.col("s_nationkey"), tuple(map(F.lit, (5, 10, 20, 20))))).select(F.lit("anchor").alias("kind"), F.col("s_suppkey").alias("id"))
    return pipes.unionByName(labels).unionByName(anchors)


ASKED = [7, 5, 999999999, 7, 12]


@query("""SELECT a.pos, a.id, o_totalprice IS NOT NULL AS found, CASE WHEN o_orderkey IS NULL THEN 'no such reading' END AS error, o_custkey AS owner FROM (VALUES (0, 7), (1, 5), (2, 999999999), (3, 7), (4, 12)) a(pos, id) LEFT JOIN orders ON o_orderkey = a.id""")
def lookup_by_id(spark, sf_dir):
    """Rows by id in the order asked, repeated ones repeated; a miss is a row that says so."""
    asked = spark.range(1).select(F.posexplode(F.array(*map(F.lit, ASKED))).alias("pos", "id"))
    o = table(spark, sf_dir, "orders")
    j = asked.join(o, F.col("id") == o.o_orderkey, "left")
    return j.select("pos", "id", F.col("o_totalprice").isNotNull().alias("found"), F.when(F.col("o_orderkey").isNull(), "no such reading").alias("error"), F.col("o_custkey").alias("owner"))


@query("""SELECT a.pos, a.id, sum(l_quantity)::BIGINT AS metres FROM (VALUES (0, 7), (1, 5), (2, 999999999), (3, 7), (4, 12)) a(pos, id) JOIN lineitem ON l_orderkey = a.id GROUP BY ALL""")
def measure_ids(spark, sf_dir):
    """Metres of the ids asked; unknown ones are left out."""
    asked = spark.range(1).select(F.posexplode(F.array(*map(F.lit, ASKED))).alias("pos", "id"))
    return asked.join(table(spark, sf_dir, "lineitem"), F.expr("l_orderkey = id")).groupBy("pos", "id").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("metres"))


@query(f"""WITH {RUNS}, q AS (SELECT designation, dn, list_sort(list(DISTINCT part)) AS pipes FROM runs WHERE upper(designation) = 'BRAND#7' GROUP BY ALL ORDER BY dn LIMIT 1)
SELECT part AS pipe, count(*) AS runs, sum(metres)::BIGINT AS metres FROM runs WHERE part IN (SELECT unnest(pipes) FROM q) GROUP BY part""")
def explain_quantity(spark, sf_dir):
    """The pipes behind the first row of a designation."""
    r = runs(spark, sf_dir)
    q = r.where(F.upper("designation") == "BRAND#7").groupBy("dn").agg(F.collect_set("part").alias("pipes")).orderBy("dn").limit(1)
    return r.join(q.select(F.explode("pipes").alias("part")), "part").groupBy(F.col("part").alias("pipe")).agg(F.count("*").alias("runs"), F.sum("metres").alias("metres"))


@query("""SELECT o_orderkey AS issue, CASE WHEN o_orderpriority = '1-URGENT' THEN 'blocking' ELSE 'noted' END AS severity FROM orders WHERE o_orderstatus = 'P' ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderkey LIMIT 80""")
def open_issues(spark, sf_dir):
    """Blocking issues before noted ones; a list of 80."""
    sev = F.when(F.col("o_orderpriority") == "1-URGENT", "blocking").otherwise("noted")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("issue"), sev.alias("severity")).orderBy(F.when(F.col("severity") == "blocking", 0).otherwise(1), "issue").limit(80)


@query("""SELECT c_custkey AS sheet, c_name AS number, n_name AS building, c_mktsegment AS discipline FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY' AND n_name = 'NATION_3' AND contains(c_name, '1')""")
def find_sheets(spark, sf_dir):
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    return only(j, c_mktsegment="machinery", n_name="nation_3").where(F.col("c_name").contains("1")).select(F.col("c_custkey").alias("sheet"), F.col("c_name").alias("number"), F.col("n_name").alias("building"), F.col("c_mktsegment").alias("discipline"))


@query("""SELECT n_name AS building, count(DISTINCT o_orderkey) AS sheets, sum(CAST(l_quantity AS BIGINT))::BIGINT AS metres FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE p_brand = 'Brand#1' OR starts_with(p_brand, 'Brand#1') GROUP BY n_name""")
def designation_through_set(spark, sf_dir):
    """A designation, or all that begin with it, through the buildings."""
    t = lambda n: table(spark, sf_dir, n)
    p = t("part").where((F.col("p_brand") == "Brand#1") | F.col("p_brand").startswith("Brand#1"))
    j = t("lineitem").join(p, F.expr("l_partkey = p_partkey")).join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey"))
    return j.groupBy(F.col("n_name").alias("building")).agg(F.countDistinct("o_orderkey").alias("sheets"), F.sum(F.col("l_quantity").cast("bigint")).alias("metres"))


@query("""WITH m AS (SELECT * FROM part WHERE contains(lower(p_name || ' ' || p_partkey), 'red') AND contains(lower(p_name || ' ' || p_partkey), '1')), f AS (SELECT count(*) AS total, list_sort(list(DISTINCT p_type)) AS facets FROM m)
SELECT p_partkey AS article, p_name AS name, total, facets FROM m, f ORDER BY p_partkey LIMIT 25 OFFSET 25""")
def article_search(spark, sf_dir):
    """Every word must occur; total and facets cover all matches, the page is the second of 25."""
    p = table(spark, sf_dir, "part")
    text = F.lower(F.concat_ws(" ", "p_name", "p_partkey"))
    m = p.where(reduce(lambda a, b: a & b, [text.contains(w) for w in "red 1".split()]))
    facts = m.agg(F.count("*").alias("total"), F.array_sort(F.collect_set("p_type")).alias("facets"))
    return m.orderBy("p_partkey").offset(25).limit(25).select(F.col("p_partkey").alias("article"), F.col("p_name").alias("name")).join(F.broadcast(facts))


@query("""SELECT o_orderkey AS reading, c_name AS owner, n_name AS place, r_name AS project, count(*) OVER () AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'F' AND (lower(c_name) LIKE '%99%' OR lower(n_name) LIKE '%99%' OR lower(r_name) LIKE '%99%') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 10""")
def readings_search(spark, sf_dir):
    """Readings whose owner, place or project holds the words, newest first, one page with the total of all."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("orders").where("o_orderstatus = 'F'").join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey")).join(t("region"), F.expr("n_regionkey = r_regionkey"))
    j = j.where(reduce(lambda a, b: a | b, [F.lower(c).like("%99%") for c in ("c_name", "n_name", "r_name")]))
    page = j.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(10).limit(50).select(F.col("o_orderkey").alias("reading"), F.col("c_name").alias("owner"), F.col("n_name").alias("place"), F.col("r_name").alias("project"))
    return page.join(F.broadcast(j.agg(F.count("*").alias("total"))))


@query("""SELECT event_id AS correction, user_id, event_type AS kind FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 20""")
def corrections_search(spark, sf_dir):
    e = only(table(spark, sf_dir, "events"), event_type="error", user_id=None)
    return e.orderBy(F.desc("ts"), F.desc("event_id")).offset(20).limit(100).select(F.col("event_id").alias("correction"), "user_id", F.col("event_type").alias("kind"))


@query("""SELECT l_orderkey AS sheet, l_linenumber AS line, CASE WHEN l_tax = 0 AND l_discount = 0 THEN 'EMPTY' WHEN l_discount > 0.05 THEN 'FILL BOUNDARY' ELSE 'STROKED' END AS verdict FROM lineitem""")
def ink_verdict(spark, sf_dir):
    """What a path is by its kind and width."""
    v = F.when((F.col("l_tax") == 0) & (F.col("l_discount") == 0), "EMPTY").when(F.col("l_discount") > 0.05, "FILL BOUNDARY").otherwise("STROKED")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("line"), v.alias("verdict"))


@query("""SELECT l_returnflag || '|' || l_linestatus || '|w' || CAST(CAST(l_quantity AS INT) % 5 AS VARCHAR) AS pen, count(*) AS paths, sum(CAST(l_quantity AS BIGINT))::BIGINT AS ink FROM lineitem GROUP BY ALL""")
def ink_census(spark, sf_dir):
    """Paths and ink of each pen."""
    pen = F.concat_ws("|", "l_returnflag", "l_linestatus", F.concat(F.lit("w"), F.col("l_quantity").cast("int") % 5))
    return table(spark, sf_dir, "lineitem").groupBy(pen.alias("pen")).agg(F.count("*").alias("paths"), F.sum(F.col("l_quantity").cast("bigint")).alias("ink"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents)
SELECT doc_id, count(*) AS words, count(*) FILTER (regexp_full_match(w, '[A-Za-z0-9#./-]{2,24}') AND regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '^([0-9]+x)?[A-Za-z]')) AS codes FROM w WHERE w <> '' GROUP BY doc_id""")
def code_like_words(spark, sf_dir):
    """Words that look like codes: short, with letter and digit, beginning with a letter after a count."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''")
    c = F.col("w")
    code = c.rlike("^[A-Za-z0-9#./-]{2,24}$") & c.rlike("[A-Za-z]") & c.rlike("[0-9]") & c.rlike("^([0-9]+x)?[A-Za-z]")
    return w.groupBy("doc_id").agg(F.count("*").alias("words"), F.count(F.when(code, 1)).alias("codes"))


@query("""WITH l(code, role) AS (VALUES ('Brand#1', 'system'), ('Brand#12', 'component'), ('Brand#2', 'material'), ('Brand#25', 'system')),
m AS (SELECT p_partkey, p_brand, arg_max(role, length(code)) AS role FROM part JOIN l ON starts_with(p_brand, code) GROUP BY ALL)
SELECT p_brand AS designation, role, count(*) AS parts FROM m GROUP BY ALL""")
def names_a_pipe(spark, sf_dir):
    """The longest legend code that begins a designation decides its role."""
    legend = spark.createDataFrame([("Brand#1", "system"), ("Brand#12", "component"), ("Brand#2", "material"), ("Brand#25", "system")], "code string, role string")
    names = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("designation")).agg(F.count("*").alias("parts"))
    return names.join(F.broadcast(legend), F.expr("startswith(designation, code)")).groupBy("designation", "parts").agg(F.max_by("role", F.length("code")).alias("role"))


#: The nominal series of pipe dimensions.
NOMINAL = [10, 12, 15, 16, 18, 20, 22, 25, 28, 32, 35, 40, 42, 50]


@query("""SELECT p_size AS dn, list_contains([10, 12, 15, 16, 18, 20, 22, 25, 28, 32, 35, 40, 42, 50], p_size) AS plausible, count(*) AS parts FROM part GROUP BY ALL""")
def nominal_sizes(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("dn"), F.col("p_size").isin(NOMINAL).alias("plausible")).agg(F.count("*").alias("parts"))


@query(f"""WITH {RUNS}, q AS (SELECT designation, dn, sum(metres)::BIGINT AS metres, bool_or(state = 'AMBIGUOUS') AS open FROM runs WHERE contains(lower(designation), '#2') GROUP BY ALL)
SELECT designation, dn, metres, (SELECT sum(metres)::BIGINT FROM q WHERE open) AS shown FROM q WHERE open""")
def quantity_table(spark, sf_dir):
    """A table filtered by text and state, with column totals over what is shown."""
    q = runs(spark, sf_dir).where(F.lower("designation").contains("#2")).groupBy("designation", "dn").agg(F.sum("metres").alias("metres"), F.bool_or(F.col("state") == "AMBIGUOUS").alias("open")).where("open").drop("open")
    return q.join(F.broadcast(q.agg(F.sum("metres").alias("shown"))))


@query("""SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'R' ELSE 'N' END AS layer, o_orderstatus AS status, count(*) AS n, max(o_orderkey) AS newest FROM orders WHERE o_custkey % 3 <> 0 GROUP BY ALL""")
def markup_facets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0")
    return o.groupBy(F.when(F.col("o_orderpriority") == "1-URGENT", "R").otherwise("N").alias("layer"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"))
