"""Queries of quantities: aggregates, journal, disputes, coverage, medians, estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import choose, takeoff
from plumbline.plans.base import query, table

#: How the tables stand for a drawing: a line item is a run, its order the sheet, the part's brand and size the identity.
RUNS = """
runs AS (
  SELECT l_orderkey AS sheet, l_linenumber AS line, p_brand AS designation, p_size AS dn, p_type AS system, l_partkey AS part, l_suppkey AS supplier, CAST(l_quantity AS BIGINT) AS metres,
         l_returnflag AS pen, CASE l_returnflag WHEN 'A' THEN 'CONFIRMED' WHEN 'N' THEN 'AMBIGUOUS' ELSE 'UNOWNED' END AS state
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SUMS = "sum(CASE WHEN state = 'CONFIRMED' THEN metres ELSE 0 END)::BIGINT AS confirmed, sum(CASE WHEN state = 'AMBIGUOUS' THEN metres ELSE 0 END)::BIGINT AS ambiguous, sum(CASE WHEN state = 'UNOWNED' THEN metres ELSE 0 END)::BIGINT AS unowned"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    state = F.when(F.col("l_returnflag") == "A", "CONFIRMED").when(F.col("l_returnflag") == "N", "AMBIGUOUS").otherwise("UNOWNED")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("line"), F.col("p_brand").alias("designation"), F.col("p_size").alias("dn"), F.col("p_type").alias("system"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").cast("bigint").alias("metres"), F.col("l_returnflag").alias("pen"), state.alias("state"),
    )


@query(f"""WITH {RUNS}, q AS (SELECT designation, dn, {SUMS}, count(*) AS runs, count(DISTINCT sheet) AS sheets FROM runs GROUP BY ALL)
SELECT *, CASE WHEN confirmed > 0 AND ambiguous = 0 THEN 'CONFIRMED' WHEN confirmed > 0 THEN 'PARTIAL' WHEN ambiguous > 0 THEN 'AMBIGUOUS' ELSE 'UNOWNED' END AS state FROM q""")
def quantity_by_designation(spark, sf_dir):
    """Metres of each state per designation and dimension."""
    return takeoff.by_identity(runs(spark, sf_dir), ["designation", "dn"], "state", "metres", "sheet")


@query(f"""WITH {RUNS} SELECT system, sum(metres)::BIGINT AS metres, count(*) AS runs, list_sort(list(DISTINCT designation)) AS designations FROM runs GROUP BY system""")
def quantity_by_system(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("system").agg(F.sum("metres").alias("metres"), F.count("*").alias("runs"), F.array_sort(F.collect_set("designation")).alias("designations"))


@query(f"""WITH {RUNS} SELECT dn, sum(metres)::BIGINT AS metres, count(DISTINCT part) AS pipes FROM runs WHERE dn > 0 AND upper(system) = 'PROMO' GROUP BY dn""")
def quantity_by_dimension(spark, sf_dir):
    """Grouped by dimension within one system; blank and zero mean no dimension."""
    return runs(spark, sf_dir).where((F.col("dn") > 0) & (F.upper("system") == "PROMO")).groupBy("dn").agg(F.sum("metres").alias("metres"), F.countDistinct("part").alias("pipes"))


@query(f"""WITH {RUNS} SELECT designation, nullif(dn, 1) AS dn, sum(metres)::BIGINT AS metres, list_sort(list(DISTINCT sheet % 10)) AS sheets, count(DISTINCT part) AS pipes FROM runs GROUP BY ALL""")
def set_quantities(spark, sf_dir):
    """Across the whole set; a designation without dimension is a row of its own."""
    r = runs(spark, sf_dir).withColumn("dn", F.nullif("dn", F.lit(1))).withColumn("sheet", F.col("sheet") % 10)
    return takeoff.set_wide(r, ["designation", "dn"], "metres", "sheet", "part")


@query("""SELECT r_name AS project, n_name AS building, p_brand AS designation, sum(CAST(l_quantity AS BIGINT))::BIGINT AS metres, min_by(p_size, p_partkey * 100000000 + l_orderkey * 10 + l_linenumber) AS dn,
  sum(greatest(l_linenumber, p_size % 7))::BIGINT AS risers
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def building_quantities(spark, sf_dir):
    """Per building and designation; risers are the larger of two sources, the first dimension is kept."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("part"), F.expr("l_partkey = p_partkey")).join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey")).join(t("region"), F.expr("n_regionkey = r_regionkey"))
    return j.groupBy(F.col("r_name").alias("project"), F.col("n_name").alias("building"), F.col("p_brand").alias("designation")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("metres"),
        F.min_by("p_size", F.expr("p_partkey * 100000000 + l_orderkey * 10 + l_linenumber")).alias("dn"),
        F.sum(F.expr("greatest(l_linenumber, p_size % 7)")).alias("risers"),
    )


CLAIMS = "claims AS (SELECT l_partkey AS run, CAST(floor(l_quantity / 10) AS BIGINT) AS piece, l_suppkey AS owner, p_brand AS identity, CAST(l_quantity AS BIGINT) AS metres FROM lineitem JOIN part ON l_partkey = p_partkey)"


def claims(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_partkey").alias("run"), F.floor(F.col("l_quantity") / 10).alias("piece"), F.col("l_suppkey").alias("owner"), F.col("p_brand").alias("identity"), F.col("l_quantity").cast("bigint").alias("metres"))


@query(f"""WITH {CLAIMS}, n AS (SELECT run, piece, count(DISTINCT owner) AS owners FROM claims GROUP BY ALL)
SELECT identity, sum(CASE WHEN owners = 1 THEN metres ELSE 0 END)::BIGINT AS confirmed, sum(CASE WHEN owners > 1 THEN metres ELSE 0 END)::BIGINT AS ambiguous, count(*) AS entries FROM claims JOIN n USING (run, piece) GROUP BY identity""")
def journal_totals(spark, sf_dir):
    """The journal's counted metres, and those withheld because two owners claim their interval."""
    return takeoff.withheld(takeoff.journal(claims(spark, sf_dir), ["run", "piece"], "owner", "metres"), ["identity"], "metres")


@query(f"""WITH {CLAIMS} SELECT run, piece, list_sort(list(DISTINCT owner)) AS alternatives FROM claims GROUP BY ALL HAVING count(DISTINCT owner) > 1""")
def disputed_intervals(spark, sf_dir):
    return takeoff.disputes(claims(spark, sf_dir), ["run", "piece"], "owner")


@query(f"""WITH {CLAIMS}, n AS (SELECT run, piece, count(DISTINCT owner) AS owners, sum(metres) AS m FROM claims GROUP BY ALL)
SELECT owners > 1 AS disputed, count(*) AS intervals, sum(m)::BIGINT AS metres FROM n GROUP BY ALL""")
def journal_check(spark, sf_dir):
    """How many intervals have one owner at most."""
    n = claims(spark, sf_dir).groupBy("run", "piece").agg(F.countDistinct("owner").alias("owners"), F.sum("metres").alias("m"))
    return n.groupBy((F.col("owners") > 1).alias("disputed")).agg(F.count("*").alias("intervals"), F.sum("m").alias("metres"))


@query(f"""WITH {RUNS}, o AS (SELECT pen, system, sheet, line, count(*) AS k, sum(metres) AS m, {SUMS} FROM runs GROUP BY pen, system, sheet, line),
q AS (SELECT pen, system, sum(m)::BIGINT AS total, sum(confirmed)::BIGINT AS confirmed, sum(ambiguous)::BIGINT AS ambiguous, sum(unowned)::BIGINT AS unowned, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END)::BIGINT AS doubled FROM o GROUP BY ALL)
SELECT *, total = confirmed + ambiguous + unowned AND doubled = 0 AS holds FROM q""")
def conservation(spark, sf_dir):
    """Confirmed, ambiguous and unowned metres make the total of each pen family."""
    return takeoff.conservation(runs(spark, sf_dir), ["pen", "system"], "state", "metres", ["sheet", "line"])


@query(f"""WITH {RUNS}, n AS (SELECT sheet, count(DISTINCT designation) AS names, count(DISTINCT CASE WHEN state = 'CONFIRMED' THEN designation END) AS with_metres, sum(metres)::BIGINT AS ink, {SUMS} FROM runs GROUP BY sheet)
SELECT sheet, names, with_metres, CASE WHEN with_metres * 2 < names THEN 'INVALID' WHEN unowned * 5 > ink THEN 'DEGRADED' ELSE 'VALID' END AS verdict,
  list_filter([CASE WHEN with_metres * 2 < names THEN 'few names with metres' END, CASE WHEN unowned * 5 > ink THEN 'much unowned' END, CASE WHEN ambiguous * 5 > ink THEN 'much ambiguous' END], lambda x: x IS NOT NULL) AS reasons FROM n""")
def reading_validity(spark, sf_dir):
    """Coverage of each sheet and the verdict on its reading, with all reasons."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, F.col("metres"))), F.lit(0))
    n = runs(spark, sf_dir).groupBy("sheet").agg(F.countDistinct("designation").alias("names"), F.countDistinct(F.when(F.col("state") == "CONFIRMED", F.col("designation"))).alias("with_metres"), F.sum("metres").alias("ink"), of("AMBIGUOUS").alias("ambiguous"), of("UNOWNED").alias("unowned"))
    few, unowned, ambiguous = F.col("with_metres") * 2 < F.col("names"), F.col("unowned") * 5 > F.col("ink"), F.col("ambiguous") * 5 > F.col("ink")
    return n.select("sheet", "names", "with_metres", F.when(few, "INVALID").when(unowned, "DEGRADED").otherwise("VALID").alias("verdict"), F.array_compact(F.array(F.when(few, "few names with metres"), F.when(unowned, "much unowned"), F.when(ambiguous, "much ambiguous"))).alias("reasons"))


@query(f"""WITH {RUNS}, n AS (SELECT part, count(DISTINCT pen) AS routes, count(DISTINCT supplier) AS names, sum(metres) AS m FROM runs GROUP BY part)
SELECT CASE WHEN names = 1 AND routes > 1 THEN 'CORROBORATED' WHEN names = 1 THEN 'ONE READING' WHEN routes = 1 THEN 'CLOSURE' ELSE 'CONFLICT' END AS verdict, count(*) AS parts, sum(m)::BIGINT AS metres FROM n GROUP BY ALL""")
def route_cross_check(spark, sf_dir):
    """Per run: does more than one independent route give one name?"""
    n = runs(spark, sf_dir).groupBy("part").agg(F.countDistinct("pen").alias("routes"), F.countDistinct("supplier").alias("names"), F.sum("metres").alias("m"))
    v = F.when((F.col("names") == 1) & (F.col("routes") > 1), "CORROBORATED").when(F.col("names") == 1, "ONE READING").when(F.col("routes") == 1, "CLOSURE").otherwise("CONFLICT")
    return n.groupBy(v.alias("verdict")).agg(F.count("*").alias("parts"), F.sum("m").alias("metres"))


@query(f"""WITH {RUNS}, w AS (SELECT system, dn, sum(metres) AS w FROM runs GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY system ORDER BY dn) AS run, sum(w) OVER (PARTITION BY system) AS total FROM w)
SELECT system, min(dn) AS dn, any_value(total)::BIGINT AS total FROM r WHERE run * 2 >= total GROUP BY system""")
def weighted_median_width(spark, sf_dir):
    """The dimension at which half of a system's metres are reached."""
    return takeoff.weighted_median(runs(spark, sf_dir), ["system"], "dn", "metres")


@query(f"""WITH {RUNS}, n AS (SELECT system, metres % 8 AS gap, count(*) AS n FROM runs GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY system) AS a, row_number() OVER (PARTITION BY system ORDER BY n DESC, gap) AS rank FROM n)
SELECT system, gap, n, rank FROM r WHERE n >= a * 0.12 AND rank <= 3""")
def gap_modes(spark, sf_dir):
    """The most common gaps of each pen, up to three with an eighth of its gaps or so."""
    return takeoff.modes(runs(spark, sf_dir).withColumn("gap", F.col("metres") % 8), ["system"], "gap", 0.12, 3)


@query(f"""WITH {RUNS}, s AS (SELECT sheet % 50 AS sheet, list_sort(list(metres)) AS v FROM runs GROUP BY ALL) SELECT sheet, v[len(v) // 2 + 1] AS median, len(v)::BIGINT AS n, list_max(v) - list_min(v) <= 1 AS agree FROM s""")
def scale_consensus(spark, sf_dir):
    """The upper median of each set's scales, and whether all agree."""
    g = runs(spark, sf_dir).groupBy((F.col("sheet") % 50).alias("sheet"))
    return g.agg(takeoff.upper_median(F.col("metres")).alias("median"), F.count("*").alias("n"), ((F.max("metres") - F.min("metres")) <= 1).alias("agree"))


@query("""WITH v AS (SELECT l_orderkey AS leader, p_type AS family, l_suppkey AS object, max(l_linenumber) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT family, sum(w)::BIGINT AS votes, count(*) AS ballots, count(DISTINCT leader) AS leaders FROM v GROUP BY family""")
def family_votes(spark, sf_dir):
    """One vote per leader, family and object, the heaviest; then the sum."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    v = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_orderkey").alias("leader"), F.col("p_type").alias("family"), F.col("l_suppkey").alias("object")).agg(F.max("l_linenumber").alias("w"))
    return v.groupBy("family").agg(F.sum("w").alias("votes"), F.count("*").alias("ballots"), F.countDistinct("leader").alias("leaders"))


@query("""WITH r AS (SELECT l_orderkey AS word, l_linenumber AS reading, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT reading, sum(27720 // n)::BIGINT AS weight, count(*) AS words FROM r GROUP BY reading""")
def pattern_weights(spark, sf_dir):
    """Each word shares one vote among its readings; votes in 27720ths so that sums are exact."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("reading"), F.count("*").over(W.partitionBy("l_orderkey")).alias("n"))
    return r.groupBy("reading").agg(F.sum(F.expr("27720 div n")).alias("weight"), F.count("*").alias("words"))


@query(f"""WITH {RUNS}, n AS (SELECT pen, designation, sum(metres)::BIGINT AS m, count(*) AS n FROM runs WHERE state <> 'CONFIRMED' GROUP BY ALL) SELECT pen, designation, m AS metres, n AS runs, rank FROM (SELECT *, row_number() OVER (PARTITION BY pen ORDER BY m DESC, designation) AS rank FROM n) WHERE rank <= 5""")
def declined_geometry(spark, sf_dir):
    """The largest amounts that no reading claims, per pen; the list is a top five, the sums cover all."""
    n = runs(spark, sf_dir).where("state <> 'CONFIRMED'").groupBy("pen", "designation").agg(F.sum("metres").alias("metres"), F.count("*").alias("runs"))
    return choose.top_k(n, ["pen"], 5, F.desc("metres"), F.col("designation"))


@query(f"""WITH {RUNS} SELECT coalesce(nullif(pen, 'R'), 'NY') AS scope, count(*) AS runs, sum(metres)::BIGINT AS metres FROM runs GROUP BY ALL""")
def scope_counts(spark, sf_dir):
    """Runs and metres per scope; without a mark it is new work."""
    return runs(spark, sf_dir).groupBy(F.coalesce(F.nullif("pen", F.lit("R")), F.lit("NY")).alias("scope")).agg(F.count("*").alias("runs"), F.sum("metres").alias("metres"))


@query("""SELECT p_type AS type, p_brand AS material, count(*) AS n, sum(p_size)::BIGINT AS volume, CASE WHEN bool_or(p_partkey % 97 = 0) THEN NULL ELSE sum(p_size * (p_partkey % 97))::BIGINT END AS mass FROM part GROUP BY ALL""")
def model_quantities(spark, sf_dir):
    """Volume and mass per group; one member without density leaves the group without a mass."""
    p = table(spark, sf_dir, "part")
    lacks = F.bool_or(F.col("p_partkey") % 97 == 0)
    return p.groupBy(F.col("p_type").alias("type"), F.col("p_brand").alias("material")).agg(F.count("*").alias("n"), F.sum("p_size").alias("volume"), F.when(lacks, None).otherwise(F.sum(F.col("p_size") * (F.col("p_partkey") % 97))).alias("mass"))


@query("""SELECT p_brand AS material, sum(p_size)::BIGINT AS volume, count(DISTINCT p_type) AS types, row_number() OVER (ORDER BY sum(p_size) DESC, p_brand) AS rank FROM part GROUP BY p_brand""")
def material_rollup(spark, sf_dir):
    """Per material, the most voluminous first; as many rows as there are materials are ranked."""
    m = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("material")).agg(F.sum("p_size").alias("volume"), F.countDistinct("p_type").alias("types"))
    return m.withColumn("rank", F.row_number().over(W.orderBy(F.desc("volume"), "material")))


#: Fixed values of the estimate: hours for a metre by upper bound of the dimension, shares in per cent.
HOUR_BANDS = [(10, 4), (20, 6), (32, 9), (40, 13)]
SUPPLEMENT, WASTE, MARKUP, VAT = 15, 7, 12, 25


@query(f"""WITH {RUNS}, q AS (SELECT designation, dn, sum(metres)::BIGINT AS metres FROM runs WHERE state = 'CONFIRMED' GROUP BY ALL),
h AS (SELECT *, CASE WHEN dn <= 10 THEN 4 WHEN dn <= 20 THEN 6 WHEN dn <= 32 THEN 9 WHEN dn <= 40 THEN 13 END AS per FROM q)
SELECT designation, dn, metres, per AS hours_per_metre, metres * per * 115 AS hours_c, metres * (100 + dn) * 107 AS material_c, metres * (100 + dn) * 107 * 112 * 125 // 10000 AS gross_c FROM h""")
def estimate(spark, sf_dir):
    """Hours and material of each row, in hundredths; above the last band there are no hours, never extrapolated ones."""
    from plumbline.operators.interval import banded

    q = runs(spark, sf_dir).where("state = 'CONFIRMED'").groupBy("designation", "dn").agg(F.sum("metres").alias("metres"))
    h = banded(q, HOUR_BANDS, "dn", "hours_per_metre")
    material = F.col("metres") * (100 + F.col("dn")) * (100 + WASTE)
    return h.withColumn("hours_c", F.col("metres") * F.col("hours_per_metre") * (100 + SUPPLEMENT)).withColumn("material_c", material).withColumn("gross_c", F.expr(f"material_c * {100 + MARKUP} * {100 + VAT} div 10000"))


@query(f"""WITH {RUNS} SELECT designation, sum(CASE WHEN state = 'AMBIGUOUS' THEN metres ELSE 0 END)::BIGINT AS hatched, sum(metres)::BIGINT - sum(CASE WHEN state = 'UNOWNED' THEN metres ELSE 0 END)::BIGINT AS horizontal, sum(line)::BIGINT * 3 AS vertical, CASE WHEN sum(line) > 0 THEN 'RISERS' ELSE 'NONE' END AS vertical_source FROM runs GROUP BY designation""")
def floor_height_rows(spark, sf_dir):
    """Rows with declared metres removed, hatched ones kept, and risers times the floor height."""
    of = lambda s: F.sum(F.when(F.col("state") == s, F.col("metres")).otherwise(0))
    g = runs(spark, sf_dir).groupBy("designation").agg(of("AMBIGUOUS").alias("hatched"), (F.sum("metres") - of("UNOWNED")).alias("horizontal"), (F.sum("line") * 3).alias("vertical"), F.sum("line").alias("_r"))
    return g.withColumn("vertical_source", F.when(F.col("_r") > 0, "RISERS").otherwise("NONE")).drop("_r")


@query(f"""WITH {RUNS}, n AS (SELECT part, state, count(*) AS n FROM runs GROUP BY ALL), a AS (SELECT part FROM runs GROUP BY part)
SELECT 'parts' AS what, count(*) AS n FROM a UNION ALL SELECT 'silent', count(*) FROM a WHERE part NOT IN (SELECT part FROM n WHERE state = 'CONFIRMED') UNION ALL SELECT lower(state), sum(n)::BIGINT FROM n GROUP BY state""")
def frontier_summary(spark, sf_dir):
    """Ends by reason, and the pipes that none speaks for."""
    n = runs(spark, sf_dir).groupBy("part", "state").agg(F.count("*").alias("n"))
    parts = n.select("part").distinct()
    silent = parts.join(n.where("state = 'CONFIRMED'").select("part"), "part", "left_anti")
    one = lambda df, name: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    return one(parts, "parts").unionByName(one(silent, "silent")).unionByName(n.groupBy(F.lower("state").alias("what")).agg(F.sum("n").alias("n")))


@query("""SELECT l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS situation, CASE WHEN count(DISTINCT l_partkey % 3) = 1 THEN min(l_partkey % 3) END AS lesson, count(*) AS times, count(DISTINCT l_partkey % 3) AS answers FROM lineitem GROUP BY ALL""")
def lessons(spark, sf_dir):
    """A situation teaches only if it had one answer."""
    c = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") * 100 + F.col("l_quantity").cast("bigint")).alias("situation"))
    n = F.countDistinct(F.col("l_partkey") % 3)
    return c.agg(F.when(n == 1, F.min(F.col("l_partkey") % 3)).alias("lesson"), F.count("*").alias("times"), n.alias("answers"))


@query("""SELECT l_suppkey AS rule, count(*) AS n, min(CAST(round(l_discount * 100) AS INT))::INT AS low, max(CAST(round(l_discount * 100) AS INT))::INT AS high, min(l_linenumber) > 1 AS same_direction FROM lineitem GROUP BY l_suppkey""")
def rule_movers(spark, sf_dir):
    d = F.round(F.col("l_discount") * 100).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("rule")).agg(F.count("*").alias("n"), F.min(d).alias("low"), F.max(d).alias("high"), (F.min("l_linenumber") > 1).alias("same_direction"))


@query("""SELECT source, count(*) AS documents, count(DISTINCT coalesce(nullif(md5(text), ''), source || doc_id)) AS independent FROM documents GROUP BY source""")
def independent_sources(spark, sf_dir):
    """Documents count once by the hash of their text."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.countDistinct(F.coalesce(F.nullif(F.md5("text"), F.lit("")), F.concat("source", "doc_id"))).alias("independent"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")))
def row_counts(spark, sf_dir):
    from functools import reduce

    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")])


@query("""SELECT r_name AS building, n_name AS discipline, list_sort(list(c_name)) AS documents, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def document_register(spark, sf_dir):
    """The register's tree: building, discipline, documents."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("customer").join(t("nation"), F.expr("c_nationkey = n_nationkey")).join(t("region"), F.expr("n_regionkey = r_regionkey"))
    return j.groupBy(F.col("r_name").alias("building"), F.col("n_name").alias("discipline")).agg(F.array_sort(F.collect_list("c_name")).alias("documents"), F.count("*").alias("n"))


@query("""SELECT text, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")
