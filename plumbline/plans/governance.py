"""Set operations, reading of texts and labels, review, scoring and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import choose
from plumbline.operators import graph
from plumbline.plans.base import query, table
from plumbline.plans.graphs import BOTH, EDGES, edges
from plumbline.plans.takeoff import RUNS, runs


@query("""SELECT 'customer' AS sheet, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY ALL""")
def union_of_sheets(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    u = c.select(F.lit("customer").alias("sheet"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name")).unionByName(s.select(F.lit("supplier").alias("sheet"), F.col("s_nationkey").alias("nation")), allowMissingColumns=True)
    return u.groupBy("sheet", "nation").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT p_brand AS code, min(p_partkey) AS first, max(CASE p_type WHEN 'PROMO' THEN 2 WHEN 'SMALL' THEN 1 ELSE 0 END) AS role FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), b AS (SELECT p_brand AS code, min(p_partkey) AS first, max(CASE p_type WHEN 'PROMO' THEN 2 WHEN 'SMALL' THEN 1 ELSE 0 END) AS role FROM part WHERE p_size < 4 GROUP BY ALL)
SELECT coalesce(a.code, b.code) AS code, coalesce(a.first, b.first) AS first, greatest(coalesce(a.role, 0), coalesce(b.role, 0)) AS role FROM a FULL JOIN b ON a.code = b.code""")
def legend_merge(spark, sf_dir):
    """The first list's entry wins; roles only travel upward."""
    p = table(spark, sf_dir, "part")
    role = F.when(F.col("p_type") == "PROMO", 2).when(F.col("p_type") == "SMALL", 1).otherwise(0)
    side = lambda c, rank: p.where(c).groupBy(F.col("p_brand").alias("code")).agg(F.min("p_partkey").alias("first"), F.max(role).alias("role")).withColumn("list", F.lit(rank))
    u = side("p_partkey % 2 = 0", 0).unionByName(side("p_size < 4", 1))
    return u.groupBy("code").agg(F.min_by("first", "list").alias("first"), F.max("role").alias("role"))


@query("""SELECT l_partkey AS name FROM lineitem WHERE l_quantity = 50 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity = 1""")
def names_found_by_both(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_quantity = 50").select(F.col("l_partkey").alias("name")).intersect(li.where("l_quantity = 1").select(F.col("l_partkey").alias("name")))


@query("""WITH a AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 49), b AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 50)
SELECT 'only first' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'only second', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def signature_diff(spark, sf_dir):
    """What two readings do not have in common, rows counted as often as they are there."""
    li = table(spark, sf_dir, "lineitem")
    a, b = (li.where(f"l_quantity >= {q}").select("l_partkey", "l_suppkey") for q in (49, 50))
    n = lambda x, y, s: x.exceptAll(y).agg(F.lit(s).alias("side"), F.count("*").alias("n"))
    return n(a, b, "only first").unionByName(n(b, a, "only second"))


@query("""WITH i AS (SELECT p_partkey AS id, p_name || p_size AS stem, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS qualifier FROM part), s AS (SELECT stem, CASE WHEN count(DISTINCT qualifier) = 1 THEN min(qualifier) END AS sole FROM i GROUP BY stem) SELECT id, stem, coalesce(qualifier, sole) AS qualifier FROM i JOIN s USING (stem)""")
def complete_identities(spark, sf_dir):
    """A missing qualifier is filled in if its stem states exactly one."""
    i = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.col("p_size").cast("string")).alias("stem"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("qualifier"))
    w = W.partitionBy("stem")
    only = F.when(F.min("qualifier").over(w) == F.max("qualifier").over(w), F.min("qualifier").over(w))
    return i.select("id", "stem", F.coalesce("qualifier", only).alias("qualifier"))


@query("""SELECT p_name AS stem, p_size AS dn, CASE WHEN count(DISTINCT nullif(p_type, 'SMALL')) <= 1 THEN coalesce(min(nullif(p_type, 'SMALL')), 'any') END AS merged, count(*) AS members FROM part GROUP BY ALL""")
def compatible_merge(spark, sf_dir):
    """Identities of a stem merge if what they state agrees; what is not stated agrees with all."""
    t = F.nullif("p_type", F.lit("SMALL"))
    g = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("stem"), F.col("p_size").alias("dn"))
    return g.agg(F.when(F.countDistinct(t) <= 1, F.coalesce(F.min(t), F.lit("any"))).alias("merged"), F.count("*").alias("members"))


@query("""WITH r AS (SELECT l_orderkey AS word, p_brand AS text, count(*) AS votes, sum(l_linenumber) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT word, min_by(text, (-votes, -score, length(text), text)) AS reading FROM r GROUP BY word""")
def chosen_reading(spark, sf_dir):
    """The best reading of a word by votes, score, length, then text."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    r = j.groupBy(F.col("l_orderkey").alias("word"), F.col("p_brand").alias("text")).agg(F.count("*").alias("votes"), F.sum("l_linenumber").alias("score"))
    return r.groupBy("word").agg(F.min_by("text", F.struct(-F.col("votes"), -F.col("score"), F.length("text"), "text")).alias("reading"))


@query("""WITH v AS (SELECT DISTINCT p_name AS word FROM part), w AS (SELECT p_partkey AS id, substr(p_name, 1, 3) || '?' || substr(p_name, 5) AS mask FROM part) SELECT id, mask, CASE WHEN count(*) = 1 THEN min(word) END AS word, count(*) AS fits FROM w JOIN v ON length(word) = length(mask) AND substr(word, 1, 3) = substr(mask, 1, 3) AND substr(word, 5) = substr(mask, 5) GROUP BY ALL""")
def unknown_characters(spark, sf_dir):
    """A word with one unknown character, completed only if one word of the vocabulary fits."""
    p = table(spark, sf_dir, "part")
    key = lambda c: F.concat(F.substring(c, 1, 3), F.lit("?"), F.substring(c, 5, 100))
    v = p.select(F.col("p_name").alias("word")).distinct().withColumn("mask", key("word"))
    w = p.select(F.col("p_partkey").alias("id"), key("p_name").alias("mask"))
    return w.join(v, "mask").groupBy("id", "mask").agg(F.count("*").alias("fits"), F.min("word").alias("_w")).select("id", "mask", F.when(F.col("fits") == 1, F.col("_w")).alias("word"), "fits")


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v::DOUBLE) AS m FROM x GROUP BY ALL), d AS (SELECT x.vec_id, c.label AS near, sum((x.v::DOUBLE - c.m) * (x.v::DOUBLE - c.m)) AS d FROM x JOIN c USING (i) GROUP BY ALL) SELECT vec_id, arg_min(near, d) AS nearest FROM d GROUP BY vec_id""")
def classified_glyphs(spark, sf_dir):
    """The class whose mean is nearest: each place of a vector meets that place of the classes' means, and the squares are summed by vector and class."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    c = x.groupBy(F.col("label").alias("near"), "i").agg(F.avg("v").alias("m"))
    d = x.join(c, "i").groupBy("vec_id", "near").agg(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))).alias("d"))
    return d.groupBy("vec_id").agg(F.min_by("near", "d").alias("nearest"))


@query("""SELECT md5(text) AS fingerprint, count(*) AS uses, min(doc_id) AS classified FROM documents GROUP BY ALL""")
def fingerprint_families(spark, sf_dir):
    """Each shape is classified once, at its first use."""
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("fingerprint")).agg(F.count("*").alias("uses"), F.min("doc_id").alias("classified"))


@query("""SELECT page_id, CASE WHEN length(html) >= 20000 THEN 'vector' WHEN length(html) >= 5000 AND contains(html, '<li>') THEN 'mixed' WHEN contains(html, '<p>') THEN 'raster' ELSE 'empty' END AS class, (length(html) - length(replace(html, '<p>', ''))) // 3 AS paths FROM pages""")
def page_classes(spark, sf_dir):
    """Pages by what is on them; those that are not read are rows with a reason too."""
    h = F.col("html")
    cls = F.when(F.length(h) >= 20000, "vector").when((F.length(h) >= 5000) & h.contains("<li>"), "mixed").when(h.contains("<p>"), "raster").otherwise("empty")
    return table(spark, sf_dir, "pages").select("page_id", cls.alias("class"), F.expr("(length(html) - length(replace(html, '<p>', ''))) div 3").alias("paths"))


@query(r"""SELECT page_id, regexp_extract(url, '^(https?)', 1) AS scheme, regexp_extract(url, '/([a-z]{2})/', 1) AS stage, CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS INT) AS number, coalesce(nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ''), regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) = regexp_extract(html, '<title>([^<]*)</title>', 1) AS agreed FROM pages""")
def title_block(spark, sf_dir):
    """Fields of a page with where they come from: what two places agree on is surer."""
    h1, title = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^(https?)", 1).alias("scheme"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("stage"), F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).cast("int").alias("number"), F.coalesce(F.nullif(h1, F.lit("")), title).alias("title"), (h1 == title).alias("agreed"))


REVIEW = [("quantity without metres", "blocking", "l_quantity <= 1 AND l_discount = 0"), ("large discount", "noted", "l_discount >= 0.1 AND l_tax = 0"), ("dense sheet", "noted", "l_linenumber = 7 AND l_quantity = 50")]


@query(" UNION ALL ".join(f"SELECT '{code}' AS code, '{sev}' AS severity, l_orderkey AS sheet, count(*) AS n FROM lineitem WHERE {c} GROUP BY l_orderkey" for code, sev, c in REVIEW))
def review_findings(spark, sf_dir):
    """Independent rules, each a query of violations; their findings together."""
    li = table(spark, sf_dir, "lineitem")
    found = [li.where(c).groupBy(F.col("l_orderkey").alias("sheet")).agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), F.lit(sev).alias("severity"), "sheet", "n") for code, sev, c in REVIEW]
    return reduce(DataFrame.unionByName, found)


@query(f"WITH {RUNS} SELECT state AS role, count(*) AS runs, sum(metres)::BIGINT AS ink FROM runs WHERE part % 500 BETWEEN 100 AND 200 AND supplier BETWEEN 20 AND 60 GROUP BY state")
def region_explained(spark, sf_dir):
    """The ink within a rectangle by its role."""
    r = runs(spark, sf_dir).where((F.col("part") % 500).between(100, 200) & F.col("supplier").between(20, 60))
    return r.groupBy(F.col("state").alias("role")).agg(F.count("*").alias("runs"), F.sum("metres").alias("ink"))


@query(f"""WITH RECURSIVE {EDGES}, {BOTH}, r(id, top) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.top FROM r JOIN u ON u.a = r.id) SELECT id, min(top) AS component, 3::BIGINT AS orders_that_agree FROM r GROUP BY id""")
def determinism(spark, sf_dir):
    """The components of the network whatever the order of its segments: as they come, turned round, and dealt anew; a row that not all give is there with fewer than three."""
    e = edges(spark, sf_dir)
    turned = [e, e.select(F.col("b").alias("a"), F.col("a").alias("b")).orderBy(F.desc("a")), e.repartition(7, F.rand(11))]
    every = reduce(DataFrame.unionByName, [graph.components(x) for x in turned])
    return every.groupBy("id", "component").agg(F.count("*").alias("orders_that_agree"))


@query("""SELECT quality, toxic, count(*) AS n, count(*) FILTER (contains(text, '!!')) AS shouting, count(*) FILTER (regexp_matches(text, '[#*$%&|<>]{3}')) AS symbols FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def label_scoring(spark, sf_dir):
    """Simple signals against the labels."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return j.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count(F.when(F.col("text").contains("!!"), 1)).alias("shouting"), F.count(F.when(F.col("text").rlike("[#*$%&|<>]{3}"), 1)).alias("symbols"))


@query("""SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE len(list_filter(regexp_split_to_array(b.text, '[ \\n]+'), lambda w: w <> '')) >= 3""")
def contamination_scan(spark, sf_dir):
    """Documents that hold a benchmark text of three words or more: candidates share the text's inner words, then the whole text decides."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    words = lambda c: F.filter(F.split(c, r"[ \n]+"), lambda w: w != "")
    # The words from the second to the last but one, five at most, are whole words wherever the text stands.
    probe = b.select("item_id", F.col("text").alias("item"), words("text").alias("w")).where("size(w) >= 3").withColumn("k", F.expr("least(5, size(w) - 2)"))
    probe = probe.select("item_id", "item", "k", F.xxhash64(F.array_join(F.expr("slice(w, 2, k)"), " ")).alias("probe"))
    lengths = sorted(r.k for r in probe.select("k").distinct().collect())  # of 1 to 5
    own = d.select("doc_id", words("text").alias("w"))
    gram = lambda k: lambda i: F.xxhash64(F.array_join(F.slice("w", i, k), " "))
    grams = [own.where(f"size(w) >= {k}").select("doc_id", F.explode(F.transform(F.expr(f"sequence(1, size(w) - {k - 1})"), gram(k))).alias("probe")).withColumn("k", F.lit(k)) for k in lengths or [5]]
    met = reduce(DataFrame.unionByName, grams).join(probe, ["probe", "k"]).select("doc_id", "item_id", "item").distinct()
    return met.join(d.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("item"))).select("doc_id", "item_id").distinct()


@query("""WITH s AS (SELECT l_suppkey AS style, sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'A') AS before, sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'R') AS after FROM lineitem GROUP BY l_suppkey)
SELECT style, CASE WHEN after * 100 < before * 90 THEN 'WORSE' WHEN after * 100 > before * 110 THEN 'BETTER' ELSE 'SAME' END AS verdict, bool_or(after * 100 < before * 90) OVER () AS rolled_back FROM s""")
def rule_gate(spark, sf_dir):
    """A rule change is rolled back if any style gets worse beyond the noise."""
    li = table(spark, sf_dir, "lineitem")
    of = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity").cast("bigint")))
    s = li.groupBy(F.col("l_suppkey").alias("style")).agg(of("A").alias("before"), of("R").alias("after"))
    worse = F.col("after") * 100 < F.col("before") * 90
    s = s.select("style", F.when(worse, "WORSE").when(F.col("after") * 100 > F.col("before") * 110, "BETTER").otherwise("SAME").alias("verdict"))
    return s.join(F.broadcast(s.agg(F.bool_or(F.col("verdict") == "WORSE").alias("rolled_back"))))


@query("""WITH c AS (SELECT l_orderkey AS q, list_sort(list(DISTINCT l_suppkey)) AS candidates, max(l_partkey % 100) AS answer FROM lineitem GROUP BY ALL) SELECT q, CASE WHEN list_contains(candidates, answer) THEN answer END AS accepted FROM c""")
def second_reader(spark, sf_dir):
    """A second reader's answer counts only if it is one of the candidates."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.collect_set("l_suppkey").alias("candidates"), F.max(F.col("l_partkey") % 100).alias("answer"))
    return c.select("q", F.when(F.expr("array_contains(candidates, answer)"), F.col("answer")).alias("accepted"))


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN role IN ('assistant', 'user') THEN role ELSE 'user' END AS role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE trim(text) <> '') SELECT conv_id, turn, role, length(text) AS n_chars FROM m WHERE n <= 20""")
def conversation_hygiene(spark, sf_dir):
    """The last twenty messages of each conversation; unknown roles are users, blank texts go."""
    m = table(spark, sf_dir, "conversations").where("trim(text) <> ''")
    m = choose.top_k(m, ["conv_id"], 20, F.desc("turn"))
    return m.select("conv_id", "turn", F.when(F.col("role").isin("assistant", "user"), F.col("role")).otherwise("user").alias("role"), F.length("text").cast("bigint").alias("n_chars"))


@query("""WITH x AS (SELECT l_orderkey AS d, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS y FROM lineitem GROUP BY ALL), s AS (SELECT count(*) AS k, sum(n) AS sn, sum(y) AS sy, sum(n * n) AS snn, sum(n * y) AS sny FROM x) SELECT k, (k * sny - sn * sy)::BIGINT AS slope_over, (k * snn - sn * sn)::BIGINT AS slope_under FROM s""")
def cost_fit(spark, sf_dir):
    """The least-squares slope of metres by runs, as an exact fraction."""
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("y"))
    s = x.agg(F.count("*").alias("k"), F.sum("n").alias("sn"), F.sum("y").alias("sy"), F.sum(F.expr("n * n")).alias("snn"), F.sum(F.expr("n * y")).alias("sny"))
    return s.select("k", F.expr("k * sny - sn * sy").alias("slope_over"), F.expr("k * snn - sn * sn").alias("slope_under"))


@query("""WITH p AS (SELECT l_partkey AS line, l_suppkey + unnest(range(0, CAST(l_quantity AS BIGINT) + 1, 5)) AS x FROM lineitem WHERE l_returnflag = 'A'), o AS (SELECT DISTINCT l_partkey AS line, l_suppkey AS x FROM lineitem WHERE l_returnflag = 'R') SELECT line, count(*) AS samples, count(*) FILTER (EXISTS (SELECT 1 FROM o WHERE o.line = p.line AND o.x BETWEEN p.x - 2 AND p.x + 2)) AS near FROM p GROUP BY line""")
def markup_overlap(spark, sf_dir):
    """Reference lines sampled point by point, and how many samples have an owner close by: both sides of a grid cell are asked."""
    li = table(spark, sf_dir, "lineitem")
    p = li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("line"), F.monotonically_increasing_id().alias("_i"), "l_suppkey", "l_quantity").select("line", F.expr("explode(transform(sequence(0, cast(l_quantity as int), 5), d -> l_suppkey + d))").alias("x"))
    n = p.groupBy("line", "x").agg(F.count("*").alias("k"))
    o = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("line"), F.explode(F.expr("sequence(l_suppkey - 2, l_suppkey + 2)")).alias("x")).distinct().withColumn("hit", F.lit(1))
    return n.join(o, ["line", "x"], "left").groupBy("line").agg(F.sum("k").alias("samples"), F.sum(F.col("k") * F.coalesce("hit", F.lit(0))).alias("near"))


@query("""WITH x AS (SELECT l_suppkey AS band, l_partkey AS y FROM lineitem), d AS (SELECT DISTINCT band, y FROM x), f AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY band ORDER BY y) <= 5 THEN 0 ELSE 1 END AS fresh FROM d), g AS (SELECT *, sum(fresh) OVER (PARTITION BY band ORDER BY y ROWS UNBOUNDED PRECEDING) AS row FROM f) SELECT band, row::BIGINT AS row, min(y) AS lo, max(y) AS hi, count(*) AS members FROM g GROUP BY band, row""")
def row_clusters(spark, sf_dir):
    """Words of a band in rows, a row ending where the gap is too large."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("band"), F.col("l_partkey").alias("y")).distinct()
    w = W.partitionBy("band").orderBy("y")
    f = d.withColumn("_f", F.when(F.col("y") - F.lag("y").over(w) <= 5, 0).otherwise(1))
    g = f.withColumn("row", F.sum("_f").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return g.groupBy("band", "row").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count("*").alias("members"))


@query("""WITH g AS (SELECT o_custkey AS ex, list(DISTINCT o_orderkey % 6) AS given, [0, 1, 2] AS keyed FROM orders GROUP BY ALL) SELECT ex, len(list_intersect(given, keyed)) * 1000 // len(list_distinct(list_concat(given, keyed))) AS points, len(list_intersect(given, keyed)) = 3 AND len(given) = 3 AS passed FROM g""")
def graded_sets(spark, sf_dir):
    """An answer that is a set, graded by what it shares with the key."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ex")).agg(F.collect_set(F.col("o_orderkey") % 6).alias("given"))
    key = F.array(*[F.lit(x).cast("bigint") for x in (0, 1, 2)])
    both, either = F.size(F.array_intersect("given", key)), F.size(F.array_union("given", key))
    return g.select("ex", F.floor(both * 1000 / either).alias("points"), ((both == 3) & (F.size("given") == 3)).alias("passed"))


@query("""SELECT s_suppkey AS level, s_acctbal AS elevation, coalesce(CASE WHEN s_suppkey % 4 = 0 THEN 2700.0 END, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - s_suppkey, 3000)::DOUBLE AS height FROM supplier""")
def level_heights(spark, sf_dir):
    """A level's own height, else up to the next level, else the usual one."""
    nxt = F.lead("s_suppkey").over(W.partitionBy("s_nationkey").orderBy("s_suppkey")) - F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("level"), F.col("s_acctbal").alias("elevation"), F.coalesce(F.when(F.col("s_suppkey") % 4 == 0, 2700.0), nxt.cast("double"), F.lit(3000.0)).alias("height"))


VALIDATION = [("part without price", "SELECT p_partkey AS id FROM part WHERE p_retailprice < 905"), ("order without line", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"), ("negative balance", "SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0")]


@query(" UNION ALL ".join(f"SELECT '{n}' AS problem, id FROM ({s})" for n, s in VALIDATION))
def model_validation(spark, sf_dir):
    """The problems of a model: each kind is a query of violations."""
    t = lambda n: table(spark, sf_dir, n)
    found = [
        t("part").where("p_retailprice < 905").select(F.lit(VALIDATION[0][0]).alias("problem"), F.col("p_partkey").alias("id")),
        t("orders").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select(F.lit(VALIDATION[1][0]).alias("problem"), F.col("o_orderkey").alias("id")),
        t("customer").where("c_acctbal < 0").select(F.lit(VALIDATION[2][0]).alias("problem"), F.col("c_custkey").alias("id")),
    ]
    return reduce(DataFrame.unionByName, found)


@query("""SELECT p_partkey AS id, CASE WHEN p_size <= 297 // 20 THEN 'A4' WHEN p_size <= 21 THEN 'A3' WHEN p_size <= 30 THEN 'A2' WHEN p_size <= 42 THEN 'A1' END AS format, CASE WHEN p_size % 9 BETWEEN 1 AND 6 THEN p_size % 9 END AS factor FROM part""")
def paper_format(spark, sf_dir):
    """The first format that a size fits; a factor outside its range has no value, it is never clamped."""
    s = F.col("p_size")
    fmt = F.when(s <= 14, "A4").when(s <= 21, "A3").when(s <= 30, "A2").when(s <= 42, "A1")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), fmt.alias("format"), F.when((s % 9).between(1, 6), s % 9).alias("factor"))


@query("""SELECT l_orderkey AS sheet, sha256(string_agg(l_partkey || '=' || l_suppkey, ';' ORDER BY l_partkey, l_suppkey)) AS fingerprint FROM lineitem GROUP BY l_orderkey""")
def rules_fingerprint(spark, sf_dir):
    """A hash over sorted settings."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sheet"))
    rows = F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey")))
    return g.agg(F.sha2(F.array_join(F.transform(rows, lambda r: F.concat(r["l_partkey"].cast("string"), F.lit("="), r["l_suppkey"].cast("string"))), ";"), 256).alias("fingerprint"))


@query("""SELECT event_id, CAST(props->>'$.k' AS INT) AS k, json_valid(props) AS valid FROM events""")
def json_payload(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int"))
    return e.select("event_id", "p.k", F.col("p").isNotNull().alias("valid"))
