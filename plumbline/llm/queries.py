"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import decontaminate

    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Fixed values of the URL rules: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import url_rules

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(_table(spark, sf_dir, "pages"), rules)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import substring_dedup

    return substring_dedup.dedup(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from plumbline.llm import byte_bpe

    return byte_bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op9_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import suffix_lm

    return suffix_lm.score(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import quality

    return quality.judge(_table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import near_dup

    return near_dup.classify(_table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import html_text

    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import quotes

    return quotes.link(_table(spark, sf_dir, "conversations"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import pii

    return pii.digest(pii.detect(_table(spark, sf_dir, "documents")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import collocations

    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one document in ten the words from `a` on are the first of them over and over, as the contract asks; the operator then judges every text."""
    from plumbline.llm import periodic_runs
    from plumbline.llm._shared import words_of

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    chosen = docs.withColumn("w", F.when(F.col("h") % 10 == 0, words_of(F.col("text"))))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    placed = chosen.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", F.when(n > 0, (F.floor((n - F.col("a")) / (3 + g % 8)) + 1).cast("int")))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    again = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)), F.lit(1), n - F.col("a")))
    return periodic_runs.digest(periodic_runs.detect(placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))))


def op13_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import quality_cnn

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    model = quality_cnn.fit(docs.where("NOT held_out"), _table(spark, sf_dir, "labels"))
    return quality_cnn.score(docs, model, keep=("held_out",)).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_url_rules, op3_substring_dedup, op4_byte_bpe, op5_near_duplicates, op6_html_text, op7_quotes, op8_pii, op9_suffix_lm, op10_quality_rules, op11_collocations, op12_periodic_runs, op13_quality_cnn)}

ORACLES = {
    "op2_url_rules": r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
""",
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w WHERE len(w) > 2),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (
  SELECT lang, phrase, a, 1 AS place, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
s AS (
  SELECT cut.*, fx.f AS l, fy.f AS r, (1000000 * a::HUGEINT * a::HUGEINT) // (fx.f::HUGEINT * fy.f::HUGEINT) AS score
  FROM cut JOIN f fx ON fx.lang = cut.lang AND fx.phrase = x JOIN f fy ON fy.lang = cut.lang AND fy.phrase = y),
best AS (SELECT lang, phrase, a, l, r, score::BIGINT AS score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1),
longer AS (
  SELECT lang, part, max(a) AS by_a FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.part = best.phrase WHERE by_a IS NULL OR 100 * by_a < 50 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
""",
}
