"""URL rules as a sort-merge range join.

A host is written with its labels reversed and a dot after each (``com.example.www.``), so that a rule's host and all its
subdomains are one interval of keys: those that begin with the rule's own key. URLs and rules are dealt to ranges of
that key, a rule to every range that its interval meets, and each range is swept once in key order with a stack of
the rules whose interval is open. Nested rules lie on top of each other in the stack; the longest one whose path
begins the URL's path wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._shared import lower_ascii, rows_out

#: Rows that one sweep should have at most; hot ranges are split to meet it.
ROWS_A_SWEEP = 200_000
#: Keys drawn to lay the ranges' borders. They decide where rows are processed, never what they get.
BORDER_KEYS = 20_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``; empty stays empty."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _swept(batches: Iterator[pa.RecordBatch], schema: pa.Schema, default: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (range, key, rules first). The stack holds (key, path, rule, verdict) of open rules."""
    stack: list[tuple[str, str, str, str]] = []
    now = None
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in schema}
        cols = [batch.column(c).to_pylist() for c in ("_range", "_key", "_is_url", "_id", "_host", "_path", "_rule", "_verdict")]
        for part, key, is_url, rid, host, path, rule, verdict in zip(*cols, strict=True):
            if part != now:
                now, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                stack.append((key, path, rule, verdict))
                continue
            best = None
            for r in stack:
                if path.startswith(r[1]) and (best is None or len(r[2]) >= len(best[2])):
                    best = r
            for name, v in (("_id", rid), ("_host", host), ("_path", path), ("rule", best and best[2]), ("verdict", best[3] if best else default)):
                out[name].append(v)
        if out["_id"]:
            yield rows_out(out, schema)


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of `urls`: id, host, path, rule (null if none fits), verdict.

    rules: columns host, path, verdict. A rule fits its host and every subdomain if the URL's path begins with the
    rule's; of several the one with the longest host and path together wins, of equally long ones that with the
    longer host. Rules with an empty host or a null column are ignored. Null URLs and URLs without ``://`` have an
    empty host and path, fit no rule and get `default`. Repeated rows stay repeated; other columns of `urls` are not
    carried, so they cannot clash. Empty tables give empty results; with no rules all URLs get `default`.
    """
    spark = urls.sparkSession
    u = urls.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"))
    u = u.withColumn("_key", reversed_host(F.col("_host")))
    r = rules.where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL").select(reversed_host(lower_ascii(F.col("host"))).alias("_key"), F.col("path").alias("_path"), F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_verdict")).distinct()

    n = u.count()
    parts = max(1, math.ceil(n / ROWS_A_SWEEP), min(n // 1000, spark.sparkContext.defaultParallelism))
    drawn = sorted(x[0] for x in u.select("_key").sample(min(1.0, BORDER_KEYS / max(n, 1)), 7).limit(2 * BORDER_KEYS).collect())
    borders = sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)} if drawn else set())
    # How often a key is drawn shows how many sweeps its range needs: a hot host is split, and its rules go to each part.
    at = lambda key: sum(1 for b in borders if b <= key)
    drawn_in = [0] * (len(borders) + 1)
    for k in drawn:
        drawn_in[at(k)] += 1
    salts = [max(1, math.ceil(parts * c / max(len(drawn), 1))) for c in drawn_in]
    border_col, salt_col = F.array(*map(F.lit, borders)).cast("array<string>"), F.array(*map(F.lit, salts))

    def range_of(key: Column) -> Column:
        return F.size(F.filter(border_col, lambda b: b <= key))

    u = u.withColumn("_r", range_of(F.col("_key"))).withColumn("_s", F.pmod(F.xxhash64("_id", "_path"), salt_col[F.col("_r")]).cast("int"))
    r = r.withColumn("_r", F.explode(F.sequence(range_of(F.col("_key")), range_of(F.concat("_key", F.lit("\U0010ffff"))))))
    r = r.withColumn("_s", F.explode(F.sequence(F.lit(0), salt_col[F.col("_r")] - 1)))
    of = lambda c: F.concat_ws(":", c("_r"), c("_s")).alias("_range")
    both = u.select(of(F.col), "_key", F.lit(True).alias("_is_url"), "_id", "_host", "_path", F.lit(None).cast("string").alias("_rule"), F.lit(None).cast("string").alias("_verdict")).unionByName(
        r.select(of(F.col), "_key", F.lit(False).alias("_is_url"), F.lit(None).cast(u.schema["_id"].dataType).alias("_id"), F.lit(None).cast("string").alias("_host"), "_path", "_rule", "_verdict")
    )
    dealt = both.repartition(max(1, sum(salts)), "_range").sortWithinPartitions("_range", "_key", "_is_url")
    out = f"_id {u.schema['_id'].dataType.simpleString()}, _host string, _path string, rule string, verdict string"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], out).schema)
    return dealt.mapInArrow(lambda it: _swept(it, arrow, default), out).select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", "verdict")
