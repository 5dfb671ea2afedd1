"""Results kept as files: sheets gathered with their page, old forms read as the current one, tables written as CSV or by sheet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The current form of an artifact; older ones lack the columns that came later.
CURRENT = {"quantities": {"designation": "string", "dn": "int", "metres": "double", "state": "string"}, "issues": {"code": "string", "severity": "string", "page": "int"}}
#: Names of columns in older forms.
RENAMED = {"quantities": {"beteckning": "designation", "meters": "metres"}}


def gather(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of <folder>/sheets/<n>/<name>.json, one JSON object a line, with `page` from the path where a row has none."""
    df = spark.read.option("pathGlobFilter", f"{name}.json").option("recursiveFileLookup", "true").json(f"{folder}/sheets")
    page = F.regexp_extract(F.col("_metadata.file_path"), r"/sheets/(\d+)/", 1).cast("int")
    return df.withColumn("page", F.coalesce(F.col("page").cast("int"), page) if "page" in df.columns else page)


def upgraded(df: DataFrame, name: str) -> DataFrame:
    """Any form of an artifact as the current one: renamed columns, missing ones null; columns that are in no form go."""
    for old, new in RENAMED.get(name, {}).items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old)).drop(old)
    keep = [c for c in ("page",) if c in df.columns and c not in CURRENT[name]]
    return df.select(*keep, *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in CURRENT[name].items()])


def write_by_sheet(df: DataFrame, path: str, sheet: str = "page") -> None:
    """One folder a sheet; a reader of one sheet opens only its files."""
    df.repartition(sheet).write.partitionBy(sheet).parquet(path)


def write_csv(df: DataFrame, path: str, decimals: int = 2) -> None:
    """Semicolons between columns, decimal commas, and no semicolon or line break within a text."""
    kinds = dict(df.dtypes)
    one = lambda c: F.translate(F.format_string(f"%.{decimals}f", F.col(c)), ".", ",") if kinds[c] in ("double", "float") else F.regexp_replace(F.col(c).cast("string"), r"[;\r\n]", " ")
    df.select(*[one(c).alias(c) for c in df.columns]).write.option("sep", ";").option("header", True).csv(path)


def union_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: Rows of one file of a document; a file is read whole to take its hash, so a task holds no more than that.
FILE_ROWS = 50_000


def write_document(frames: dict[str, DataFrame], path: str) -> DataFrame:
    """All artifacts of a document under one folder, one after the other, then their manifest: (artifact, file, bytes, sha256) of every file that was written.

    The hashes are taken from the files as a reader finds them, so the manifest says what is there and not what was meant. It is written last;
    a folder without one is not whole.
    """
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        df.write.option("maxRecordsPerFile", FILE_ROWS).json(f"{path}/{name}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load([f"{path}/{n}" for n in frames])
    at = F.element_at(F.split("path", "/"), -1)
    manifest = files.select(F.element_at(F.split("path", "/"), -2).alias("artifact"), at.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")
