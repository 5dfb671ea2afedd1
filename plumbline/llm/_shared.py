"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.shared import shared_dir, stored  # noqa: F401

#: What counts as white space between words: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like stored(), in one pass over several kinds of rows: partitioned by `key`, so that a reader of one kind opens only its files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(key).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def slices(texts: pa.Array, most: int = 1_000_000):
    """(from, to, texts) for ranges of consecutive texts of about `most` bytes, each decoded when its turn comes, so that work on a batch stays within memory; one long text is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        held = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, held + most, "right")))
        yield start, stop, texts.slice(start, stop - start).to_pylist()
        start = stop


#: Bytes, by Spark's estimate of the stored table, up to which it may be sent to all tasks.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame) -> DataFrame:
    """df, a stored table or a cheap reading of one, marked for broadcast if its rows, each taken at the width of its first rows, are few bytes; else it is joined by shuffle."""
    fixed = {"bigint": 8, "int": 4, "double": 8, "boolean": 1}
    if all(f.dataType.simpleString() in fixed for f in df.schema):
        most = BROADCAST_BYTES // (16 + sum(fixed[f.dataType.simpleString()] for f in df.schema))
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    width = F.sum(F.length(F.to_json(F.struct(*df.columns))).cast("long"))
    held = df.limit(BROADCAST_BYTES // 64 + 1).agg(F.count("*"), width).first()
    return F.broadcast(df) if held[0] <= BROADCAST_BYTES // 64 and (held[1] or 0) <= BROADCAST_BYTES else df


#: Rows of one key from which it counts as hot.
HOT = 2_000


def join_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows joined with per_key, a stored table of one row a key that says in `count` how many rows have it.

    Rows of hot keys are joined where they are, as the hot keys are sent to all tasks if they are few bytes; the others
    are shuffled. Both sides of the shuffled join are plain exchanges, which Spark can split where a key is large.
    """
    hot = per_key.where(F.col(count) >= HOT)
    few = small(hot)
    if few is hot:
        return rows.join(per_key, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(per_key.where(F.col(count) < HOT), keys)
    return rows.join(few, keys).unionByName(cold)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def rows_out(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema], schema=schema)
