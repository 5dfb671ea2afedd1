"""Graphs given as tables of edges: components, reachability, shortest paths, chains, degrees."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.shared import removed, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = both.join(least, "a")
    out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = out.where("a <> b")
    return out if large else out.distinct()  # what the large stars repeat, the small ones sum


#: Edges that are contracted in memory at a time.
CHUNK = 500_000


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of the numbers below n hangs together with by the pairs (a, b): hooks on the lesser root, then roots of roots."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges (a, b), b < a, sorted by a: (open, u, v), stars (vertex, least vertex) of what hangs together in each chunk, and its open edges.

    An edge is open if its b may stand in a chunk before, or its a does already: what it joins may be known elsewhere. Before the first
    chunk of the first range there is none.
    """
    held, rows, last, first = [], 0, None, TaskContext.get().partitionId() == 0

    def one() -> pa.RecordBatch:
        nonlocal last, first
        t = pa.Table.from_batches(held)
        both = pa.concat_arrays([*t.column("a").chunks, *t.column("b").chunks]).dictionary_encode()
        order = pc.sort_indices(both.dictionary)
        names, code = both.dictionary.take(order), np.empty(len(order), np.int64)
        code[order.to_numpy()] = np.arange(len(order))
        code = code[both.indices.to_numpy()]
        a, b = code[: len(t)], code[len(t) :]
        if last is not None:
            before = pc.sum(pc.less_equal(names, last)).as_py()  # so many ids are not beyond the chunk before
            open_ = (b < before) | (a < before)
        else:
            open_ = b < (0 if first else a[0])
        last, first = names[a[-1]], False
        root = least_labels(len(names), a[~open_], b[~open_])
        own = np.unique(np.concatenate([a[~open_], b[~open_]]))
        u, v = np.concatenate([own, a[open_]]), np.concatenate([root[own], b[open_]])
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(u)) >= len(own)), names.take(pa.array(u)), names.take(pa.array(v))], names=["open", "u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield one()
                held, rows = [], 0
    if held:
        yield one()


def _starred(edges: DataFrame) -> DataFrame:
    """(id, component) of edges (a, b), a <> b, by alternating large and small stars; each round is removed when the next one is there."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    was = sign(e)
    while was[0]:
        old, e = e, stored(_star(_star(e, True), False), "stars")
        removed(old)
        now = sign(e)
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of edges (a, b): the least id that can be reached.

    Edges are sorted by their greater end and contracted chunk by chunk in memory. What reaches out of a chunk is left: if ids that hang together lie
    together, next to nothing, and that is done the same way. If it is most of them, stars are joined by alternating large and small stars, rounds that shuffle the edges and sum them before
    they do; a hub is no group that anyone collects. Repeated edges and nulls do no harm, an empty table gives an empty result.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    alone = edges.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    kind = e.schema["a"].dataType.simpleString()
    n = e.count()
    ranges = e.repartitionByRange(n // CHUNK + 1, "a").sortWithinPartitions("a")
    found = stored(ranges.mapInArrow(_contracted, f"open boolean, u {kind}, v {kind}"), "contracted")
    removed(e)
    out, left = found.where("NOT open").select(F.col("u").alias("id"), F.col("v").alias("component")), found.where("open")
    few = left.count()
    if few:
        root = lambda d, c: d.join(out.select(F.col("id").alias(c), F.col("component").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
        ends = root(root(left.select(F.col("u").alias("a"), F.col("v").alias("b")), "a"), "b")
        joined = stored(components(ends.where("a <> b")) if few <= n // 2 else _starred(ends.where("a <> b")), "joined")
        further = joined.join(out.select("id"), "id", "left_anti")
        out = out.join(joined.select(F.col("id").alias("component"), F.col("component").alias("_c")), "component", "left").select("id", F.coalesce("_c", "component").alias("component")).unionByName(further)
        out = stored(out, "components")
    return out.unionByName(alone.distinct().join(out.select("id"), "id", "left_anti"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def shortest_paths(edges: DataFrame, start, most: int | None = None) -> DataFrame:
    """(id, hops, path): every vertex that can be reached from `start` with the least of its shortest paths, as an array.

    With `most`, up to so many hops; else until nothing new is reached. Breadth first: a round joins the frontier with the edges and drops what was reached before. The start is reached
    even if no edge has it.
    """
    spark = edges.sparkSession
    e = stored(undirected(edges), "undirected")
    kind = e.schema["a"].dataType.simpleString()
    frontier = stored(spark.range(1).select(F.lit(start).cast(kind).alias("id"), F.lit(0).alias("hops"), F.array(F.lit(start).cast(kind)).alias("path")), "frontier")
    seen = frontier
    for hop in itertools.count(1) if most is None else range(1, most + 1):
        step = frontier.join(e.select(F.col("a").alias("id"), "b"), "id").select(F.col("b").alias("id"), F.lit(hop).alias("hops"), F.concat("path", F.array("b")).alias("path"))
        frontier = stored(step.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.first("hops").alias("hops"), F.min("path").alias("path")), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))


def chains(edges: DataFrame) -> DataFrame:
    """(id, chain): maximal runs of vertices of degree two, named by their least vertex."""
    two = degrees(edges).where("degree = 2").select("id")
    inner = undirected(edges).join(two.withColumnRenamed("id", "a"), "a", "left_semi").join(two.withColumnRenamed("id", "b"), "b", "left_semi")
    loops = two.select(F.col("id").alias("a"), F.col("id").alias("b"))
    return components(inner.unionByName(loops)).withColumnRenamed("component", "chain")


def neighbours_by_shared(membership: DataFrame, member: str, node: str) -> DataFrame:
    """(a, b), a < b: members that share a node."""
    l, r = membership.select(F.col(member).alias("a"), node), membership.select(F.col(member).alias("b"), node)
    return l.join(r, node).where("a < b").select("a", "b").distinct()
