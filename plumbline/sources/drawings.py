"""Drawing files as tables of entities. Files are split by Spark; a task reads one file's text at a time."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "file string, n int, kind string, layer string, points array<struct<x:double,y:double>>, text string"
NUMBER = re.compile(r"-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, body), one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def dxf_entities(body: str) -> Iterator[tuple[str, str, list[tuple[float, float]], str | None]]:
    """Lines, polylines, circles, arcs and texts of a DXF file, which is pairs of lines: a code and a value. Other kinds are counted as they are, without points."""
    lines = [x.strip() for x in body.splitlines()]
    pairs = list(zip(lines[::2], lines[1::2], strict=False))
    at, inside = 0, False
    while at < len(pairs):
        code, value = pairs[at]
        at += 1
        if code == "2" and value == "ENTITIES":
            inside = True
        if code != "0" or not inside:
            continue
        if value == "ENDSEC":
            inside = False
            continue
        own: dict[str, list[str]] = {}
        while at < len(pairs) and pairs[at][0] != "0":
            own.setdefault(pairs[at][0], []).append(pairs[at][1])
            at += 1
        num = lambda c: [float(v) for v in own.get(c, [])]  # noqa: B023, E731
        layer = own.get("8", [""])[0]
        if value == "LINE":
            yield "line", layer, [*zip(num("10"), num("20"), strict=False), *zip(num("11"), num("21"), strict=False)], None
        elif value in ("LWPOLYLINE", "POLYLINE"):
            yield "polyline", layer, list(zip(num("10"), num("20"), strict=False)), None
        elif value in ("CIRCLE", "ARC") and num("10") and num("40"):
            a, b = (num("50") or [0.0])[0], (num("51") or [360.0])[0]
            b += 360 if b <= a else 0
            turn = [math.radians(a + (b - a) * k / 24) for k in range(25)]
            yield value.lower(), layer, [(num("10")[0] + num("40")[0] * math.cos(t), num("20")[0] + num("40")[0] * math.sin(t)) for t in turn], None
        elif value in ("TEXT", "MTEXT"):
            yield "text", layer, list(zip(num("10"), num("20"), strict=False)), own.get("1", [""])[0]
        else:
            yield f"unsupported {value}", layer, [], None


def svg_entities(body: str) -> Iterator[tuple[str, str, list[tuple[float, float]], str | None]]:
    """Lines, rectangles, polylines, polygons and straight path parts of an SVG file, under nested translations and scales."""

    def moved(matrix, points):
        sx, sy, dx, dy = matrix
        return [(x * sx + dx, y * sy + dy) for x, y in points]

    def walk(node, matrix):
        for name, args in re.findall(r"(translate|scale)\(([^)]*)\)", node.get("transform", "")):
            v = [float(x) for x in NUMBER.findall(args)]
            v = v + ([v[0]] if name == "scale" else [0.0]) if len(v) == 1 else v
            sx, sy, dx, dy = matrix
            matrix = (sx, sy, dx + sx * v[0], dy + sy * v[1]) if name == "translate" else (sx * v[0], sy * v[1], dx, dy)
        tag, get = node.tag.rpartition("}")[2], lambda k: float(node.get(k, 0))
        layer = node.get("class", "")
        if tag == "line":
            yield "line", layer, moved(matrix, [(get("x1"), get("y1")), (get("x2"), get("y2"))]), None
        elif tag == "rect":
            x, y, w, h = (get(k) for k in ("x", "y", "width", "height"))
            yield "rect", layer, moved(matrix, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]), None
        elif tag in ("polyline", "polygon"):
            v = [float(x) for x in NUMBER.findall(node.get("points", ""))]
            yield tag, layer, moved(matrix, list(zip(v[::2], v[1::2], strict=False))), None
        elif tag == "path":
            here, points = (0.0, 0.0), []
            for cmd, args in re.findall(r"([MmLlHhVvZz])([^MmLlHhVvZzCcSsQqTtAa]*)", node.get("d", "")):
                v = [float(x) for x in NUMBER.findall(args)]
                if cmd in "Zz":
                    points.append(points[0] if points else here)
                steps = [(x, None) for x in v] if cmd in "Hh" else [(None, y) for y in v] if cmd in "Vv" else list(zip(v[::2], v[1::2], strict=False))
                for x, y in steps:
                    if cmd.islower():
                        here = (here[0] + (x or 0.0), here[1] + (y or 0.0))
                    else:
                        here = (here[0] if x is None else x, here[1] if y is None else y)
                    points.append(here)
            yield "path", layer, moved(matrix, points), None
        elif tag == "text":
            yield "text", layer, moved(matrix, [(get("x"), get("y"))]), "".join(node.itertext())
        for child in node:
            yield from walk(child, matrix)

    yield from walk(ElementTree.fromstring(body), (1.0, 1.0, 0.0, 0.0))


def entities(files: DataFrame, of) -> DataFrame:
    """The entities of each file (file, body), numbered as they stand; a file that cannot be read is one row of kind 'error'."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, body in zip(b["file"], b["body"], strict=True):
                try:
                    rows += [(file, n, k, layer, [{"x": x, "y": y} for x, y in pts], text) for n, (k, layer, pts, text) in enumerate(of(body))]
                except (ElementTree.ParseError, ValueError) as e:
                    rows.append((file, 0, "error", "", [], str(e)))
            yield pd.DataFrame(rows, columns=["file", "n", "kind", "layer", "points", "text"])

    return files.select("file", "body").mapInPandas(read, ENTITY)


def read_dxf(spark: SparkSession, path: str) -> DataFrame:
    return entities(read_text_files(spark, path), dxf_entities)


def read_svg(spark: SparkSession, path: str) -> DataFrame:
    return entities(read_text_files(spark, path), svg_entities)


def bounds(found: DataFrame, by: list[str]) -> DataFrame:
    """The box of all points of each group."""
    p = found.select(*by, F.explode("points").alias("p"))
    return p.groupBy(*by).agg(F.min("p.x").alias("x0"), F.min("p.y").alias("y0"), F.max("p.x").alias("x1"), F.max("p.y").alias("y1"))


def segments(found: DataFrame) -> DataFrame:
    """Entities cut into segments."""
    p = F.col("points")
    pairs = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))
    return found.where("size(points) > 1").select("file", "n", "layer", F.posexplode(pairs).alias("seg", "s")).select("file", "n", "layer", "seg", "s.*")
