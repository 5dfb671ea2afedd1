import json

from pyspark.sql import functions as F

from plumbline.sources import artifacts, drawings
from plumbline.streaming import events

DXF = "\n".join("0 SECTION 2 ENTITIES 0 LINE 8 pipes 10 0 20 0 11 3 21 4 0 LWPOLYLINE 8 walls 10 0 20 0 10 1 20 0 10 1 20 2 0 CIRCLE 8 c 10 5 20 5 40 2 0 TEXT 8 t 10 1 20 1 1 KV1 0 SPLINE 8 s 0 ENDSEC 0 EOF".split(" "))
SVG = '<svg xmlns="http://www.w3.org/2000/svg"><g transform="translate(10,0)"><g transform="scale(2)"><line x1="0" y1="0" x2="1" y2="1"/></g><path d="M0 0 l2 0 v3 h-2 z"/></g><rect x="1" y="1" width="2" height="3"/></svg>'


def test_drawings(spark, tmp_path):
    (tmp_path / "a.dxf").write_text(DXF)
    (tmp_path / "b.svg").write_text(SVG)
    (tmp_path / "c.svg").write_text("<svg>")
    d = drawings.read_dxf(spark, f"{tmp_path}/a.dxf")
    assert [r.kind for r in d.orderBy("n").collect()] == ["line", "polyline", "circle", "text", "unsupported SPLINE"]
    assert tuple(drawings.bounds(d.where("kind = 'circle'"), ["layer"]).first()) == ("c", 3, 3, 7, 7)
    assert drawings.segments(d.where("kind <> 'circle'")).count() == 3
    s = {r.kind: [(p.x, p.y) for p in r.points] for r in drawings.read_svg(spark, f"{tmp_path}/*.svg").collect()}
    assert s["line"] == [(10, 0), (12, 2)] and s["path"] == [(10, 0), (12, 0), (12, 3), (10, 3), (10, 0)] and s["error"] == []


def test_artifacts(spark, tmp_path):
    for n, row in ((1, {"beteckning": "KV1", "meters": 2.5}), (2, {"designation": "VV1", "dn": 22, "metres": 1.0, "page": 7})):
        (tmp_path / f"sheets/{n}").mkdir(parents=True)
        (tmp_path / f"sheets/{n}/quantities.json").write_text(json.dumps(row))
    q = artifacts.upgraded(artifacts.gather(spark, str(tmp_path), "quantities"), "quantities")
    assert sorted(map(tuple, q.collect())) == [(1, "KV1", None, 2.5, None), (7, "VV1", 22, 1.0, None)]
    artifacts.write_csv(q.withColumn("state", F.lit("a;b")), f"{tmp_path}/csv")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/csv").collect())
    assert "1;KV1;;2,50;a b" in lines
    artifacts.write_by_sheet(q, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").where("page = 7").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.accepted(events.read(spark, f"{tmp_path}/in"))
    events.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/chk")
    events.run_available(events.accepted(events.read(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/chk")  # a restart finds nothing new
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.accepted(batch).count()
    windows = events.daily(events.read(spark, f"{tmp_path}/in", 10))
    events.run_available(windows, f"{tmp_path}/days", f"{tmp_path}/chk2")
    closed = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/days").collect()}
    assert closed and closed <= {tuple(r) for r in events.daily(batch).collect()}
    assert events.sessions(batch).count() > 0
