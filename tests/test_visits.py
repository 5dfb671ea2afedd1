import datetime as dt
import random

from pyspark.sql import functions as F

from plumbline.streaming import events, visits


def plain(rows, pause):
    out = []
    for user in sorted({r[2] for r in rows}):
        visit = []
        for r in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0])):
            if visit and ((r[1] - visit[-1][1]).total_seconds() > pause or visit[-1][3] == "purchase"):
                out.append(visit)
                visit = []
            visit.append(r)
        out.append(visit)
    return sorted((v[0][2], v[0][1], v[-1][1], len(v), sum(round(x[4] * 100) for x in v), "purchase" if v[-1][3] == "purchase" else "pause") for v in out)


def table():
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    return [(i, start + dt.timedelta(seconds=rng.randint(0, 40) * 900), rng.randint(1, 6), rng.choice(["view", "click", "purchase", "view"]), float(rng.randint(0, 9)), None) for i in range(150)]


def test_stream_with_restarts_equals_the_query(spark, tmp_path):
    rows, pause = table(), 3600
    batch = spark.createDataFrame(rows, events.SCHEMA)
    want = plain(rows, pause)
    assert sorted(map(tuple, visits.visits(batch, pause).collect())) == want
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", visits.PROVIDER)
    try:
        order = sorted(rows, key=lambda r: (r[1], random.Random(r[0]).random()))
        late = lambda r: r[1] + dt.timedelta(seconds=random.Random(r[0]).randint(0, 5000))
        order.sort(key=late)  # out of order, within the watermark
        parts = [order[k : k + 50] for k in (0, 50, 100)] + [[(999, dt.datetime(2024, 2, 1), 99, "view", 0.0, None)], [(1000, dt.datetime(2024, 2, 9), 98, "view", 0.0, None)]]
        for k, part in enumerate(parts):  # each run is a restart from the checkpoint
            spark.createDataFrame(part, events.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            events.run_available(visits.visits_of_stream(events.read(spark, f"{tmp_path}/in"), pause, "2 hours"), f"{tmp_path}/out", f"{tmp_path}/chk")
            if k == 2:
                assert spark.read.parquet(f"{tmp_path}/out").count() < len(want)  # the last visits are still open
        got = spark.read.parquet(f"{tmp_path}/out").where(F.col("user_id") < 90)
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
