"""Visits: a user's events without a long pause, ended early by a purchase; as a query and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds without an event after which a visit is over, the event that ends one at once, and how late an event may come.
PAUSE, CLOSES, LATE = 4 * 3600, "purchase", "1 day"
SCHEMA = "user_id bigint, start timestamp_ntz, end timestamp_ntz, events bigint, cents bigint, closed_by string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def visits(events: DataFrame, pause: int = PAUSE) -> DataFrame:
    """(user_id, start, end, events, cents, closed_by) from a table of events: two windows by user and a sum.

    Events of one moment are in the order of their ids. A visit is closed by its purchase or by the pause after it. Events without a user or a time are in none.
    """
    e = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "ts", "event_id", "event_type", F.coalesce(F.round(F.col("value") * 100).cast("bigint"), F.lit(0)).alias("cents"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    new = (gap > pause * 1_000_000) | (F.lag("event_type").over(w) == CLOSES)
    numbered = e.withColumn("visit", F.sum(F.when(new, 1).otherwise(0)).over(w))
    g = numbered.groupBy("user_id", "visit").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("events"), F.sum("cents").alias("cents"), F.bool_or(F.col("event_type") == CLOSES).alias("bought"))
    return g.select("user_id", "start", "end", "events", "cents", F.when(F.col("bought"), CLOSES).otherwise("pause").alias("closed_by"))


class _Visits(StatefulProcessor):
    """Events wait in the state, in no order, until the watermark has passed the end of their visit; a timer a pause after each wakes it up."""

    def __init__(self, pause: int):
        self.pause = pause * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts bigint, event_id bigint, event_type string, cents bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = set(self.handle.listTimers())
        for batch in rows:
            new = list(zip(batch["micros"].tolist(), batch["event_id"].tolist(), batch["event_type"].tolist(), batch["cents"].tolist()))
            if new:
                self.waiting.appendList([tuple(x) for x in new])
            for ts in {(x[0] + self.pause) // 1000 + 1 for x in new} - known:
                self.handle.registerTimer(ts)
                known.add(ts)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(x) for x in self.waiting.get())
        out, visit, rest = [], [], []

        def close(how):
            out.append((key[0], pd.Timestamp(visit[0][0], unit="us"), pd.Timestamp(visit[-1][0], unit="us"), len(visit), sum(x[3] for x in visit), how))
            visit.clear()

        for k, x in enumerate(held):
            if x[0] > now:  # an event before it may still come
                rest = held[k:]
                break
            if visit and x[0] - visit[-1][0] > self.pause:
                close("pause")
            visit.append(x)
            if x[2] == CLOSES:
                close(CLOSES)
        if visit and visit[-1][0] + self.pause < now and not (rest and rest[0][0] - visit[-1][0] <= self.pause):
            close("pause")
        if out:
            left = visit + rest
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
            yield pd.DataFrame(out, columns=["user_id", "start", "end", "events", "cents", "closed_by"])

    def close(self) -> None:
        pass


def visits_of_stream(events: DataFrame, pause: int = PAUSE, late: str = LATE) -> DataFrame:
    """The same rows from a stream, each when the watermark shows that nothing can change it; events later than `late` are lost, a restart goes on from the checkpoint.

    State is a user's waiting events, which the watermark bounds. The session needs the state store that keeps timers, PROVIDER.
    """
    e = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", F.col("ts").cast("timestamp").alias("_t"), "event_id", "event_type", F.coalesce(F.round(F.col("value") * 100).cast("bigint"), F.lit(0)).alias("cents"))
    e = e.withColumn("micros", F.unix_micros("_t")).withWatermark("_t", late)
    return e.groupBy("user_id").transformWithStateInPandas(_Visits(pause), SCHEMA, "Append", "EventTime")
