"""Click sessions with a model: started, refined, confirmed or cancelled, in order of time; as a batch and as a stream.

Events have key, ts, seq, kind (start, refine, confirm, cancel), x, y, iou, area and corners: what the model made of the
click. A start opens a session if its mask is sure enough and not too large, and replaces one that is open; one that is
refused changes nothing. A refinement adds its point to an open session. A confirmation ends it, and gives a row if the
last polygon is one; a cancellation ends it without. Events of one key with equal seq are one event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEAST_IOU, LARGEST_AREA, LEAST_CORNERS = 0.5, 0.7, 3

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_OUT = "key string, started timestamp, ended timestamp, x double, y double, points long, corners int"


def accepted(iou: Column, area: Column) -> Column:
    """Whether a first mask opens a session."""
    return F.coalesce((iou >= LEAST_IOU) & (area <= LARGEST_AREA), F.lit(False))


def confirmed(events: DataFrame) -> DataFrame:
    """key, started, ended, x, y (of the first click), points and corners of the confirmed sessions of a batch."""
    e = events.dropDuplicates(["key", "seq"])
    along = Window.partitionBy("key").orderBy("ts", "seq")
    opens = (F.col("kind") == "start") & accepted(F.col("iou"), F.col("area"))
    turn = F.when(opens, True).when(F.col("kind").isin("confirm", "cancel"), False)
    e = e.withColumns({"opens": opens, "turn": turn})
    e = e.withColumn("open", F.coalesce(F.last("turn", True).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    e = e.withColumn("session", F.count_if("opens").over(along))
    own = e.where("opens or open and kind in ('refine', 'confirm')")
    click = F.when(F.col("kind") != "confirm", F.struct("ts", "seq"))
    by = own.groupBy(F.col("key").cast("string").alias("key"), "session").agg(
        F.min("ts").alias("started"),
        F.max(F.when(F.col("kind") == "confirm", F.col("ts"))).alias("ended"),
        F.min_by("x", click).alias("x"),
        F.min_by("y", click).alias("y"),
        F.count_if(F.col("kind") != "confirm").alias("points"),
        F.max_by("corners", click).alias("corners"),
    )
    return by.where(f"ended is not null and corners >= {LEAST_CORNERS}").select(*(c.split()[0] for c in _OUT.split(", ")))


class Sessions(StatefulProcessor):
    """Holds a key's events until the watermark says that none before them can come, then takes them in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long, seq long", "kind string, x double, y double, iou double, area double, corners int")
        self.session = handle.getValueState("session", "started long, x double, y double, points long, corners int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for df in rows:
            ts = df["ts"].astype("datetime64[us]").astype("int64")
            for t, e in zip(ts.tolist(), df.itertuples()):
                number = lambda v: None if pd.isna(v) else float(v)
                self.waiting.updateValue((t, int(e.seq)), (e.kind, number(e.x), number(e.y), number(e.iou), number(e.area), None if pd.isna(e.corners) else int(e.corners)))
                last = t if last is None else max(last, t)
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ripe = sorted(((k, v) for k, v in self.waiting.iterator() if k[0] < now), key=lambda kv: tuple(kv[0]))
        out, open_ = [], self.session.get() if self.session.exists() else None
        seen = set()
        for (ts, seq), (kind, x, y, iou, area, corners) in ripe:
            self.waiting.removeKey((ts, seq))
            if seq in seen:
                continue
            seen.add(seq)
            if kind == "start" and iou is not None and area is not None and iou >= LEAST_IOU and area <= LARGEST_AREA:
                open_ = (ts, x, y, 1, corners)
            elif open_ and kind == "refine":
                open_ = (*open_[:3], open_[3] + 1, corners)
            elif kind in ("confirm", "cancel"):
                if open_ and kind == "confirm" and open_[4] is not None and open_[4] >= LEAST_CORNERS:
                    out.append((key[0], pd.Timestamp(open_[0], unit="us"), pd.Timestamp(ts, unit="us"), *open_[1:]))
                open_ = None
        if open_:
            self.session.update(tuple(open_))
        else:
            self.session.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    def close(self) -> None:
        pass


def confirmed_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """confirmed() of a stream: late and repeated events within the watermark give what a batch of all gives."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own = events.withColumn("key", F.col("key").cast("string")).withWatermark("ts", late)
    return own.groupBy("key").transformWithStateInPandas(Sessions(), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")


def served(calls: DataFrame) -> DataFrame:
    """calls (key, ts, seq, takes) with begins and ends, if each key's are served one after the other in order.

    A call begins when it comes or when the one before has ended: ends is the running sum of takes and the largest
    lead of an arrival over the sum before it, so two running windows give all."""
    along = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("takes").over(along)
    c = calls.withColumn("total", total).withColumn("lead", F.max(F.col("ts") - F.col("total") + F.col("takes")).over(along))
    return c.withColumn("ends", F.col("total") + F.col("lead")).withColumn("begins", F.col("ends") - F.col("takes")).drop("total", "lead")
