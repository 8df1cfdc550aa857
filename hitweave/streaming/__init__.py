"""Hit streams with Structured Streaming.

Event time is the tick count read as microseconds, as real times are too fine for timestamps.
Rows later than the watermark (500 microseconds of real time by default) are dropped by Spark;
``late_rows`` keeps them apart in batch.
"""

from __future__ import annotations

import socket
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hitweave.model import JOIN_TICKS, REORDER_TICKS, TICK_NS, WINDOW_TICKS
from hitweave.operators import kernels

LATENESS = f"{REORDER_TICKS // 1000} milliseconds"


def with_event_time(hits: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return hits.withColumn("et", F.timestamp_micros(F.col("tick"))).withWatermark("et", lateness)


def temporal_clusters(hits: DataFrame, max_dt: int = JOIN_TICKS) -> DataFrame:
    """lane, first_tick, last_tick, hit_count and energy of temporal clusters; each ``lane`` is a stream of its own.

    Spark joins events whose distance equals the gap, clusters don't: the gap is a tick shorter.
    """
    session = F.session_window("et", f"{max_dt - 1} microseconds")
    out = hits.groupBy("lane", session).agg(F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"), F.count("*").alias("hit_count"), F.sum("e").alias("energy"))
    return out.drop("session_window")


def window_counts(hits: DataFrame, width: int = WINDOW_TICKS) -> DataFrame:
    """win, hit_count, energy and max_energy of tumbling windows."""
    out = hits.groupBy(F.window("et", f"{width} microseconds")).agg(F.count("*").alias("hit_count"), F.sum("e").alias("energy"), F.max("e").alias("max_energy"))
    return out.select(F.floor(F.unix_micros("window.start") / width).cast("long").alias("win"), "hit_count", "energy", "max_energy")


class PixelListProcessor(StatefulProcessor):
    """Keeps a lane's hits until the watermark has passed their session, then clusters the session."""

    def __init__(self, max_dt: int = JOIN_TICKS, tile: int = 1):
        self.max_dt, self.tile = max_dt, tile

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("hits", "tick long, x int, y int, e double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[["tick", "x", "y", "e"]]
        yield from self._emit(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._emit(key, None, timerValues)

    def _emit(self, key, new: pd.DataFrame | None, timers) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.open.get()) if self.open.exists() else [], columns=["tick", "x", "y", "e"])
        hits = held if new is None else pd.concat([held, new], ignore_index=True) if len(held) else new
        hits = hits.sort_values(["tick", "y", "x"], ignore_index=True)
        mark = timers.getCurrentWatermarkInMs() * 1000
        session = (hits["tick"].diff().fillna(0) >= self.max_dt).cumsum()
        closed = hits["tick"].groupby(session).transform("max") + self.max_dt <= mark
        rest = hits[~closed]
        if len(rest):
            self.open.put([tuple(r) for r in rest.astype(object).itertuples(index=False)])
            self.handle.registerTimer(int(rest["tick"].max() + self.max_dt) // 1000 + 1)
        else:
            self.open.clear()
        done = hits[closed]
        for _, part in done.groupby(session[closed]):
            label = kernels.pixel_list(part["tick"].to_numpy("int64"), part["x"].to_numpy("int64"), part["y"].to_numpy("int64"), self.max_dt, self.tile)
            part = part.assign(key=part["tick"] * 65536 + part["y"] * 256 + part["x"], label=label)
            out = part.groupby("label").agg(cluster_id=("key", "min"), hit_count=("tick", "size"), energy=("e", "sum"), first=("tick", "min"), last=("tick", "max"))
            out["timespan"] = (out["last"] - out["first"]) * TICK_NS
            yield out[["cluster_id", "hit_count", "energy", "timespan"]].astype({"hit_count": "int64", "cluster_id": "int64"})

    def close(self) -> None:
        pass


def pixel_list_clusters(hits: DataFrame, max_dt: int = JOIN_TICKS, tile: int = 1) -> DataFrame:
    """cluster_id, hit_count, energy and timespan of exact pixel-list clusters; needs the RocksDB state store.

    Each ``lane`` is an independent stream (a detector, or a chip of one).
    """
    return hits.groupBy("lane").transformWithStateInPandas(
        PixelListProcessor(max_dt, tile), "cluster_id long, hit_count long, energy double, timespan double", "append", "eventtime"
    )


def throughput(progress: list) -> dict[str, float]:
    """Mean and median of input rows a second over the batches of ``query.recentProgress`` that had rows, and all rows."""
    rates = sorted(p["processedRowsPerSecond"] for p in progress if p["numInputRows"])
    rows = float(sum(p["numInputRows"] for p in progress))
    if not rates:
        return {"rows": rows, "mean": 0.0, "median": 0.0}
    return {"rows": rows, "mean": sum(rates) / len(rates), "median": rates[len(rates) // 2]}


def late_rows(hits: DataFrame, arrival: str, lateness: int = REORDER_TICKS, block: int = 1 << 16) -> DataFrame:
    """The hits that come more than ``lateness`` ticks after the latest time seen before them, in the order of ``arrival``."""
    from pyspark.sql import Window

    rows = hits.withColumn("__block", F.floor(F.col(arrival) / block))
    tops = rows.groupBy("__block").agg(F.max("tick").alias("__top"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(tops.select("__block", F.max("__top").over(before).alias("__seen")), "__block")
    inside = Window.partitionBy("__block").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.col("__seen"), F.max("tick").over(inside))
    return rows.withColumn("__late", seen - F.col("tick") > lateness).filter("__late").drop("__block", "__seen", "__late")


class UdpDatagrams(DataSource):
    """Stream source ``hit_udp``: datagrams of a readout as datagram_no and payload (options host, port, batch)."""

    @classmethod
    def name(cls) -> str:
        return "hit_udp"

    def schema(self) -> str:
        return "datagram_no long, payload binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return UdpReader(self.options.get("host", "127.0.0.1"), int(self.options.get("port", 1556)), int(self.options.get("batch", 10_000)))


class UdpReader(SimpleDataSourceStreamReader):
    """Takes what has arrived, up to a batch; datagrams stay in memory until Spark has committed them."""

    def __init__(self, host: str, port: int, batch: int):
        self.at, self.batch = (host, port), batch
        self.socket: socket.socket | None = None
        self.held: dict[int, bytes] = {}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _listen(self) -> socket.socket:
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, 1 << 24)
            self.socket.bind(self.at)
            self.socket.settimeout(0.05)
        return self.socket

    def read(self, start: dict):
        n, own = start["n"], self._listen()
        while n - start["n"] < self.batch:
            try:
                self.held[n] = own.recv(65_535)
            except TimeoutError:
                break
            n += 1
        return iter([(i, self.held[i]) for i in range(start["n"], n)]), {"n": n}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([(i, self.held[i]) for i in range(start["n"], end["n"]) if i in self.held])

    def commit(self, end: dict) -> None:
        for i in [i for i in self.held if i < end["n"]]:
            del self.held[i]
