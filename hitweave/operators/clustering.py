"""Clustering of calibrated hits: pixel-list, tiled, temporal, two-step, halo and energy-filtered.

Input: columns x, y, tick, e (and any others, which are kept).  Output: the same rows with
``cluster_id``, which is ``min(tick * 65536 + linear coordinate)`` over the cluster's hits, so it
depends on the data alone.  Hits are first cut into sessions at gaps no cluster can cross; the
sessions then go through a kernel on Arrow batches, very many in one call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.model import CHIP, JOIN_TICKS, SPLIT_TICKS, ticks
from hitweave.operators import kernels
from hitweave.operators.ordered import sessions

Kernel = Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]


def hit_key() -> Column:
    return F.col("tick") * 65536 + F.col("y") * CHIP + F.col("x")


def temporal(df: DataFrame, max_dt: int = JOIN_TICKS) -> DataFrame:
    """A cluster is a run of hits with gaps below ``max_dt`` ticks; space plays no part."""
    rows = sessions(df.withColumn("lin", F.col("y") * CHIP + F.col("x")), max_dt, "__session")
    least = F.min(hit_key()).over(Window.partitionBy("__session"))
    return rows.withColumn("cluster_id", least).drop("__session")


def in_sessions(df: DataFrame, session: str, kernel: Kernel, needs: tuple[str, ...] = ("tick", "x", "y")) -> DataFrame:
    """``df`` with cluster_id, by a kernel over the sessions' hits in time order."""
    fields = [f for f in df.schema.fields if f.name != "cluster_id"]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", cluster_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            own = batch.column(names.index(session)).to_numpy()
            cut = int(np.searchsorted(own, own[-1])) if len(own) else 0  # the last session may go on
            if held and len(own) and cut == 0 and held[-1].column(names.index(session))[0].as_py() != own[-1]:
                yield from finished(held)
                held = []
            if cut:
                yield from finished([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        yield from finished(held)

    def finished(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks() if parts else None
        if table is None or not table.num_rows:
            return
        cols = {c: table.column(c).to_numpy() for c in needs}
        own = table.column(session).to_numpy()
        key = cols["tick"] * 65536 + cols["y"].astype(np.int64) * CHIP + cols["x"]
        _, group = np.unique(kernel(own, cols), return_inverse=True)
        least = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, key)
        ids = least[group]
        for batch in table.append_column("cluster_id", pa.array(ids)).to_batches(max_chunksize=10_000):
            yield batch

    ordered = df.select(names).repartition(F.col(session)).sortWithinPartitions(session, "tick", "y", "x")
    return ordered.mapInArrow(run, schema)


def _by_sessions(df: DataFrame, gap: int, kernel: Kernel, needs: tuple[str, ...] = ("tick", "x", "y")) -> DataFrame:
    rows = sessions(df.withColumn("__lin", F.col("y") * CHIP + F.col("x")), gap, "__session", tie=("__lin",)).drop("__lin")
    return in_sessions(rows, "__session", kernel, needs).drop("__session")


def pixel_list(df: DataFrame, max_dt: int = JOIN_TICKS, tile: int = 1) -> DataFrame:
    """Exact pixel-list clustering; ``tile`` > 1 compares tiles of pixels instead."""
    if CHIP % tile:
        raise ValueError("the tile size must divide 256")

    def kernel(session: np.ndarray, h: dict[str, np.ndarray]) -> np.ndarray:
        return kernels.pixel_list_sessions(session, h["tick"], h["x"], h["y"], max_dt, tile)

    return _by_sessions(df, max_dt, kernel)


def two_step(df: DataFrame, gap: int = SPLIT_TICKS, area: int = 25) -> DataFrame:
    """Groups of hits with gaps below 30 ns; those whose box is over ``area`` are split into connected parts."""
    rows = sessions(df.withColumn("__lin", F.col("y") * CHIP + F.col("x")), gap, "__session", tie=("__lin",)).drop("__lin")
    w = Window.partitionBy("__session")
    span = lambda c: F.least(F.max(c).over(w) + 1, F.lit(CHIP - 1)) - F.greatest(F.min(c).over(w) - 1, F.lit(0))
    rows = rows.withColumn("__area", span("x") * span("y")).withColumn("__key", F.min(hit_key()).over(w))
    whole = rows.filter(F.col("__area") <= area).withColumn("cluster_id", F.col("__key"))

    def kernel(session: np.ndarray, h: dict[str, np.ndarray]) -> np.ndarray:
        return kernels.split_groups(session, h["tick"], h["x"], h["y"], gap - 1)

    split = in_sessions(rows.filter(F.col("__area") > area), "__session", kernel)
    return whole.unionByName(split).drop("__session", "__area", "__key")


def halo_boxes(df: DataFrame, window_ns: float = 1000.0, threshold: float = 120.0, tile: int = 2) -> DataFrame:
    """Halo bounding-box clustering in buffers of ``window_ns``; a gap longer than that always opens a new buffer."""
    window = ticks(window_ns)

    def kernel(session: np.ndarray, h: dict[str, np.ndarray]) -> np.ndarray:
        return kernels.each_session(session, lambda *c: kernels.halo_boxes(*c, window, threshold, tile=tile), h["tick"], h["x"], h["y"], h["e"])

    return _by_sessions(df, window + 1, kernel, ("tick", "x", "y", "e"))


def strict_halo_boxes(df: DataFrame, window_ns: float = 1000.0) -> DataFrame:
    """Halo clustering with a lower threshold of 60 keV and tiles of 4 pixels, so that boxes start from more hits and reach further."""
    return halo_boxes(df, window_ns, threshold=60.0, tile=4)


def energy_filtered(clustered: DataFrame, threshold: float = 70.0) -> DataFrame:
    """The hits of clusters with at least one hit above ``threshold`` keV."""
    hot = F.max("e").over(Window.partitionBy("cluster_id"))
    return clustered.withColumn("__hot", hot).filter(F.col("__hot") > threshold).drop("__hot")


def nested(clustered: DataFrame) -> DataFrame:
    """One row per cluster: cluster_id, first_toa, last_toa, hit_count and its hits in time order."""
    ns = F.col("tick") * F.lit(1.5625)
    hit = F.struct("tick", "x", "y", ns.alias("toa"), "e")
    return clustered.groupBy("cluster_id").agg(
        F.min(ns).alias("first_toa"), F.max(ns).alias("last_toa"), F.count("*").alias("hit_count"), F.sort_array(F.collect_list(hit)).alias("hits")
    )
