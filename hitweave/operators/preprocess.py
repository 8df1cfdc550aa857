"""From raw to calibrated, ordered hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave import functions as H
from hitweave.model import TICK_NS
from hitweave.operators.ordered import BUCKET, numbered, runs


def valid(raw: DataFrame) -> DataFrame:
    """Raw hits with a time; negative ones mark the end of a stream."""
    return raw.filter(F.col("toa") >= 0)


def decode(raw: DataFrame) -> DataFrame:
    """Raw hits with x, y, tick and toa_ns."""
    lin = F.col("linear_coord")
    t = H.tick(F.col("toa"), F.col("fast_toa"))
    return raw.withColumns({"x": H.pixel_x(lin), "y": H.pixel_y(lin), "tick": t, "toa_ns": H.toa_ns(t)})


def calibrate(hits: DataFrame, calib: DataFrame) -> DataFrame:
    """Hits with energy e; the calibration has one row for each of the chip's 65 536 pixels.

    A hit on a pixel without a row keeps the energy of an invalid pixel.
    """
    out = hits.join(F.broadcast(calib.select("x", "y", "a", "b", "c", "t")), ["x", "y"], "left")
    energy = H.energy(F.col("tot"), F.col("a"), F.col("b"), F.col("c"), F.col("t"))
    return out.withColumn("e", F.when(F.col("a").isNull(), F.lit(H.INVALID_KEV)).otherwise(energy)).drop("a", "b", "c", "t")


def uncalibrated(hits: DataFrame) -> DataFrame:
    return hits.withColumn("e", F.col("tot").cast("double"))


def to_raw(hits: DataFrame) -> DataFrame:
    """Calibrated hits (x, y, toa_ns) as raw hits; their time over threshold is lost and set to 1."""
    ns = F.col("toa_ns")
    return hits.select(
        H.linear_coord(F.col("x"), F.col("y")).alias("linear_coord"), H.slow_ticks(ns).alias("toa"), H.fast_ticks(ns).alias("fast_toa"), F.lit(1).alias("tot")
    )


def drop_faulty(hits: DataFrame, order: list[str], repeats: int = 10, pixel: str = "lin") -> DataFrame:
    """Without each hit that is more than the ``repeats``-th in a row from one pixel."""
    rows = runs(hits, pixel, order, F.floor(F.col("tick") / BUCKET), "__place")
    return rows.filter(F.col("__place") <= repeats).drop("__place")


def time_sorted(hits: DataFrame, order: list[str]) -> DataFrame:
    """Hits with row_no, their place in time; written out by ranges of time they need no global sort."""
    return numbered(hits, order, F.floor(F.col("tick") / BUCKET))


def range_sorted(hits: DataFrame, partitions: int | None = None) -> DataFrame:
    """Hits range-partitioned by time and sorted inside, as the file sinks want them."""
    by = ["tick", "y", "x"]
    ranged = hits.repartitionByRange(partitions, *by) if partitions else hits.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by)


def replay(raw: DataFrame, times: int, first_toa: int, last_toa: int) -> DataFrame:
    """Raw hits ``times`` over, each repetition shifted by the span of the recording."""
    again = raw.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return again.withColumn("toa", F.col("toa") + F.col("repetition") * (last_toa - first_toa))


def repeat(raw: DataFrame, times: int, size: int = 0, order: str = "line") -> DataFrame:
    """A recording over and over: its first ``size`` hits in file order (all, if not positive), shifted by their span each time."""
    if size > 0:
        raw = numbered(raw, [order], F.floor(F.col(order) / (1 << 16)), "__place").filter(F.col("__place") <= size).drop("__place")
    ends = raw.agg(F.min_by("toa", order).alias("first"), F.max_by("toa", order).alias("last")).first()
    return raw.limit(0).withColumn("repetition", F.lit(0)) if ends["first"] is None else replay(raw, times, ends["first"], ends["last"])


def scale_frequency(clustered: DataFrame, factor: float) -> DataFrame:
    """Clustered hits with the time between clusters divided by ``factor`` and that within them kept; toa and fast_toa follow."""
    first = clustered.groupBy("cluster_id").agg(F.min("tick").alias("__first"))
    moved = clustered.join(first, "cluster_id")
    ns = F.col("__first") * F.lit(TICK_NS) / F.lit(float(factor)) + (F.col("tick") - F.col("__first")) * F.lit(TICK_NS)
    moved = moved.withColumn("toa_ns", ns)
    return moved.withColumns({"toa": H.slow_ticks(F.col("toa_ns")), "fast_toa": H.fast_ticks(F.col("toa_ns"))}).drop("__first")
