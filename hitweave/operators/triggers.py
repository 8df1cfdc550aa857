"""Triggers: which windows fire, and which hits pass while a trigger is active."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitweave.model import WINDOW_TICKS
from hitweave.operators import windows
from hitweave.operators.windows import BINS, SCALARS

#: Names in interval files for the features of a window.
NAMES = {
    "start_toa[ms]": "start_toa_ns",
    "mean_x[px]": "mean_x",
    "mean_y[px]": "mean_y",
    "std_x[px]": "std_x",
    "std_y[px]": "std_y",
    "hit_count[1]": "hit_count",
    "total_energy[keV]": "total_energy",
    "max_energy_hit[keV]": "max_energy_hit",
    "mean_temp_cluster_size[1]": "mean_temp_cluster_size",
    "mean_temp_cluster_energy[keV]": "mean_temp_cluster_energy",
}

Interval = dict[str, tuple[float, float]]


def parse_intervals(text: str) -> list[Interval]:
    """Rows of an interval file: a header of feature names, then ``[lo:hi]`` for each, ``*`` for no bound."""
    lines = [line for line in text.splitlines() if line.strip()]
    names = []
    for name in lines[0].split(" ") if lines else []:
        column = NAMES.get(name, name)
        if column not in (*SCALARS, "start_toa_ns"):
            raise ValueError(f"{name}: intervals are for scalar features only")
        names.append(column)
    out = []
    for line in lines[1:]:
        row: Interval = {}
        for name, part in zip(names, line.split(" "), strict=True):
            low, _, high = part.strip("[]").partition(":")
            row[name] = (-np.inf if low == "*" else float(low), np.inf if high == "*" else float(high))
        out.append(row)
    return out


def fires_interval(rows: list[Interval]) -> Column:
    """True if all values lie in the closed intervals of any row; NaN passes every test."""

    def inside(name: str, low: float, high: float) -> Column:
        c = F.col(name)
        return F.isnan(c) | ((c >= F.lit(float(low))) & (c <= F.lit(float(high))))

    out = F.lit(False)
    for row in rows:
        every = F.lit(True)
        for name, (low, high) in row.items():
            every = every & inside(name, low, high)
        out = out | every
    return out


def fires_frequency(ratio: float = 2.0, count: str = "hit_count") -> Column:
    """True if the rate differs from that of the window before by more than ``ratio`` either way; the first window fires."""
    before = F.lag(count).over(Window.orderBy("win"))
    up = (before > 0) & (F.col(count) / before > ratio)
    down = (F.col(count) > 0) & (before / F.col(count) > ratio)
    return F.coalesce(up | down, F.lit(True))


def read_model(spark: SparkSession, path: str) -> bytes:
    """The content of an ONNX file, from any store that Spark reads."""
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def fires_model(features_: DataFrame, model: bytes, one_class: bool = False) -> DataFrame:
    """Windows with column fires from an ONNX model's content (26 floats: all features but the start time, NaN as 0).

    Networks and classifiers fire above 0.5, one-class models below 0.
    """
    names = [*SCALARS, *(f"h{i}" for i in range(BINS))]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features_.schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # Spark has a task for each core already
        session = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
        source, target = session.get_inputs()[0].name, session.get_outputs()[0].name
        for part in parts:
            values = np.nan_to_num(part[names].to_numpy(np.float32), nan=0.0)
            score = np.asarray(session.run([target], {source: values})[0]).reshape(len(part), -1)[:, 0] if len(part) else np.zeros(0)
            yield part.assign(fires=score < 0 if one_class else score > 0.5)

    return features_.mapInPandas(run, f"{fields}, fires boolean")


def gate_windows(hits: DataFrame, width: int = WINDOW_TICKS, count_closing: bool = False) -> DataFrame:
    """Hits with column win and ``counted``: a hit that closes a window is in no window's statistics, unless asked for."""
    rows = windows.assign(hits, width)
    first = F.row_number().over(Window.partitionBy("win").orderBy("tick", "y", "x")) == 1
    return rows.withColumn("counted", F.lit(True) if count_closing else ~(first & (F.col("win") > 0)))


def activity(features_: DataFrame, trigger_ticks: int) -> DataFrame:
    """Non-empty windows (win, fires, last_tick) with ``active`` after each and ``was_active`` before."""
    w = Window.orderBy("win")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("fires"), F.col("last_tick")), ignorenulls=True).over(upto)
    out = features_.withColumn("active", F.coalesce(F.col("last_tick") - hit <= trigger_ticks, F.lit(False)))
    return out.withColumn("was_active", F.coalesce(F.lag("active").over(w), F.lit(False)))


def gate(windowed: DataFrame, states: DataFrame, width: int = WINDOW_TICKS) -> DataFrame:
    """The hits that pass: those after a window that left the trigger active, and those that a firing window lets out of the buffer.

    ``states`` comes from ``activity``.  Each hit's window meets the state of the last non-empty
    window before it and of the windows that can still flush it; both are equi joins on the number.
    """
    # Windows with hits only of the closing kind aren't shown to the trigger: they inherit the state before them.
    numbers = windowed.select("win").distinct().join(states.select("win", "fires", "active", "was_active"), "win", "left")
    w = Window.orderBy("win").rowsBetween(Window.unboundedPreceding, -1)
    numbers = numbers.withColumn("__before", F.coalesce(F.last("active", ignorenulls=True).over(w), F.lit(False)))
    rows = windowed.join(numbers.select("win", "__before"), "win")
    flush = states.filter("fires and not was_active").select(F.col("win").alias("__f"))
    # A window flushes its own hits and those not older than its start by a whole width.
    reach = flush.select("__f", F.explode(F.array(F.col("__f"), F.col("__f") - 1, F.col("__f") - 2)).alias("win"))
    reach = reach.groupBy("win").agg(F.min("__f").alias("__f"), F.max("__f").alias("__g"))
    rows = rows.join(reach, "win", "left")
    ok = lambda c: F.coalesce((F.col(c) == F.col("win")) | (F.col("tick") + width >= F.col(c) * width), F.lit(False))
    return rows.filter(F.col("__before") | ok("__f") | ok("__g")).drop("__before", "__f", "__g")


def discarded_share(all_hits: DataFrame, passed: DataFrame) -> DataFrame:
    n, kept = all_hits.agg(F.count("*").alias("n")), passed.agg(F.count("*").alias("kept"))
    return n.crossJoin(kept).select((1 - F.col("kept") / F.greatest("n", F.lit(1))).alias("discarded"))


def scaler(features_: DataFrame) -> DataFrame:
    """feature, mean, std over all windows; NaN adds nothing to the sums but counts, a tiny deviation becomes 1."""
    names = [*SCALARS, *(f"h{i}" for i in range(BINS))]
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.when(F.isnan(c), 0.0).otherwise(F.col(c)).alias("v")) for c in names))
    rows = features_.select(F.explode(pairs).alias("p")).select("p.feature", "p.v")
    out = rows.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return out.withColumn("std", F.when(F.col("std") < 1e-7, 1.0).otherwise(F.col("std")))


def frequency_windows(hits: DataFrame, width: int = WINDOW_TICKS // 4) -> DataFrame:
    """win and hit_count of the rate windows that the triggered clustering watches (50 ms by default)."""
    return hits.groupBy(F.floor(F.col("tick") / width).alias("win")).agg(F.count("*").cast("double").alias("hit_count"), F.max("tick").alias("last_tick"))
