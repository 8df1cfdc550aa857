"""Tumbling windows of a hit stream and their feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave import functions as H
from hitweave.model import JOIN_TICKS, TICK_NS, WINDOW_TICKS

SCALARS = ["mean_x", "mean_y", "std_x", "std_y", "hit_count", "total_energy", "max_energy_hit", "mean_temp_cluster_size", "mean_temp_cluster_energy"]
BINS = len(H.ENERGY_EDGES) + 1


def assign(hits: DataFrame, width: int = WINDOW_TICKS, out: str = "win") -> DataFrame:
    """Hits with their window's number.

    Windows start at 0.  A hit on the boundary between two windows still goes to the earlier one if
    that is open, that is, if it is the first window or has a hit already.
    """
    rows = hits.withColumn("__k", F.floor(F.col("tick") / width)).withColumn("__edge", (F.col("tick") % width == 0) & (F.col("__k") > 0))
    # Few windows have hits on their boundary; only these and the ones before them are looked at.
    edges = rows.filter("__edge").select("__k").distinct()
    inner = rows.filter("not __edge").select((F.col("__k") + 1).alias("__k")).distinct().withColumn("__inner", F.lit(True))
    edges = edges.join(inner, "__k", "left").withColumn("__open", F.coalesce("__inner", F.lit(False)) | (F.col("__k") == 1))
    # Where only boundary hits come before, they kept that window open if they did not go down themselves.
    w = Window.orderBy("__k")
    edges = edges.withColumn("__starts", F.col("__open") | (F.coalesce(F.lag("__k").over(w), F.lit(-1)) != F.col("__k") - 1))
    edges = edges.withColumn("__from", F.last(F.when(F.col("__starts"), F.struct("__k", "__open")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    even = (F.col("__k") - F.col("__from.__k")) % 2 == 0
    edges = edges.select("__k", F.when(even, F.col("__from.__open")).otherwise(~F.col("__from.__open")).alias("__down"))
    rows = rows.join(edges, "__k", "left")
    number = F.when(F.col("__edge") & F.col("__down"), F.col("__k") - 1).otherwise(F.col("__k"))
    return rows.withColumn(out, number.cast("long")).drop("__k", "__edge", "__down")


def _deviation(n: Column, s: Column, s2: Column) -> Column:
    mean = s / n
    return F.when(n < 2, F.lit(float("nan"))).otherwise(F.sqrt(F.greatest(s2 / n - mean * mean, F.lit(0.0))))


def aggregate(windowed: DataFrame, width: int = WINDOW_TICKS, win: str = "win") -> DataFrame:
    """One row per non-empty window: win, start_toa_ns, the scalar features, last_tick and histogram bins h0 to h16.

    Hits are counted once per bin in the same aggregation; temporal clusters are gaps over 200 ns,
    the first hit counting if it is later than that after 0.
    """
    before = F.lag("tick").over(Window.partitionBy(win).orderBy("tick", "y", "x"))
    rows = windowed.withColumn("__opens", (F.col("tick") - F.coalesce(before, F.lit(0)) > JOIN_TICKS).cast("long")).withColumn("__bin", H.energy_bin(F.col("e")))
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    sums = rows.groupBy(win).agg(
        F.count("*").alias("n"),
        F.sum("e").alias("total_energy"),
        F.greatest(F.max("e"), F.lit(0.0)).alias("max_energy_hit"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"),
        F.sum("__opens").alias("c"),
        F.max("tick").alias("last_tick"),
        *(F.count_if(F.col("__bin") == i).alias(f"b{i}") for i in range(BINS)),
    )
    n, c = F.col("n"), F.col("c")
    return sums.select(
        win,
        (F.col(win) * width * F.lit(TICK_NS)).alias("start_toa_ns"),
        (F.col("sx") / n).alias("mean_x"),
        (F.col("sy") / n).alias("mean_y"),
        _deviation(n, F.col("sx"), F.col("sxx")).alias("std_x"),
        _deviation(n, F.col("sy"), F.col("syy")).alias("std_y"),
        n.cast("double").alias("hit_count"),
        "total_energy",
        "max_energy_hit",
        F.when(c > 0, F.floor(n / c)).otherwise(0).cast("double").alias("mean_temp_cluster_size"),
        F.when(c > 0, F.col("total_energy") / c).otherwise(0.0).alias("mean_temp_cluster_energy"),
        "last_tick",
        *((F.col(f"b{i}") / n).alias(f"h{i}") for i in range(BINS)),
    )


def fill_empty(features: DataFrame, width: int = WINDOW_TICKS, emit_open: bool = False, win: str = "win") -> DataFrame:
    """A row for every window from 0 on, empty ones with NaN means and zero counts; without the last, still open one unless asked for."""
    last = features.agg(F.max(win).alias("top"))
    spine = last.filter("top is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias(win))
    spine = spine if emit_open else spine.join(last, spine[win] == last["top"], "left_anti")
    out = spine.join(features, win, "left")
    nan = float("nan")
    values = {"start_toa_ns": F.col(win) * width * F.lit(TICK_NS)}
    values |= {c: F.coalesce(F.col(c), F.lit(nan if c[:4] in ("mean", "std_") and "temp" not in c else 0.0)) for c in SCALARS}
    values |= {f"h{i}": F.coalesce(F.col(f"h{i}"), F.lit(0.0)) for i in range(BINS)}
    return out.withColumns(values)


def features(hits: DataFrame, width: int = WINDOW_TICKS, emit_open: bool = False) -> DataFrame:
    return fill_empty(aggregate(assign(hits, width), width), width, emit_open)


def max_frequency(features_: DataFrame, width: int = WINDOW_TICKS) -> DataFrame:
    """Hits per second of the fullest closed window."""
    return features_.agg(F.max(F.col("hit_count") * 1e9 / F.lit(width * TICK_NS)).alias("max_frequency"))


def histogram_long(features_: DataFrame, win: str = "win") -> DataFrame:
    """win, bin, share: a row for each window and bin."""
    pairs = F.array(*(F.struct(F.lit(i).alias("bin"), F.col(f"h{i}").alias("share")) for i in range(BINS)))
    return features_.select(win, F.explode(pairs).alias("p")).select(win, "p.bin", "p.share")


def median_difference(filled: DataFrame, history: int, win: str = "win", block: int = 4096) -> DataFrame:
    """Scalar features minus the upper median of the ``history`` windows before; start time and histogram stay.

    Before the first window the history holds empty ones.  NaN sorts last.  Windows are handled in
    blocks that overlap by the history, however many blocks that spans, so no task sees the whole series.
    """
    nan = F.lit(float("nan"))
    empty = {c: nan if c.startswith(("mean_x", "mean_y", "std")) else F.lit(0.0) for c in SCALARS}
    rows = filled.withColumn("__block", F.floor(F.col(win) / block)).withColumn("__own", F.lit(True))
    reach = F.floor((F.col(win) + history) / block) - F.col("__block")  # how many of the blocks after its own look back at a window
    tail = rows.filter(reach > 0).withColumn("__block", F.explode(F.sequence(F.col("__block") + 1, F.col("__block") + reach))).withColumn("__own", F.lit(False))
    w = Window.partitionBy("__block").orderBy(win).rowsBetween(-history, -1)
    both = rows.unionByName(tail)
    # Windows that lie before number 0 are missing from the frame: so many empty vectors are added.
    missing = F.greatest(F.lit(history) - F.col(win), F.lit(0)).cast("int")
    for c in SCALARS:
        known = F.collect_list(c).over(w)
        both = both.withColumn(f"__m_{c}", F.element_at(F.array_sort(F.concat(known, F.array_repeat(empty[c], missing))), history // 2 + 1))
    out = both.filter("__own")
    return out.withColumns({c: F.col(c) - F.col(f"__m_{c}") for c in SCALARS}).drop("__block", "__own", *(f"__m_{c}" for c in SCALARS))


def to_vector(features_: DataFrame, replace_nan: bool = False) -> DataFrame:
    """win and vector: start time, scalars, histogram."""
    value = lambda c: F.when(F.isnan(c), 0.0).otherwise(F.col(c)) if replace_nan else F.col(c)
    return features_.select("win", F.array("start_toa_ns", *(value(c) for c in SCALARS), *(F.col(f"h{i}") for i in range(BINS))).alias("vector"))


def to_lines(features_: DataFrame) -> DataFrame:
    """One text line per window: scalars with six decimals, then ``[ ... ]`` with two."""
    scalar = lambda c: F.when(F.isnan(c), F.lit("nan")).otherwise(F.format_string("%.6f", F.col(c)))
    bins = F.concat_ws(" ", *(F.format_string("%.2f", F.col(f"h{i}")) for i in range(BINS)))
    return features_.select("win", F.concat_ws(" ", scalar("start_toa_ns"), *(scalar(c) for c in SCALARS), F.lit("["), bins, F.lit("]")).alias("value"))


def from_lines(lines: DataFrame) -> DataFrame:
    """The features of text lines (column value)."""
    parts = F.split(F.trim(F.regexp_replace("value", r"[\[\]]", " ")), r"\s+")
    names = ["start_toa_ns", *SCALARS, *(f"h{i}" for i in range(BINS))]
    return lines.filter(F.trim("value") != "").select(*(F.element_at(parts, i + 1).cast("double").alias(c) for i, c in enumerate(names)))
