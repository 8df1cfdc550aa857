"""Cluster properties, halo widths, histograms and comparison of two clusterings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.model import TICK_NS
from hitweave.operators import kernels


def properties(clustered: DataFrame) -> DataFrame:
    """cluster_id, hit_count, diameter (px), timespan (ns), total_energy, center_x, center_y."""
    return clustered.groupBy("cluster_id").agg(
        F.count("*").alias("hit_count"),
        F.greatest(F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1).cast("long").alias("diameter"),
        ((F.max("tick") - F.min("tick")) * F.lit(TICK_NS)).alias("timespan"),
        F.sum("e").alias("total_energy"),
        F.avg("x").alias("center_x"),
        F.avg("y").alias("center_y"),
    )


def halo_widths(clustered: DataFrame, threshold: float = 50.0, full: float = 0.74) -> DataFrame:
    """cluster_id, e, halo for each hit above the threshold of clusters that don't touch the chip's edge."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for cluster, hits in zip(part["cluster_id"], part["hits"], strict=True):
                x, y, e = (np.array([h[c] for h in hits]) for c in ("x", "y", "e"))
                out += [(cluster, *h) for h in kernels.halo_width(x, y, e, threshold, full)]
            yield pd.DataFrame(out, columns=["cluster_id", "e", "halo"]).astype({"cluster_id": "int64", "e": "float64", "halo": "int32"})

    # Clusters without such hits, or on the edge, never leave the JVM.
    edge = lambda c: (F.min(c) == 0) | (F.max(c) == 255)
    groups = clustered.groupBy("cluster_id").agg(F.max("e").alias("top"), (edge("x") | edge("y")).alias("edge"), F.collect_list(F.struct("x", "y", "e")).alias("hits"))
    return groups.filter((F.col("top") > threshold) & ~F.col("edge")).select("cluster_id", "hits").mapInPandas(run, "cluster_id long, e double, halo int")


def histogram_2d(df: DataFrame, a: str, b: str, buckets: int = 10) -> DataFrame:
    """a_bucket, b_bucket, share: equal-width buckets between the extremes, counts over the largest one."""
    ends = df.agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in (a, b) for n, f in (("lo", F.min), ("hi", F.max))))
    rows = df.select(a, b).crossJoin(F.broadcast(ends))  # one row of extremes

    def bucket(c: str) -> Column:
        width = (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / buckets
        return F.when(width > 0, F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / width), F.lit(buckets - 1))).otherwise(0).cast("int")

    counts = rows.groupBy(bucket(a).alias("a_bucket"), bucket(b).alias("b_bucket")).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    return counts.crossJoin(F.broadcast(top)).select("a_bucket", "b_bucket", (F.col("n") / F.col("top")).alias("share"))


def mean_std(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def log_values(lines: DataFrame, pattern: str, *by: Column) -> DataFrame:
    """Means of the numbers that the pattern's first group finds in log lines (column value)."""
    found = F.regexp_extract("value", pattern, 1)
    return lines.filter(found != "").groupBy(*by).agg(F.avg(found.cast("double")).alias("mean"), F.count("*").alias("n"))


def signatures(clustered: DataFrame) -> DataFrame:
    """A row per cluster: its hit count and a hash of its hits in any order (128 bits and the sum of 40 more)."""
    hashed = lambda seed: F.xxhash64(F.lit(seed), "tick", "x", "y")
    total = F.sum(F.pmod(hashed(3), F.lit(1 << 40)))  # repeated hits cancel each other in the others
    return clustered.groupBy("cluster_id").agg(F.count("*").alias("n"), F.bit_xor(hashed(1)).alias("h1"), F.bit_xor(hashed(2)).alias("h2"), total.alias("h3")).select(
        "cluster_id", "n", F.struct("n", "h1", "h2", "h3").alias("signature")
    )


def iou(first: DataFrame, second: DataFrame) -> DataFrame:
    """matched, only_first, only_second, iou: clusters with exactly the same hits match, each once."""
    count = lambda d, n: signatures(d).groupBy("signature").agg(F.count("*").alias(n))
    both = count(first, "a").join(count(second, "b"), "signature", "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    sums = both.agg(F.sum(F.least(a, b)).alias("matched"), F.sum(a).alias("na"), F.sum(b).alias("nb"))
    m = F.coalesce("matched", F.lit(0))
    rest = F.col("na") + F.col("nb") - m
    return sums.select(
        m.alias("matched"),
        (F.coalesce("na", F.lit(0)) - m).alias("only_first"),
        (F.coalesce("nb", F.lit(0)) - m).alias("only_second"),
        F.when(rest > 0, m / rest).alias("iou"),
    )


def approx_matches(first: DataFrame, second: DataFrame, first_ns: float = 0.001, hit_ns: float = 0.01, energy: float = 0.01) -> DataFrame:
    """Pairs (a, b) of nested clusters that are equal up to small differences of times and energies.

    Starts are compared within buckets of 10 ns and their neighbours, by an equi join.
    """
    cell = lambda d, n: d.select(F.floor(F.col("first_toa") / 10).alias("cell"), F.col("cluster_id").alias(n), F.col("first_toa").alias(f"{n}_toa"), F.col("hit_count").alias(f"{n}_n"), F.col("hits").alias(f"{n}_hits"))
    left = cell(first, "a")
    right = cell(second, "b").withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    pairs = left.join(right, "cell").filter((F.abs(F.col("a_toa") - F.col("b_toa")) <= first_ns) & (F.col("a_n") == F.col("b_n")))
    by = lambda c: F.array_sort(F.transform(c, lambda h: F.struct(h["toa"].alias("toa"), h["x"].alias("x"), h["y"].alias("y"), h["e"].alias("e"))))
    near = lambda p: (p["0"]["x"] == p["1"]["x"]) & (p["0"]["y"] == p["1"]["y"]) & (F.abs(p["0"]["toa"] - p["1"]["toa"]) < hit_ns) & (F.abs(p["0"]["e"] - p["1"]["e"]) < energy)
    zipped = F.zip_with(by(F.col("a_hits")), by(F.col("b_hits")), lambda p, q: F.struct(p.alias("0"), q.alias("1")))
    return pairs.filter(F.forall(zipped, near)).select("a", "b")


def approx_iou(first: DataFrame, second: DataFrame, **tolerance: float) -> DataFrame:
    """iou of nested clusterings under ``approx_matches``."""
    matched = approx_matches(first, second, **tolerance).agg(F.least(F.countDistinct("a"), F.countDistinct("b")).alias("matched"))
    sums = matched.crossJoin(first.agg(F.count("*").alias("na"))).crossJoin(second.agg(F.count("*").alias("nb")))
    rest = F.col("na") + F.col("nb") - F.col("matched")
    return sums.select("matched", F.when(rest > 0, F.col("matched") / rest).alias("iou"))
