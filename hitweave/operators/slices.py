"""Time slices, their borders, and merging of clusters across borders.

The default clustering needs none of this: sessions are exact.  Slices serve data so dense that a
session never ends: each slice is clustered by itself, and only clusters near a border are merged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.model import CHIP, JOIN_TICKS, SLICE_NS, SLICE_TICKS, TICK_NS
from hitweave.operators import kernels
from hitweave.operators.clustering import in_sessions
from hitweave.operators.ordered import cut


def rounded_ns(tick: Column) -> Column:
    """Whole nanoseconds, halves away from zero."""
    return F.floor(tick * F.lit(TICK_NS) + 0.5).cast("long")


def slice_of(hits: DataFrame, lanes: int = 4) -> DataFrame:
    """Hits with their time slice and the lane (worker) it goes to."""
    at = F.floor(rounded_ns(F.col("tick")) / SLICE_NS).cast("long")
    return hits.withColumn("slice", at).withColumn("lane", (at % lanes).cast("int"))


def cluster_bounds(clustered: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """One row per cluster: its first and last tick, hit count and box, a pixel wider and within the chip."""
    return clustered.groupBy("cluster_id").agg(
        F.min("tick").alias("first_tick"),
        F.max("tick").alias("last_tick"),
        F.count("*").alias("hit_count"),
        F.greatest(F.min("x") - 1, F.lit(0)).cast("int").alias("left"),
        F.least(F.max("x") + 1, F.lit(CHIP - 1)).cast("int").alias("right"),
        F.greatest(F.min("y") - 1, F.lit(0)).cast("int").alias("top"),
        F.least(F.max("y") + 1, F.lit(CHIP - 1)).cast("int").alias("bottom"),
        *(extra or []),
    )


def _on_border(margin: int, every: int = 1) -> Column:
    """Whether an edge of blocks of so many slices lies within the margin of a cluster's first or last hit, or inside it."""
    first, last, width = F.col("first_tick"), F.col("last_tick"), every * SLICE_TICKS
    near = lambda t: (t % width < margin) | (t % width > width - margin)
    return near(first) | near(last) | (last - first > width)


def with_border(bounds: DataFrame, margin: int = JOIN_TICKS) -> DataFrame:
    """Clusters with flag border: a slice's edge lies within the margin of their first or last hit, or inside them."""
    return bounds.withColumn("border", _on_border(margin))


def with_level(bounds: DataFrame, levels: int = 2, margin: int = JOIN_TICKS) -> DataFrame:
    """Clusters with the number of levels (0 to ``levels``) of a merging tree that have to look at them.

    Level n joins blocks of 2 ** (n - 1) slices; what lies on no edge of such blocks is finished before it.
    """
    flags = [_on_border(margin, 1 << n).cast("int") for n in range(levels)]
    return bounds.withColumn("level", reduce(lambda x, y: x + y, flags, F.lit(0)))


def two_way(bounds: DataFrame) -> DataFrame:
    """Clusters with the pipe (0 or 1) their half of the slice goes to, and the border nearest to their start."""
    ns = rounded_ns(F.col("first_tick"))
    pipe = F.when(ns % SLICE_NS < SLICE_NS // 2, 0).otherwise(1)
    return bounds.withColumn("pipe", pipe).withColumn("border_id", F.floor((ns + SLICE_NS // 2) / SLICE_NS).cast("long"))


def sliced_clusters(hits: DataFrame, max_dt: int = JOIN_TICKS, tile: int = 1) -> DataFrame:
    """Pixel-list clusters of each slice by itself (columns slice and cluster_id added)."""

    def kernel(session, h):
        return kernels.pixel_list_sessions(session, h["tick"], h["x"], h["y"], max_dt, tile)

    rows = hits.withColumn("slice", F.floor(F.col("tick") / SLICE_TICKS).cast("long"))
    return in_sessions(rows, "slice", kernel)


def merge_borders(clustered: DataFrame, max_dt: int = JOIN_TICKS) -> DataFrame:
    """Clusters of slices joined across borders; other clusters keep their id.

    Two clusters merge if their times are within ``max_dt``, their boxes overlap and some pair of
    their hits are neighbours in space and time.  Only hits near a slice's edge can be such a pair,
    so these alone meet, by an equi join on (edge, pixel around).
    """
    edge = F.floor((F.col("tick") + SLICE_TICKS // 2) / SLICE_TICKS)
    away = F.abs(F.col("tick") - edge * SLICE_TICKS)
    near = clustered.withColumn("edge", edge).filter(away <= max_dt).select("edge", "tick", "x", "y", "cluster_id", (F.col("tick") < edge * SLICE_TICKS).alias("before"))
    early = near.filter("before").select("edge", F.col("tick").alias("t"), F.col("cluster_id").alias("a"), "x", "y")
    around = F.explode(F.array(*(F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    late = near.filter("not before").select("edge", F.col("tick").alias("u"), F.col("cluster_id").alias("b"), around.alias("p")).select("edge", "u", "b", "p.x", "p.y")
    links = early.join(late, ["edge", "x", "y"]).filter(F.col("u") - F.col("t") < max_dt).select("a", "b").distinct()
    roots = merge_roots(links)
    out = clustered.join(roots.withColumnRenamed("node", "cluster_id"), "cluster_id", "left")
    return out.withColumn("cluster_id", F.coalesce("root", "cluster_id")).drop("root")


def merge_roots(links: DataFrame) -> DataFrame:
    """node and root, the smallest id of its component; labels spread until nothing changes."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    label = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    while True:
        seen = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        after = label.join(seen, "node").select("node", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("moved"))
        after = cut(after)
        label = after.select("node", "root")
        if not after.filter("moved").limit(1).count():
            return label


def time_union(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Several streams as one, in the order of time."""
    return reduce(DataFrame.unionByName, parts).orderBy(*order)


def ranked_union(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Several cluster streams with row_no, their common order by time; no global sort."""
    from hitweave.operators.ordered import BUCKET, numbered

    both = reduce(DataFrame.unionByName, parts)
    return numbered(both, order, F.floor(F.col("first_tick") / BUCKET))


def write_lanes(clustered: DataFrame, path: str) -> None:
    """A folder for each lane, without a final sort."""
    clustered.write.partitionBy("lane").parquet(path)
