"""Clusterings against plain sequential models, and properties that must hold."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitweave.operators import analysis, clustering, kernels, ordered, slices

HIT = "tick long, x int, y int, e double"


def model(hits, max_dt=128):
    """Pixel-list clustering by the book: a list of clusters, each with all its pixels."""
    clusters = []
    for t, x, y in hits:
        near = [c for c in clusters if abs(t - c["last"]) < max_dt and any(abs(x - a) <= 1 and abs(y - b) <= 1 for _, a, b in c["hits"])]
        own = {"first": t, "last": t, "hits": [(t, x, y)]}
        for c in near:
            own["hits"] += c["hits"]
            own["last"] = max(own["last"], c["last"])
        clusters = [c for c in clusters if c not in near] + [own]
    return {frozenset(c["hits"]) for c in clusters}


def random_hits(seed, n, side=6, step=90):
    rng = random.Random(seed)
    t, out = 0, []
    for _ in range(n):
        t += rng.choice([0, 1, rng.randint(0, step), rng.randint(0, 3 * step)])
        out.append((t, rng.randint(1, side), rng.randint(1, side)))
    return sorted(set(out))


def groups(hits, labels):
    out = {}
    for h, label in zip(hits, labels, strict=True):
        out.setdefault(label, set()).add(h)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("seed", range(60))
def test_pixel_list_kernel(seed):
    hits = random_hits(seed, 60)
    t, x, y = (np.array(c) for c in zip(*hits, strict=True))
    assert groups(hits, kernels.pixel_list(t, x, y)) == model(hits)


@pytest.mark.parametrize("seed", range(20))
def test_many_sessions_at_once(seed):
    hits = random_hits(seed, 400, step=70)
    t, x, y = (np.array(c) for c in zip(*hits, strict=True))
    session = np.maximum.accumulate(np.where(np.diff(t, prepend=-1000) >= 128, t, 0))
    assert groups(hits, kernels.pixel_list_sessions(session, t, x, y)) == model(hits)
    parts = kernels.split_groups(session, t, x, y, 19)
    near = lambda a, b: abs(a[0] - b[0]) <= 19 and abs(a[1] - b[1]) <= 1 and abs(a[2] - b[2]) <= 1
    left = set(hits)
    want = set()
    while left:
        todo, own = [left.pop()], set()
        while todo:
            h = todo.pop()
            own.add(h)
            close = {o for o in left if near(h, o)}
            left -= close
            todo += close
        want.add(frozenset(own))
    assert groups(hits, parts) == want


def test_old_pixel_attracts():
    """A pixel of a cluster that lives on elsewhere still attracts hits, though its own hit is too old."""
    hits = [(0, 5, 5), (96, 6, 5), (192, 4, 5)]
    t, x, y = (np.array(c) for c in zip(*hits, strict=True))
    assert len(set(kernels.pixel_list(t, x, y))) == 1
    assert len(set(kernels.split_groups(np.zeros(3, int), t, x, y, 127).tolist())) == 2


def test_three_way_merge_and_strict_gap():
    hits = [(0, 5, 5), (1, 7, 5), (2, 6, 7), (3, 6, 6)]
    t, x, y = (np.array(c) for c in zip(*hits, strict=True))
    assert len(set(kernels.pixel_list(t, x, y))) == 1
    apart = [(0, 5, 5), (128, 5, 5)]
    t, x, y = (np.array(c) for c in zip(*apart, strict=True))
    assert len(set(kernels.pixel_list(t, x, y))) == 2
    assert len(set(kernels.pixel_list(np.array([0, 127]), x, y))) == 1


def test_tiles_must_divide_the_chip():
    with pytest.raises(ValueError):
        kernels.Clusters(tile=3)


@pytest.mark.parametrize("bucket", [1, 64, 1000, 163_840])
def test_sessions(spark, bucket):
    hits = random_hits(bucket, 400)
    df = spark.createDataFrame([(t, x, y, 1.0) for t, x, y in hits], HIT).withColumn("lin", F.col("y") * 256 + F.col("x"))
    got = {(r["tick"], r["x"], r["y"]): r["session"] for r in ordered.sessions(df, 128, bucket=bucket).collect()}
    start, before = None, None
    for h in hits:
        if before is None or h[0] - before >= 128:
            start = h[0]
        assert got[h] == start
        before = h[0]


@pytest.mark.parametrize("bucket", [1, 32, 100_000])
def test_runs_cross_buckets(spark, bucket):
    rng = random.Random(3)
    keys = [rng.choice("aab") for _ in range(300)] + ["a"] * 9000 + ["b"]
    df = spark.createDataFrame(list(enumerate(keys)), "tick long, key string")
    got = {r["tick"]: r["place"] for r in ordered.runs(df, "key", ["tick"], F.floor(F.col("tick") / bucket), "place").collect()}
    place = 0
    for i, k in enumerate(keys):
        place = place + 1 if i and keys[i - 1] == k else 1
        assert got[i] == place


def test_spark_pixel_list(spark):
    hits = random_hits(7, 1500, side=9)
    df = spark.createDataFrame([(t, x, y, 1.0) for t, x, y in hits], HIT)
    rows = clustering.pixel_list(df).collect()
    assert groups([(r["tick"], r["x"], r["y"]) for r in rows], [r["cluster_id"] for r in rows]) == model(hits)
    for r in rows:
        assert r["cluster_id"] <= r["tick"] * 65536 + r["y"] * 256 + r["x"]


def test_empty(spark):
    df = spark.createDataFrame([], HIT)
    for f in (clustering.temporal, clustering.pixel_list, clustering.two_step, clustering.halo_boxes):
        assert f(df).count() == 0


def test_two_step_keeps_small_groups_whole(spark):
    near = [(0, 10, 10), (5, 12, 11)]  # box (2+2)*(1+2) = 12: whole, though apart
    far = [(1000, 10, 10), (1005, 30, 30), (1010, 11, 11)]
    df = spark.createDataFrame([(t, x, y, 1.0) for t, x, y in near + far], HIT)
    rows = clustering.two_step(df).collect()
    got = groups([(r["tick"], r["x"], r["y"]) for r in rows], [r["cluster_id"] for r in rows])
    assert got == {frozenset(near), frozenset([far[0], far[2]]), frozenset([far[1]])}


def test_halo_draws_in_the_box(spark):
    hits = [(0, 10, 10, 200.0), (10, 14, 14, 150.0), (12, 12, 12, 5.0), (13, 9, 9, 5.0), (20, 100, 100, 5.0)]
    rows = clustering.halo_boxes(spark.createDataFrame(hits, HIT)).collect()
    by = {(r["x"], r["y"]): r["cluster_id"] for r in rows}
    # (9, 9) lies in the first box; (12, 12) lies in none, but its tile touches the tiles of both hot hits
    assert by[9, 9] == by[10, 10] == by[12, 12] == by[14, 14] != by[100, 100]


def test_strict_halo_starts_from_more_hits(spark):
    hits = [(0, 10, 10, 70.0), (10, 15, 10, 70.0), (20, 100, 100, 5.0)]
    df = spark.createDataFrame(hits, HIT)
    strict = {(r["x"], r["y"]): r["cluster_id"] for r in clustering.strict_halo_boxes(df).collect()}
    # pixels 10 and 15 lie in neighbouring tiles of 4, but not of 2
    assert strict[10, 10] == strict[15, 10] != strict[100, 100]
    assert len({r["cluster_id"] for r in clustering.halo_boxes(df).collect()}) == 3


def test_levels_of_a_merging_tree(spark):
    width = slices.SLICE_TICKS
    bounds = [(1, width // 2, width // 2 + 5), (2, width - 3, width + 3), (3, 2 * width - 300, 2 * width - 100), (4, 4 * width + 1, 4 * width + 9), (5, 3 * width - 200, 6 * width - 200)]
    rows = slices.with_level(spark.createDataFrame(bounds, "cluster_id long, first_tick long, last_tick long"), levels=3).collect()
    assert {r["cluster_id"]: r["level"] for r in rows} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 2}


def test_halo_buffers_are_separate(spark):
    hits = [(0, 10, 10, 200.0), (640, 50, 50, 1.0), (641, 50, 50, 1.0)]
    rows = clustering.halo_boxes(spark.createDataFrame(hits, HIT)).collect()
    assert len({r["cluster_id"] for r in rows}) == 3


def test_energy_filter(spark):
    rows = [(0, 5, 5, 80.0), (1, 6, 5, 1.0), (1000, 9, 9, 70.0)]
    kept = clustering.energy_filtered(clustering.pixel_list(spark.createDataFrame(rows, HIT)))
    assert kept.count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_slices_agree_with_sessions(spark, seed):
    """Clusters cut at a slice's edge are joined again; compared by their hits."""
    rng = random.Random(seed)
    hits = set()
    for edge in (163_840, 327_680, 491_520):
        for _ in range(12):
            t, x, y = edge + rng.randint(-100, 60), rng.randint(2, 250), rng.randint(2, 250)
            hits |= {(t + rng.randint(0, 40), x + i, y) for i in range(3)}
    df = spark.createDataFrame([(t, x, y, 1.0) for t, x, y in hits], HIT)
    merged = slices.merge_borders(slices.sliced_clusters(df))
    row = analysis.iou(merged, clustering.pixel_list(df)).first()
    assert row["iou"] > 0.9


def test_halo_width():
    x, y = (c.ravel() for c in np.meshgrid(np.arange(50, 57), np.arange(50, 57)))
    e = np.where((x == 53) & (y == 53), 99.0, 1.0)
    assert kernels.halo_width(x, y, e) == [(99.0, 3)]
    assert kernels.halo_width(x - 50, y, e) == []


def test_iou_and_approximate_match(spark):
    a = spark.createDataFrame([(0, 5, 5, 1.0), (1, 6, 5, 1.0), (900, 9, 9, 1.0)], HIT)
    b = spark.createDataFrame([(0, 5, 5, 1.001), (1, 6, 5, 1.0), (901, 9, 9, 1.0)], HIT)
    ca, cb = clustering.pixel_list(a), clustering.pixel_list(b)
    assert analysis.iou(ca, cb).first()["iou"] == pytest.approx(1 / 3)
    assert analysis.approx_iou(clustering.nested(ca), clustering.nested(cb)).first()["iou"] == pytest.approx(1 / 3)
    assert analysis.iou(ca, ca).first()["iou"] == 1
