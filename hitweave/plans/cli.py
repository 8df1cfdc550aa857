"""Command line: ``python -m hitweave.plans.cli [options] INPUT [INPUT2]``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hitweave import deploy, sinks, sources
from hitweave.model import SLICE_NS, Settings
from hitweave.operators import analysis, clustering
from hitweave.plans.graph import CLUSTERINGS, MERGES, Context, Graph, build, recipe


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hitweave")
    p.add_argument("--mode", choices=("clustering", "window_features", "compare", "benchmark"), default="clustering")
    p.add_argument("--args", help="file of node settings")
    p.add_argument("--calib", help="folder with a.txt, b.txt, c.txt and t.txt")
    p.add_argument("--output", default="./")
    p.add_argument("--n_workers", type=int, default=4)
    p.add_argument("--clustering_type", choices=tuple(CLUSTERINGS), help="by default the settings' type")
    p.add_argument("--merge_type", choices=MERGES, default="single_layer")
    p.add_argument("--sliced", action="store_true", help="pixel-list clusters by slices of time, for data so dense that hits never pause")
    p.add_argument("--debug", action="store_true")
    p.add_argument("input", nargs="+")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs a mode; returns the path or figure that it gives."""
    o = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("hitweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    deploy.ship(spark)
    settings = Settings()
    if o.args:
        settings = Settings.parse([r[0] for r in spark.read.text(o.args).collect()])
    if o.sliced:
        settings.set("clustering", "sliced", "true")
    if o.mode == "compare":
        a, b = (sources.clusters(spark, p) for p in o.input[:2])
        named = lambda d: clustering.nested(d.selectExpr("cluster_no as cluster_id", "x", "y", "e", "cast(round(toa / 1.5625) as bigint) as tick"))
        return str(analysis.approx_iou(named(a), named(b)).first()["iou"])
    context = Context(spark, settings, {"r1": sources.text_hits(spark, o.input[-1])}, sources.calibration(spark, o.calib) if o.calib else None)
    began = time.time()
    if o.mode == "window_features":
        out = build(Graph.parse("r1bm1,bm1s1,s1wfc1"), context)["wfc1"]
        path = sinks.output_name(o.input[-1], o.output, "window_features")
        sinks.write_features(out, path)
        return path
    split_at = next((n for n in ("reader", "calibrator", "sorter") if settings.get(n, "split")), "reader")
    kind = o.clustering_type or settings.get("clustering", "type")
    plan = recipe(kind, o.merge_type, o.n_workers, "p", split_at, settings.get("trigger", "use_trigger"))
    out = build(Graph.parse(plan), context)["p1"]
    if o.mode == "benchmark":
        n = out.selectExpr("sum(hit_count)").first()[0] or 0
        return f"{n / 1e6 / (time.time() - began):.3f} Mhit/s"
    path = sinks.output_name(o.input[-1], o.output)
    folder, _, name = path.rpartition("/")
    if o.merge_type != "multioutput":
        return sinks.write_clusters(out, folder or ".", name)
    # one output for each worker: slices of time are dealt in turn, a cluster goes with its first hit
    lane = F.pmod(F.floor(F.col("first_toa") / SLICE_NS), F.lit(o.n_workers))
    return ",".join(sinks.write_clusters(out.filter(lane == i), folder or ".", f"{name}_{i}") for i in range(o.n_workers))


if __name__ == "__main__":
    print(main())
