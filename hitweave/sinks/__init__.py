"""Writers of clustered datasets, window features and raw hits."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.model import TICK_NS
from hitweave.operators import windows
from hitweave.operators.ordered import BUCKET, prefix_sums


def pixel_text(nested: DataFrame) -> DataFrame:
    """Clusters with ``text``: a line ``x y toa e`` for each hit, then ``#``."""
    line = lambda h: F.format_string("%d %d %.6f %.2f\n", h["x"], h["y"], h["toa"], h["e"])
    return nested.withColumn("text", F.concat(F.array_join(F.transform("hits", line), ""), F.lit("#\n")))


def cluster_offsets(nested: DataFrame) -> DataFrame:
    """cluster_id, first_toa, hit_count, line_start, byte_start and text, in the order of first_toa, then id.

    Lines and bytes before a cluster are prefix sums in two levels, so nothing is sorted globally.
    """
    rows = pixel_text(nested).withColumn("__lines", F.col("hit_count") + 1).withColumn("__bytes", F.octet_length("text").cast("long"))
    bucket = F.floor(F.col("first_toa") / F.lit(TICK_NS) / BUCKET)
    rows = prefix_sums(rows, ["__lines", "__bytes"], ["first_toa", "cluster_id"], bucket)
    return rows.select("cluster_id", "first_toa", "hit_count", F.col("__lines_before").alias("line_start"), F.col("__bytes_before").alias("byte_start"), "text")


def write_clusters(nested: DataFrame, folder: str, name: str) -> str:
    """Writes <name>.ini, <name>_cl.txt and <name>_px.txt; returns the .ini's path.

    The two data files are folders of ordered part files, whose concatenation is the file; the
    reader takes either form.
    """
    spark = nested.sparkSession
    rows = cluster_offsets(nested).repartitionByRange("line_start").sortWithinPartitions("line_start")
    heads = F.format_string("%.6f %d %d %d", "first_toa", "hit_count", "line_start", "byte_start")
    rows.select(heads).write.text(f"{folder}/{name}_cl.txt")
    rows.select(F.rtrim(F.col("text"), F.lit("\n"))).write.text(f"{folder}/{name}_px.txt")
    ini = spark.createDataFrame([("[Measurement]",), (f"PxFile={name}_px.txt",), (f"ClFile={name}_cl.txt",), ("Format=txt",)], "value string")
    ini.coalesce(1).write.text(f"{folder}/{name}.ini")
    return f"{folder}/{name}.ini"


def write_features(features: DataFrame, path: str) -> None:
    windows.to_lines(features).repartitionByRange("win").sortWithinPartitions("win").select("value").write.text(path)


def write_raw(raw: DataFrame, path: str) -> None:
    """Raw hits as text that the reader takes back."""
    raw.select(F.concat_ws(" ", "linear_coord", "toa", "fast_toa", "tot")).write.text(path)


def output_name(source: str, target: str, kind: str = "clustered", at: datetime | None = None, number: int | None = None) -> str:
    """Path of a result: in a folder ``<kind>_<input><number>_<time>``, else ``target`` serves as a prefix."""
    stamp = (at or datetime.now()).strftime("%d_%m_%Y_%H_%M_%S")
    stem = os.path.splitext(os.path.basename(source))[0]
    name = f"{kind}_{stem}{'' if number is None else number}_{stamp}"
    return os.path.join(target, name) if target.endswith("/") or os.path.isdir(target) else f"{target}{name}"
