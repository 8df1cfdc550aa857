"""Readers of hits, clusters, calibrations and readout frames."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitweave.operators.ordered import BUCKET, last_before, prefix_sums

#: Byte order mark.
BOM = "\ufeff"


def text_hits(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Raw hits of text files: ``linear_coord toa fast_toa tot`` by white space; ``#`` lines, blank ones and a BOM are skipped.

    ``numbered`` adds column line, the place in the file.
    """
    lines = numbered_lines(spark, path) if numbered else spark.read.text(path)
    return parse_hits(lines.withColumn("value", F.trim(F.regexp_replace("value", BOM, ""))))


def parse_hits(lines: DataFrame) -> DataFrame:
    """Raw hits of text lines (column value); works on streams too."""
    rows = lines.filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    part = F.split("value", r"\s+")
    number = lambda i, kind: F.try_element_at(part, F.lit(i)).try_cast(kind)
    out = rows.select(
        *(["line"] if "line" in lines.columns else []),
        number(1, "int").alias("linear_coord"), number(2, "bigint").alias("toa"), number(3, "smallint").alias("fast_toa"), number(4, "smallint").alias("tot")
    )
    return out.filter(F.col("linear_coord").isNotNull() & (F.col("toa") >= 0) & F.col("tot").isNotNull())


def calibration(spark: SparkSession, folder: str) -> DataFrame:
    """x, y, a, b, c, t from the files a.txt, b.txt, c.txt, t.txt: 256 rows (y) of 256 numbers (x)."""
    out = None
    for name in "abct":
        whole = spark.read.text(f"{folder}/{name}.txt", wholetext=True)
        rows = whole.select(F.posexplode(F.filter(F.split(F.trim("value"), r"\r?\n"), lambda s: F.trim(s) != "")).alias("y", "line"))
        cells = rows.select("y", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("x", "v")).select("x", "y", F.col("v").cast("double").alias(name))
        out = cells if out is None else out.join(cells, ["x", "y"])
    return out


def calibration_for(data_file: str, folders: list[str]) -> str:
    """The one folder whose name is part of the data file's name."""
    name = os.path.basename(data_file)
    found = [f for f in folders if os.path.basename(os.path.normpath(f)) in name]
    if len(found) != 1:
        raise ValueError(f"{name}: {len(found)} calibration folders fit")
    return found[0]


def calibrations(data_files: list[str], folders: list[str], mode: str = "automatic") -> dict[str, str | None]:
    """The calibration folder of each data file: by name, in the order given, one for all, or none."""
    if mode == "none":
        return dict.fromkeys(data_files)
    if mode == "automatic":
        return {f: calibration_for(f, folders) for f in data_files}
    if mode == "same" and len(folders) == 1:
        return dict.fromkeys(data_files, folders[0])
    if mode == "manual" and len(folders) == len(data_files):
        return dict(zip(data_files, folders, strict=True))
    raise ValueError(f"{mode}: {len(folders)} calibration folders for {len(data_files)} files")


def clusters(spark: SparkSession, ini_path: str) -> DataFrame:
    """Hits with cluster_no, first_toa, hit_count from a clustered dataset (.ini with its _cl and _px files)."""
    ini = {k.strip(): v.strip() for line in spark.read.text(ini_path).toPandas()["value"] if "=" in line for k, _, v in [line.partition("=")]}
    base = os.path.dirname(ini_path)
    files = {k: ini[k] if os.path.isabs(ini[k]) else f"{base}/{ini[k]}" for k in ("ClFile", "PxFile")}
    pixels = _pixel_lines(spark, files["PxFile"])
    part = F.split(F.trim("value"), r"\s+")
    heads = spark.read.text(files["ClFile"]).filter(F.trim("value") != "").select(
        *(F.element_at(part, i + 1).cast(kind).alias(c) for i, (c, kind) in enumerate((("first_toa", "double"), ("hit_count", "long"), ("line_start", "long"), ("byte_start", "long"))))
    )
    # A cluster's lines are the numbers from line_start on: an equi join of each line with its owner.
    own = heads.select("first_toa", "hit_count", "line_start", F.explode(F.expr("sequence(line_start, line_start + hit_count - 1)")).alias("line"))
    return pixels.join(own, "line").select(F.col("line_start").alias("cluster_no"), "first_toa", "hit_count", "x", "y", "toa", "e")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0) and value of a text file or a folder of ordered part files.

    Lines are numbered within each file split as it is read; the splits before add their counts.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, int], int] = {}
        for part in parts:
            place = part.groupby(["file", "block"], sort=False).cumcount()
            for at, n in part.groupby(["file", "block"], sort=False).size().items():
                here = (part["file"] == at[0]) & (part["block"] == at[1])
                place[here] += seen.get(at, 0)
                seen[at] = seen.get(at, 0) + int(n)
            yield part.assign(place=place.astype("int64"))

    lines = raw.mapInPandas(count, "file string, block long, value string, place long")
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    sizes = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(sizes, ["file", "block"]).select((F.col("place") + F.col("before")).alias("line"), "value")


def _pixel_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, x, y, toa, e."""
    rows = numbered_lines(spark, path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    part = F.split(F.trim("value"), r"\s+")
    fields = (("x", "int"), ("y", "int"), ("toa", "double"), ("e", "double"))
    return rows.select("line", *(F.element_at(part, i + 1).cast(kind).alias(c) for i, (c, kind) in enumerate(fields)))


def _bits(frame: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(frame, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def decode_frames(frames: DataFrame, order: str = "frame_no", block: int = 1 << 16) -> DataFrame:
    """Raw hits of 48-bit readout frames (columns frame_no, frame as long).

    Hit frames are of kind 0, 1 and 4; kind 5 sets the time offset for the hits after it, which is
    carried over blocks of frames by a table of one row per block.
    """
    kind, frame = _bits(F.col("frame"), 44, 4), F.col("frame")
    rows = frames.withColumn("__kind", kind).withColumn("__block", F.floor(F.col(order) / block))
    rows = rows.withColumn("__offset", F.when(F.col("__kind") == 5, _bits(frame, 0, 32)))
    seen = F.max_by("__offset", F.when(F.col("__offset").isNotNull(), F.col(order)))
    ends = last_before(rows.groupBy("__block").agg(seen.alias("__last")), "__block", "__last")
    rows = rows.join(ends.select("__block", F.coalesce("__last_before", F.lit(0)).alias("__carry")), "__block")
    inside = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__offset", F.coalesce(F.last("__offset", ignorenulls=True).over(inside), "__carry"))
    return rows.filter(F.col("__kind").isin(0, 1, 4)).select(
        order,
        _bits(frame, 28, 16).cast("int").alias("linear_coord"),
        (_bits(frame, 14, 14) + F.col("__offset") * 16384).alias("toa"),
        _bits(frame, 0, 4).cast("int").alias("fast_toa"),
        _bits(frame, 4, 10).cast("int").alias("tot"),
    )


def frame_summary(frames: DataFrame) -> DataFrame:
    """Hits in the frames, hits that frame ends announce, frames of lost pixels, and whether any frame ended."""
    kind = _bits(F.col("frame"), 44, 4)
    return frames.agg(
        F.count_if(kind.isin(0, 1, 4)).alias("hits"),
        F.coalesce(F.sum(F.when(kind == 12, _bits(F.col("frame"), 0, 36))), F.lit(0)).alias("announced"),
        F.count_if(kind == 13).alias("lost_frames"),
        F.coalesce(F.bool_or(kind == 12), F.lit(False)).alias("ended"),
    )


#: More frames than a datagram of 65,535 bytes can hold, so that numbers of frames follow those of datagrams.
MOST_FRAMES = 1 << 14


def split_datagrams(datagrams: DataFrame) -> DataFrame:
    """frame_no and frame of datagrams (datagram_no, payload): six little-endian bytes each."""
    size = 6
    n = F.floor(F.length("payload") / size).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    rows = datagrams.select("datagram_no", "payload", at.alias("i"))
    cut = F.expr(f"substring(payload, i * {size} + 1, {size})")
    hexes = F.hex(cut)
    turned = F.concat(*(F.substring(hexes, 2 * (size - 1 - b) + 1, 2) for b in range(size)))
    return rows.select((F.col("datagram_no") * MOST_FRAMES + F.col("i")).alias("frame_no"), F.conv(turned, 16, 10).cast("long").alias("frame"))


def chip_id(word: Column) -> Column:
    """A chip's name from its id word: column letter, row number and wafer."""
    wafer = F.shiftleft(_bits(word, 16, 8), 4).bitwiseOR(_bits(word, 8, 8))
    return F.concat(F.char(_bits(word, 0, 4) + 64), _bits(word, 4, 4).cast("string"), F.lit("-W000"), wafer.cast("string"))


def encode_frames(hits: DataFrame, order: list[str]) -> DataFrame:
    """frame_no and frame of raw hits in the given order, with an offset frame wherever the high part of the time changes."""
    rows = prefix_sums(hits.withColumn("__one", F.lit(1)), ["__one"], order, F.floor(F.col("toa") * 16 / BUCKET))
    body = (
        F.lit(4 << 44).bitwiseOR(F.shiftleft(F.col("linear_coord").cast("long"), 28))
        .bitwiseOR(F.shiftleft(F.col("toa") % 16384, 14)).bitwiseOR(F.shiftleft((F.col("tot") % 1024).cast("long"), 4)).bitwiseOR(F.col("fast_toa").cast("long"))
    )
    offset = F.lit(5 << 44).bitwiseOR(F.floor(F.col("toa") / 16384).cast("long"))
    two = F.array(F.struct((F.col("__one_before") * 2).alias("frame_no"), offset.alias("frame")), F.struct((F.col("__one_before") * 2 + 1).alias("frame_no"), body.alias("frame")))
    return rows.select(F.explode(two).alias("f")).select("f.frame_no", "f.frame")
