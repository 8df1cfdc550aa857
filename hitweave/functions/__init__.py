"""Scalar column functions on hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitweave.model import CHIP, TICK_NS


def tick(toa: Column, fast_toa: Column) -> Column:
    return (toa.cast("long") * 16 - fast_toa).cast("long")


def toa_ns(tick_col: Column) -> Column:
    return tick_col * F.lit(TICK_NS)


def pixel_x(linear: Column) -> Column:
    return (linear % CHIP).cast("int")


def pixel_y(linear: Column) -> Column:
    return F.floor(linear / CHIP).cast("int")


def linear_coord(x: Column, y: Column) -> Column:
    return (y * CHIP + x).cast("int")


def slow_ticks(ns: Column) -> Column:
    """Whole 25 ns ticks of a time, rounded up."""
    return F.ceil(ns / F.lit(25.0)).cast("long")


def fast_ticks(ns: Column) -> Column:
    """1.5625 ns ticks by which the slow time is ahead; halves round up."""
    return F.round((slow_ticks(ns) * 25 - ns) / F.lit(TICK_NS)).cast("int")


#: Energy of a hit whose pixel has no usable calibration.
INVALID_KEV = 0.1


def energy(tot: Column, a: Column, b: Column, c: Column, t: Column, least: float = INVALID_KEV) -> Column:
    """keV from time over threshold: the larger root of ``tot = a E + b - c / (E - t)``, at least ``least``."""
    p = -a * t + b - tot
    root = p * p - 4 * a * (tot * t - b * t - c)
    solved = F.greatest((-p + F.sqrt(root)) / (2 * a), F.lit(least))
    return F.when((F.abs(a) < 1e-12) | (root < 0), F.lit(least)).otherwise(solved)


def energy_bin(e: Column) -> Column:
    """Bin of the energy histogram (0 to 16): the first edge above e."""
    return F.size(F.filter(F.array(*(F.lit(float(x)) for x in ENERGY_EDGES)), lambda edge: edge <= e)).cast("int")


# Upper edges of the energy histogram in keV; the last bin is open.
ENERGY_EDGES = [5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 150, 200, 400, 600, 1000]
