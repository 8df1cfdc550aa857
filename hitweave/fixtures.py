"""Hit tables derived from the driver's tables; the same rules as SQL text serve both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave import functions as H

CALIB = {
    "a": "cast(1.6 as double) + ((x * 7 + y * 13) % 50) / cast(100 as double)",
    "b": "cast(20 as double) + ((x + y) % 10)",
    "c": "cast(100 as double) + ((x * 3 + y) % 40)",
    "t": "cast(1 as double) + ((x + 2 * y) % 5) / cast(10 as double)",
}
F1 = """select l_orderkey as grp, l_partkey as part, l_suppkey as supp,
 cast((l_orderkey * 37) % 250 + (l_linenumber % 4) as int) as x, cast((l_orderkey * 91) % 250 + (l_partkey % 3) as int) as y,
 cast(l_orderkey * 64 + l_linenumber as bigint) as toa, cast(l_suppkey % 16 as int) as fast_toa, cast(cast(l_quantity as int) * 4 as int) as tot from lineitem"""
F2 = """select event_id, cast(user_id % 150 as int) as x, cast(event_id % 256 as int) as y,
 cast(floor(({epoch} - 1704067200000000) / 1000) as bigint) as toa, cast(event_id % 16 as int) as fast_toa, cast(cast(floor(value) as bigint) + 1 as int) as tot from events"""
EPOCH = {"spark": "unix_micros(cast(ts as timestamp))", "duckdb": "epoch_us(ts)"}
DERIVED = "select *, cast(16 * toa - fast_toa as bigint) as tick, cast(y * 256 + x as int) as lin from"


def _energy_sql() -> str:
    c = {k: f"({v})" for k, v in CALIB.items()}
    p = f"(-{c['a']} * {c['t']} + {c['b']} - tot)"
    root = f"({p} * {p} - 4 * {c['a']} * (tot * {c['t']} - {c['b']} * {c['t']} - {c['c']}))"
    return f"case when {root} < 0 then cast(0.1 as double) else greatest((-{p} + sqrt({root})) / (2 * {c['a']}), cast(0.1 as double)) end"


#: CTEs of the oracle: f1, f2 (raw hits with tick and lin) and e1, e2 (with energy).
CTES = f"""f1 as ({DERIVED} ({F1})), f2 as ({DERIVED} ({F2.format(epoch=EPOCH["duckdb"])})),
e1 as (select *, {_energy_sql()} as e from f1), e2 as (select *, {_energy_sql()} as e from f2)"""


def calibration(spark: SparkSession) -> DataFrame:
    """The synthetic calibration: 65 536 rows x, y, a, b, c, t."""
    pixels = spark.range(256 * 256).select((F.col("id") % 256).cast("int").alias("x"), F.floor(F.col("id") / 256).cast("int").alias("y"))
    return pixels.select("x", "y", *(F.expr(v).alias(k) for k, v in CALIB.items()))


def _hits(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    view = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    rows = spark.sql(sql.replace(f"from {table}", "from {source}"), source=view)
    return rows.withColumn("tick", H.tick(F.col("toa"), F.col("fast_toa"))).withColumn("lin", H.linear_coord(F.col("x"), F.col("y")))


def track_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense short tracks."""
    return _hits(spark, sf_dir, "lineitem", F1)


def stream_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long sparse stream."""
    return _hits(spark, sf_dir, "events", F2.format(epoch=EPOCH["spark"]))
