"""What the operators of this subpackage share: materialised tables, checked broadcasts and input readers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow rows in a file of an intermediate table.
FILE_ROWS = 50_000
#: Narrow rows (a few longs) that may be broadcast; longer tables are joined by shuffles.
BROADCAST_ROWS = 1 << 19
#: Bytes of an Arrow batch, about: Spark counts rows only (10,000), and so many texts may take any size.
BATCH_BYTES = 1 << 21
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_OWN: dict[str, str] = {}


def bounded_batches(spark: SparkSession) -> None:
    """From now on Python functions of the session get batches of about ``BATCH_BYTES`` at most, unless it has a bound of its own.

    Workers keep the memory of their largest batch, and so do the executor's buffers.  It stays set, as results are evaluated later.
    """
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one if all runs in this process, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="hitweave-")
    return _OWN[app]


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors.

    ``rows``: about how many narrow rows it has; they are written in files of some size, not in
    one for every shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(6, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.hitweave_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``materialize`` made and that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.hitweave_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of so many narrow rows, to be broadcast in a join if these are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite_vector(col: str):
    """True for a vector that is not null and holds only finite, non-null components."""
    c = F.col(col)
    inf = float("inf")
    return c.isNotNull() & F.forall(
        c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(inf))
    )


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def shard_by_shard(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], build: Callable, answer: Callable) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``keys`` and column asks: ``answer(index, queries)`` for the queries of each shard, batch by batch.

    ``index`` is ``build(entries)``, made once for a shard; queries stream past it, so that only entries are held.
    """
    key, held, index = None, [], None
    for batch in batches:
        flags = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (*keys, "asks")]
        new = np.zeros(max(0, batch.num_rows - 1), bool)
        for f in flags:
            new |= f[1:] != f[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            own = tuple(f[start] for f in flags[:-1])
            if own != key:
                key, held, index = own, [], None
            part = batch.slice(start, end - start)
            if not flags[-1][start]:
                held.append(part)
            elif held:
                if index is None:
                    index = build(pa.Table.from_batches(held))
                yield answer(index, part)


def spread(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Rows of a key together and sorted by it, entries before queries (column asks), in a stated number of partitions."""
    # a stated number is never coalesced, however few bytes the rows have
    return rows.repartition(max(1, min(parts, 20_000)), *(F.col(k) for k in keys)).sortWithinPartitions(*keys, "asks")
