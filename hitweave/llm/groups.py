"""Keeps one whole row of each group of near-duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.common import drop, fresh, materialize, small


def first_of_each(df: DataFrame, id_col: str, text_col: str, find: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """The first row, whole, of each group (column root) that ``find`` gives rows of id, text and the columns it has to keep.

    First is the smallest id, null ids last; of rows that repeat id and text one is kept, any.  Only rows that go, and kept ones
    that occur several times, are joined to ``df``: the tables of both are broadcast if they are short enough.
    """
    names = [f"`{c}`" for c in df.columns]
    own_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    own = [own_id.isNull(), own_id, text.isNull(), text]
    k1, k2 = fresh(df, "__k1", "__k2")
    # a row is found again by two hashes of id and text: 128 bits
    rows = df.withColumn(k1, F.xxhash64(*own)).withColumn(k2, F.xxhash64(F.lit(1), *own))
    narrow = rows.select(own_id.alias("id"), text.alias("text"), F.col(k1).alias("k1"), F.col(k2).alias("k2"))
    each = find(narrow, ("k1", "k2")).groupBy("root", "k1", "k2").agg(F.first("id").alias("id"), F.count("*").alias("n"))
    each = materialize(each, "each")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2", "n")).alias("first")
    kept = materialize(each.groupBy("root").agg(first).select("first.k1", "first.k2", "first.n"), "kept")
    keys = [F.col("k1").alias(k1), F.col("k2").alias(k2)]
    odd = each.join(kept, ["k1", "k2"], "left_anti").select(*keys).unionByName(kept.filter("n > 1").select(*keys))
    odd, often = materialize(odd, "odd"), materialize(kept.filter("n > 1").select(*keys), "often")
    drop(each, kept)
    once = rows.join(small(odd, odd.count()), [k1, k2], "left_anti")
    one = rows.join(small(often, often.count()), [k1, k2], "left_semi").dropDuplicates([k1, k2])
    return once.unionByName(one).select(names)
