"""Sharding by histogram sort: shards of nearly equal bytes over a sorted key.

The key of a row is (hash of its text, hash of its id, row number), so that equal texts stand
together and any group of them can still be cut.  Candidate boundaries are the edges of a radix
histogram: a round counts exact bytes and rows below each of them in all partitions at once, and
only the ranges that hold a splitter and are still wider than the tolerance, or hold too many rows
for one task, are counted again with edges 256 times finer.  Then rows are exchanged once, by range.

Defined results: a null text counts as empty, with size 1 and the checksum of no bytes; a null id is a key like any
other; repeated rows are told apart by their row number; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.llm.common import materialize

#: Edges of the first round, and the bits that each further round adds.
FIRST_BITS, MORE_BITS = 12, 8
#: How far a splitter may be off, as a share of a shard's bytes.
TOLERANCE = 0.002
#: A range with more rows than this share of all is counted again.
ROWS_SHARE = 1 / 1024
WORDS = ("h1", "h2", "h3")


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows: id, size, text_crc32 and the three key words; written once, as each round reads them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return materialize(
        df.select(
            F.col(id_col),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("h1"),
            F.xxhash64(F.col(id_col).isNull(), F.col(id_col)).alias("h2"),
            F.xxhash64(F.monotonically_increasing_id()).alias("h3"),
        ),
        "keyed",
    )


def _count(rows: DataFrame, depth: int, wanted: list[tuple[int, int]] | None) -> list[tuple[int, int, int]]:
    """(prefix of ``depth`` bits, rows, bytes), only below the ``wanted`` (prefix, depth) ranges if given.

    Depths stay within a word: 12, 20, ... 60, 64 bits of the first word, then of the next.
    """
    word, bits = (depth - 1) // 64, (depth - 1) % 64 + 1
    col = F.col(WORDS[word])
    value = col if bits == 64 else F.shiftrightunsigned(col, 64 - bits)
    if wanted is not None:
        before = wanted[0][1]
        b_word, b_bits = (before - 1) // 64, (before - 1) % 64 + 1
        parent = F.col(WORDS[b_word]) if b_bits == 64 else F.shiftrightunsigned(F.col(WORDS[b_word]), 64 - b_bits)
        keys = [parent] + [F.col(w) for w in WORDS[:b_word]]
        table = [tuple([_signed(p & (2**b_bits - 1))] + [_signed(p >> (b_bits + 64 * (b_word - 1 - i)) & (2**64 - 1)) for i in range(b_word)]) for p, _ in wanted]
        names = [f"k{i}" for i in range(len(keys))]
        # At most 1 / ROWS_SHARE ranges hold too many rows and one holds each splitter: a bounded table.
        small = rows.sparkSession.createDataFrame([(i, *t) for i, t in enumerate(table)], ["at", *names])
        small = small.select(F.col("at").cast("int"), *(F.col(n).cast("long") for n in names))
        tagged = rows.select("size", value.alias("value"), *(k.alias(n) for k, n in zip(keys, names, strict=True)))
        counted = tagged.join(F.broadcast(small), names).groupBy("at", "value").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
        step = depth - before
        out = []
        for r in counted:
            low = (r["value"] & (2**64 - 1)) & (2**step - 1)
            out.append(((wanted[r["at"]][0] << step) | low, r["n"], r["b"]))
        return out
    counted = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    return [(r["value"] & (2**64 - 1), r["n"], r["b"]) for r in counted]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _finer(depth: int) -> int:
    """The next depth: some bits more, but not across a word's end."""
    inside = (depth - 1) % 64 + 1
    return depth + min(MORE_BITS, 64 - inside if inside < 64 else MORE_BITS)


def histogram(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[tuple[int, int, int, int]], int]:
    """Key ranges in order, fine enough for splitters within tolerance; and the bytes of all rows."""
    done, depth = [], FIRST_BITS
    now = [(p, depth, n, b) for p, n, b in _count(rows, depth, None)]
    total_rows, total = sum(r[2] for r in now), sum(r[3] for r in now)
    while now:
        ordered = sorted([*done, *now], key=lambda r: r[0] << (192 - r[1]))
        below, coarse = 0, set()
        for r in ordered:
            # a splitter inside this range, and neither edge near enough to it
            first = -(-below * shards // total) if total else 0
            off = tolerance * total / shards
            inside = [s for s in range(first, shards) if below < s * total / shards < below + r[3]]
            if any(s * total / shards - below > off and below + r[3] - s * total / shards > off for s in inside):
                coarse.add(r[:2])
            below += r[3]
        split = [r for r in now if r[1] < 192 and r[2] > 1 and (r[:2] in coarse or r[2] > max(1000, ROWS_SHARE * total_rows))]
        kept = {r[:2] for r in split}
        done += [r for r in now if r[:2] not in kept]
        if not split:
            break
        depth = _finer(split[0][1])
        now = [(p, depth, n, b) for p, n, b in _count(rows, depth, [r[:2] for r in split])]
    return sorted(done, key=lambda r: r[0] << (192 - r[1])), total


def splitters(ranges: list[tuple[int, int, int, int]], total: int, shards: int) -> list[tuple[int, int]]:
    """For each range its shard and the rows of that shard below it."""
    out, below, shard, slot = [], 0, 0, 0
    for _, _, n, b in ranges:
        # a range belongs to the shard in which its nearer half lies
        while shard < shards - 1 and below + b / 2 > (shard + 1) * total / shards:
            shard, slot = shard + 1, 0
        out.append((shard, slot))
        slot += n
        below += b
    return out


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """Columns id_col, size, text_crc32, shard, slot: slots follow the key and have no gaps in a shard."""
    rows = keyed(df, id_col, text_col)
    ranges, total = histogram(rows, shards, tolerance)
    placed = splitters(ranges, total, shards)
    lows = [r[0] << (192 - r[1]) for r in ranges]
    by_word = [np.array([low >> (64 * (2 - i)) & (2**64 - 1) for low in lows], dtype=np.uint64) for i in range(3)]
    names = [id_col, "size", "text_crc32", "h1", "h2", "h3"]
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, size long, text_crc32 long, h1 long, h2 long, h3 long, range int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [batch.column(names.index(w)).to_numpy().view(np.uint64) for w in WORDS]
            low, high = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, len(lows), np.int64)
            # the last range whose low edge is not above the key, word by word
            while (open_ := np.flatnonzero(high - low > 1)).size:
                mid = (low[open_] + high[open_]) // 2
                above = np.zeros(len(open_), bool)
                equal = np.ones(len(open_), bool)
                for w in range(3):
                    edge, own = by_word[w][mid], key[w][open_]
                    above |= equal & (edge > own)
                    equal &= edge == own
                high[open_] = np.where(above, mid, high[open_])
                low[open_] = np.where(above, low[open_], mid)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low.astype(np.int32))], names=[*names, "range"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(placed, dtype=np.int64).reshape(-1, 2)
        for batch in batches:
            r = batch.column(3).to_numpy()
            slot = at[r, 1] + batch.column(4).to_numpy() - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(at[r, 0].astype(np.int32)), pa.array(slot)], names=[id_col, "size", "text_crc32", "shard", "slot"]
            )

    order = [F.col(w).bitwiseXOR(F.lit(-(2**63))) for w in WORDS]  # as unsigned
    ranged = rows.select(*names).mapInArrow(run, schema)
    numbered = ranged.withColumn("n", F.row_number().over(Window.partitionBy("range").orderBy(*order)).cast("long"))
    out = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, size long, text_crc32 long, shard int, slot long"
    return numbered.select(id_col, "size", "text_crc32", "range", "n").mapInArrow(place, out)
