"""Best-fit packing by minimum bin slack.

Texts become pieces of at most ``size`` tokens.  Bins are filled one after the other: the longest
piece left is taken, then a bitset subset-sum over the lengths still available finds the fullest
combination for the rest of the bin, and its pieces are removed.  As only lengths matter, the plan
is made from the histogram of lengths (at most ``size`` numbers): a combination is used as often
as its lengths last, so the plan has few steps for any number of bins.  Each piece then looks up
its bin by its length and its rank among the pieces of that length.

Ranks need no global order: a partition numbers its pieces by length as it makes them, and the
sums of the partitions before it are added.

Defined results: a null text counts as empty and is one piece of one token; added tokens of the file (such as
end marks) that stand in a text get their own ids, as its library gives them; repeated rows are
packed as often as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.llm.bpe import Codec, _sliced
from hitweave.llm.common import materialize

SIZE = 1024
END = 2


@functools.lru_cache(maxsize=2)
def json_codec(path: str) -> Codec:
    """The codec of a byte-level BPE in a tokeniser file: its merges in order are the ranks.

    Ids and ranks agree for such files; that is checked here, so that the fast encoder may be used.
    The file's added tokens, which the tokeniser takes out of a text first, are apart (``added_tokens``).
    """
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(visible))}
    ranks = {bytes(map(chars.__getitem__, token)): i for token, i in model["vocab"].items() if all(c in chars for c in token) and not token.startswith("<|")}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or len(merged) + 256 != len(ranks):
        raise ValueError(f"{path}: its ids are not the ranks of its merges")
    return Codec(ranks, PATTERN)


@functools.lru_cache(maxsize=2)
def added_tokens(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """The added tokens of a tokeniser file: what finds them (leftmost, then longest), and their ids."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: an added token takes more than its own text")
    ids = {t["content"]: t["id"] for t in added}
    longest = sorted(ids, key=len, reverse=True)
    return re.compile("|".join(map(re.escape, longest))) if ids else None, ids


def encode(path: str, text: str) -> list[int]:
    """The ids of a text as the tokeniser of the file gives them, without those it would put around it."""
    own, (found, ids) = json_codec(path), added_tokens(path)
    at, out = 0, []
    for m in found.finditer(text) if found else ():
        out += [*own.encode(text[at : m.start()]), ids[m[0]]]
        at = m.end()
    return out + own.encode(text[at:]) if at else own.encode(text)


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Columns id_col, piece, start, length, ids_crc32, __part, __rank and, on demand, packed ids.

    __rank numbers the pieces of one length within the partition __part.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, piece int, start long, length int, ids_crc32 long, __part int, __rank long"
    schema += ", ids binary" * with_ids
    names = [id_col, "piece", "start", "length", "ids_crc32", "__part", "__rank", "ids"][: 8 if with_ids else 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in _sliced(batches, 1024):
            doc, out = [], [[] for _ in names[1:]]
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(path, text), END], dtype="<u4")
                start, piece = 0, 0
                while start < len(ids):
                    upto = start + (size if start or len(ids) % size == 0 else len(ids) % size)
                    raw = ids[start:upto].tobytes()
                    n = upto - start
                    doc.append(row)
                    for col, value in zip(out, (piece, start, n, zlib.crc32(raw), part, seen[n], raw), strict=False):
                        col.append(value)
                    seen[n] += 1
                    start, piece = upto, piece + 1
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            cols = [batch.column(0).take(pa.array(doc, pa.int64())), *(pa.array(x, t) for x, t in zip(out, types, strict=False))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, schema)


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """A combination of available lengths with the largest sum up to ``room``, preferring long ones."""
    lengths = [int(x) for x in np.flatnonzero(counts[: room + 1]) if x]
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:  # short ones first, so that the way back takes long ones first
        n = min(int(counts[length]), room // length)
        many = 1
        while n > 0:  # so many at once: 1, 2, 4, ... and the rest
            take = min(many, n)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            n -= take
            many *= 2
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        whole = length * take
        if total >= whole and before >> (total - whole) & 1:
            chosen += [length] * take
            total -= whole
    return chosen


class Plan:
    """Which bin and place the n-th piece of each length gets."""

    def __init__(self, counts: np.ndarray, size: int = SIZE):
        self.bins = 0
        # by length: first rank, first bin, pieces of this length in each bin, place of the first
        self.steps: dict[int, list[tuple[int, int, int, int]]] = {}
        left, used = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
        while (rest := np.flatnonzero(left)).size:
            longest = int(rest[-1])
            left[longest] -= 1
            chosen = [longest, *fullest(left, size - longest)]
            left[longest] += 1
            each: dict[int, int] = {}
            for length in chosen:
                each[length] = each.get(length, 0) + 1
            times = min(int(left[length]) // n for length, n in each.items())
            place = 0
            for length, n in each.items():
                self.steps.setdefault(length, []).append((int(used[length]), self.bins, n, place))
                used[length] += n * times
                left[length] -= n * times
                place += n * length
            self.bins += times
        self.first = {length: [s[0] for s in steps] for length, steps in self.steps.items()}

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bin_, place = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for one in np.unique(length).tolist():
            at = np.flatnonzero(length == one)
            steps = np.array(self.steps[one], dtype=np.int64)
            s = steps[np.searchsorted(steps[:, 0], rank[at], side="right") - 1]
            inside = rank[at] - s[:, 0]
            bin_[at] = s[:, 1] + inside // s[:, 2]
            place[at] = s[:, 3] + inside % s[:, 2] * one
        return bin_, place

    def place(self, length: int, rank: int) -> tuple[int, int]:
        first, bin_, n, at = self.steps[length][bisect.bisect_right(self.first[length], rank) - 1]
        return bin_ + (rank - first) // n, at + (rank - first) % n * length


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset; columns as those of ``pieces``."""
    made = materialize(pieces(df, path, id_col, text_col, size, with_ids), "pieces")
    counted = materialize(made.groupBy("__part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(size + 1, np.int64)
    for length, n in counted.groupBy("length").agg(F.sum("n")).collect():  # at most ``size`` rows
        counts[length] = n
    plan = Plan(counts, size)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(counted.select("__part", "length", before.alias("__before")), "offsets")
    ranked = made.join(offsets, ["__part", "length"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    names = [c for c in made.columns if c not in ("__part", "__rank")]
    schema = ", ".join(f"`{c}` {made.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bin_, place = plan.places(batch.column("length").to_numpy(), batch.column("__rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(bin_), pa.array(place)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "__rank").mapInArrow(run, schema)
