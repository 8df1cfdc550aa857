"""Byte-level BPE encoding and decoding by tree reduction.

A text is halved until its parts are short.  Parts are encoded on their own; neighbours are joined
by encoding a window around their border again.  The window grows until the tokens outside it
provably can't change:

* at an *anchor* (a letter or digit followed by a character that is neither) every match of the
  pre-tokeniser ends, in the part as in the whole text, so what lies beyond it is settled;
* inside one long match, token boundaries left and right of the window are settled once each seam
  pair of tokens encodes to itself: a sequence of tokens is the encoding of a match if and only
  if all its neighbouring pairs are.

Decoding concatenates the parts' bytes up the same kind of tree.

Defined results: a null text counts as empty, an empty one has no tokens; strings that look like
special tokens are ordinary text; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 2048
LEAF_IDS = 1024
WINDOW = 32
#: Beyond this many characters without an anchor the join looks for settled pairs of tokens.
FAR = 512
ANCHOR = re.compile(r"[^\W_](?=[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e。，、！？])")
ONE_MATCH = regex.compile(r"\p{L}+|\p{N}+")


class Codec:
    """Ranks of a byte-level BPE with the pre-tokeniser's pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.leaf = self.encoding.encode_ordinary
        self.one = self.encoding._encode_single_piece

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        if len(text) <= leaf:
            return self.leaf(text)
        mid = len(text) // 2
        left, right = text[:mid], text[mid:]
        return self.join(left, self.encode(left, leaf), right, self.encode(right, leaf))

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        """The tokens of ``left + right`` from those of both."""
        if not a or not b:
            return a or b
        size = WINDOW
        while True:
            if size > FAR and (joined := self._join_inside(left, a, right, b)) is not None:
                return joined
            start, end = max(0, len(left) - size), min(len(right), size)
            found = None
            for found in ANCHOR.finditer(left, start):  # noqa: B007
                pass
            follow = ANCHOR.search(right, 0, end)
            cut = found.end() if found else 0 if start == 0 else None
            upto = follow.end() if follow else len(right) if end == len(right) else None
            if cut is not None and upto is not None:
                break
            size *= 4
        middle = self.leaf(left[cut:] + right[:upto])
        keep = self._tokens(reversed(a), len(left[cut:].encode("utf-8", "surrogatepass")))
        skip = self._tokens(b, len(right[:upto].encode("utf-8", "surrogatepass")))
        return a[: len(a) - keep] + middle + b[skip:]

    def _tokens(self, ids, n_bytes: int) -> int:
        """How many of the ids make up just n_bytes."""
        n, known = 0, self.bytes
        for i in ids:
            if n_bytes <= 0:
                break
            n_bytes -= len(known[i])
            n += 1
        if n_bytes:
            raise AssertionError("an anchor must be a token boundary")
        return n

    def _join_inside(self, left: str, a: list[int], right: str, b: list[int]) -> list[int] | None:
        """The join where the border lies deep inside one match of the pattern; None if it doesn't."""
        head, tail = left[-FAR:], right[:FAR]
        if len(head) < FAR or len(tail) < FAR or not ONE_MATCH.fullmatch(head + tail):
            return None
        known, n = self.bytes, 8
        room = [min(len(side.encode()), len(side)) for side in (head, tail)]
        while n < min(len(a), len(b)):
            before, after = b"".join(known[i] for i in a[-n:]), b"".join(known[i] for i in b[:n])
            if len(before) + 64 > room[0] or len(after) + 64 > room[1]:
                return None
            middle = self.one(before + after)
            if self._pair(a[-n - 1], middle[0]) and self._pair(middle[-1], b[n]):
                return a[:-n] + middle + b[n:]
            n *= 2
        return None

    def _pair(self, x: int, y: int) -> bool:
        return self.one(self.bytes[x] + self.bytes[y]) == [x, y]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str | None = None) -> Codec:
    """The codec of a rank file, once in each process."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Codec(ranks, pattern)


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _packed(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def encode(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decode_too: bool = False) -> DataFrame:
    """Columns ``keep``, n_tokens, ids (little-endian unsigned 32-bit, packed) and, on demand, decoded bytes."""
    fields = [df.schema[c] for c in keep]
    rows = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long, ids binary" + ", decoded binary" * decode_too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in _sliced(batches):
            ids = [own.encode(t) for t in batch.column(len(keep)).to_pylist()]
            cols = [batch.column(i) for i in range(len(keep))]
            cols += [pa.array([len(x) for x in ids], type=pa.int64()), _packed([np.array(x, dtype="<u4").tobytes() for x in ids])]
            if decode_too:
                cols.append(_packed([own.decode(x) for x in ids]))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_tokens", "ids", "decoded"][: len(cols)])

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and decoded: the bytes of packed ids (null ids: empty)."""
    fields = [df.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in _sliced(batches):
            out = [own.decode(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), _packed(out)], names=[*keep, "decoded"])

    return df.select(*keep, ids_col).mapInArrow(run, schema)
