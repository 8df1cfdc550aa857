"""SimHash near-duplicates through pivot distance tables.

A document's fingerprint holds the majority of its shingles' 64-bit hashes, bit by bit.  Distinct
fingerprints are routed by an exact pigeonhole rule (at most ``max_bits`` differing bits leave one
of ``max_bits + 1`` bit bands equal; a band that gathers too many fingerprints is divided by bands
of the other bits, then dealt in tiles of bounded size).  Within a route each fingerprint gets its
Hamming distances to a set of reference fingerprints; as these distances can differ by no more
than the pair's own distance, pairs that exceed it in any coordinate are discarded, and only the
survivors' bits are compared.  A task returns a spanning forest of its links, never all pairs;
components are joined by star contraction.

``keep_one(exact=True)`` finds its candidates in the same way, among fingerprints of shingle sets: routes are exact up to
``SURE`` differing bits, within them whatever is no more than ``REACH`` bits apart is held against the texts themselves.  No
number of bits holds all similar texts, so the rest of them follows by an exact join (``jaccard``).

Defined results: a null text counts as empty; a text without words has fingerprint zero and links
like any other; equal texts share a fingerprint; a component's id is its smallest doc_id, null
only if all its ids are null; repeated rows give repeated results; an empty table an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm import jaccard
from hitweave.llm.common import drop, materialize
from hitweave.llm.components import components
from hitweave.llm.groups import first_of_each

SEED = 42
#: A route of more fingerprints is divided further; also the largest tile's half.
ROUTE_ROWS = 4096
PIVOTS = 16
#: Of candidates for an exact comparison: bits up to which their routes are exact, bits that may differ within a route.
SURE, REACH = 7, 12
#: Candidates are linked in steps of so many bits, nearest first.
STEP = 4


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes, as a signed long; 0 for none."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text's word shingles, as a signed long."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest = xxhash.xxh64_intdigest
        pairs = zip(starts[: 1 - shingle].tolist() if shingle > 1 else starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.array([digest(joined[i:j], SEED) for i, j in pairs], dtype=np.uint64)
    return majority(hashes)


def with_fingerprint(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """Columns ``keep`` and fp (signed long)."""
    schema = ", ".join(f"`{df.schema[c].name}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(fps, type=pa.int64())], names=[*keep, "fp"])

    return df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, schema)


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """n fixed, mutually distant fingerprints: hashes of the numbers below n."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(n)], dtype=np.uint64)


def _flat(label: np.ndarray) -> np.ndarray:
    while (label[label] != label).any():
        label = label[label]
    return label


def forest(route: np.ndarray, fps: np.ndarray, steps: tuple[int, ...], pivots: np.ndarray, direct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, root) that join what is within the last of ``steps`` bits inside each route, within the first ones first.

    With ``direct`` the links are the pairs that were compared, not those with the root.  Rows are compared in the order of their
    distance to the first reference fingerprint; a row leaves once that coordinate alone rules out all later ones of its route.
    """
    u = fps.view(np.uint64)
    table = np.bitwise_count(u[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.lexsort((u, table[:, 0], route))
    route, u, table = route[order], u[order], table[order]
    label = np.arange(len(u))
    pairs: list[tuple[int, int]] = []
    for bits in steps:
        alive, d = np.arange(len(u) - 1), 0
        while len(alive):
            d += 1
            alive = alive[alive + d < len(u)]
            other = alive + d
            near = (route[alive] == route[other]) & (table[other, 0] - table[alive, 0] <= bits)
            alive, other = alive[near], other[near]
            apart = label[alive] != label[other]
            i, j = alive[apart], other[apart]
            for p in range(1, table.shape[1]):
                if not len(i):
                    break
                left = np.abs(table[i, p] - table[j, p]) <= bits
                i, j = i[left], j[left]
            linked = np.bitwise_count(u[i] ^ u[j]) <= bits
            joined = False
            for own_x, own_y in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
                x, y = own_x, own_y
                while label[x] != x:
                    x = label[x]
                while label[y] != y:
                    y = label[y]
                if x != y:
                    label[max(x, y)], joined = min(x, y), True
                    pairs.append((own_x, own_y))
            if joined:
                label = _flat(label)
    if direct:
        a, b = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
    else:
        a = np.flatnonzero(label != np.arange(len(u)))
        b = label[a]
    return u[a].view(np.int64), u[b].view(np.int64)


def _links(batches: Iterator[pa.RecordBatch], steps: tuple[int, ...], n_pivots: int, direct: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by route; whole routes are gathered to some size and searched together."""
    pivots = reference_fingerprints(n_pivots)
    route, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(n: int) -> pa.RecordBatch:
        a, b = forest(route[:n], fps[:n], steps, pivots, direct)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        route = np.concatenate([route, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy()])
        if len(route) >= 1 << 17 and (n := int(np.searchsorted(route, route[-1]))):
            yield out(n)
            route, fps = route[n:], fps[n:]
    if len(route):
        yield out(len(route))


def _bands(rest: str, bits: int, n: int, parent) -> DataFrame:
    """An array of (route, rest): one for each of n bands of the ``bits`` bits in column ``rest``."""
    cuts = [bits * i // n for i in range(n + 1)]
    out = []
    for i in range(n):
        low, width = cuts[i], cuts[i + 1] - cuts[i]
        value = F.expr(f"shiftrightunsigned({rest}, {low}) & {(1 << width) - 1}L")
        below = F.expr(f"{rest} & {(1 << low) - 1}L") if low else F.lit(0).cast("long")
        above = F.expr(f"shiftleft(shiftrightunsigned({rest}, {low + width}), {low})") if low + width < 64 else F.lit(0).cast("long")
        out.append(F.struct(F.xxhash64(parent, F.lit(i), value).alias("route"), below.bitwiseOR(above).alias("rest")))
    return F.explode(F.array(*out))


def near_links(fps: DataFrame, max_bits: int = 3, route_rows: int = ROUTE_ROWS, n_pivots: int = PIVOTS, reach: int | None = None) -> DataFrame:
    """A spanning forest (a, b) of the links between distinct fingerprints (column fp).

    With ``reach`` links are compared pairs of up to so many bits, of all within ``max_bits`` and of those beyond that share a
    route, in each route a forest of near ones first.
    """
    steps = (max_bits,) if reach is None else (*range(STEP, reach, STEP), reach)
    n = max_bits + 1
    wide = 64 // n
    level = fps.select("fp", _bands("fp", 64, n, F.lit(0)).alias("at")).select("fp", "at.route", "at.rest")

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        hot = materialize(rows.groupBy("route").agg(F.count("*").alias("n")).filter(F.col("n") > route_rows), "hot")
        if not hot.limit(1).count():
            return rows, rows, False
        return rows.join(hot.select("route"), "route", "left_anti"), rows.join(hot, "route"), True

    found, over, more = split(level)
    found = found.select("route", "fp")
    if more:
        left = 64 - wide
        level = over.select("fp", _bands("rest", left, n, F.col("route")).alias("at")).select("fp", "at.route", "at.rest")
        cold, over, more = split(level)
        found = found.unionByName(cold.select("route", "fp"))
    if more:
        half = route_rows // 2
        blocks = over.withColumn("k", F.ceil(F.col("n") / half)).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("k")))
        tiles = blocks.select("route", "fp", "i", F.explode(F.expr("sequence(0L, k - 1)")).alias("j"))
        found = found.unionByName(tiles.select(F.xxhash64("route", F.least("i", "j"), F.greatest("i", "j")).alias("route"), "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _links(batches, steps, n_pivots, reach is not None)

    parts = found.repartition(F.col("route")).sortWithinPartitions("route")
    return parts.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns id_col, ``keep``, fp, root (the component's smallest fingerprint) and component_id for every row of ``df``."""
    rows = materialize(with_fingerprint(df, text_col, (id_col, *keep), shingle), "fingerprints")
    n = rows.count()
    own = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "own", n)
    links = materialize(near_links(own.select("fp"), max_bits), "links")
    nodes = components(links)
    drop(links)
    named = own.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named, "named", n)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialize(named.join(least, "root").select("fp", "root", "component_id"), "labels", n)
    drop(own, named)
    return rows.join(labels, "fp").select(id_col, *keep, "fp", "root", "component_id")


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (columns node, fp) whose fingerprints are near: a forest within each route; those of one fingerprint meet its first node."""
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "first")
    met = near_links(first.select("fp"), SURE, reach=REACH).distinct()
    of_a, of_b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"node_{c}")) for c in ("a", "b"))
    apart = met.join(of_a, "a").join(of_b, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    equal = nodes.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return apart.unionByName(equal)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, shingle: int = 3, exact: bool = False) -> DataFrame:
    """One row of each component of near-duplicates, whole: the one with the smallest id (null ids last), of repeated rows any.

    With ``exact`` texts are linked by the similarity of their shingle sets (``jaccard.T_OF / jaccard.T_IN`` or more): candidates
    by their fingerprints are verified, and what fingerprints don't reach is found by the exact join.
    """
    if exact:
        return first_of_each(df, id_col, text_col, lambda rows, keep: jaccard.near_duplicates(rows, "id", "text", keep, shingle, sketch=majority, candidates=candidates))
    return first_of_each(df, id_col, text_col, lambda rows, keep: near_duplicates(rows, "id", "text", max_bits, shingle, keep))
