"""Near-duplicates by the exact Jaccard similarity of word shingles, with a prefix-filter join.

Two sets of similarity ``T`` or more have one of their first ``size - ceil(T * size) + 1`` members
in common, in any order that holds for all sets.  The order here is by hash, with the members that
are frequent in the corpus last, so that common lines don't bring all their texts together.  Equal
sets are one node.

Pairs that are given as candidates (by SimHash in the pipeline) are compared first.  The rest is searched in rounds, past what is
in one component already, so that none depends on the candidates.  In the first rounds each node is held against one other: every prefix
member names the node most typical of it (with most of its own members shared), and a node takes the
one that is named most often and not yet in its component; that links nearly all of a large group by
few pairs.  Then all pairs that share a prefix member are searched, but for those already in one
component, which can't change it.  There the smaller set of a pair must have the member among its
first ``size - ceil(2T / (1 + T) * size) + 1`` ones.

Before texts are compared a pair must pass exact bounds: on the sizes, and on the parities of the
sets' members in a power of two of buckets, which differ in no more buckets than the sets differ in
members.  The number of buckets grows with the set (folding the halves of a longer row of parities
onto each other gives a shorter one), so that few pairs pass that aren't similar.  Groups compare
at most ``GROUP_BITS`` buckets, then pairs the full rows, then pairs their texts.

Nothing is missed but for equal 64-bit hashes.  Defined results: a null text counts as empty; texts
without words equal each other only; up to ``shingle`` words are one shingle; a component's root is
its smallest node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm import components
from hitweave.llm.common import drop, materialize, small

SEED = 42
SHINGLE = 5
#: Similarity from which texts are near-duplicates: T = 4/5.
T_OF, T_IN = 4, 5
#: Parities: at least so many, two or more for each member, so many at most.
BITS, MOST_BITS = 512, 1 << 15
#: Parities that stand with each member of a group, at most.
GROUP_BITS = 2048
#: Shingles are counted in windows of about so many; from so many texts on one is frequent; so many are told apart from the rest at most.
WINDOW, FREQUENT, MOST_FREQUENT = 1 << 20, 64, 1 << 17
#: Nodes of one prefix member that are compared in one piece; larger groups are dealt in tiles.
GROUP_ROWS = 2048
#: Rounds in which each node has one partner.
ROUNDS = 2
#: Partners of one node that are compared in one piece.
PARTNERS = 256
#: Pairs of a task's groups that are held at once, about, and pieces they are held in.
PAIRS, PIECES = 1 << 17, 20_000
_MUL = np.array([xxhash.xxh64_intdigest(bytes([i]), SEED) | 1 for i in range(256)], dtype=np.uint64)


def shingles(text: str | bytes, k: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes."""
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h += w[i : len(w) - n + 1 + i] * _MUL[i]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def node_of(members: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(members.tobytes(), SEED)


def similar(common, a, b):
    """Whether sets of sizes a and b with so many common members are similar enough."""
    return (T_OF + T_IN) * common >= T_OF * (a + b)


def near_enough(apart, a, b):
    """Whether sets of sizes a and b can be similar that differ in at least ``apart`` members: (a + b - apart) / 2 are common."""
    return (T_OF + T_IN) * (a + b - apart) >= 2 * T_OF * (a + b)


def prefix(members: np.ndarray, frequent: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The members that a similar set must share one of; ``frequent`` (sorted) ones, ``times`` often, come last."""
    n = len(members) - -(-T_OF * len(members) // T_IN) + 1 if len(members) else 0
    if not len(frequent):
        return members[:n]
    at = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
    return members[np.argsort(np.where(frequent[at] == members, times[at], 0), kind="stable")[:n]]


def parities(members: np.ndarray) -> np.ndarray:
    """The parities of a set's members by their low bits, as words."""
    n = min(MOST_BITS, max(BITS, 1 << (2 * len(members) - 1).bit_length() if len(members) else 0))
    odd = np.bincount((members & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """Parities of fewer buckets, in n words."""
    while len(words) > n:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _text(text_col: str):
    return F.coalesce(F.col(text_col), F.lit("")).alias("text")


def frequent_shingles(df: DataFrame, text_col: str, k: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles most frequent over all texts, and their counts.  They affect the speed only.

    Lossy counting: a window of texts gives out the shingles that stand in two or more of them, so a count misses at
    most one for each window, and what is shuffled is no more than what repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            every = np.concatenate([np.zeros(0, np.uint64), *held])
            every.sort()
            members, more = np.unique(every[1:][every[1:] == every[:-1]], return_counts=True)  # what repeats, less one of each
            return pa.RecordBatch.from_arrays([pa.array(members.view(np.int64)), pa.array(more.astype(np.int64) + 1)], names=["s", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingles(text, k)
                if (node := node_of(s)) in seen:  # copies say nothing new
                    continue
                seen.add(node)
                held.append(s)
                n += len(s)
                if n >= window:
                    yield out()
                    held, n = [], 0
        yield out()

    counts = df.select(_text(text_col)).mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    top = np.array(counts.orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).collect(), dtype=np.int64).reshape(-1, 2)
    members, order = np.unique(top[:, 0].copy().view(np.uint64), return_index=True)
    return members, top[order, 1]


def with_sets(df: DataFrame, text_col: str, keep: list[str], k: int, sketch: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """Columns ``keep`` and node (the hash of a text's set); where a task meets a node first also size, bits, full (size and all parities), prefix and fp (``sketch`` of the set)."""
    frequent, times = frequent_shingles(df, text_col, k)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", node long, size long, bits binary, full binary, prefix array<long>, fp long"
    names = [*keep, "node", "size", "bits", "full", "prefix", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(len(keep)).to_pylist():
                s = shingles(text, k)
                if (node := node_of(s)) in seen:
                    out.append((node, None, None, None, None, None))
                    continue
                seen.add(node)
                words = parities(s)
                full = np.uint64(len(s)).tobytes() + words.tobytes()
                first = prefix(s, frequent, times).view(np.int64)
                out.append((node, len(s), folded(words, GROUP_BITS // 64).tobytes(), full, first, sketch(s) if sketch else None))
            nodes = np.array([x[0] for x in out], dtype=np.uint64).view(np.int64)
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
            cols = [pa.array(nodes), *(pa.array([x[i + 1] for x in out], t) for i, t in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *cols], names=names)

    return df.select(*keep, _text(text_col)).mapInArrow(run, schema)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (member, node, early) sorted by the first two those whose member has several nodes, once."""
    last = None  # the row before, and whether it has been given out
    for batch in batches:
        member, node, flag = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = np.ones(len(member), bool)
        new[1:] = (member[1:] != member[:-1]) | (node[1:] != node[:-1])
        if last and len(member):
            new[0] = (member[0], node[0]) != last[:2]
        member, node, flag = member[new], node[new], flag[new]
        if not len(member):
            continue
        if last:
            member, node, flag = np.r_[last[0], member], np.r_[last[1], node], np.r_[last[2], flag]
        first = np.flatnonzero(np.r_[True, member[1:] != member[:-1]])
        count = np.diff(np.r_[first, len(member)])
        many = count > 1
        keep = np.repeat(many, count)
        if last and last[3]:
            many[0], keep[: count[0]], keep[0] = True, True, False
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (member, node, flag)], names=["member", "node", "early"])
        last = int(member[-1]), int(node[-1]), bool(flag[-1]), bool(many[-1])


def _near(i: int, j: np.ndarray, size: np.ndarray, words: list[np.ndarray], short: np.ndarray) -> np.ndarray:
    """Those of the rows j that pass the bounds with row i."""
    j = j[similar(np.minimum(size[i], size[j]), size[i], size[j])]
    j = j[near_enough(np.bitwise_count(short[i] ^ short[j]).sum(axis=1, dtype=np.int64), size[i], size[j])]
    if len(words[i]) == short.shape[1]:
        return j
    good = np.zeros(len(j), bool)
    for n in {len(words[x]) for x in j.tolist()}:
        at = np.flatnonzero(np.array([len(words[x]) == n for x in j.tolist()], bool))
        m = min(n, len(words[i]))
        own, rest = folded(words[i], m), np.stack([folded(words[x], m) for x in j[at].tolist()])
        good[at] = near_enough(np.bitwise_count(rest ^ own).sum(axis=1, dtype=np.int64), size[i], size[j[at]])
    return j[good]


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of different roots within groups that pass the bounds, some repeatedly; rows come sorted by group."""

    def given(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    def out(group, node, root, size, flag, bits) -> Iterator[pa.RecordBatch]:
        words = [np.frombuffer(b, dtype=np.uint64) for b in bits]
        short = np.stack([folded(w, BITS // 64) for w in words])
        found: list[np.ndarray] = []
        n = 0
        edges = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for i in range(x, y - 1 if (root[x:y] != root[x]).any() else x):
                j = np.arange(i + 1, y)
                # the smaller set has the member early
                j = j[(root[j] != root[i]) & np.where(size[j] < size[i], flag[j], flag[i] | (flag[j] & (size[j] == size[i])))]
                j = _near(i, j, size, words, short) if len(j) else j
                if len(j):
                    found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1))
                    n += len(j)
                if n >= PAIRS or len(found) >= PIECES:
                    yield given(found)
                    found, n = [], 0
        yield given(found)

    held = None
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        if len(held[0]) >= 1 << 15 and (n := int(np.searchsorted(held[0], held[0][-1]))):
            yield from out(*(x[:n] for x in held))
            held = [x[n:] for x in held]
    if held and len(held[0]):
        yield from out(*held)


def compared(pairs: DataFrame, values: DataFrame, load: Callable, test: Callable) -> DataFrame:
    """The pairs (a, b) whose values (node, value: binary) pass ``test(load(value of a), load(value of b))``.

    A task reads the value of a node a once for each ``PARTNERS`` partners, then theirs one after the other.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("k"))
    left = values.select(F.col("node").alias("a"), "value")
    right = values.select(F.col("node").alias("b"), "value")
    heads = many.withColumn("part", F.explode(F.expr("sequence(0L, k - 1)"))).join(left, "a").select("a", "part", F.lit(None).cast("long").alias("b"), "value")
    tails = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("k"))).join(right, "b").select("a", "part", "b", "value")
    both = heads.unionByName(tails).repartition(F.col("a"), F.col("part")).sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            found_a, found_b = [], []
            for i in range(batch.num_rows):
                b, value = batch.column(2)[i].as_py(), load(batch.column(3)[i].as_py())
                if b is None:
                    head = value
                elif test(head, value):
                    found_a.append(batch.column(0)[i].as_py())
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _load_full(value: bytes) -> tuple[int, np.ndarray]:
    words = np.frombuffer(value, dtype=np.uint64)
    return int(words[0]), words[1:]


def _full_test(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> bool:
    (a, p), (b, q) = x, y
    if not similar(min(a, b), a, b):
        return False
    n = min(len(p), len(q))
    return bool(near_enough(int(np.bitwise_count(folded(p, n) ^ folded(q, n)).sum()), a, b))


def _text_test(x: np.ndarray, y: np.ndarray) -> bool:
    return bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))


def near_duplicates(
    df: DataFrame,
    id_col: str,
    text_col: str,
    keep: tuple[str, ...],
    shingle: int = SHINGLE,
    group_rows: int = GROUP_ROWS,
    sketch: Callable[[np.ndarray], int] | None = None,
    candidates: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Columns id_col, ``keep`` (they tell texts apart) and root for every row of ``df``.

    ``candidates`` gives pairs (a, b) for the nodes (columns node, fp) and their ``sketch``; they are compared before all others.
    """
    own = [id_col, *keep]
    rows = materialize(with_sets(df, text_col, own, shingle, sketch), "sets")
    firsts = rows.filter("size is not null")
    count = F.col("size") - F.ceil(F.col("size") * (2 * T_OF) / (T_OF + T_IN)) + 1
    members = firsts.select(F.posexplode("prefix").alias("at", "member"), "node", count.alias("n")).select("member", "node", (F.col("at") < F.col("n")).alias("early"))
    members = members.repartition(F.col("member")).sortWithinPartitions("member", "node")
    shared = materialize(members.mapInArrow(_shared, "member long, node long, early boolean"), "shared")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are similar."""
        pairs = materialize(pairs, f"{name}-pairs")
        full = firsts.select("node", F.col("full").alias("value")).dropDuplicates(["node"])
        close = materialize(compared(pairs, full, _load_full, _full_test), f"{name}-close")
        used = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
        used = materialize(used, f"{name}-used")
        n = used.count()
        where = rows.join(small(used, n), "node", "left_semi").groupBy("node").agg(F.min(F.struct(*keep)).alias("one")).select("node", "one.*")
        where = materialize(where, f"{name}-where")
        texts = df.select(*keep, _text(text_col)).join(small(where, n), list(keep)).dropDuplicates(["node"])
        texts = materialize(texts.select("node", F.col("text").cast("binary").alias("value")), f"{name}-texts")
        out = materialize(compared(close, texts, lambda t: shingles(t, shingle), _text_test), f"{name}-links")
        drop(pairs, close, used, where, texts)
        return out

    def tested(pairs: DataFrame, name: str) -> DataFrame:
        """The similar ones of materialised pairs; of a pair the node with more partners comes first."""
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("d"))
        a_d, b_d = (ends.select(F.col("node").alias(c), F.col("d").alias(f"d{c}")) for c in ("a", "b"))
        most = F.col("da") >= F.col("db")
        both = pairs.join(a_d, "a").join(b_d, "b")
        return links(both.select(F.when(most, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(most, F.col("b")).otherwise(F.col("a")).alias("b")), name)

    # the share of a node's members that others have
    own_share = shared.groupBy("node").agg(F.count("*").alias("n")).join(firsts.select("node", F.size("prefix").alias("of")).dropDuplicates(["node"]), "node")
    own_share = materialize(own_share.select("node", (F.col("n") / F.col("of")).alias("typical")), "typical")

    def grouped(root: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Members with nodes of several roots: their rows (member, node, early, root), and n, high and low root of each."""
        group = shared.withColumn("root", F.col("node")) if root is None else shared.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        of = group.groupBy("member").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
        return group, of.select("member", "n")

    found: DataFrame | None = None  # links
    tried: DataFrame | None = None
    root: DataFrame | None = None
    if candidates:
        pairs = candidates(firsts.select("node", "fp").dropDuplicates(["node"]))
        tried = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
        found = tested(tried, "candidates")
        root = components.components(found)
    for step in range(ROUNDS):
        group, of = grouped(root)
        group = materialize(group.select("member", "node", "root").join(of, "member").join(own_share, "node"), "group")
        by_root = group.groupBy("member", "root").agg(F.max(F.struct("typical", "node")).alias("best"))
        one = materialize(by_root.groupBy("member").agg(F.max(F.struct("best", "root")).alias("one")), "one")
        two = by_root.join(one, "member").filter(F.col("root") != F.col("one.root")).groupBy("member").agg(F.max("one").alias("one"), F.max("best").alias("two"))
        hub = F.when(F.col("root") == F.col("one.root"), F.col("two.node")).otherwise(F.col("one.best.node"))
        met = group.join(two, "member").select("node", hub.alias("hub")).groupBy("node", "hub").agg(F.count("*").alias("n"))
        pairs = met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), "node", "n")
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        best = pairs.groupBy("node").agg(F.max(F.struct("n", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
        pairs = materialize(best, "round")
        new = tested(pairs, "star")
        found = new if found is None else found.unionByName(new)
        tried = pairs if tried is None else tried.unionByName(pairs)
        root = components.components(found)
        drop(group, one)

    group, of = grouped(root)
    facts = firsts.select("node", "size", "bits").dropDuplicates(["node"])
    group = group.join(of, "member").join(facts, "node")
    k = F.ceil(F.col("n") / (group_rows // 2))
    tiled = group.filter(F.col("n") > group_rows).withColumn("k", k).withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")))
    tiled = tiled.withColumn("j", F.explode(F.expr("sequence(0L, k - 1)")))
    at = F.xxhash64("member", F.least("i", "j"), F.greatest("i", "j"))
    columns = ["node", "root", "size", "early", "bits"]
    whole = group.filter(F.col("n") <= group_rows).select(F.col("member").alias("at"), *columns)
    dealt = whole.unionByName(tiled.select(at.alias("at"), *columns)).repartition(F.col("at")).sortWithinPartitions("at")
    second = links(dealt.mapInArrow(_across, "a long, b long").distinct(), "across")
    drop(shared)
    root = components.components(found.unionByName(second))
    return rows.select(*own, "node").join(root, "node", "left").select(*own, F.coalesce("root", "node").alias("root"))
