"""The pipeline's near-duplicates against brute force over all pairs' exact 5-word Jaccard similarity."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hitweave.llm import jaccard, simhash
from tests.llm.test_operators import EDGES, docs, text


def slow_set(t):
    words = (t or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_groups(texts):
    """For each text the number of the first text of its group."""
    sets = [slow_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def changed_texts():
    """Near copies with one to fourteen changed words around the similarity of 0.8, and a line in common to many."""
    rng = random.Random(21)
    base = [text(rng, n) for n in (6, 20, 60, 120, 300, 300)]
    line = text(rng, 40)
    out = [f"{line} {text(rng, 60)}" for _ in range(40)] + [f"{line} {text(rng, 9)}" for _ in range(20)]
    for t in base:
        for n in [*range(1, 15)] * 2:
            words = t.split()
            for at in rng.sample(range(len(words)), min(n, len(words))):
                words[at] = f"changed{rng.randrange(10**6)}"
            out.append(" ".join(words))
    return EDGES + base + out


def test_stage_finds_all_similar_texts(spark):
    texts = changed_texts()
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts), "")
    want = set(slow_groups(texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert len(EDGES) < len(want) < len(texts)


@pytest.mark.parametrize("group_rows", [4, 2048])
def test_groups(spark, group_rows, monkeypatch):
    """Groups dealt in tiles and frequent shingles put last lose no link."""
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    texts = changed_texts()
    df = docs(spark, texts).withColumn("k", F.col("doc_id"))
    root = {r["doc_id"]: r["root"] for r in jaccard.near_duplicates(df, "doc_id", "text", ("k",), group_rows=group_rows).collect()}
    groups = slow_groups(texts)
    assert len(root) == len(texts) and len(set(root.values())) == len(set(groups)) == len({(root[i], g) for i, g in enumerate(groups)})


def test_shared_over_batches():
    """Members of several nodes, repeated rows once, however the rows are cut into batches."""
    rng = np.random.default_rng(0)
    for _ in range(40):
        member = np.repeat(np.arange(30), rng.integers(1, 6, 30))
        node = rng.integers(0, 4, len(member))
        order = np.lexsort((node, member))
        member, node = member[order], node[order]
        rows = sorted({(m, n, n % 2 == 0) for m, n in zip(member.tolist(), node.tolist(), strict=True)})
        want = [r for r in rows if sum(m == r[0] for m, _, _ in rows) > 1]
        for size in (1, 2, 3, 7, 100):
            columns = (member, node, node % 2 == 0)
            cut = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in columns], names=["member", "node", "early"]) for i in range(0, len(member), size)]
            assert sorted(tuple(r.values()) for b in jaccard._shared(iter(cut)) for r in b.to_pylist()) == want


def test_parities_bound_the_difference():
    """Folded or not, parities never differ in more buckets than the sets in members."""
    rng = np.random.default_rng(1)
    for _ in range(100):
        pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 2500))) for _ in range(2))
        p, q = jaccard.parities(a), jaccard.parities(b)
        apart = len(np.setxor1d(a, b))
        for n in {min(len(p), len(q)), jaccard.BITS // 64}:
            assert int(np.bitwise_count(jaccard.folded(p, n) ^ jaccard.folded(q, n)).sum()) <= apart


@pytest.mark.parametrize("window", [50, 1 << 20])
def test_frequent_shingles_count_all_texts(spark, window, monkeypatch):
    """Counts over all different texts, short of them by at most one for each window."""
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    texts = changed_texts()
    df = docs(spark, texts + texts[:40]).coalesce(1)
    members, times = jaccard.frequent_shingles(df, "text", 5, window)
    true: dict[int, int] = {}
    sets = {jaccard.node_of(s): s for s in (jaccard.shingles(t or "", 5) for t in texts)}
    for s in sets.values():
        for m in s.tolist():
            true[m] = true.get(m, 0) + 1
    got = dict(zip(members.tolist(), times.tolist(), strict=True))
    windows = 1 if window > 10**6 else sum(map(len, sets.values())) // window + 1
    assert all(1 < n <= true[m] for m, n in got.items())
    assert all(got.get(m, 0) >= n - windows for m, n in true.items())
    if windows == 1:
        assert got == {m: n for m, n in true.items() if n > 1}


def test_columns_with_dots(spark):
    df = docs(spark, changed_texts()[:30]).withColumn("a.b", F.lit("mine"))
    kept = corpus_pipeline.drop_near_duplicates(spark, df.unionByName(df), "")
    assert kept.columns == df.columns and kept.count() == len(set(slow_groups(changed_texts()[:30])))


@pytest.mark.parametrize("route_rows", [8, 4096])
def test_candidates_by_pivots(spark, route_rows):
    """All pairs within the sure radius are joined, by pairs that were compared, and nothing beyond the reach is given."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for n in range(1, 15):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    fps = sorted(fps)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    got = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), simhash.SURE, route_rows, reach=simhash.REACH)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    pairs = {tuple(sorted((signed[r["a"]], signed[r["b"]]))) for r in got.collect()}
    assert all(0 < (a ^ b).bit_count() <= simhash.REACH for a, b in pairs)
    for a, b in pairs:
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a in fps for b in fps if (a ^ b).bit_count() <= simhash.SURE)


def test_stage_links_by_fingerprints(spark, monkeypatch):
    """The stage's links come from SimHash fingerprints and pivots first, two thirds or more of them even for these texts around the limit; the rest is exact."""
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    given = []
    true_links = jaccard.components.components
    monkeypatch.setattr(jaccard.components, "components", lambda links: given.append(links.collect()) or true_links(links))
    texts = changed_texts()
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(slow_groups(texts)))
    assert len(given) == 2 and 3 * len(given[0]) >= 2 * len(given[1])


def test_pairs_of_a_large_group_are_given_out_in_parts():
    """A group of equal bounds: all its pairs, but never all held at once."""
    n = 800
    columns = [np.zeros(n, np.int64), np.arange(n), np.arange(n), np.full(n, 100), np.ones(n, bool), [bytes(jaccard.BITS // 8)] * n]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", "node", "root", "size", "early", "bits"])
    out = list(jaccard._across(iter([batch])))
    pairs = [p for b in out for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert sorted(pairs) == [(i, j) for i in range(n) for j in range(i + 1, n)]
    assert max(b.num_rows for b in out) <= jaccard.PAIRS + n
