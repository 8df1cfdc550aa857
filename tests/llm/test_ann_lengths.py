"""Vectors of several lengths: each is searched among its own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hitweave.llm import ann
from tests.llm.test_operators import brute, vectors


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=n).round(2).tolist(), "x") for i, n in enumerate([8] * 60 + [5] * 50 + [1] * 12)]
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 10 == 0, k=5, share=1.0, shard_rows=50)
    want = brute(rows, lambda i: i % 10 == 0, 5, lambda a, b: float((a.astype(np.longdouble) * b).sum()))
    assert {(r[0], r[1], r[2], round(r[3], 9)) for r in got.collect()} == {(a, b, c, round(float(s), 9)) for a, b, c, s in want}
    assert ann.search(vectors(spark, rows), F.col("vec_id") == 115, k=5).count() == 5
