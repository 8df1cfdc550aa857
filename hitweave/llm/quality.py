"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are compared: the target's, from texts labelled as good,
and that of the raw corpus, counted over every text.  A text's log ratio is the sum over its n-grams
of ``log p_target - log p_raw``.  Its log weight is that ratio over the square root of the text's
length (a sum over n n-grams has a spread that grows with the root of n, else long texts would always
come first or last), divided by ``TEMPERATURE``.  The sample is drawn without replacement, in
proportion to the weights, by Gumbel top-k: the k largest of ``log weight + Gumbel(0, 1)``, the noise
a hash of the row.  k is a parameter; by default it is the expected number of good texts, counted over
all rows with a cut that the labelled rows give.

n-grams: every three neighbouring bytes of a text, and for each word whether it repeats the word
before it, hashed into ``BUCKETS`` buckets.

Defined results: a null or empty text has weight 0 and is kept; without labelled rows of both
kinds nothing can be rejected; rows that tie with the k-th key are kept; of labelled ids that occur
several times the first text in order counts; texts of any length are read whole; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.common import drop, fresh, materialize

BUCKETS = 1 << 16
#: At most about so many labelled rows fit the target model and the cut.
LABELLED = 20_000
SMOOTH = 4.0
#: Margins (log ratio over the root of the length) are divided by this: the smaller, the more a text's weight decides over the noise.
TEMPERATURE = 0.05
#: The cut that counts the good texts is never above this margin: a text is bad on evidence against it, not for want of evidence.
SURE = -0.5
#: All digits count as one.
DIGITS = bytes.maketrans(b"123456789", b"000000000")
_REPEAT, _NEW = BUCKETS, BUCKETS + 1


def features(text: str) -> tuple[np.ndarray, int, int]:
    """Buckets of the text's byte trigrams; how many of its words repeat the one before, and don't."""
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw.translate(DIGITS), dtype=np.uint8).astype(np.uint32)
    grams = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(16) if len(b) > 2 else np.zeros(0, np.uint32)
    words = raw.split()
    again = sum(map(eq, words, words[1:]))
    return grams, again, max(0, len(words) - 1 - again)


def _counts(texts, into: np.ndarray) -> None:
    for text in texts:
        grams, again, new = features(text)
        into[:BUCKETS] += np.bincount(grams, minlength=BUCKETS) if len(grams) > 4096 else 0
        if len(grams) <= 4096:
            np.add.at(into, grams, 1)
        into[_REPEAT] += again
        into[_NEW] += new


def corpus_counts(texts: DataFrame) -> np.ndarray:
    """n-gram counts over every row of ``texts`` (one string column), summed up in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 2, np.int64)
        for batch in batches:
            _counts(batch.column(0).to_pylist(), total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 2, np.int64)
    out[rows["bucket"]] = rows["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw by bucket; trigrams and the word pairs are two distributions."""
    out = np.zeros(len(raw))
    for part in (slice(0, BUCKETS), slice(BUCKETS, BUCKETS + 2)):
        t, r = target[part].astype(float), raw[part].astype(float)
        # Both get as many counts more as say nothing: an n-gram that the target sample is too small to show weighs little.
        expected = r * (t.sum() / max(r.sum(), 1.0))
        out[part] = np.log(t + SMOOTH) - np.log(expected + SMOOTH)
    return out


def weigh(text: str, ratio: np.ndarray) -> float:
    grams, again, new = features(text)
    return float(ratio[grams].sum() + again * ratio[_REPEAT] + new * ratio[_NEW])


def fit_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut on the weight per square root of length with the fewest errors, an error on a good text counting double."""
    if not len(good) or not len(bad):
        return -math.inf
    cuts = np.unique(np.concatenate([good, bad]))
    below_good = np.searchsorted(np.sort(good), cuts)
    kept_bad = len(bad) - np.searchsorted(np.sort(bad), cuts)
    cost = 2 * below_good / len(good) + kept_bad / len(bad)
    best = np.flatnonzero(cost == cost.min())
    at = int(best[0])
    return min(SURE, float(cuts[at] if at == 0 else (cuts[at] + cuts[at - 1]) / 2))


class Model:
    """The log ratios and the cut of a fitted classifier; a few hundred KB, whatever the corpus."""

    def __init__(self, ratio: np.ndarray, cut: float):
        self.ratio, self.cut = ratio.astype(np.float32), cut

    def column(self, text_col):
        ratio = self.ratio

        @F.pandas_udf("double")
        def log_ratio_of(texts: pd.Series) -> pd.Series:
            return pd.Series([weigh(t, ratio) for t in texts])

        return log_ratio_of(text_col)


def margin(weight: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The weight against the spread that chance gives it, which grows with the root of the length."""
    return weight / np.sqrt(n_bytes + 16.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = LABELLED) -> Model:
    """Fits target and cut on a hashed sample of labelled rows; counts the raw model over all of ``docs``."""
    text, own = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.col(f"`{id_col}`").alias("id")
    known = labels.select(own, F.col(f"`{label_col}`").alias("good")).filter("good is not null and id is not null")
    share = min(1.0, max_labelled / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1 << 40)) < int(share * (1 << 40)))
    picked = picked.groupBy("id").agg(F.max("good").alias("good"))
    labelled = docs.select(own, text).join(F.broadcast(picked), "id").groupBy("id").agg(F.first("good").alias("good"), F.min("text").alias("text"))
    labelled = materialize(labelled.select("good", "text"), "labelled")
    raw = corpus_counts(docs.select(text))
    target = corpus_counts(labelled.filter("good = 1").select("text"))
    ratio = log_ratio(target, raw)
    model = Model(ratio, -math.inf)
    scored = labelled.select("good", F.octet_length("text").alias("n"), model.column(F.col("text")).alias("w")).toPandas()
    m = margin(scored["w"].to_numpy(), scored["n"].to_numpy())
    good = scored["good"].to_numpy() == 1
    return Model(ratio, fit_cut(m[good], m[~good]))


def _ordered(key):
    """Doubles as longs of the same order (key: a column without NaN)."""
    return F.floor(key * float(1 << 32)).cast("long")


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the longs in column key, by counting ranges that narrow 4096-fold; None if there are fewer."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n < k or k < 1:
        return None
    while low < high:
        step = max(1, -(-(high - low + 1) // 4096))
        rows = keys.filter(F.col("key").between(low, high)).groupBy(F.floor((F.col("key") - low) / step).alias("b")).count().collect()
        for b, count in sorted(((r[0], r[1]) for r in rows), reverse=True):
            if k <= count:
                low, high = low + b * step, min(high, low + (b + 1) * step - 1)
                break
            k -= count
    return low


def resample(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, weights: bool = True, k: int | None = None, temperature: float = TEMPERATURE
) -> DataFrame:
    """A sample of k rows of ``docs``, whole, and with ``weights`` columns log_weight and gumbel_key after them.

    Without ``k`` the sample is as large as the number of rows whose margin reaches the model's cut.
    Columns of ``docs`` that have these names already are left out with ``weights``.
    """
    names = docs.columns
    w, g, m = fresh(docs, "__weight", "__gumbel", "__margin")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    uniform = (F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.octet_length(text), F.lit(seed)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    scored = docs.withColumn(m, model.column(text) / F.sqrt(F.octet_length(text) + F.lit(16.0))).withColumn(w, F.col(m) / F.lit(temperature))
    scored = scored.withColumn(g, F.col(w) - F.log(-F.log(uniform)))
    cut = -1e300 if model.cut == -math.inf else model.cut
    keys = materialize(scored.select(_ordered(F.col(g)).alias("key"), (F.col(m) >= F.lit(cut)).alias("inside")), "keys")
    k = keys.agg(F.sum(F.col("inside").cast("long"))).first()[0] or 0 if k is None else min(k, keys.count())
    bar = kth_largest(keys, k)
    drop(keys)
    kept = scored.filter(F.lit(False) if bar is None else _ordered(F.col(g)) >= F.lit(bar))
    if not weights:
        return kept.select([f"`{c}`" for c in names])
    own = [f"`{c}`" for c in names if c not in ("log_weight", "gumbel_key")]
    return kept.select(*own, F.col(w).alias("log_weight"), F.col(g).alias("gumbel_key"))
