"""A training-data pipeline over ``documents``: quality, near-duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave import deploy
from hitweave.llm import packing, quality, secrets, simhash
from hitweave.llm.common import bounded_batches, materialize, table

#: The stages can't be expressed in SQL (tokenisers, hashed models); tests compare them with brute force.
ORACLE_SQL = None


def _prepare(spark: SparkSession) -> None:
    deploy.ship(spark)
    bounded_batches(spark)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws; those it rejects go."""
    _prepare(spark)
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.resample(docs, model, weights=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word Jaccard of 0.8 or more): the one with the smallest id."""
    _prepare(spark)
    return simhash.keep_one(docs, shingle=5, exact=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; n_chars follows the text."""
    _prepare(spark)
    out = secrets.redact(docs, F.col("source"), F.col("lang"))
    changed = F.col("text").isNotNull() & F.col("n_chars").isNotNull()
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 1024 tokens."""
    from public_tokenizers import path

    _prepare(spark)
    return packing.pack(docs, path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, f"stage{n}")
    return docs
