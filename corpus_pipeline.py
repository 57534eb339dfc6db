"""Corpus preparation in five stages, each reading what the stage before it kept.

Quality filter, near-duplicates (one document of each class stays), secrets (masked in the text), mixing (documents
are sampled by calibrated probabilities), subword encoding (the result: ids and digests per document left).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leaseweave.llm import mixing, ordered, pieces, quality, secrets
from leaseweave.llm.common import documents, forget, stored
from leaseweave.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that labelled neighbours vote good; an input without labels is kept whole."""
    return quality.keep_good(docs, quality.learn(docs, documents(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near-duplicates."""
    return ordered.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked, those inside encoded layers too; n_chars follows the text."""
    return secrets.mask_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose source, language and topic shares of tokens meet the tempered targets."""
    return mixing.sample_mixture(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of every document that is left."""
    return pieces.encode_decode(docs, vocabulary())


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing", mixing_stage),
    ("subword encoding", encoding_stage),
]

#: Voting, sketches and subword encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result is a Parquet table in the shared folder, reread for the next."""
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
