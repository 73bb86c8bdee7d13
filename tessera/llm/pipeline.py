"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next one's
documents. All but the last return the columns of `documents`; the last adds `copies`,
and `run` returns each document once for each of its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, mixing, pii, quality, simhash
from .common import fold, materialize, table

#: Score under which the classifier rejects a document; bits in which near-duplicates may
#: differ: more than the two of op10, to find copies with a few words changed.
QUALITY, BUDGET = 0.7, 6


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects; it learns from the training fold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return quality.score_documents(docs, model, QUALITY, keep=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs, BUDGET)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontam.flag(docs, table(spark, sf_dir, "benchmark"), keep=True)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.redact(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and how many copies of each the mix takes, 0 or more; `run` emits them."""
    return mixing.mark(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("PII", redact_personal),
    ("mixing sources to target weights", mix_sources),
]

#: Trained models and a fixpoint over links are not SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return mixing.emit(docs)
