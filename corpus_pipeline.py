"""A corpus from raw documents: identified, without exact and near copies, mixed to target weights, and tokenised.

Each stage takes the documents that the one before kept; all but the last return the columns of ``documents``. Rows that
a stage repeats (documents that the mixture reads for a second epoch) are repeated rows of the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqlake.llm import byte_bpe, exact_dedup, lang_id, mixing, simhash
from seqlake.llm.common import table
from seqlake.llm.pretokens import UNIT_PATTERN
from seqlake.llm.queries import WEIGHTS, domain, vocabulary
from seqlake.store import Files, scratch


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages, which their lang then names; those without a letter or in another language go."""
    return lang_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked fingerprints the document with the smallest doc_id."""
    return simhash.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt by weight, up to two epochs of a source."""
    return mixing.take(docs, domain(), epochs=2, seed=42, weights=WEIGHTS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    return byte_bpe.encode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), UNIT_PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix),
    ("byte_bpe", tokenise),
]

#: SQL has neither the classifiers nor XXH64 fingerprints nor BPE; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read again by the next.

    A table goes when the next is written; the last, which the result reads, goes when the driver's JVM ends.
    """
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    files = Files(spark, folder)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                files.remove(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
