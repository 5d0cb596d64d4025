"""Corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.llm import decontaminate, exact, jaccard, language, sentence_pieces
from rowtide.llm.common import table
from rowtide.session import materialize


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; null, empty and letterless texts go, and all when no row is labelled.

    The language found and the ambiguity flag reject nothing.
    """
    found = language.identify_language(docs, language.fit_language(docs), keep=True)
    return found.filter(F.col(found.columns[-2]) != language.UNKNOWN).select(*[found[c] for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of equal texts, as one row; one row of a group without ids."""
    return exact.drop_copies(exact.drop_repeats(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near copies: five words, similarity 0.8 or more."""
    return jaccard.drop_near_copies(docs, size=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark passages."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=True)
    return found.filter(~F.col(found.columns[-1])).select(*[found[c] for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids: piece_ids, n_pieces, round_trip."""
    return sentence_pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=True)


STAGES = [
    ("language id", keep_known_languages),
    ("exact dedup", drop_exact_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("sentence pieces", encode_pieces),
]

# Classifiers, indexes and encoders have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
