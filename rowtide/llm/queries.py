"""One registered query per operator, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowtide.llm import (
    bpe_count,
    chat,
    decontaminate,
    exact,
    html_text,
    infilling,
    jaccard,
    language,
    merkle,
    pii,
    sentence_pieces,
    sharding,
    suffix_dedup,
)
from rowtide.llm.common import table
from rowtide.session import materialize


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.fit_field(docs))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract_pages(pages, html_text.fit_pages(pages))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify_language(docs, language.fit_language(docs))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.next_reply_pairs(table(spark, sf_dir, "conversations")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return infilling.fill_in_middle(materialize(infilling.store_frames(docs), "frames"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_html_text,
        op3_decontamination,
        op4_sentence_pieces,
        op5_exact_dedup,
        op6_suffix_dedup,
        op7_token_counts,
        op8_language_id,
        op9_ngram_jaccard,
        op10_preference_pairs,
        op11_merkle_manifest,
        op12_feistel_shards,
        op13_fill_in_middle,
    )
}
