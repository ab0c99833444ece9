"""The queries opN_<name> and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .align import link_statistics
from .chat import CHAT_SQL, chat_query
from .common import read_table
from .decontaminate import find_leaks
from .fingerprints import compare_edits
from .html import extract_pages
from .jaccard import link_documents
from .language import fit_network, identify_languages
from .licenses import license_query
from .lines import dedup_lines
from .quality import quality_query
from .tokenize import count_tokens, encode_digests
from .vectors import compress_vectors

WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), strict=False)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_query(read_table(spark, sf_dir, "conversations"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_query(read_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify_languages(docs, fit_network(docs))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(read_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(read_table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return link_statistics(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": CHAT_SQL}
