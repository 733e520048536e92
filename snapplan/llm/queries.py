"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .embedding_links import ORACLE as LINKS_SQL
from .embedding_links import embedding_links
from .filter_audit import ORACLE as AUDIT_SQL
from .filter_audit import filter_audit
from .fingerprints import document_fingerprints
from .html_text import page_texts
from .line_dedup import ORACLE as LINE_SQL
from .line_dedup import line_dedup
from .merkle import ORACLE as MERKLE_SQL
from .merkle import dataset_manifest
from .mixing import mix_sources
from .ngram_join import ORACLE as NGRAM_SQL
from .ngram_join import ngram_components
from .packing import best_fit_packing
from .substring_dedup import ORACLE as SUBSTRING_SQL
from .substring_dedup import substring_dedup
from .token_count import token_counts
from .token_files import token_files
from .toxicity import toxicity


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents", "doc_id", "source"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_components(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents", "doc_id", "text"),
                   table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return out.select("doc_id", "held_out", "score", "predicted", "evidence")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    hit = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 2 = 0")
    return dataset_manifest(docs, F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"),
                        table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_line_dedup, op3_source_mixing, op4_document_fingerprints, op5_ngram_join, op6_substring_dedup, op7_html_main_text,
    op8_token_counts, op9_embedding_links, op10_toxicity, op11_merkle_manifest,
    op12_filter_interaction_audit, op13_token_files)}
ORACLES: dict[str, str] = {"op2_line_dedup": LINE_SQL, "op5_ngram_join": NGRAM_SQL,
                            "op6_substring_dedup": SUBSTRING_SQL, "op9_embedding_links": LINKS_SQL,
                            "op11_merkle_manifest": MERKLE_SQL,
                            "op12_filter_interaction_audit": AUDIT_SQL}
