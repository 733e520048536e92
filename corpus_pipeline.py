"""Training-corpus pipeline: documents to packed sequences, a stage for each of five operators.

Each stage takes what the one before has kept, written as Parquet and read
again.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapplan.llm.common import settle, table
from snapplan.llm.line_dedup import line_dedup
from snapplan.llm.mixing import mix_sources
from snapplan.llm.ngram_join import ngram_components
from snapplan.llm.packing import GROUP, best_fit_packing, in_read_order
from snapplan.llm.toxicity import toxicity


def _with(docs: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` with (left_semi) or without (left_anti) a partner in ``chosen`` (doc_id, text_hash)."""
    chosen = chosen.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(chosen.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_doc"))
                     & (F.xxhash64("text") == F.col("_hash")), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    scores = toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return _with(docs, scores.filter("predicted = 1"), "left_anti")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them have; n_chars follows the text."""
    out = line_dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones (its smallest doc_id), and all without words."""
    found = ngram_components(docs)
    kept = found.filter((F.col("n_shingles") == 0) | F.col("component_id").isNull()
                        | F.col("doc_id").eqNullSafe(F.col("component_id")))
    # of repeated rows one stays; rows without words are nobody's copy
    empty = found.filter("n_shingles = 0")
    return _with(docs, kept.filter("n_shingles > 0"), "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(
        _with(docs, empty, "left_semi"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixed order: the order of files and of rows within them."""
    out = mix_sources(docs)
    return out.repartitionByRange("position").sortWithinPartitions("position").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, group: int = GROUP) -> DataFrame:
    """Sequences of documents that are read from the files of ``mix``: each run of sequence ids is a run of the mix."""
    return best_fit_packing(in_read_order(docs), group=group)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", drop_near_copies),
          ("source_mixing", mix), ("best_fit_packing", pack)]

#: tokens, word statistics and a fitted classifier: not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of documents after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
