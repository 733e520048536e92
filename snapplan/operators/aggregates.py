"""Counters over inventories and queues (O-47, O-48)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inventory_counts(files: DataFrame, store: DataFrame, patterns: DataFrame,
                     planned: DataFrame) -> DataFrame:
    """O-47 in long form ``metric, scope, value``: files per root, total
    files, store hashes, rule count, files indexed, files to upload.  One
    aggregation per input (partial first); the total is summed from the
    per-root rows, the plan counters come from a single pass."""
    per_root = files.groupBy("root").agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("files_per_root").alias("metric"), F.col("root").alias("scope"), "value")
    total = per_root.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select(
        F.lit("files_total").alias("metric"), F.lit("").alias("scope"), "value")
    store_n = store.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("store_hashes").alias("metric"), F.lit("").alias("scope"), "value")
    pat_n = patterns.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("patterns").alias("metric"), F.lit("").alias("scope"), "value")
    plan_n = planned.agg(F.count(F.lit(1)).alias("n"), F.count_if("queued").alias("q")).select(
        F.expr("stack(2, 'files_indexed', n, 'files_to_upload', q) as (metric, value)")).select(
        "metric", F.lit("").alias("scope"), "value")
    out = per_root.unionByName(total).unionByName(store_n).unionByName(pat_n).unionByName(plan_n)
    return out.withColumn("value", F.col("value").cast("long"))


def queue_totals(queue: DataFrame) -> DataFrame:
    """O-48: item count and bytes."""
    return queue.agg(F.count(F.lit(1)).alias("n_items"),
                     F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))
