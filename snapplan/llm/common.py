"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapplan.session import cut_lineage, ship_package

#: rows of a key above total / HOT_SHARE make it hot; there are at most HOT_SHARE such keys
HOT_SHARE = 10_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back."""
    return cut_lineage(df)


def python_ready(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers."""
    ship_package(spark)


def parts_for(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], counts: Column, total: int,
           how: str = "inner") -> DataFrame:
    """Join ``left`` with ``right`` (one row per key, no null keys) when single keys of ``left`` may be hot.

    ``counts`` is a column of ``right``: how many left rows have the key.  Keys
    with more than ``total / HOT_SHARE`` rows number at most ``HOT_SHARE``, so
    their part of ``right`` has a proven bound and is broadcast; all other keys
    are shuffled, none of them heavy.  ``how`` is ``inner`` or ``left``.
    """
    limit = max(1, total // HOT_SHARE)
    hot = F.broadcast(right.filter(counts > limit).withColumn("_hot", F.lit(True)))
    cold = right.filter(counts <= limit).withColumn("_hot", F.lit(False))
    value = [c for c in right.columns if c not in keys]
    first = left.join(hot, keys, "left")
    with_hot = first.filter(F.col("_hot")).drop("_hot")
    rest = first.filter(F.col("_hot").isNull()).drop("_hot", *value)
    return with_hot.unionByName(rest.join(cold, keys, how).drop("_hot"))


def spread_over(rows: int) -> int:
    """Parts for narrow rows: some thousands of rows each, up to 2000 parts; beyond, up to 4 million rows each."""
    return max(parts_for(rows, 4_000_000), min(parts_for(rows, 8_192), 2_000))


def in_order(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``rows`` written in the order of ``keys`` (nulls first), with the place of each: ``_part``, ``_file``, ``_row``.

    Parts ascend by the keys, and so do the rows of a part.  Rows with equal
    keys may go to several parts, so no key is too frequent for one.
    """
    out = (rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, "_salt")
           .sortWithinPartitions(*keys, "_salt").drop("_salt"))
    name = F.col("_metadata.file_name")
    return settle(out).select("*", F.regexp_extract(name, r"^part-(\d+)", 1).cast("long").alias("_part"),
                              name.alias("_file"), F.col("_metadata.row_index").alias("_row"))
