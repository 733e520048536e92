"""Rule and list sources (O-07, O-08, O-57)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encodings import split_list

_WS = r"^\s+|\s+$"


def clean_rule_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """O-07: trim, drop blank lines and ``#`` comments; lines are kept whole
    (not split on commas)."""
    t = F.regexp_replace(F.col(line_col), _WS, "")
    return (lines.withColumn("pattern", t)
            .filter((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
            .drop(line_col))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """O-07 from a text file: ``(ord, pattern)`` with the 1-based line number."""
    raw = spark.read.text(path).select(F.col("value").alias("line"))
    numbered = raw.withColumn("ord", F.monotonically_increasing_id())
    return clean_rule_lines(numbered).select("ord", "pattern")


def text_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Split whole texts into ``(line_no, line)`` rows (1-based)."""
    return df.select("*", F.posexplode(F.split(F.col(text_col), "\n")).alias("_pos", "line")) \
        .withColumn("line_no", F.col("_pos") + 1).drop("_pos", text_col)


def explode_list(df: DataFrame, col: str, out: str = "item") -> DataFrame:
    """O-08: delimited list column -> one row per item with its position."""
    return (df.select("*", F.posexplode(split_list(col)).alias("pos", out)))


def union_rules(*sources: DataFrame) -> DataFrame:
    """O-57: bag union of rule sources, tagged by their source order."""
    out = None
    for i, s in enumerate(sources):
        t = s.select(F.lit(i).alias("source"), "ord", "pattern")
        out = t if out is None else out.unionByName(t)
    return out
