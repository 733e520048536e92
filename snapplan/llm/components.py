"""Connected components of a large graph by contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """id and root (the smallest id reachable) of every end of ``edges`` (columns a, b, no order or uniqueness needed).

    Each round every vertex points to its smallest neighbour if that is below
    it, pointers are followed to their ends by doubling, and the edges are
    renamed to those ends.  Every vertex that is not the smallest of its
    neighbourhood disappears, so rounds are few.  Vertices are aggregated and
    joined by key; no neighbourhood is ever collected.
    """
    edges = settle(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct())
    known = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = settle(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                    .select("id", F.least("id", "m").alias("root")))
        while True:
            over = up.select(F.col("id").alias("root"), F.col("root").alias("far"))
            far = settle(up.join(over, "root").select("id", F.col("far").alias("root"),
                                                      (F.col("far") != F.col("root")).alias("moved")))
            up = far.select("id", "root")
            if far.filter("moved").isEmpty():
                break
        if known is None:
            known = up
        else:
            over = up.select(F.col("id").alias("root"), F.col("root").alias("far"))
            known = settle(known.join(over, "root", "left").select("id", F.coalesce("far", "root").alias("root")))
        a = up.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        b = up.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        edges = settle(edges.join(a, "a").join(b, "b").filter("ra != rb")
                       .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return known if known is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
