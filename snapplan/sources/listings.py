"""Content-store indexes from listings (O-03, O-04, O-05).

Every listing reduces to ``store(hash string, size long)``, unique on hash.
"Same hash twice, last wins" is made deterministic as "greatest path wins";
the reduction is an aggregation, so a hash listed many times is combined
map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import basename, stem


def _dedup(df: DataFrame) -> DataFrame:
    return df.groupBy("hash").agg(F.max_by("size", "path").alias("size"))


def store_from_listing(listing: DataFrame, exclude_prefix: str | None = None) -> DataFrame:
    """O-03: hash = file name without its last extension; size 0 and empty
    names dropped.  ``exclude_prefix`` (e.g. ``metadata/``) keeps manifests
    out of the index when wanted (D-15)."""
    df = listing.select("path", "size", stem(basename("path")).alias("hash"))
    if exclude_prefix:
        df = df.filter(~F.col("path").startswith(exclude_prefix))
    return _dedup(df.filter((F.col("size") > 0) & (F.col("hash") != "")))


def store_from_objects(objects: DataFrame, on_error: str = "skip") -> DataFrame:
    """O-04: object listings prefer the stored MD5 (lower hex) and fall back
    to the name stem; empty objects are dropped.  ``on_error='fail'`` raises
    when a row has neither (variant P collects and raises)."""
    md5 = F.col("content_md5")
    key = F.when((md5.isNotNull()) & (F.octet_length(md5) > 0), F.lower(F.hex(md5))) \
        .otherwise(stem(basename("path")))
    df = objects.filter(F.col("size") > 0).select("path", "size", key.alias("hash"))
    if on_error == "fail":
        bad = df.filter(F.col("hash").isNull() | (F.col("hash") == "")).limit(1).count()
        if bad:
            raise ValueError("object listing holds entries without a usable key")
    return _dedup(df.filter(F.col("hash").isNotNull() & (F.col("hash") != "")))


def store_from_kv(state_kv: DataFrame, sizes: DataFrame, attr: str = "user.backup_hash") -> DataFrame:
    """O-05: hash kept as an attribute of the stored file; files without the
    attribute are ignored (inner join)."""
    kv = state_kv.filter(F.col("attr") == attr).select("path", F.col("value").alias("hash"))
    return _dedup(kv.join(sizes.select("path", "size"), "path", "inner"))


def listing_from_directory(spark: SparkSession, root: str) -> DataFrame:
    """Listing of a small directory store via ``binaryFile`` without reading
    content (the reader prunes the content column), paths relative to the
    root.  Its file index lives on the driver: for large stores use the
    inventory source (``DirectoryStore.list``)."""
    import re
    rel = root[len("file:"):] if root.startswith("file:") else root
    rel = rel.rstrip("/")
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
          .select("path", F.col("length").alias("size")))
    return df.select(F.regexp_extract("path", re.escape(rel) + "/(.*)$", 1).alias("path"), "size")
