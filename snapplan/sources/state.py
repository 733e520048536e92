"""Per-file state: wide view of the attribute table and upserts (O-06, O-15).

State is a table, never extended attributes: ``state_kv(path, attr, value)``
(long) or ``state(path, st_hash, st_hash_mtime, backup_mtime)`` (wide).  A
new state is written as a new snapshot directory (``write_state``), which is
atomic for readers that follow a pointer to the latest snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Attribute names of the per-file state.
ATTR_HASH = "user.md5_hash_value"
ATTR_HASH_MTIME = "user.md5_hash_mtime"


def attr_backup_mtime(job: str) -> str:
    return f"user.{job}_backup_mtime"


def state_wide(state_kv: DataFrame, job: str = "job") -> DataFrame:
    """O-06: one row per path, a missing attribute is null.  Conditional
    aggregation (one pass, partial aggregation per path)."""
    bm = attr_backup_mtime(job)
    a, v = F.col("attr"), F.col("value")
    return state_kv.groupBy("path").agg(
        F.max(F.when(a == ATTR_HASH, v)).alias("st_hash"),
        F.max(F.when(a == ATTR_HASH_MTIME, v)).try_cast("long").alias("st_hash_mtime"),
        F.max(F.when(a == bm, v)).try_cast("long").alias("backup_mtime"),
    ).filter(F.col("st_hash").isNotNull() | F.col("st_hash_mtime").isNotNull()
             | F.col("backup_mtime").isNotNull())


def state_updates(planned: DataFrame, saved: DataFrame | None = None,
                  variant: str = "C", mark_duplicates: bool = False) -> DataFrame:
    """Updates a run produces, one row per path, null = leave as is.

    * stale rows: fresh hash and hash-mtime,
    * repairs (safe mode): backup-mtime = mtime,
    * saved items (``saved`` = paths whose copy succeeded; all queued rows
      when None): backup-mtime = mtime,
    * links (variant C, never copied): backup-mtime = mtime, in the same
      encoding as every other mark (D-5),
    * ``mark_duplicates``: rows whose content was saved through another
      path are marked too (D-4 option; default off, as the reference).
    Variant P also clears backup-mtime of queued rows that were not saved
    (``clear_backup`` column)."""
    p = planned
    if saved is not None:
        ok = saved.select("path").distinct().withColumn("_saved", F.lit(True))
        p = p.join(ok, "path", "left")
        saved_flag = F.coalesce(F.col("_saved"), F.lit(False))
    else:
        saved_flag = F.col("queued")
    mark = F.col("repair") | saved_flag
    if variant.upper() == "C":
        mark = mark | F.col("hash").startswith("SYM-")
    if mark_duplicates:
        done = (p.filter(saved_flag).select("hash").distinct()
                .withColumn("_content_saved", F.lit(True)))
        p = p.join(done, "hash", "left")
        mark = mark | (F.col("upload_required") & F.coalesce(F.col("_content_saved"), F.lit(False)))
    clear = (F.col("queued") & ~saved_flag) if variant.upper() == "P" else F.lit(False)
    # a path reached through two roots has two plan rows (only one of them
    # queued): combine per path so no mark is lost
    out = p.groupBy("path").agg(
        F.max(F.when(F.col("stale"), F.col("hash"))).alias("new_hash"),
        F.max(F.when(F.col("stale"), F.col("mtime"))).alias("new_hash_mtime"),
        F.max(F.when(mark, F.col("mtime"))).alias("new_backup_mtime"),
        (F.bool_or(clear) & ~F.bool_or(mark)).alias("clear_backup"),
    )
    has = (F.col("new_hash").isNotNull() | F.col("new_hash_mtime").isNotNull()
           | F.col("new_backup_mtime").isNotNull() | F.col("clear_backup"))
    return out.filter(has)


def merge_state(old: DataFrame, updates: DataFrame) -> DataFrame:
    """O-15: full outer join on path, newest value per attribute wins."""
    j = old.join(updates, "path", "full_outer")
    return j.select(
        "path",
        F.coalesce("new_hash", "st_hash").alias("st_hash"),
        F.coalesce("new_hash_mtime", "st_hash_mtime").alias("st_hash_mtime"),
        F.when(F.coalesce(F.col("clear_backup"), F.lit(False)), F.lit(None).cast("long"))
        .otherwise(F.coalesce("new_backup_mtime", "backup_mtime")).alias("backup_mtime"),
    )


def state_long(state: DataFrame, job: str = "job") -> DataFrame:
    """Wide -> attribute rows (inverse of ``state_wide``)."""
    bm = attr_backup_mtime(job)
    arr = F.array(
        F.struct(F.lit(ATTR_HASH).alias("attr"), F.col("st_hash").alias("value")),
        F.struct(F.lit(ATTR_HASH_MTIME).alias("attr"), F.col("st_hash_mtime").cast("string").alias("value")),
        F.struct(F.lit(bm).alias("attr"), F.col("backup_mtime").cast("string").alias("value")),
    )
    return (state.select("path", F.inline(arr)).filter(F.col("value").isNotNull()))


def write_state(state: DataFrame, base: str, snapshot_id: str) -> str:
    """Write a new state snapshot directory and return its path.  Readers
    switch to it only after the write has committed."""
    path = f"{base.rstrip('/')}/snapshot={snapshot_id}"
    state.repartition("path").write.mode("errorifexists").parquet(path)
    return path


def write_state_bucketed(state: DataFrame, table: str, buckets: int) -> str:
    """State as a catalog table bucketed and sorted by ``path``: a later
    join on ``path`` with ``buckets`` shuffle partitions reads it without an
    exchange (only the inventory side is shuffled).  Needs a persistent
    catalog on a cluster; write each run to a new table name (a table that
    is read cannot be overwritten in the same job)."""
    (state.repartition(buckets, "path").write.mode("errorifexists")
     .bucketBy(buckets, "path").sortBy("path").saveAsTable(table))
    return table
