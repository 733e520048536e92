"""Decision operators of the snapshot plan (O-36 .. O-42, O-45, O-46).

Inputs
  files  : path, dir, name, ext, size, mtime[, root_ord][, content | real file]
           [, is_symlink, link_target]
  state  : path, st_hash, st_hash_mtime, backup_mtime      (unique on path)
  store  : hash, size                                      (unique on hash)

Scale notes
  * ``with_state`` is an equi-join on ``path`` (no hot keys: a path occurs
    at most once per root).
  * ``flag_changed_safe`` joins on ``hash``, where one hash can hold a third
    of all rows (empty files, a common licence text).  The store side is
    unique per hash, so the join is a many-to-one lookup.  ``hot_keys``
    finds hashes above ``1 / (4 * partitions)`` of the rows in a bounded
    sample; those rows join a broadcast of at most that many store rows,
    the rest take the shuffled join (where AQE's skew split still applies).
  * ``first_per_key`` never groups whole rows: it aggregates the least
    ordering struct per hash (map-side partial aggregation collapses a hot
    hash before the shuffle) and joins the winners back on the full
    identity ``(hash, order columns)``, which is spread evenly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import digest_or_zero, is_link_digest, symlink_digest
from ..sources.store_index import StoreIndex

STATE_COLS = ("st_hash", "st_hash_mtime", "backup_mtime")


def with_state(files: DataFrame, state: DataFrame) -> DataFrame:
    """O-38: files LEFT JOIN last-known state USING (path).  State grows with
    the files, so it is not broadcast on an estimate."""
    st = state.select("path", *STATE_COLS).hint("merge")
    return files.join(st, "path", "left")


def stale_flag(variant: str = "C") -> Column:
    """O-39 predicate: the stored digest cannot be reused."""
    if variant.upper() == "C":
        return (F.col("st_hash_mtime").isNull()
                | (F.col("st_hash_mtime") != F.col("mtime"))
                | F.col("st_hash").isNull() | (F.col("st_hash") == ""))
    return (F.coalesce(F.col("st_hash_mtime"), F.lit(0)) != F.col("mtime")) | F.col("st_hash").isNull()


def fresh_digest(variant: str = "C", content: str = "content") -> Column:
    """Digest of the current payload: links get the ``SYM-`` pseudo digest in
    variant C; variant P follows links and writes ``0`` for empty files."""
    if variant.upper() == "C":
        return F.when(F.coalesce(F.col("is_symlink"), F.lit(False)),
                      symlink_digest("link_target")).otherwise(F.md5(F.col(content)))
    return digest_or_zero(content, "size")


def with_digest(df: DataFrame, variant: str = "C", content: str = "content") -> DataFrame:
    """O-39 on an already joined frame: ``stale`` flag and the effective
    ``hash`` (the digest branch is lazy, so fresh rows never hash content).
    Prefer ``with_state_digest`` when the payload would cross a shuffle."""
    stale = stale_flag(variant)
    return (df.withColumn("stale", stale)
              .withColumn("hash", F.when(F.col("stale"), fresh_digest(variant, content))
                          .otherwise(F.col("st_hash"))))


def with_state_digest(files: DataFrame, state: DataFrame, variant: str = "C",
                      content: str = "content", keep_content: bool = False) -> DataFrame:
    """O-38 + O-39 for table payloads, shuffle-friendly: the payload is
    digested map-side and dropped before the join on ``path``, so the
    exchange carries a 32-character digest instead of the payload; the
    stored digest is still used for rows that are not stale."""
    df = files.withColumn("_fresh", fresh_digest(variant, content))
    if not keep_content:
        df = df.drop(content)
    df = with_state(df, state)
    return (df.withColumn("stale", stale_flag(variant))
              .withColumn("hash", F.when(F.col("stale"), F.col("_fresh")).otherwise(F.col("st_hash")))
              .drop("_fresh"))


def split_undigested(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-37: rows without a usable digest are reported, not planned."""
    ok = F.col("hash").isNotNull() & (F.col("hash") != "")
    return df.filter(ok), df.filter(~ok)


def flag_changed_fast(df: DataFrame, variant: str = "C") -> DataFrame:
    """O-40: upload when backup-mtime is missing or differs from mtime."""
    if variant.upper() == "C":
        req = ~F.col("backup_mtime").eqNullSafe(F.col("mtime"))
    else:
        req = F.coalesce(F.col("backup_mtime"), F.lit(0)) != F.col("mtime")
    return df.withColumn("upload_required", req)


def flag_changed_safe(df: DataFrame, store: "DataFrame | StoreIndex",
                      hot_keys: Sequence[str] | None = None) -> DataFrame:
    """O-41: upload when the hash is absent from the store or its size differs.

    ``hot_keys``: hashes known to be hot; their store rows (at most
    ``len(hot_keys)``) are broadcast and joined separately from the rest.
    ``store``: the listed ``(hash, size)`` rows, or a ``StoreIndex``.
    """
    indexed = isinstance(store, StoreIndex)
    st = None if indexed else store.select("hash", F.col("size").alias("store_size"))

    def lookup(rows: DataFrame) -> DataFrame:
        return store.with_size(rows) if indexed else rows.join(st.hint("merge"), "hash", "left")

    if hot_keys:
        hot = F.col("hash").isin(list(hot_keys))
        few = store.sizes_of(list(hot_keys)) if indexed else st.filter(hot)
        joined = df.filter(hot).join(F.broadcast(few), "hash", "left").unionByName(lookup(df.filter(~hot)))
    else:
        joined = lookup(df)
    req = F.col("store_size").isNull() | (F.col("store_size") != F.col("size"))
    return joined.withColumn("upload_required", req)


def hot_keys(df: DataFrame, key: str, partitions: int | None = None, max_keys: int = 1000,
             min_rows_in_sample: int = 100, min_hot_rows: int = 50_000) -> list:
    """Keys holding more than ``1 / (4 * partitions)`` of all rows, found
    in a bounded sample (detection only - every row is still processed).

    At most ``4 * partitions`` keys can pass that share, and the result is
    capped at ``max_keys``, so what the caller broadcasts is bounded.  When
    that share is below ``min_hot_rows`` rows no key can make a task
    straggle, and the sample is skipped."""
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = 1.0 / (4 * parts)
    n = df.count()                           # Parquet footers when df is a written table
    if n == 0 or n * share < max(2, min_hot_rows):
        return []
    frac = min(1.0, min_rows_in_sample / (share * n))
    sample = df.select(key).sample(withReplacement=False, fraction=frac, seed=7)
    need = max(2, int(0.5 * share * n * frac))
    rows = (sample.groupBy(key).count().filter(F.col("count") >= need)
            .orderBy(F.col("count").desc()).limit(min(max_keys, 4 * parts)).collect())
    return [r[key] for r in rows if r[key] is not None]


def status_repairs(df: DataFrame, variant: str = "C") -> Column:
    """O-42: safe mode, nothing to upload, but the backup mark is stale."""
    if variant.upper() == "C":
        stale_mark = ~F.col("backup_mtime").eqNullSafe(F.col("mtime"))
    else:
        stale_mark = F.coalesce(F.col("st_hash_mtime"), F.lit(0)) != F.col("mtime")
    return ~F.col("upload_required") & stale_mark


def queue_eligible(variant: str = "C") -> Column:
    """O-36: flagged, non-empty, and (variant C) not a link."""
    cond = F.col("upload_required") & (F.col("size") > 0)
    if variant.upper() == "C":
        cond = cond & ~is_link_digest("hash")
    return cond


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """O-45: the least row per ``key`` by ``order`` -> ``key, *order``.

    Aggregates a struct minimum (partial aggregation before the shuffle), so
    a key holding a third of all rows costs one row per map task."""
    rep = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return rep.select(key, *[F.col(f"_first.{c}").alias(c) for c in order])


def mark_first(df: DataFrame, eligible: Column, key: str, order: Sequence[str],
               out_col: str = "queued") -> DataFrame:
    """Flag the first eligible row per key; ineligible rows are never ranked."""
    reps = first_per_key(df.filter(eligible), key, order).withColumn("_is_first", F.lit(True))
    return (df.join(reps, [key, *order], "left")
              .withColumn(out_col, eligible & F.coalesce(F.col("_is_first"), F.lit(False)))
              .drop("_is_first"))


def unique_paths(df: DataFrame, order: Sequence[str] = ("root_ord",)) -> DataFrame:
    """O-46: one row per path (the first root that reached it)."""
    cols = [c for c in order if c in df.columns]
    if not cols:
        return df.dropDuplicates(["path"])
    first = first_per_key(df, "path", cols)
    return df.join(first, ["path", *cols], "left_semi")
