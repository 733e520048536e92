"""Snapshot plans (O-58 .. O-61, O-63) and the dry-run report (O-16).

``plan`` turns an inventory (or any keyed table, see ``table_files``) plus
the last-known state and, in safe mode, the content-store index into one
row per inventory row:

  path, dir, name, ext, hash, size, mtime, stale, upload_required,
  in_queue ('x' or ''), queued, dest, repair

Exchanges: one on ``path`` (state join), one on ``hash`` (store join, safe
mode only) and one on ``(hash, order)`` for the first-per-hash winners.  The
digested rows are written once below ``spark.checkpoint.dir`` (digests never
run twice); in safe mode a bounded sample of that table finds hot hashes.
Those two jobs run when the plan is built; the rest is one lazy DataFrame
and nothing else reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import digest_files
from ..functions.paths import extension, shard_path
from ..operators import planning as P
from ..session import cut_lineage

PLAN_COLS = ["path", "dir", "name", "ext", "hash", "size", "mtime", "stale",
             "upload_required", "in_queue", "queued", "dest", "repair"]


@dataclass(frozen=True)
class PlanOptions:
    mode: str = "fast"            # 'fast' | 'safe'
    variant: str = "C"            # 'C' | 'P'
    depth: int = 3                # destination directory depth
    order: tuple[str, ...] = ("root_ord", "path")   # "first" in listing order
    hot_hashes: tuple[str, ...] = ()                # optional known hot hashes
    keep_extra: tuple[str, ...] = ()                # extra input columns to keep
    cut_lineage: bool = True      # write the digested table once (digests run once)
    detect_skew: bool = True      # safe mode: route hot hashes through a bounded broadcast
    hot_min_rows: int = 50_000    # a hot hash must be able to hold at least this many rows


def _digest_real_files(files: DataFrame, state: DataFrame, variant: str) -> DataFrame:
    """Files without a ``content`` column: join the state, read only the
    stale files, in tasks of equal bytes, and keep the stored digest of the
    others, which no Python process sees."""
    df = cut_lineage(P.with_state(files, state).withColumn("stale", P.stale_flag(variant)))
    stale = df.filter("stale").select("path", "size").groupBy("path").agg(F.max("size").alias("size"))
    fresh = digest_files(stale, out_col="_fresh", follow_links=variant.upper() == "P").select("path", "_fresh")
    df = df.join(fresh.hint("merge"), "path", "left")
    fresh = F.col("_fresh")
    if variant.upper() == "P":
        # variant P: empty files are "0"; a failed digest aborts the run
        fresh = F.when(F.col("size") == 0, F.lit("0")).when(
            F.col("_fresh").isNull(), F.raise_error(F.concat(F.lit("digest failed: "), F.col("path")))
        ).otherwise(F.col("_fresh"))
    return df.withColumn("hash", F.when(F.col("stale"), fresh).otherwise(F.col("st_hash"))).drop("_fresh")


def plan(files: DataFrame, state: DataFrame, store: DataFrame | None = None,
         opts: PlanOptions = PlanOptions()) -> DataFrame:
    variant = opts.variant.upper()
    order = [c for c in opts.order if c in files.columns] or ["path"]
    if "path" not in order:
        order.append("path")

    df = files
    if variant == "P":
        df = df.withColumn("ext", extension("name", "P"))
        if "link_to_dir" in df.columns:
            # variant P walks directories and lists files only; a link to a
            # directory is neither descended nor listed
            df = df.filter(~F.coalesce(F.col("link_to_dir"), F.lit(False)))
    if "content" in df.columns:
        # table payloads: digest map-side, then join (O-38, O-39)
        df = P.with_state_digest(df, state, variant, keep_content="content" in opts.keep_extra)
    else:
        df = _digest_real_files(df, state, variant)                    # O-38, O-39 (stale rows read)
    if variant == "C":
        df, _issues = P.split_undigested(df)                           # O-37

    base_cols = ["path", "dir", "name", "ext", "hash", "size", "mtime", "stale", "backup_mtime",
                 "st_hash_mtime"]
    df = df.select(*base_cols, *[c for c in [*order, *opts.keep_extra]
                                 if c in df.columns and c not in base_cols])
    if opts.cut_lineage:
        # digests are computed once; both the store join and the
        # first-per-hash step below read this narrow written table
        df = cut_lineage(df)

    if opts.mode == "safe":
        if store is None:
            raise ValueError("safe mode needs the store index")
        hot = list(opts.hot_hashes)
        if opts.detect_skew and opts.cut_lineage and not hot:
            hot = P.hot_keys(df, "hash", min_hot_rows=opts.hot_min_rows)
        df = P.flag_changed_safe(df, store, hot or None)               # O-41
        df = df.withColumn("repair", P.status_repairs(df, variant))   # O-42
    else:
        df = P.flag_changed_fast(df, variant)                          # O-40
        df = df.withColumn("repair", F.lit(False))

    df = df.withColumn("in_queue", F.when(F.col("upload_required") & (F.col("size") > 0),
                                          F.lit("x")).otherwise(F.lit("")))
    df = P.mark_first(df, P.queue_eligible(variant), "hash", order)     # O-36, O-45
    df = df.withColumn("dest", F.when(F.col("queued"), shard_path("hash", "ext", opts.depth)))  # O-24
    extra = [c for c in opts.keep_extra if c in df.columns and c not in PLAN_COLS]
    return df.select(*PLAN_COLS, *extra)


def plan_summary(planned: DataFrame) -> DataFrame:
    """O-61: one row of plan counters (single aggregation, partial first)."""
    c = F.col
    return planned.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(c("stale")).alias("n_stale"),
        F.count_if(c("upload_required")).alias("n_flagged"),
        F.count_if(c("in_queue") == "x").alias("n_marked"),
        F.count_if(c("queued")).alias("n_queued"),
        F.coalesce(F.sum(F.when(c("queued"), c("size"))), F.lit(0)).cast("long").alias("queued_bytes"),
        F.count_if(c("repair")).alias("n_repaired"),
        F.count_if(c("hash").startswith("SYM-")).alias("n_links"),
        F.count_if(c("size") == 0).alias("n_empty"),
    )


def queue(planned: DataFrame) -> DataFrame:
    """The copy queue: path, dest, hash, size, try_count."""
    return (planned.filter("queued")
            .select("path", "dest", "hash", "size", "ext", F.lit(0).alias("try_count")))


def dry_run_report(planned: DataFrame) -> DataFrame:
    """O-16: what a run would copy, as log lines; no sink is touched."""
    q = planned.filter("queued")
    return q.select("path", "dest",
                    F.concat(F.lit("[DRY RUN] would copy "), "path", F.lit(" to "), "dest").alias("line"))


def table_files(df: DataFrame, key: Sequence[str], cols: Sequence, table: str = "table") -> DataFrame:
    """O-63: present a keyed table as an inventory ``plan()`` accepts.

    ``path`` = ``/<table>/<key columns joined by |>``; ``content`` = the
    selected columns joined by ``|`` (pass ``stable_text`` columns for
    doubles and dates); the row's version plays the part of the mtime: a
    64-bit hash of the payload, so a changed row is stale (re-digested) and
    an unchanged one reuses its stored digest."""
    k = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    payload = F.concat_ws("|", *[F.col(c) if isinstance(c, str) else c for c in cols])
    return df.select(
        F.concat(F.lit(f"/{table}/"), k).alias("path"), F.lit(f"/{table}").alias("dir"),
        k.alias("name"), F.lit("").alias("ext"), payload.alias("content"),
        F.octet_length(payload).cast("long").alias("size"),
        F.xxhash64(payload).alias("mtime"),
        F.lit(False).alias("is_symlink"), F.lit(None).cast("string").alias("link_target"))


def stable_text(col, kind: str) -> F.Column:
    """Engine-independent text of a value for row digests."""
    c = F.col(col) if isinstance(col, str) else col
    if kind == "money":
        return F.round(c * 100).cast("long").cast("string")
    if kind == "date":
        return c.cast("date").cast("string")
    return c.cast("string")


def table_snapshot(current: DataFrame, previous: DataFrame, key: str = "k", digest: str = "digest") -> DataFrame:
    """O-63 decision: new / changed / unchanged per key, and which changed
    rows are queued (first key per distinct digest).

    Both tables are shuffled once, by key: the rows that moved give the least
    key of each digest (partial aggregation first), and these winners come
    back by key to rows that are partitioned by it already.  The two readers
    of the joined rows share the shuffled tables, which grow with the data and
    are never broadcast."""
    prev = previous.select(F.col(key), F.col(digest).alias("_prev"))
    j = current.select(key, digest).join(prev.hint("merge"), key, "left")
    status = (F.when(F.col("_prev").isNull(), "new")
              .when(F.col("_prev") != F.col(digest), "changed").otherwise("unchanged"))
    j = j.withColumn("status", status).drop("_prev")
    # a key that occurs several times may be the least of several digests
    first = (j.filter("status != 'unchanged'").groupBy(digest).agg(F.min(key).alias(key))
             .groupBy(key).agg(F.collect_set(digest).alias("_first")))
    queued = (F.col("status") != "unchanged") & F.coalesce(F.array_contains("_first", F.col(digest)), F.lit(False))
    return j.join(first.hint("merge"), key, "left").select(key, digest, "status", queued.alias("queued"))
