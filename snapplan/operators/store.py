"""Content stores: put-if-absent sinks, blob tables, transfer plan and the
pluggable store protocol (O-09 .. O-12, O-68).

Copies run inside Spark tasks (``mapInPandas``).  A task can be retried
after an executor loss, so every put is idempotent: the content is written
to a temporary name next to the destination and renamed into place; an
existing destination is success without copying.  The per-item results are
returned as a DataFrame; callers persist them once (``write_results``) and
read them back instead of recomputing the side effects.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import balance_by_size, tasks_for_bytes
from ..session import local_fs_path, shared_path
from ..sources.listings import store_from_listing
from ..sources.storage import read_range
from .blobs import put_blobs, stored_blobs

RESULT_SCHEMA = ("path string, dest string, hash string, status string, tries int, "
                 "bytes long, error string")

# Fixed values (transfer thresholds and settings of the object-store client).
LARGE_TRANSFER_BYTES = 100 * 1024 * 1024
LARGE_FILE_BYTES = 1024 * 1024 * 1024
LARGE_FILE_BYTES_P = 65 * 1024 * 1024
CONCURRENCY_LARGE, CONCURRENCY_SMALL = 8, 4
BLOCK_LARGE, BLOCK_SMALL = 8 * 1024 * 1024, 4 * 1024 * 1024
METADATA_TIER = "Cold"
VALID_TIERS = ("Hot", "Cool", "Cold", "Archive")


def _put_one(src: str | None, payload: bytes | None, dest: str, on_exists: str) -> tuple[str, int, str | None]:
    try:
        exists = os.path.exists(dest)
        if exists and on_exists == "skip":
            return "exists", 0, None
        os.makedirs(os.path.dirname(dest) or ".", exist_ok=True)
        tmp = f"{dest}.tmp-{uuid.uuid4().hex}"
        if payload is not None:
            with open(tmp, "wb") as fh:
                fh.write(payload)
            n = len(payload)
        else:
            n = 0
            with open(src, "rb") as fin, open(tmp, "wb") as fout:
                while True:
                    block = fin.read(4 * 1024 * 1024)
                    if not block:
                        break
                    fout.write(block)
                    n += len(block)
        os.replace(tmp, dest)
        return ("overwritten" if exists else "copied"), n, None
    except OSError as e:
        return "failed", 0, f"{type(e).__name__}: {e}"


def copy_to_store(queue: DataFrame, store_root: str, on_exists: str = "skip",
                  content_col: str | None = None,
                  target_bytes: int | None = 256 * 1024 * 1024,
                  large_bytes: int = LARGE_TRANSFER_BYTES) -> DataFrame:
    """O-09 / O-11: put every queue row into ``store_root/dest``.

    ``queue`` has ``path, dest, hash[, size][, try_count]`` and, for table
    payloads, ``content_col``, which are put where they are.  Files with known
    sizes are dealt over tasks by bytes (``target_bytes`` per task), and files above ``large_bytes`` go
    block by block over many tasks (``copy_in_blocks``).  Status: copied |
    exists | overwritten | failed."""
    root = local_fs_path(store_root).rstrip("/")
    if "size" in queue.columns and not content_col:
        large = queue.filter(F.col("size") > large_bytes)
        if not large.isEmpty():
            rest = queue.filter(F.coalesce(F.col("size") <= large_bytes, F.lit(True)))
            return copy_to_store(rest, store_root, on_exists, None, target_bytes, 1 << 62).unionByName(
                copy_in_blocks(large, store_root, on_exists, target_bytes or BLOCK_LARGE))
    if target_bytes and "size" in queue.columns and not content_col:
        queue = balance_by_size(queue, target_bytes)
    cols = ["path", "dest", "hash"] + (["try_count"] if "try_count" in queue.columns else [])
    if content_col:
        cols.append(content_col)
    q = queue.select(*cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                payload = None
                if content_col:
                    v = rec[content_col]
                    payload = v.encode("utf-8") if isinstance(v, str) else bytes(v or b"")
                status, n, err = _put_one(rec["path"], payload, f"{root}/{rec['dest']}", on_exists)
                tries = int(rec.get("try_count") or 0) + 1
                rows.append((rec["path"], rec["dest"], rec["hash"], status, tries, n, err))
            yield pd.DataFrame(rows, columns=["path", "dest", "hash", "status", "tries", "bytes", "error"])

    return q.mapInPandas(run, RESULT_SCHEMA)


def copy_in_blocks(queue: DataFrame, store_root: str, on_exists: str = "skip",
                   target_bytes: int = 256 * 1024 * 1024, block_bytes: int = BLOCK_LARGE) -> DataFrame:
    """Put large files block by block, many tasks to a file.

    The blocks of a file are written at their places in one temporary file
    next to the destination, in any order and any number of times; what
    became of them is written once.  Then a task per file renames it into
    place if every block is there and its length is right, and removes it
    otherwise: a reader never sees part of a file."""
    root, run = local_fs_path(store_root).rstrip("/"), uuid.uuid4().hex
    tries = F.coalesce(F.col("try_count"), F.lit(0)) if "try_count" in queue.columns else F.lit(0)
    files = queue.select("path", "dest", "hash", "size", (tries + 1).cast("int").alias("tries"))
    total = files.agg(F.sum("size")).first()[0] or 0
    n = F.expr(f"cast((size + {block_bytes - 1}) div {block_bytes} as int)")
    blocks = (files.withColumn("block", F.explode(F.sequence(F.lit(0), n - 1)))
              .repartition(tasks_for_bytes(total, target_bytes), "path", "block"))

    def write_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                dest, error = f"{root}/{rec['dest']}", None
                try:
                    if on_exists != "skip" or not os.path.exists(dest):
                        os.makedirs(os.path.dirname(dest) or ".", exist_ok=True)
                        start = rec["block"] * block_bytes
                        data = read_range(rec["path"], start, min(block_bytes, rec["size"] - start))
                        fh = os.open(f"{dest}.tmp-{run}", os.O_CREAT | os.O_WRONLY, 0o644)
                        try:
                            at = 0
                            while at < len(data):
                                at += os.pwrite(fh, data[at:], start + at)
                        finally:
                            os.close(fh)
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((rec["path"], rec["dest"], rec["hash"], rec["size"], rec["tries"], error))
            yield pd.DataFrame(rows, columns=["path", "dest", "hash", "size", "tries", "error"])

    path = shared_path(queue.sparkSession, "blocks")
    done = write_results(blocks.mapInPandas(
        write_blocks, "path string, dest string, hash string, size long, tries int, error string"), path)
    whole = done.groupBy("path", "dest", "hash", "size", "tries").agg(F.max("error").alias("error"))

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                dest = f"{root}/{rec['dest']}"
                tmp, error, n_bytes = f"{dest}.tmp-{run}", rec["error"], 0
                try:
                    there = os.path.exists(dest)
                    if error is None and os.path.exists(tmp):
                        if os.path.getsize(tmp) != rec["size"]:
                            raise OSError(f"{dest}: {os.path.getsize(tmp)} of {rec['size']} bytes written")
                        os.replace(tmp, dest)
                        status, n_bytes = "overwritten" if there else "copied", rec["size"]
                    elif error is None:
                        status = "exists" if there else "failed"
                    else:
                        status = "failed"
                        if os.path.exists(tmp):
                            os.remove(tmp)
                except OSError as e:
                    status, error = "failed", f"{type(e).__name__}: {e}"
                rows.append((rec["path"], rec["dest"], rec["hash"], status, rec["tries"], n_bytes, error))
            yield pd.DataFrame(rows, columns=["path", "dest", "hash", "status", "tries", "bytes", "error"])

    return whole.mapInPandas(show, RESULT_SCHEMA)


def write_results(results: DataFrame, path: str) -> DataFrame:
    """Persist put results once, then re-read them (side effects are not
    re-run by later actions)."""
    results.write.mode("errorifexists").parquet(path)
    return results.sparkSession.read.parquet(path)


def put_outcome(queue: DataFrame, listing: DataFrame, on_exists: str = "skip") -> DataFrame:
    """O-11 decided up front: ``exists`` when the destination is already
    listed (skip policy), else ``copied``; the overwrite policy always
    copies (``overwritten`` when it was present)."""
    present = listing.select(F.col("path").alias("dest")).distinct().withColumn("_present", F.lit(True))
    j = queue.join(present, "dest", "left")
    here = F.coalesce(F.col("_present"), F.lit(False))
    if on_exists == "skip":
        outcome = F.when(here, "exists").otherwise("copied")
    else:
        outcome = F.when(here, "overwritten").otherwise("copied")
    return j.select("path", "dest", outcome.alias("outcome"))


def transfer_plan(queue: DataFrame, is_metadata: bool = False, variant: str = "C",
                  tier: str | None = None) -> DataFrame:
    """O-12: per-item transfer class (concurrency, block size), access tier
    and the large-file flag.  Thresholds are module constants."""
    big = F.col("size") > F.lit(LARGE_TRANSFER_BYTES)
    if variant.upper() == "P":
        if tier is not None:
            known = {t.casefold(): t for t in VALID_TIERS}
            if tier.strip().casefold() not in known:
                raise ValueError(f"invalid storage tier {tier!r}")
            tier = known[tier.strip().casefold()]
        tier_col = F.lit(tier)
        large = F.col("size") > F.lit(LARGE_FILE_BYTES_P)
    else:
        tier_col = F.lit(METADATA_TIER) if is_metadata else F.lit(None).cast("string")
        large = F.col("size") > F.lit(LARGE_FILE_BYTES)
    return queue.select(
        "path", "size",
        F.when(big, CONCURRENCY_LARGE).otherwise(CONCURRENCY_SMALL).alias("concurrency"),
        F.when(big, BLOCK_LARGE).otherwise(BLOCK_SMALL).alias("block_bytes"),
        tier_col.alias("tier"), large.alias("is_large"))


def blob_append_set(queue_with_content: DataFrame, store: DataFrame, shard_depth: int = 1) -> DataFrame:
    """O-10 rows: queue items whose ``(hash, size)`` the store lacks,
    with their shard key."""
    missing = queue_with_content.join(store.select("hash", "size"), ["hash", "size"], "left_anti")
    return missing.withColumn("shard", F.substring("hash", 1, shard_depth))


class Store:
    """O-68: a content store lists its index, ``(hash, size)``, and puts queue
    rows ``path, dest, hash, size[, try_count]``, with their payload in
    ``content_col`` or in the file ``path``; put results have the columns of
    ``RESULT_SCHEMA``, one row per queue row."""

    def list(self) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError

    def put(self, queue: DataFrame, content_col: str | None = None) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError


class DirectoryStore(Store):
    """Files named ``<hash><ext>`` below sharded directories, any Hadoop
    path readable by Spark; puts go through ``copy_to_store``."""

    def __init__(self, spark: SparkSession, root: str, on_exists: str = "skip"):
        self.spark, self.root, self.on_exists = spark, root, on_exists

    def list(self) -> DataFrame:
        """Distributed listing through the inventory source (the driver only
        expands the top shard directories; tasks walk the rest), so a store
        with billions of objects never lands in a driver-side file index.
        Manifests (``metadata/``) and leftovers of interrupted puts are not
        content."""
        from ..sources import inventory as INV
        root = local_fs_path(self.root).rstrip("/")
        if not os.path.exists(root):
            return self.spark.createDataFrame([], "hash string, size long")
        scan = INV.files_only(INV.inventory(self.spark, [root]))
        rel = (scan.filter(~F.col("name").contains(".tmp-"))
               .select(F.expr(f"substring(path, {len(root) + 2})").alias("path"), "size"))
        return store_from_listing(rel, exclude_prefix="metadata/")

    def put(self, queue: DataFrame, content_col: str | None = None) -> DataFrame:
        return copy_to_store(queue, self.root, self.on_exists, content_col)


class BlobTableStore(Store):
    """Payloads as rows of a table that grows by commits (``blobs``), on any
    file system Spark and Arrow both reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def list(self) -> DataFrame:
        return stored_blobs(self.spark, self.path)

    def put(self, queue: DataFrame, content_col: str | None = None) -> DataFrame:
        """Payloads come from ``content_col``, or from the files named in
        ``path``; rows without a path are known by hash and extension."""
        if content_col and content_col != "content":
            queue = queue.withColumnRenamed(content_col, "content")
        if "path" not in queue.columns:
            name = F.concat("hash", F.coalesce("ext", F.lit(""))) if "ext" in queue.columns else F.col("hash")
            queue = queue.withColumns({"path": name, "dest": name})
        return put_blobs(queue, self.path)


def open_store(spark: SparkSession, kind: str, location: str) -> Store:
    """Select a store by name; unknown names fall back to a directory."""
    if kind.lower() in ("table", "blob", "blobtable"):
        return BlobTableStore(spark, location)
    return DirectoryStore(spark, location)
