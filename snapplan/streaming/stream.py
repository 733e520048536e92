"""Structured Streaming forms of the plan (O-64 .. O-67).

The pipelined variant indexes and uploads at the same time; here each
micro-batch of inventory rows is planned, deduplicated against everything
already stored and appended, under a checkpoint, so a restarted query
resumes where it stopped.  Sinks are idempotent per batch id (a replayed
batch overwrites its own output folder) and by content address.

No event-time semantics exist in the reference, so there are no
watermarks: the dedup state lives for the whole run (RocksDB state store
recommended, set by ``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import blob_append_set
from ..plans import snapshot as S
from ..session import cut_lineage, has_entries
from ..sources import state as SS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Large, ever-growing dedup state belongs in RocksDB, not the JVM heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def write_batches(df: DataFrame, path: str, order_expr, n_batches: int) -> list[str]:
    """Split a table into ``n_batches`` parquet folders by value ranges of a
    numeric ``order_expr`` (as if the rows arrived over time).  Only the
    min and max reach the driver."""
    k = F.col(order_expr) if isinstance(order_expr, str) else order_expr
    lo, hi = df.agg(F.min(k), F.max(k)).first()
    width = (float(hi) - float(lo) + 1.0) / n_batches
    ranged = df.withColumn("_b", F.floor((k - F.lit(lo)) / F.lit(width)).cast("int"))
    names = []
    for b in range(n_batches):
        p = f"{path.rstrip('/')}/batch={b:05d}"
        ranged.filter(F.col("_b") == b).drop("_b").write.mode("errorifexists").parquet(p)
        names.append(p)
    return names


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = 1) -> DataFrame:
    """``files_per_trigger`` None: all files that have come are one micro-batch."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def arrivals(spark: SparkSession, folders: list[str], schema) -> Iterator[DataFrame]:
    """The stream over the folders of ``write_batches``, once per folder: the
    folders up to it have come, those after it have not.

    A query that is run to its end on each of them, under one checkpoint, takes
    every folder as one micro-batch, in order, however many files it has.  Taken
    by files, a folder's rows would be split, in an order that is not theirs."""
    top = folders[0].rpartition("/")[0]
    names = [f.rpartition("/")[2] for f in folders]
    for n in range(1, len(names) + 1):
        yield read_stream(spark, f"{top}/{{{','.join(names[:n])}}}", schema, None)


# --------------------------------------------------------------------------
# O-64: dedup by hash for the whole run
# --------------------------------------------------------------------------

def stream_dedup(sdf: DataFrame, key: str = "hash") -> DataFrame:
    return sdf.dropDuplicates([key])


class state_partitions:
    """Number of state-store partitions for queries started inside the
    block (fixed for a checkpoint's lifetime; AQE does not coalesce
    stateful operators).  None keeps the session setting."""

    def __init__(self, spark: SparkSession, n: int | None):
        self.spark, self.n, self.old = spark, n, None

    def __enter__(self):
        if self.n:
            self.old = self.spark.conf.get("spark.sql.shuffle.partitions")
            self.spark.conf.set("spark.sql.shuffle.partitions", str(self.n))
        return self

    def __exit__(self, *exc):
        if self.n and self.old is not None:
            self.spark.conf.set("spark.sql.shuffle.partitions", self.old)
        return False


def run_to_parquet(sdf: DataFrame, out: str, checkpoint: str, mode: str = "append",
                   partitions: int | None = None) -> None:
    with state_partitions(sdf.sparkSession, partitions):
        q = (sdf.writeStream.format("parquet").outputMode(mode).option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()


# --------------------------------------------------------------------------
# O-65: streaming plan + sink
# --------------------------------------------------------------------------

def stream_plan(sdf: DataFrame, state: DataFrame, blob_table: str, results_dir: str,
                checkpoint: str, mode: str = "safe", order=("path",),
                state_updates_dir: str | None = None) -> None:
    """Each micro-batch: plan against the stored state, compare with the
    blob table as committed by earlier batches, append the missing blobs,
    record per-file results and (``state_updates_dir``) the state updates
    (O-15), each under ``batch_id=<id>`` so a replay overwrites its own
    output.  ``state`` is read again in each micro-batch: pass a written
    table, not one that is computed.

    The plan knows a payload by its digest only and is written once; payloads
    cross one exchange, to the planned rows whose blobs are missing."""
    spark = sdf.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        # the store as committed by earlier batches only: a replay of this
        # batch must not see its own partial output (it would then append
        # less and overwrite its folder with fewer blobs)
        if has_entries(spark, blob_table):
            store = (spark.read.parquet(blob_table).filter(F.col("batch_id") < batch_id)
                     .select("hash", "size").distinct())
        else:
            store = spark.createDataFrame([], "hash string, size long")
        opts = S.PlanOptions(mode=mode, order=tuple(order), keep_extra=("_payload",))
        # a path may come twice in a batch, and a stored digest need not be that of the payload
        rows = batch.withColumn("_payload", F.coalesce(F.md5("content"), F.lit("")))
        planned = cut_lineage(S.plan(rows, state, store if mode == "safe" else None, opts))
        queue = planned.filter("queued").select("path", "_payload", "hash", "size", "ext")
        missing = blob_append_set(queue, store).dropDuplicates(["hash"])
        key = ["path", "_payload"]
        blobs = rows.select(*key, "content").join(missing.hint("merge"), key).dropDuplicates([*key, "hash"])
        out = f"{blob_table.rstrip('/')}/batch_id={batch_id}"
        blobs.select("hash", "size", "ext", "content", "shard").write.mode("overwrite").parquet(out)
        res = planned.select("path", "hash", "size", "queued", "upload_required",
                             F.lit(batch_id).alias("batch_id"))
        res.write.mode("overwrite").parquet(f"{results_dir.rstrip('/')}/batch_id={batch_id}")
        if state_updates_dir:
            (SS.state_updates(planned).write.mode("overwrite")
             .parquet(f"{state_updates_dir.rstrip('/')}/batch_id={batch_id}"))

    q = (sdf.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def state_after_stream(spark: SparkSession, base_state: DataFrame, state_updates_dir: str) -> DataFrame:
    """Base state with every batch's updates applied in batch order (the
    latest non-null value per path and attribute wins)."""
    if not has_entries(spark, state_updates_dir):
        return base_state
    ups = spark.read.parquet(state_updates_dir)
    last = ups.groupBy("path").agg(
        F.max_by("new_hash", F.when(F.col("new_hash").isNotNull(), F.col("batch_id"))).alias("new_hash"),
        F.max_by("new_hash_mtime", F.when(F.col("new_hash_mtime").isNotNull(), F.col("batch_id"))).alias("new_hash_mtime"),
        F.max_by("new_backup_mtime", F.when(F.col("new_backup_mtime").isNotNull(), F.col("batch_id")))
        .alias("new_backup_mtime"),
        F.max_by("clear_backup", F.col("batch_id")).alias("clear_backup"))
    return SS.merge_state(base_state, last)


# --------------------------------------------------------------------------
# O-66: retries as a stateful operator
# --------------------------------------------------------------------------

RETRY_OUT = "job int, item string, status string, tries int, event_id long, bytes long"
#: what is known of a bucket's items, as an Arrow stream of ``RETRY_KNOWN``
RETRY_STATE = "known binary"
RETRY_KNOWN = ["job", "item", "tries", "done"]
#: buckets of items, unless told; each call of the stateful function costs milliseconds, whatever it does
RETRY_BUCKETS = 1024


def _retry_fn(max_retries: int):
    limit = max_retries + 1
    keys = ["job", "item"]

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # only the first ``limit`` attempts of an item (by ts, event_id) can
        # change its outcome: keep a running selection of these over the
        # chunks, never the whole group
        best = None
        for pdf in pdfs:
            if pdf.empty:
                continue
            rows = pdf if best is None else pd.concat([best, pdf])
            best = rows.sort_values(["ts", "event_id"]).groupby(keys, sort=False, dropna=False).head(limit)
        if best is None:
            return
        known = None
        if state.exists:
            known = pa.ipc.open_stream(bytes(state.get[0])).read_pandas()
            best = best.merge(known, "left", keys)
        else:
            best = best.assign(tries=0, done=False)
        best["tries"] = best["tries"].fillna(0).astype("int32")
        best = best[~best["done"].eq(True)].copy()
        best["tries"] += best.groupby(keys, sort=False, dropna=False).cumcount().astype("int32") + 1
        best["ok"] = best["ok"].eq(True)
        before = best["ok"].astype("int32").groupby([best[k] for k in keys], sort=False, dropna=False).cumsum() - best["ok"]
        best = best[(best["tries"] <= limit) & (before == 0)]
        if best.empty:
            return
        best["done"] = best["ok"] | (best["tries"] >= limit)
        now = best[RETRY_KNOWN].drop_duplicates(keys, keep="last")
        if known is not None:
            now = pd.concat([known, now]).drop_duplicates(keys, keep="last")
        table = pa.Table.from_pandas(now, pa.schema([("job", pa.int32()), ("item", pa.string()), ("tries", pa.int32()),
                                                     ("done", pa.bool_())]), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        status = np.where(best["ok"], "saved", np.where(best["done"], "exhausted", "retry"))
        yield best.assign(status=status, bytes=best["bytes"].astype("Int64").where(best["ok"]))[
            ["job", "item", "status", "tries", "event_id", "bytes"]]

    return fn


def stream_retry(attempts_sdf: DataFrame, max_retries: int = 3, buckets: int = RETRY_BUCKETS) -> DataFrame:
    """Per item: each failed attempt is emitted as ``retry`` with its try
    number until ``max_retries`` retries are used (``exhausted``) or an
    attempt succeeds (``saved``).  State per item: tries and done.

    The key of the stateful function is a bucket of items, by their hash: the
    items of a bucket share one call and one state row per batch.  ``buckets``
    is fixed for a checkpoint's lifetime."""
    bucket = F.pmod(F.xxhash64("job", "item"), F.lit(buckets)).cast("int").alias("_bucket")
    return (attempts_sdf.select(bucket, "job", "item", "ts", "event_id", "ok", "bytes").groupBy("_bucket")
            .applyInPandasWithState(_retry_fn(max_retries), RETRY_OUT, RETRY_STATE, "append",
                                    GroupStateTimeout.NoTimeout))


# --------------------------------------------------------------------------
# O-67: live totals
# --------------------------------------------------------------------------

def stream_totals(attempts_sdf: DataFrame) -> DataFrame:
    """Per job: attempts seen, saved attempts and saved bytes (update or
    complete mode)."""
    return attempts_sdf.groupBy("job").agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.count_if("ok").alias("n_saved"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("bytes"))), F.lit(0)).cast("long").alias("saved_bytes"),
    )


def run_complete_to_parquet(sdf: DataFrame, out: str, checkpoint: str,
                            partitions: int | None = None) -> None:
    """Complete-mode aggregate -> each epoch's full result in its own folder
    (file sinks take append only)."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/epoch={batch_id:08d}")

    with state_partitions(sdf.sparkSession, partitions):
        q = (sdf.writeStream.outputMode("complete").foreachBatch(each)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()


def latest_epoch(spark: SparkSession, out: str) -> DataFrame:
    df = spark.read.parquet(out)
    last = df.agg(F.max("epoch")).first()[0]
    return df.filter(F.col("epoch") == last).drop("epoch")


__all__ = ["stream_dedup", "stream_plan", "stream_retry", "stream_totals", "use_rocksdb",
           "write_batches", "read_stream", "arrivals", "run_to_parquet", "run_complete_to_parquet", "latest_epoch"]


# --------------------------------------------------------------------------
# O-66: delayed retries as a second stream source
# --------------------------------------------------------------------------

RETRY_SCHEMA = "path string, dest string, hash string, size long, try_count int"


def _put_batch(source: str, store_root: str, retry_dir: str, results_dir: str, max_retries: int):
    from ..operators.store import copy_to_store

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        items = batch.select("path", "dest", "hash", "size",
                             F.coalesce(F.col("try_count"), F.lit(0)).cast("int").alias("try_count"))
        out = f"{results_dir.rstrip('/')}/source={source}/batch_id={batch_id}"
        copy_to_store(items, store_root).write.mode("overwrite").parquet(out)   # side effects once
        res = spark.read.parquet(out)
        again = (res.filter((F.col("status") == "failed") & (F.col("tries") <= max_retries))
                 .join(items.drop("try_count"), ["path", "dest", "hash"])
                 .select("path", "dest", "hash", "size", F.col("tries").cast("int").alias("try_count")))
        again.write.mode("overwrite").parquet(f"{retry_dir.rstrip('/')}/from={source}-{batch_id:08d}")

    return each


def stream_put_with_retries(queue_sdf: DataFrame, store_root: str, retry_dir: str, results_dir: str,
                            checkpoint_dir: str, max_retries: int = 3, delay_s: int | None = None,
                            rounds: int | None = None) -> None:
    """Put queue items as they stream in; a failed put goes to ``retry_dir``
    with its try count, which a second stream reads and puts again, until
    ``max_retries`` retries are used.  In production the retry stream runs
    on a ``processingTime`` trigger of ``delay_s`` seconds (the delay before
    a retry); with ``rounds`` it is run that many times with an
    availableNow trigger (tests, batch catch-up)."""
    spark = queue_sdf.sparkSession
    q = (queue_sdf.writeStream.foreachBatch(_put_batch("queue", store_root, retry_dir, results_dir, max_retries))
         .option("checkpointLocation", f"{checkpoint_dir.rstrip('/')}/queue").trigger(availableNow=True).start())
    q.awaitTermination()
    retry_src = (spark.readStream.schema(RETRY_SCHEMA).option("recursiveFileLookup", "true").parquet(retry_dir))
    writer = (retry_src.writeStream.foreachBatch(_put_batch("retry", store_root, retry_dir, results_dir, max_retries))
              .option("checkpointLocation", f"{checkpoint_dir.rstrip('/')}/retry"))
    if rounds is None:
        writer.trigger(processingTime=f"{delay_s or 5} seconds").start()       # runs until stopped
        return
    for _ in range(rounds):
        writer.trigger(availableNow=True).start().awaitTermination()
