"""A snapshot plan over a stream, with state per path that advances (O-65)
and puts that come back after a delay (O-66).

One keyed operator (``transformWithState``) holds what is known of each path:
its digest, the mtime that was digested, the mtime that is safe in the store,
and the put that is not answered yet.  Its key is a bucket of paths, by their
hash: each call of a stateful function costs milliseconds, whatever it does, so
the paths of a bucket share one call, one state row and one timer per batch.
It reads two kinds of rows:

* ``seen``: an inventory row (no payload; a file is read in the task that
  finds its digest stale, and nowhere before),
* ``done``: the outcome of a put, written by this query's own sink.

A row is judged against all rows before it, of this run too.  A put that
succeeded marks its path, a failed one is due again after the delay, told by a
timer of its bucket; then the put goes out again, up to ``max_retries`` times.
A newer put of the path takes the place of one that is due.  State per path is
one entry, whatever the number of rows or attempts of the path.

The outcomes of a micro-batch are written once: after a restart they are
found by the batch id, and nothing is put again; an outcome that is read twice
answers no open put.  Duplicates of a payload are ``exists``
and count as saved.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import paths as FP
from ..functions.digest import SYMLINK_PREFIX, _digest_one
from ..plans.run import _fs
from ..session import has_entries, ship_package
from .stream import state_partitions, use_rocksdb

#: an inventory row; ``scan`` tells rows of one path apart in the output
SEEN = "path string, scan int, size long, mtime long, is_symlink boolean, link_target string"
DONE = "path string, dest string, hash string, mtime long, status string, tries int, bytes long, error string, at_ms long"
EVENT = ("kind string, path string, scan int, size long, mtime long, is_symlink boolean, link_target string, "
         "status string, tries int")
#: what is known of a path: ``due`` is the time in ms when its put goes out again
KNOWN = ("paths array<struct<path:string,st_hash:string,st_hash_mtime:bigint,backup_mtime:bigint,put_hash:string,"
         "put_mtime:bigint,put_size:bigint,put_scan:int,tries:int,due:bigint>>")
PLANNED = ("path string, scan int, size long, mtime long, hash string, stale boolean, upload_required boolean, "
           "action string, tries int")
COLUMNS = [c.split()[0] for c in PLANNED.split(", ")]
#: buckets of paths, unless told; some hundred thousand paths each are still a small state row
BUCKETS = 4096
STATE = "path string, st_hash string, st_hash_mtime long, backup_mtime long"

#: what becomes of a row: planned only, put, put given up, or no digest (O-37)
PLAN, PUT, EXHAUSTED, UNDIGESTED = "plan", "put", "exhausted", "undigested"


PlannedRow = Row(*COLUMNS)


class PathProcessor(StatefulProcessor):
    def __init__(self, max_retries: int, delay_ms: int, digest: Callable[[str], str | None] | None = None):
        self.max_retries, self.delay_ms = max_retries, delay_ms
        self.digest = digest or (lambda path: _digest_one(path, "md5"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", KNOWN)

    def _load(self) -> dict[str, list]:
        """What is known of the bucket's paths."""
        found = self.known.get()
        return {r[0]: list(r)[1:] for r in found[0]} if found else {}

    def _save(self, known: dict[str, list]) -> None:
        self.known.update(([(path, *entry) for path, entry in known.items()],))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._save({r["path"]: [r["st_hash"], r["st_hash_mtime"], r["backup_mtime"]] + [None] * 6
                    for r in initialState.paths})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        answers, seen = {}, {}
        for r in rows:
            if r.kind == "done":
                answers.setdefault(r.path, {})[r.tries] = (r.status, r.mtime)
            else:                                       # of equal scans the newest row counts
                scans = seen.setdefault(r.path, {})
                old = scans.get(r.scan)
                scans[r.scan] = r if old is None or r.mtime >= old.mtime else old
        known, out = self._load(), []
        due = timerValues.getCurrentProcessingTimeInMs() + self.delay_ms
        for path in answers.keys() | seen.keys():
            entry = known.get(path) or [None] * 9
            known[path] = self._judge(path, entry, answers.get(path, {}), seen.get(path, {}), due, out)
        if any(known[path][8] == due for path in answers):
            self.handle.registerTimer(due)
        self._save(known)
        return iter([PlannedRow(*row) for row in out])

    def _judge(self, path: str, entry: list, answers: dict, seen: dict, again: int, out: list[tuple]) -> list:
        """The path's entry after its rows; adds the planned rows to ``out``."""
        st_hash, st_mtime, backup, put_hash, put_mtime, put_size, put_scan, tries, due = entry
        if put_mtime is not None and answers.get(tries, ("", None))[1] == put_mtime:
            if answers[tries][0] != "failed":
                backup, put_mtime, due = put_mtime, None, None
            elif tries > self.max_retries:
                out.append((path, put_scan, put_size, put_mtime, put_hash, False, True, EXHAUSTED, tries))
                put_mtime, due = None, None
            elif due is None:
                due = again
        for scan in sorted(seen):
            r = seen[scan]
            mtime, size, link = r.mtime, r.size, bool(r.is_symlink)
            stale = st_mtime != mtime or not st_hash
            digest = (self.digest(path) if stale else st_hash)
            if not digest:
                out.append((path, scan, size, mtime, None, stale, False, UNDIGESTED, 0))
                continue
            required = backup != mtime
            st_hash, st_mtime = digest, mtime
            action, n = PLAN, 0
            if digest.startswith(SYMLINK_PREFIX) or link:
                backup = mtime
            elif required and size > 0 and put_mtime != mtime:
                put_hash, put_mtime, put_size, put_scan, tries, due = digest, mtime, size, scan, 1, None
                action, n = PUT, 1
            out.append((path, scan, size, mtime, digest, stale, required, action, n))
        return [st_hash, st_mtime, backup, put_hash, put_mtime, put_size, put_scan, tries, due]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, known, out = expiredTimerInfo.getExpiryTimeInMs(), self._load(), []
        for path, s in known.items():
            if s[8] is not None and s[8] <= now:        # still not saved, and not replaced by a newer put
                s[7], s[8] = s[7] + 1, None
                out.append((path, s[6], s[5], s[4], s[3], False, True, PUT, s[7]))
        self._save(known)
        return iter([PlannedRow(*row) for row in out])

    def close(self) -> None:
        pass


def written_once(spark: SparkSession, path: str, rows: Callable[[], DataFrame], schema: str) -> DataFrame:
    """The rows of a folder, written now unless an earlier attempt finished writing them."""
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    if not fs.exists(p):
        rows().write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def snapshot_query(seen: DataFrame, put: Callable[[DataFrame, int], DataFrame], work: str,
                   state: DataFrame | None = None, max_retries: int = 3, delay_s: float = 5.0, depth: int = 3,
                   trigger_s: float = 1.0, partitions: int | None = None, buckets: int = BUCKETS):
    """Start the query over a stream of ``SEEN`` rows; returns it running.

    ``put(queue, batch_id)`` puts ``path, dest, hash, size, try_count`` rows
    and returns the results of ``store.RESULT_SCHEMA``; it may be called
    again with the same batch after a restart.  Below ``work``: ``planned``
    and ``results`` (one folder per batch), ``checkpoint``.  ``state``
    (``STATE``, one row per path) is what is known before the first batch.
    ``buckets`` and ``partitions`` are fixed for a checkpoint's lifetime.
    """
    spark = seen.sparkSession
    ship_package(spark)
    use_rocksdb(spark)
    work = work.rstrip("/")
    fs, p = _fs(spark, f"{work}/results")
    fs.mkdirs(p)
    done = (spark.readStream.schema(DONE).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
            .parquet(f"{work}/results"))
    none = F.lit(None)
    events = seen.select(F.lit("seen").alias("kind"), "path", "scan", "size", "mtime", "is_symlink", "link_target",
                         none.cast("string").alias("status"), none.cast("int").alias("tries")).unionByName(
        done.select(F.lit("done").alias("kind"), "path", none.cast("int").alias("scan"), none.cast("long").alias("size"),
                    "mtime", none.cast("boolean").alias("is_symlink"), none.cast("string").alias("link_target"),
                    "status", "tries"))
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")
    known = None
    if state is not None:
        each_path = state.select(bucket, F.struct("path", "st_hash", "st_hash_mtime", "backup_mtime").alias("p"))
        known = each_path.groupBy("bucket").agg(F.collect_list("p").alias("paths")).groupBy("bucket")
    planned = events.select(bucket, "*").groupBy("bucket").transformWithState(
        PathProcessor(max_retries, int(delay_s * 1000)), PLANNED, "Append", "ProcessingTime", initialState=known)

    def each(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch is planned again, as its state was not committed; what it has put is not put again
        path = f"{work}/planned/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        rows = spark.read.schema(PLANNED).parquet(path)
        queue = rows.filter(F.col("action") == PUT).withColumn("ext", FP.extension(FP.basename("path")))
        if queue.isEmpty():
            return
        queue = queue.select("path", FP.shard_path("hash", "ext", depth).alias("dest"), "hash", "size", "mtime",
                             (F.col("tries") - 1).alias("try_count"))

        def results() -> DataFrame:
            # the least path of a digest is put for all of them
            first = queue.groupBy("hash").agg(F.min("path").alias("path"))
            told = put(queue.drop("mtime").join(first, ["hash", "path"], "left_semi"), batch_id).select(
                F.col("path").alias("_put"), "hash", "status", "bytes", "error")
            own = F.col("path") == F.col("_put")
            return queue.join(told, "hash").select(
                "path", "dest", "hash", "mtime",
                F.when(own | (F.col("status") == "failed"), F.col("status")).otherwise("exists").alias("status"),
                (F.col("try_count") + 1).alias("tries"), F.when(own, F.col("bytes")).otherwise(0).alias("bytes"), "error",
                F.unix_millis(F.current_timestamp()).alias("at_ms"))

        written_once(spark, f"{work}/results/batch_id={batch_id}", results, DONE)

    with state_partitions(spark, partitions):
        return (planned.writeStream.foreachBatch(each).outputMode("append")
                .option("checkpointLocation", f"{work}/checkpoint")
                .trigger(processingTime=f"{int(trigger_s * 1000)} milliseconds").start())


def planned_rows(spark: SparkSession, work: str) -> DataFrame:
    path = f"{work.rstrip('/')}/planned"
    return (spark.read.schema(PLANNED + ", batch_id long").parquet(path) if has_entries(spark, path)
            else spark.createDataFrame([], PLANNED + ", batch_id long"))


def put_results(spark: SparkSession, work: str) -> DataFrame:
    path = f"{work.rstrip('/')}/results"
    return (spark.read.schema(DONE + ", batch_id long").parquet(path) if has_entries(spark, path)
            else spark.createDataFrame([], DONE + ", batch_id long"))


def open_puts(spark: SparkSession, work: str, max_retries: int) -> DataFrame:
    """Failed puts that have a try left and were not put again yet."""
    results, puts = put_results(spark, work), planned_rows(spark, work).filter(F.col("action") == PUT)
    failed = results.filter((F.col("status") == "failed") & (F.col("tries") <= max_retries)).select(
        "path", "mtime", (F.col("tries") + 1).alias("tries"))
    return failed.join(puts.select("path", "mtime", "tries"), ["path", "mtime", "tries"], "left_anti")


def run_until_done(query, spark: SparkSession, work: str, max_retries: int, timeout_s: float = 3600.0) -> None:
    """Let a started query read all there is and put what can be put, then stop it."""
    end = time.monotonic() + timeout_s
    idle, last = 0, -1
    try:
        while time.monotonic() < end:
            if query.awaitTermination(0.5):
                raise query.exception() or RuntimeError("the query ended by itself")
            progress = query.lastProgress
            if progress is None or progress["batchId"] == last:
                continue
            last = progress["batchId"]
            idle = idle + 1 if progress["numInputRows"] == 0 else 0
            if idle >= 2 and open_puts(spark, work, max_retries).isEmpty():
                return
        raise TimeoutError(f"still running after {timeout_s} s")
    finally:
        query.stop()
