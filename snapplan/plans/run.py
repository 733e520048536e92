"""Run to completion (O-62): scan, plan, copy, manifest, state.

Every stage whose recomputation would be wrong or expensive is written once
to the shared folder and read back (the inventory - a directory walk -, the
plan with its digests, the copy results).  An executor lost after a stage
therefore never repeats a walk, a digest pass or a copy; lineage is cut by
written tables, not by local checkpoints.

State snapshots live in ``<state_dir>/snapshot=<id>``; a snapshot counts
only when its ``_SUCCESS`` marker exists, and the latest committed one is
the current state.
"""

from __future__ import annotations

import datetime as dt
import os
import re
import time
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifest as MF
from ..operators.ignore import apply_ignore_fixed
from ..operators.store import DirectoryStore, Store, write_results
from ..session import few_rows, local_fs_path
from ..sources import inventory as INV
from ..sources import state as SS
from ..sources.rounds import inventory_rounds
from ..sources.store_index import StoreIndex
from . import snapshot as S

STATE_SCHEMA = "path string, st_hash string, st_hash_mtime long, backup_mtime long"
#: as stored: digests are shared, backup marks are per job
STORED_SCHEMA = "path string, st_hash string, st_hash_mtime long, marks map<string,bigint>"
COMMITTED = "snapplan.committed"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def latest_snapshot(spark: SparkSession, state_dir: str) -> str | None:
    """Newest committed ``snapshot=<id>`` directory, via the Hadoop FS API."""
    fs, p = _fs(spark, state_dir)
    if not fs.exists(p):
        return None
    best = None
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("snapshot=") and \
                fs.exists(spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            if best is None or name > best[0]:
                best = (name, st.getPath().toString())
    return best[1] if best else None


def stored_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The newest committed snapshot: digests, and each job's backup mark."""
    snap = latest_snapshot(spark, state_dir)
    return spark.read.parquet(snap) if snap else spark.createDataFrame([], STORED_SCHEMA)


def job_state(stored: DataFrame, job: str = "job") -> DataFrame:
    """One job's view of the stored state."""
    return stored.select("path", "st_hash", "st_hash_mtime",
                         F.element_at("marks", F.lit(job)).alias("backup_mtime"))


def read_state(spark: SparkSession, state_dir: str, job: str = "job") -> DataFrame:
    return job_state(stored_state(spark, state_dir), job)


def latest_state_table(spark: SparkSession, prefix: str) -> str | None:
    """Newest committed ``<prefix>_<run id>`` table in the current catalog
    database (run ids hold no underscore)."""
    names = [t.name for t in spark.catalog.listTables()
             if re.fullmatch(re.escape(prefix.lower()) + "_[^_]+", t.name)]
    for name in sorted(names, reverse=True):
        if any(r.key == COMMITTED for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()):
            return name
    return None


def prune_state(stored: DataFrame, scan: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Drop the state of files that a complete scan no longer found, so that
    a path created anew starts without marks.

    Rows stay when their path was seen, when no scanned root holds them, or
    when they lie below a root or directory that raised an issue.
    """
    def below(path: str, top: str):
        """Whether ``path`` is ``top`` or lies below it (both columns)."""
        return F.expr(f"{path} = {top} or startswith({path}, if({top} = '/', '/', concat({top}, '/')))")

    tops = stored.sparkSession.createDataFrame([(os.path.abspath(r),) for r in roots], "top string")
    troubled = scan.filter("issue is not null").select(F.col("dir").alias("top")).distinct()
    seen = scan.filter("issue is null").select("path").distinct().withColumn("_seen", F.lit(True))
    rows = stored.join(seen, "path", "left")
    gone = rows.filter("_seen is null").drop("_seen")
    inside = gone.join(F.broadcast(tops), below("path", "top"), "left_semi")
    # every ancestor of a missing path, to be found among the troubled directories by an equi-join
    parts = F.split("path", "/")
    up = inside.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(
        i == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))).alias("top"))
    kept = up.join(troubled, "top", "left_semi").select("path").distinct()
    lost = inside.select("path").join(kept, "path", "left_anti").distinct()
    return stored.join(lost, "path", "left_anti")


def merge_stored(stored: DataFrame, updates: DataFrame, job: str) -> DataFrame:
    """O-15 on the stored form: digests as in ``merge_state``; the job's mark
    replaced or cleared, other jobs' marks untouched."""
    merged = SS.merge_state(job_state(stored, job), updates)
    others = stored.select("path", F.map_filter("marks", lambda k, _: k != job).alias("_others"))
    mine = F.when(F.col("backup_mtime").isNotNull(), F.create_map(F.lit(job), F.col("backup_mtime")))
    none = F.create_map().cast("map<string,bigint>")
    return merged.join(others, "path", "left").select(
        "path", "st_hash", "st_hash_mtime",
        F.map_concat(F.coalesce("_others", none), F.coalesce(mine, none)).alias("marks"))


def put_until_done(store, queue: DataFrame, work: str, retries: int, delay: float) -> DataFrame:
    """Put a queue; failed items are put again, up to ``retries`` times and
    ``delay`` seconds apart.  Every attempt is written; the result has the
    last one of each item."""
    pending, attempts = queue, None
    for k in range(retries + 1):
        if k:
            time.sleep(delay)
        done = write_results(store.put(pending), f"{work}/results/attempt={k}").withColumn("attempt", F.lit(k))
        attempts = done if attempts is None else attempts.unionByName(done)
        failed = done.filter(F.col("status") == "failed").select("path", "dest")
        if failed.isEmpty():
            break
        pending = queue.join(failed, ["path", "dest"], "left_semi")
    last = attempts.groupBy("path", "dest").agg(F.max_by(F.struct(*attempts.columns), "attempt").alias("r"))
    return last.select("r.*").withColumn("tries", F.col("attempt") + 1).drop("attempt")


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write once to the shared folder and read back (cuts lineage)."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def run_snapshot(spark: SparkSession, roots: Sequence[str], store_root: str, state_dir: str,
                 work_dir: str, ignore: Sequence[str] = (), mode: str = "safe",
                 dry_run: bool = False, job: str = "job", run_id: str | None = None,
                 depth: int = 3, preamble: Sequence[str] = (), state_table: str | None = None,
                 state_buckets: int | None = None, store: Store | None = None, retries: int = 3,
                 delay: float = 5.0, store_index: StoreIndex | None = None, variant: str = "C") -> DataFrame:
    """Plan and execute one snapshot run; returns a one-row summary.

    Variant P lists links without descending them and digests what they lead
    to, skips the fixed junk names as well, clears the marks of what was not
    saved, writes its own manifest form, and ends in an error when a put has
    no try left (its results are written by then).

    With a ``store_index`` the store is listed once, to begin the index;
    later runs compare with the index, and add what they have put.

    State lives in ``state_dir`` snapshot folders, or - with
    ``state_table`` and a persistent catalog - in tables
    ``<state_table>_<run id>`` bucketed by path, so the state join shuffles
    only the inventory side.  Dry run: plans and returns the summary with
    the would-be copies, but writes nothing to the store, the manifest area,
    the work folder or the state (a plan's lineage cut still goes below
    ``spark.checkpoint.dir``)."""
    run_id = run_id or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    work = f"{work_dir.rstrip('/')}/run={run_id}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        """A stage's rows, written once; a dry run leaves nothing in the work folder."""
        return df if dry_run else materialize(df, f"{work}/{name}")

    scan = inventory_rounds(spark, list(roots), list(ignore), follow_links=variant == "C",
                            work=None if dry_run else f"{work}/inventory")
    files = INV.files_only(scan)
    if variant == "P":
        files = apply_ignore_fixed(files)
    if state_table:
        latest = latest_state_table(spark, state_table)
        stored = spark.table(latest) if latest else spark.createDataFrame([], STORED_SCHEMA)
    else:
        stored = stored_state(spark, state_dir)
    stored = prune_state(stored, scan, roots)
    state = job_state(stored, job)
    backend = store or DirectoryStore(spark, store_root)
    listed = None
    if mode == "safe":
        listed = backend.list() if store_index is None else store_index
        if store_index is not None and not store_index.runs():
            if dry_run:
                listed = backend.list()
            else:
                store_index.append(backend.list())
    opts = S.PlanOptions(mode=mode, variant=variant, depth=depth, order=("root_ord", "path"))
    planned = keep(S.plan(files, state, listed, opts), "plan")

    if dry_run:
        return planned.agg(
            F.count(F.lit(1)).alias("n_files"), F.count_if("queued").alias("n_queued"),
            F.lit(0).cast("long").alias("n_copied"), F.lit(0).cast("long").alias("n_exists"),
            F.lit(0).cast("long").alias("n_failed"), F.count_if("repair").alias("n_repaired"),
            F.count_if("queued").alias("dry_run_lines"))

    queue = S.queue(planned)
    results = put_until_done(backend, queue, work, retries, delay)
    if variant == "P":
        lost = results.filter("status = 'failed'").select("path", "error").first()
        if lost:
            raise RuntimeError(f"retries exhausted: {lost.path}: {lost.error}")

    # manifest (text sink, archive layout)
    run_ts = dt.datetime.strptime(run_id[:15], "%Y%m%dT%H%M%S") if run_id[:8].isdigit() else dt.datetime.now()
    lines = MF.manifest_lines(MF.manifest_rows(planned, variant, mtime_unit="us"),
                              MF.manifest_preamble(variant, run_ts, preamble))
    arch = (f"{store_root.rstrip('/')}/metadata/{job}/{run_ts:%Y}/{run_ts:%m}/"
            f"backup_{run_ts:%Y-%m-%d_%H-%M-%S}.csv")
    MF.write_manifest(lines, arch)
    MF.write_manifest_table(planned, f"{work_dir.rstrip('/')}/manifest_table", job, run_ts)

    # state: digests, repairs and successful copies
    saved = results.filter(F.col("status").isin("copied", "exists", "overwritten"))
    saved_paths = saved.select("path")
    if store_index is not None:
        store_index.append(saved.join(queue.select("path", "size"), "path").select("hash", "size"))
    new_state = merge_stored(stored, SS.state_updates(planned, saved_paths, variant), job)
    if state_table:
        buckets = state_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = SS.write_state_bucketed(new_state, f"{state_table.lower()}_{run_id.lower()}", buckets)
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{COMMITTED}' = 'true')")
    else:
        SS.write_state(new_state, state_dir, run_id)

    counts = planned.agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if("queued").alias("n_queued"),
        F.count_if("repair").alias("n_repaired")).first()
    return results.agg(
        F.count_if(F.col("status") == "copied").alias("n_copied"),
        F.count_if(F.col("status") == "exists").alias("n_exists"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
    ).select(
        F.lit(counts.n_files).cast("long").alias("n_files"),
        F.lit(counts.n_queued).cast("long").alias("n_queued"),
        "n_copied", "n_exists", "n_failed",
        F.lit(counts.n_repaired).cast("long").alias("n_repaired"),
    )


# --------------------------------------------------------------------------
# Real files derived from the driver's tables (for scans and runs)
# --------------------------------------------------------------------------

def materialize_files(files: DataFrame, base: str) -> int:
    """Write each fixture file below ``base`` inside Spark tasks: content as
    bytes, mtime set, links as symbolic links (to ``base + link_target``,
    which may dangle).  Returns the number of entries written."""
    root = local_fs_path(base).rstrip("/")

    def run(batches):
        for batch in batches:
            n = 0
            for rec in few_rows(batch):
                dest = root + rec["path"]
                os.makedirs(os.path.dirname(dest), exist_ok=True)
                if os.path.lexists(dest):
                    n += 1
                    continue
                if rec["is_symlink"]:
                    os.symlink(root + rec["link_target"], dest)
                else:
                    tmp = dest + ".part"
                    with open(tmp, "wb") as fh:
                        fh.write((rec["content"] or "").encode("utf-8"))
                    os.utime(tmp, (rec["mtime"], rec["mtime"]))
                    os.replace(tmp, dest)
                n += 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    out = files.select("path", "content", "mtime", "is_symlink", "link_target").mapInArrow(run, "n long")
    return int(out.agg(F.sum("n")).first()[0] or 0)
