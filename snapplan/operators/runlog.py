"""Run log: retries, progress and summaries (O-49, O-53, O-54, O-55).

Input ``attempts(job, item, ts, event_id, ok, bytes)``: one row per copy
attempt.  Attempt order within an item is ``(ts, event_id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encodings import MIB, epoch_micros
from ..session import cut_lineage
from .windows import bucketed_running


def retry_outcome(attempts: DataFrame, max_retries: int = 3, fail_on_exhausted: bool = False) -> DataFrame:
    """O-55: at most ``max_retries + 1`` tries per item; the first success
    ends it.  -> ``job, item, status ('saved'|'exhausted'|'pending'), tries,
    saved_ts, saved_event_id, saved_bytes``.

    ``row_number <= k`` over ``(job, item)`` plans a WindowGroupLimit: every
    map task keeps at most k rows per item before the shuffle, so an item
    with a third of all attempts shuffles k rows per task."""
    limit = max_retries + 1
    w = Window.partitionBy("job", "item").orderBy("ts", "event_id")
    first = (attempts.select("job", "item", "ts", "event_id", "ok", "bytes")
             .withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit))
    agg = first.groupBy("job", "item").agg(
        F.count(F.lit(1)).alias("_tries_seen"),
        F.min(F.when(F.col("ok"), F.struct("n", "ts", "event_id", "bytes"))).alias("_s"),
    )
    status = (F.when(F.col("_s").isNotNull(), "saved")
              .when(F.col("_tries_seen") >= limit, "exhausted").otherwise("pending"))
    if fail_on_exhausted:
        # variant P: an item out of retries stops the run
        status = F.when(status == "exhausted", F.raise_error(
            F.concat(F.lit("retries exhausted: "), F.col("item")))).otherwise(status)
    return agg.select(
        "job", "item", status.alias("status"),
        F.coalesce(F.col("_s.n"), F.col("_tries_seen")).cast("int").alias("tries"),
        F.col("_s.ts").alias("saved_ts"), F.col("_s.event_id").alias("saved_event_id"),
        F.col("_s.bytes").alias("saved_bytes"))


def _job_totals(attempts: DataFrame) -> DataFrame:
    """One pass over the log: per job the queue size (items, and bytes as
    each item's largest attempt) and the first and last attempt time."""
    per_item = attempts.groupBy("job", "item").agg(
        F.max("bytes").alias("size"), F.min(epoch_micros("ts")).alias("_first"),
        F.max(epoch_micros("ts")).alias("_last"))
    return per_item.groupBy("job").agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("size").cast("long").alias("total_bytes"),
        F.min("_first").alias("start_us"), F.max("_last").alias("end_us"))


def progress_reports(attempts: DataFrame, max_retries: int = 3, every: int = 10) -> DataFrame:
    """O-53: after every ``every``-th saved item and when all are saved:
    saved files/bytes, percents, remaining, MB/s and ETA.

    The running count and byte sum per job in success order come from
    ``bucketed_running``, so a job holding a third of all items is still
    spread over many tasks."""
    out = cut_lineage(retry_outcome(attempts, max_retries).filter(F.col("status") == "saved")
                      .select("job", "saved_event_id", "saved_bytes", epoch_micros("saved_ts").alias("_k")))
    tot = _job_totals(attempts).drop("end_us")
    run = (bucketed_running(out, ["job"], "_k", ["saved_event_id"], ["saved_bytes"])
           .withColumnRenamed("run_n", "n").withColumnRenamed("run_saved_bytes", "saved_bytes_cum")
           .join(tot, "job")
           .filter((F.col("n") % every == 0) | (F.col("n") == F.col("total_files"))))
    el = (F.col("_k") - F.col("start_us")) / F.lit(1e6)
    frac = F.col("saved_bytes_cum") / F.col("total_bytes")
    return run.select(
        "job", F.col("n").cast("long").alias("saved_files"), "total_files",
        F.col("saved_bytes_cum").cast("long").alias("saved_bytes"), "total_bytes",
        F.when(F.col("total_files") > 0, F.col("n") * 100.0 / F.col("total_files")).otherwise(0.0).alias("pct_files"),
        F.when(F.col("total_bytes") > 0, F.col("saved_bytes_cum") * 100.0 / F.col("total_bytes"))
        .otherwise(0.0).alias("pct_bytes"),
        (F.col("total_files") - F.col("n")).cast("long").alias("remaining_files"),
        (F.col("total_bytes") - F.col("saved_bytes_cum")).cast("long").alias("remaining_bytes"),
        el.alias("elapsed_s"),
        F.when(el > 0, (F.col("saved_bytes_cum") / F.lit(float(MIB))) / el).otherwise(0.0).alias("mb_per_s"),
        F.when((F.col("saved_bytes_cum") > 0) & (F.col("total_bytes") > 0), el / frac - el)
        .otherwise(0.0).alias("eta_s"),
    )


def digest_progress(digested: DataFrame, every: int = 100, order: str = "path") -> DataFrame:
    """O-54: every ``every``-th digest (in ``order``): count, total, percent."""
    d = digested.select(order)
    total = d.count()
    ranked = bucketed_running(d, [], order, total=total)
    return (ranked.filter(F.col("run_n") % every == 0)
            .select(F.col("run_n").cast("long").alias("n"), F.lit(total).cast("long").alias("total"),
                    (F.col("run_n") * 100.0 / F.lit(total)).alias("pct")))


def run_summary(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """O-49: per job saved vs total files, bytes, MB, duration and mean MB/s
    (0 when nothing was saved)."""
    out = retry_outcome(attempts, max_retries)
    saved = out.groupBy("job").agg(
        F.count_if(F.col("status") == "saved").alias("saved_files"),
        F.coalesce(F.sum(F.when(F.col("status") == "saved", F.col("saved_bytes"))), F.lit(0))
        .cast("long").alias("saved_bytes"))
    tot = _job_totals(attempts).withColumn(
        "duration_s", (F.col("end_us") - F.col("start_us")) / F.lit(1e6)).drop("start_us", "end_us")
    j = saved.join(tot, "job")
    mb = F.col("saved_bytes") / F.lit(float(MIB))
    return j.select(
        "job", "saved_files", "total_files", "saved_bytes", "total_bytes",
        F.round(mb, 2).alias("saved_mb"), "duration_s",
        F.when((F.col("saved_bytes") > 0) & (F.col("duration_s") > 0), mb / F.col("duration_s"))
        .otherwise(0.0).alias("mb_per_s"))
