"""The stream whose state per path advances, and puts that come back after a delay."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import functions as F

from snapplan.operators.blobs import put_blobs, stored_blobs
from snapplan.streaming import snapshot_stream as SN
from snapplan.streaming import stream as ST


def scan_rows(spark, folder, rows, n):
    spark.createDataFrame([(p, n, os.path.getsize(p), m, False, None) for p, m in rows], SN.SEEN).coalesce(1) \
        .write.parquet(f"{folder}/{n}")


def files(tmp_path, k):
    out = []
    for i in range(k):
        f = tmp_path / f"f{i}.txt"
        f.write_text(f"text {i}")
        out.append(str(f))
    return out


def run(spark, tmp_path, put, state=None, max_retries=2, delay_s=0.5):
    seen = ST.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], SN.SEEN).schema, 100)
    q = SN.snapshot_query(seen, put, f"{tmp_path}/work", state, max_retries, delay_s, trigger_s=0.1, partitions=2)
    SN.run_until_done(q, spark, f"{tmp_path}/work", max_retries, timeout_s=180)


def test_state_advances_and_survives_a_restart(spark, tmp_path):
    paths = files(tmp_path, 4)
    table = f"{tmp_path}/blobs"
    h = [hashlib.md5(open(p, "rb").read()).hexdigest() for p in paths]
    state = spark.createDataFrame([(paths[0], h[0], 10, 10), (paths[1], h[1], 10, None)], SN.STATE)
    put = lambda queue, i: put_blobs(queue, table, commit=f"batch-{i}")
    scan_rows(spark, f"{tmp_path}/in", [(p, 10) for p in paths], 1)
    run(spark, tmp_path, put, state)
    scan_rows(spark, f"{tmp_path}/in", [(paths[0], 10), (paths[2], 10), (paths[3], 20)], 2)
    run(spark, tmp_path, put, state)                                  # the same checkpoint: goes on where it was
    got = {(r.path, r.scan): (r.stale, r.upload_required, r.action) for r in SN.planned_rows(spark, f"{tmp_path}/work").collect()}
    assert got == {(paths[0], 1): (False, False, "plan"), (paths[1], 1): (False, True, "put"),
                   (paths[2], 1): (True, True, "put"), (paths[3], 1): (True, True, "put"),
                   (paths[0], 2): (False, False, "plan"), (paths[2], 2): (False, False, "plan"),
                   (paths[3], 2): (True, True, "put")}
    status = sorted((r.path, r.mtime, r.status) for r in SN.put_results(spark, f"{tmp_path}/work").collect())
    assert status == [(paths[1], 10, "copied"), (paths[2], 10, "copied"), (paths[3], 10, "copied"), (paths[3], 20, "exists")]
    assert {r.hash for r in stored_blobs(spark, table).collect()} == set(h[1:])


def test_failed_puts_wait_and_end(spark, tmp_path):
    """f0 is saved at once, f1 at its third try, f2 never; a vanished file is reported, a hot path answered once."""
    paths = files(tmp_path, 4)
    needs = {paths[0]: 0, paths[1]: 2, paths[2]: 9}
    scan_rows(spark, f"{tmp_path}/in", [(paths[0], 1)] * 200 + [(p, 1) for p in paths], 1)
    os.remove(paths[3])

    def put(queue, batch_id):
        limit = F.create_map(*(x for p, n in needs.items() for x in (F.lit(p), F.lit(n))))
        bad = F.col("try_count") < F.element_at(limit, F.col("path"))
        return queue.select("path", "dest", "hash", F.when(bad, "failed").otherwise("copied").alias("status"),
                            (F.col("try_count") + 1).alias("tries"), F.col("size").alias("bytes"),
                            F.when(bad, "no").alias("error"))

    run(spark, tmp_path, put)
    rows = SN.put_results(spark, f"{tmp_path}/work").orderBy("path", "tries").collect()
    assert [(r.path, r.tries, r.status) for r in rows] == [
        (paths[0], 1, "copied"), (paths[1], 1, "failed"), (paths[1], 2, "failed"), (paths[1], 3, "copied"),
        (paths[2], 1, "failed"), (paths[2], 2, "failed"), (paths[2], 3, "failed")]
    for a, b in zip(rows, rows[1:], strict=False):
        assert a.path != b.path or b.at_ms - a.at_ms >= 500
    ends = {(r.path, r.action) for r in SN.planned_rows(spark, f"{tmp_path}/work").filter("action in ('exhausted', 'undigested')").collect()}
    assert ends == {(paths[2], "exhausted"), (paths[3], "undigested")}


def test_a_batch_is_written_once(spark, tmp_path):
    calls = []

    def rows():
        calls.append(1)
        return spark.range(3).selectExpr("cast(id as string) as path")

    for _ in range(2):
        assert SN.written_once(spark, f"{tmp_path}/b", rows, "path string").count() == 3
    assert len(calls) == 1


def test_payloads_are_in_no_exchange():
    assert "content" not in SN.EVENT and "content" not in SN.PLANNED


def test_paths_share_a_call_of_the_stateful_function(spark, tmp_path):
    """A call costs the same for one path as for many: paths of a bucket come in one, and keep their own state."""
    paths = files(tmp_path, 6)
    fails = {p: i % 3 for i, p in enumerate(paths)}
    scan_rows(spark, f"{tmp_path}/in", [(p, 1) for p in paths], 1)
    known = spark.createDataFrame([(paths[0], hashlib.md5(b"text 0").hexdigest(), 1, 1)], SN.STATE)

    def put(queue, batch_id):
        limit = F.create_map(*(x for p, n in fails.items() for x in (F.lit(p), F.lit(n))))
        bad = F.col("try_count") < F.element_at(limit, F.col("path"))
        return queue.select("path", "dest", "hash", F.when(bad, "failed").otherwise("copied").alias("status"),
                            (F.col("try_count") + 1).alias("tries"), F.col("size").alias("bytes"),
                            F.lit(None).cast("string").alias("error"))

    seen = ST.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], SN.SEEN).schema, 100)
    q = SN.snapshot_query(seen, put, f"{tmp_path}/work", known, 2, 0.5, trigger_s=0.1, partitions=2, buckets=1)
    try:
        SN.run_until_done(q, spark, f"{tmp_path}/work", 2, timeout_s=120)
        states = sum(p["stateOperators"][0]["numRowsUpdated"] > 2 for p in q.recentProgress if p["stateOperators"])
    finally:
        q.stop()
    assert states == 0                                   # one row of the bucket and its timer, for all six paths
    got = {r.path: r.n for r in SN.put_results(spark, f"{tmp_path}/work").groupBy("path").agg(F.max("tries").alias("n")).collect()}
    assert got == {p: fails[p] + 1 for p in paths[1:]}
