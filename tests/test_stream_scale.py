"""Streams over folders of many files, with state by buckets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from snapplan.fixtures import Fixtures
from snapplan.operators import runlog as RL
from snapplan.streaming import stream as ST

SF001 = "/root/testdata/sf0.001"
ATTEMPTS = "job int, item string, ts timestamp, event_id long, ok boolean, bytes long"


@pytest.fixture
def a_task_per_file(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_stream_retry_takes_a_folder_of_many_files_at_once(spark, tmp_path, a_task_per_file):
    events = Fixtures(spark, SF001).table("events")
    events.repartition(6, F.hash("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    st = E.queries()["stream_retry"](spark, str(tmp_path))
    final = {(r.job, r.item): (r.status, r.tries, r.event_id if r.status == "saved" else None)
             for r in st.filter("status != 'retry'").collect()}
    batch = RL.retry_outcome(Fixtures(spark, SF001).attempts, max_retries=1).collect()
    assert final == {(r.job, r.item): (r.status, r.tries, r.saved_event_id) for r in batch if r.status != "pending"}


def plain(batches, max_retries):
    """The rule, attempt by attempt."""
    tries, done, out = {}, set(), []
    for rows in batches:
        for job, item, _, event, ok, size in sorted(rows, key=lambda r: (r[2], r[3])):
            if (job, item) in done:
                continue
            n = tries[job, item] = tries.get((job, item), 0) + 1
            status = "saved" if ok else "exhausted" if n > max_retries else "retry"
            if status != "retry":
                done.add((job, item))
            out.append((job, item, status, n, event, size if status == "saved" else None))
    return out


def key(row):
    return tuple(str(x) for x in row)


def test_stream_retry_equals_the_rule_and_keeps_few_state_rows(spark, tmp_path):
    rng, t0, big = random.Random(3), dt.datetime(2024, 1, 1), (1 << 60) + 1
    batches = []
    for b in range(3):
        rows = [(rng.choice([1, 2, None]), rng.choice([None, f"i{rng.randrange(1500)}"]) if rng.random() < 0.02 else
                 f"i{rng.randrange(1500)}", t0 + dt.timedelta(seconds=1000 * b + rng.randrange(50)), 100_000 * b + i,
                 rng.choice([True, False, False, None]), big if i % 7 == 0 else i) for i in range(4000)]
        # one item has more attempts than a chunk of a group, and the first of them last
        rows += [(3, "hot", t0 + dt.timedelta(seconds=1000 * b, microseconds=30_000 - i), 100_000 * b + 5000 + i, False, 1)
                 for i in range(12_000)]
        batches.append(rows)
        spark.createDataFrame(rows, ATTEMPTS).repartition(3).write.parquet(f"{tmp_path}/in/batch={b:05d}")
    names, out, ck = [f"{tmp_path}/in/batch={b:05d}" for b in range(3)], f"{tmp_path}/out", f"{tmp_path}/ck"
    schema = spark.createDataFrame([], ATTEMPTS).schema
    for sdf in ST.arrivals(spark, names, schema):
        ST.run_to_parquet(ST.stream_retry(sdf, max_retries=3, buckets=40), out, ck, partitions=4)
    got = [tuple(r) for r in spark.read.parquet(out).select("job", "item", "status", "tries", "event_id", "bytes").collect()]
    assert sorted(got, key=key) == sorted(plain(batches, 3), key=key)
    assert spark.read.format("statestore").load(ck).count() <= 40


def test_stream_plan_takes_a_folder_of_many_files_at_once(spark, tmp_path, a_task_per_file):
    import duckdb
    sf = "/root/testdata/sf0.01"
    documents = Fixtures(spark, sf).table("documents")
    documents.repartition(6, F.hash("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    got = E.queries()["stream_plan"](spark, str(tmp_path)).select("path", "hash", "size", "queued", "upload_required")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = con.execute(f"select path, hash, size, queued, upload_required from ({E.oracle_sql()['stream_plan']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_stream_plan_carries_no_payload_and_puts_the_right_ones(spark, tmp_path, monkeypatch):
    from snapplan.plans import snapshot as S
    cut, plain_cut = [], S.cut_lineage

    def noted(df, *args):
        cut.append(df.columns)
        return plain_cut(df, *args)

    monkeypatch.setattr(S, "cut_lineage", noted)
    monkeypatch.setattr(ST, "cut_lineage", noted, raising=False)
    x, y, z = "0" * 32, "1" * 32, "2" * 32
    known = [("/r/b", x, 1, None), ("/r/c", y, 1, None), ("/r/d", z, 1, None)]
    rows = [("/r/a", "one", 1), ("/r/a", "one", 1),                     # a path twice
            ("/r/b", "two", 1), ("/r/b", "three", 2),                   # with two payloads, the first one digested before
            ("/r/c", "four", 1), ("/r/c", "four", 2),                   # with one payload under two digests
            ("/r/d", None, 1),                                          # a stored digest, and no payload
            ("/r/e", "", 1), ("/r/g1", "five", 1), ("/r/g2", "five", 1)]
    files = spark.createDataFrame(
        [(p, "/r", p[3:], "", t, 5 if t is None else len(t), m, False, None) for p, t, m in rows],
        "path string, dir string, name string, ext string, content string, size long, mtime long, is_symlink boolean, "
        "link_target string")
    files.repartition(4).write.parquet(f"{tmp_path}/in/batch=00000")
    state = spark.createDataFrame(known, "path string, st_hash string, st_hash_mtime long, backup_mtime long")
    for sdf in ST.arrivals(spark, [f"{tmp_path}/in/batch=00000"], files.schema):
        ST.stream_plan(sdf, state, f"{tmp_path}/blobs", f"{tmp_path}/results", f"{tmp_path}/ck")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/blobs").select("hash", "size", "content", "shard").collect())
    digest = {t: spark.range(1).select(F.md5(F.lit(t))).first()[0] for t in ("one", "three", "four", "five")}
    want = [(h, len(t), t, h[0]) for t, h in digest.items()] + [(x, 3, "two", "0"), (y, 4, "four", "1"), (z, 5, None, "2")]
    assert got == sorted(want)
    assert spark.read.parquet(f"{tmp_path}/results").count() == len(rows)
    assert cut and not any("content" in c for c in cut)
