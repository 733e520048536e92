"""Blob table with a commit protocol, and block-wise copies of large files."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
import pytest

from snapplan.operators import store as ST
from snapplan.operators.blobs import (FORMAT, BlobSink, BlobWriter, blob_contents, blocks_of, commit_of, put_blobs,
                                      read_blocks, staging_of, stored_blobs)
from snapplan.operators.store import BlobTableStore, DirectoryStore, copy_in_blocks, copy_to_store

QUEUE = "path string, dest string, hash string, size long"


def files(tmp_path, sizes):
    rows = []
    for i, n in enumerate(sizes):
        data = os.urandom(n)
        f = tmp_path / f"f{i}.bin"
        f.write_bytes(data)
        h = hashlib.md5(data).hexdigest()
        rows.append((str(f), f"{h[0]}/{h}.bin", h, n))
    return rows


def test_put_reads_files_in_blocks(spark, tmp_path):
    rows = files(tmp_path, [0, 1, 10, 11, 95])
    twin = (str(tmp_path / "zz"), "t", rows[4][2], 95)             # the same payload under a later path
    table = str(tmp_path / "table")
    q = spark.createDataFrame([*rows, twin], QUEUE)
    got = {r.path: (r.status, r.tries, r.bytes) for r in put_blobs(q, table, block_bytes=10).collect()}
    assert got == {**{r[0]: ("copied", 1, r[3]) for r in rows}, twin[0]: ("exists", 1, 0)}
    assert {(r.hash, r.size) for r in stored_blobs(spark, table).collect()} == {(r[2], r[3]) for r in rows}
    stored = {r.hash: bytes(r.content) for r in blob_contents(spark, table).collect()}
    assert stored == {r[2]: open(r[0], "rb").read() for r in rows}
    again = put_blobs(q, table, block_bytes=10).collect()
    assert {r.status for r in again} == {"exists"} and read_blocks(spark, table).count() == 1 + 1 + 1 + 2 + 10


def test_failed_reads_are_results_and_can_come_back(spark, tmp_path):
    rows = files(tmp_path, [30, 40])
    os.truncate(rows[1][0], 15)                                     # two of its four blocks are missing
    table = str(tmp_path / "table")
    q = spark.createDataFrame(rows, QUEUE)
    got = {r.path: (r.status, r.error is None) for r in put_blobs(q, table, block_bytes=10).collect()}
    assert got == {rows[0][0]: ("copied", True), rows[1][0]: ("failed", False)}
    assert [r.hash for r in stored_blobs(spark, table).collect()] == [rows[0][2]]
    assert blob_contents(spark, table).count() == 1                 # half a payload is never seen
    data = b"".join(bytes([i]) for i in range(40))
    with open(rows[1][0], "wb") as fh:
        fh.write(data)
    back = put_blobs(q.selectExpr("*", "1 as try_count"), table, block_bytes=10)
    assert {r.path: (r.status, r.tries) for r in back.collect()} == {
        rows[0][0]: ("exists", 2), rows[1][0]: ("copied", 2)}


def test_payloads_of_a_table(spark, tmp_path):
    rows = [(f"/k/{i}", f"d{i}", hashlib.md5(b"x" * i).hexdigest(), i, "x" * i) for i in range(1, 30)]
    store = BlobTableStore(spark, str(tmp_path / "t"))
    q = spark.createDataFrame(rows, QUEUE + ", text string")
    assert {r.status for r in store.put(q, "text").collect()} == {"copied"}
    assert {(r.hash, r.size) for r in store.list().collect()} == {(r[2], r[3]) for r in rows}
    assert {bytes(r.content) for r in blob_contents(spark, store.path).collect()} == {r[4].encode() for r in rows}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(BlobSink)
    table = str(tmp_path / "t")

    def broken(batches):
        for k, b in enumerate(batches):
            yield b
        raise ValueError("lost")

    rows = files(tmp_path, [30, 40])
    blocks = blocks_of(spark.createDataFrame(rows, QUEUE), 10)
    bad = blocks.mapInArrow(broken, blocks.schema)
    with pytest.raises(Exception, match="lost"):
        bad.write.format(FORMAT).option("path", table).option("commit", "c1").mode("append").save()
    assert read_blocks(spark, table).count() == 0
    assert not os.path.exists(staging_of(table, "c1")) and not os.path.exists(commit_of(table, "c1"))


def attempt(writer, i):
    return writer.write(iter([pa.RecordBatch.from_pylist([{
        "path": f"p{i}", "dest": "d", "hash": f"h{i}", "size": 3, "ext": "", "shard": "h", "block": 0, "n_blocks": 1,
        "start": 0, "length": 3, "content": b"abc"}])]))


def test_only_reported_attempts_count(spark, tmp_path):
    table = str(tmp_path / "t")
    writer = BlobWriter({"path": table, "commit": "c1"})
    first, lost, other = attempt(writer, 1), attempt(writer, 1), attempt(writer, 2)
    assert len(lost.files) == 2 and read_blocks(spark, table).count() == 0          # staged files are not seen
    writer.commit([first, None, other])
    assert sorted(r.hash for r in read_blocks(spark, table).collect()) == ["h1", "h2"]
    again = BlobWriter({"path": table, "commit": "c1"})                             # a replay of the same commit
    again.commit([attempt(again, 3)])
    assert sorted(r.hash for r in read_blocks(spark, table).collect()) == ["h1", "h2"]
    assert not os.path.exists(staging_of(table, "c1"))


def test_a_replayed_put_returns_the_same(spark, tmp_path):
    rows, table = files(tmp_path, [5, 25]), str(tmp_path / "t")
    q = spark.createDataFrame(rows, QUEUE)
    a, b = (sorted(map(tuple, put_blobs(q, table, commit="batch-7", block_bytes=10).collect())) for _ in range(2))
    assert a == b and read_blocks(spark, table).count() == 1 + 3


def test_large_files_go_in_blocks(spark, tmp_path):
    rows = files(tmp_path, [95, 7, 64])
    q, root = spark.createDataFrame(rows, QUEUE), str(tmp_path / "store")
    out = copy_in_blocks(q, root, target_bytes=20, block_bytes=8)
    results = {r.path: (r.status, r.bytes, r.tries) for r in ST.write_results(out, str(tmp_path / "r1")).collect()}
    assert results == {r[0]: ("copied", r[3], 1) for r in rows}
    for path, dest, _, _ in rows:
        assert open(f"{root}/{dest}", "rb").read() == open(path, "rb").read()
    assert {r.status for r in copy_in_blocks(q, root, block_bytes=8).collect()} == {"exists"}
    assert {r.status for r in copy_in_blocks(q, root, "overwrite", block_bytes=8).collect()} == {"overwritten"}


def test_a_file_with_a_lost_block_is_never_seen(spark, tmp_path):
    rows = files(tmp_path, [95, 60])
    os.truncate(rows[0][0], 50)
    q, root = spark.createDataFrame(rows, QUEUE), str(tmp_path / "store")
    got = {r.path: r.status for r in copy_to_store(q, root, large_bytes=50).collect()}
    assert got == {rows[0][0]: "failed", rows[1][0]: "copied"}
    names = [n for _, _, ns in os.walk(root) for n in ns]
    assert names == [os.path.basename(rows[1][1])]


def test_stores_have_one_contract(spark, tmp_path):
    rows = files(tmp_path, [5, 6, 7])
    q = spark.createDataFrame(rows, QUEUE)
    found = []
    for store in (DirectoryStore(spark, str(tmp_path / "d")), BlobTableStore(spark, str(tmp_path / "b"))):
        out = ST.write_results(store.put(q), str(tmp_path / f"r{type(store).__name__}"))
        found.append(([f.simpleString() for f in out.schema], sorted(map(tuple, out.collect())),
                      sorted(map(tuple, store.list().collect()))))
    assert found[0] == found[1]
