"""Sources and sinks on small inputs: rule files, listings, stores, manifests."""

import pytest
from pyspark.sql import functions as F

from snapplan.operators import manifest as MF
from snapplan.operators import store as ST
from snapplan.sources import listings as LS
from snapplan.sources import rules as RU


def test_read_rules_from_text_file(spark, tmp_path):
    f = tmp_path / "ignore.txt"
    f.write_text("# comment\n\n  *.tmp  \nnode_modules\na,b\n")
    rules = RU.read_rules(spark, str(f)).orderBy("ord").collect()
    assert [r.pattern for r in rules] == ["*.tmp", "node_modules", "a,b"]   # not split on commas


def test_store_from_objects_fail_mode(spark):
    objs = spark.createDataFrame([("a/b/x.bin", 5, None), ("a/b/.bin", 3, None)],
                                 "path string, size long, content_md5 binary")
    assert {r.hash for r in LS.store_from_objects(objs).collect()} == {"x"}
    with pytest.raises(ValueError):
        LS.store_from_objects(objs, on_error="fail")


def test_transfer_plan_thresholds_and_tier(spark):
    q = spark.createDataFrame([("s", 10), ("m", 200 * 1024 * 1024), ("l", 2 * 1024 ** 3)], "path string, size long")
    rows = {r.path: r for r in ST.transfer_plan(q).collect()}
    assert (rows["s"].concurrency, rows["m"].concurrency, rows["l"].is_large) == (4, 8, True)
    assert rows["m"].block_bytes == 8 * 1024 * 1024 and not rows["m"].is_large
    assert {r.tier for r in ST.transfer_plan(q, is_metadata=True).collect()} == {"Cold"}
    assert {r.tier for r in ST.transfer_plan(q, variant="P", tier="Cool").collect()} == {"Cool"}
    with pytest.raises(ValueError):
        ST.transfer_plan(q, variant="P", tier="Freezing")


def test_blob_table_store_roundtrip(spark, tmp_path):
    store = ST.open_store(spark, "table", str(tmp_path / "blobs"))
    assert store.list().count() == 0
    q = spark.createDataFrame([("h1", 3, ".txt", "abc"), ("h2", 2, "", "xy"), ("h1", 3, ".md", "abc")],
                              "hash string, size long, ext string, content string")
    store.put(q)
    assert {(r.hash, r.size) for r in store.list().collect()} == {("h1", 3), ("h2", 2)}
    store.put(q)                                              # nothing missing: nothing appended
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 2
    assert isinstance(ST.open_store(spark, "unknown", str(tmp_path / "d")), ST.DirectoryStore)


def test_variant_p_manifest_quotes(spark):
    planned = spark.createDataFrame(
        [("/r", "/r/a,b.tar.gz", "a,b.tar.gz", "h", ".gz", 3, 1704067200, "x")],
        "dir string, path string, name string, hash string, ext string, size long, mtime long, in_queue string")
    lines = {r.line for r in MF.manifest_rows(planned, variant="P").collect()}
    assert lines == {"dir >> /r", '"a,b.tar.gz",h,.gz,3,1704067200.0,x'}
    c = {r.line for r in MF.manifest_rows(planned, variant="C").collect()}
    assert "a,b.tar.gz,h,.gz,3,133485408000000000,x" in c


def test_write_manifest_orders_globally(spark, tmp_path):
    rows = spark.createDataFrame(
        [("/b", 1, "/b/2", "l4"), ("/a", 1, "/a/1", "l2"), ("/b", 0, "", "dir >> /b"), ("/a", 0, "", "dir >> /a")],
        "dir string, kind int, path string, line string")
    out = MF.write_manifest(MF.manifest_lines(rows, ["run"]), str(tmp_path / "m"), partitions=3)
    text = "".join(open(p).read() for p in sorted((tmp_path / "m").glob("part-*")))
    assert text.splitlines() == ["run", "EOF", "", MF.MANIFEST_HEADER, "dir >> /a", "l2", "dir >> /b", "l4"]
    assert out.endswith("m")


def test_manifest_preamble_variants():
    import datetime as dt
    ts = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert MF.manifest_preamble("C", ts, ["a=1"]) == ["Backup run at: 2024-01-02 03:04:05", "a=1"]
    assert MF.manifest_preamble("P", ts) == ["Backup configuration:"]


def test_variant_p_clears_backup_mark_of_unsaved_items(spark):
    from snapplan.sources import state as SS
    planned = spark.createDataFrame(
        [("/a", "h1", 10, False, True, False), ("/b", "h2", 20, False, True, False), ("/c", "h3", 30, False, False, False)],
        "path string, hash string, mtime long, stale boolean, queued boolean, repair boolean") \
        .withColumn("upload_required", F.col("queued"))
    old = spark.createDataFrame([("/a", "h1", 10, 5), ("/b", "h2", 20, 5), ("/c", "h3", 30, 30)],
                                "path string, st_hash string, st_hash_mtime long, backup_mtime long")
    saved = spark.createDataFrame([("/a",)], "path string")
    new = {r.path: r.backup_mtime for r in
           SS.merge_state(old, SS.state_updates(planned, saved, variant="P")).collect()}
    assert new == {"/a": 10, "/b": None, "/c": 30}     # saved -> marked, queued but unsaved -> cleared
