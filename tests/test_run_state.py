"""Runs that must not lose a backup: re-created files, several jobs, retries,
broken stores, odd directory entries, foreign session settings."""

import os

import pytest
from pyspark.sql import functions as F

from snapplan.functions.paths import basename, dirname, extension
from snapplan.operators.store import BlobTableStore, DirectoryStore, transfer_plan
from snapplan.plans.run import job_state, merge_stored, prune_state, read_state, run_snapshot
from snapplan.session import has_entries
from snapplan.sources import inventory as INV


def _write(path, text, mtime=1_700_000_000):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (mtime, mtime))


def _args(tmp_path, **more):
    return dict(roots=[str(tmp_path / "data")], store_root=str(tmp_path / "store"), state_dir=str(tmp_path / "state"),
                work_dir=str(tmp_path / "work"), mode="fast", delay=0.0) | more


def test_recreated_file_is_stored_again(spark, tmp_path):
    a, b = tmp_path / "data" / "a.txt", tmp_path / "data" / "b.txt"
    _write(a, "one")
    _write(b, "other")
    assert run_snapshot(spark, run_id="20240101T000000", **_args(tmp_path)).first().n_copied == 2
    a.unlink()
    assert run_snapshot(spark, run_id="20240101T000100", **_args(tmp_path)).first().n_queued == 0
    _write(a, "two")                                   # other content, same mtime
    r = run_snapshot(spark, run_id="20240101T000200", **_args(tmp_path)).first()
    assert (r.n_queued, r.n_copied) == (1, 1)


def test_each_job_has_its_own_marks(spark, tmp_path):
    _write(tmp_path / "data" / "a.txt", "one")
    r1 = run_snapshot(spark, run_id="20240101T000000", **_args(tmp_path, job="A")).first()
    other = _args(tmp_path, job="B", store_root=str(tmp_path / "store2"))
    r2 = run_snapshot(spark, run_id="20240101T000100", **other).first()
    r3 = run_snapshot(spark, run_id="20240101T000200", **other).first()
    assert [(r.n_queued, r.n_copied) for r in (r1, r2, r3)] == [(1, 1), (1, 1), (0, 0)]


def test_prune_keeps_what_was_not_seen_for_a_reason(spark):
    stored = spark.createDataFrame(
        [(p, "h", 1, {"j": 1}) for p in ("/r/a", "/r/gone", "/r/bad/x", "/r/bad/y/z", "/r2/k", "/rr/k")],
        "path string, st_hash string, st_hash_mtime long, marks map<string,bigint>")
    scan = spark.createDataFrame([("/r", "/r/a", None), ("/r/bad", "/r/bad", "unreadable")],
                                 "dir string, path string, issue string")
    left = {r.path for r in prune_state(stored, scan, ["/r"]).collect()}
    assert left == {"/r/a", "/r/bad/x", "/r/bad/y/z", "/r2/k", "/rr/k"}


def test_merge_leaves_other_jobs_alone(spark):
    stored = spark.createDataFrame([("/a", "h", 1, {"j": 1, "k": 2})],
                                   "path string, st_hash string, st_hash_mtime long, marks map<string,bigint>")
    updates = spark.createDataFrame([("/a", None, None, None, True), ("/b", "g", 5, 5, False)],
                                    "path string, new_hash string, new_hash_mtime long, new_backup_mtime long, "
                                    "clear_backup boolean")
    out = merge_stored(stored, updates, "j")
    assert {r.path: r.marks for r in out.collect()} == {"/a": {"k": 2}, "/b": {"j": 5}}
    assert {r.path: r.backup_mtime for r in job_state(out, "k").collect()} == {"/a": 2, "/b": None}


def test_failed_puts_are_tried_again(spark, tmp_path):
    _write(tmp_path / "data" / "a.txt", "one")

    class Flaky(DirectoryStore):
        calls = 0

        def put(self, queue, content_col=None):
            Flaky.calls += 1
            out = super().put(queue, content_col)
            return out if Flaky.calls > 2 else out.withColumn("status", F.lit("failed"))

    store = Flaky(spark, str(tmp_path / "store"), on_exists="overwrite")
    r = run_snapshot(spark, run_id="20240101T000000", **_args(tmp_path, store=store, retries=3)).first()
    assert (Flaky.calls, r.n_failed, r.n_queued) == (3, 0, 1)
    assert run_snapshot(spark, run_id="20240101T000100", **_args(tmp_path)).first().n_queued == 0


def test_a_broken_store_raises_and_an_absent_one_is_empty(spark, tmp_path):
    assert BlobTableStore(spark, str(tmp_path / "none")).list().count() == 0
    assert not has_entries(spark, str(tmp_path / "none"))
    (tmp_path / "blobs").mkdir()
    (tmp_path / "blobs" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|schema"):
        BlobTableStore(spark, str(tmp_path / "blobs")).list().count()


def test_odd_names_become_issues(spark, tmp_path):
    _write(tmp_path / "data" / "ok.txt", "x")
    with open(os.fsencode(str(tmp_path / "data")) + b"/bad\xff.txt", "wb") as f:
        f.write(b"x")
    rows = INV.inventory(spark, [str(tmp_path / "data")]).collect()
    assert sorted(r.issue for r in rows if r.issue) == ["name is not UTF-8"]
    assert [r.name for r in rows if not r.issue] == ["ok.txt"]


def test_work_units_stay_within_their_bound(spark, tmp_path):
    for i in range(60):
        _write(tmp_path / "data" / f"d{i}" / "f.txt", "x")
    reader = INV.InventoryReader({"roots": str(tmp_path / "data"), "max_units": "8"})
    units = reader.partitions()
    assert len(units) <= 8
    rows = [r for u in units for r in reader.read(u)]
    assert len(rows) == 60 and all(r[-1] is None for r in rows)


def test_path_parts_of_odd_paths(spark):
    df = spark.createDataFrame([("/x.txt",), ("/a/b\nc/d.txt",), ("bare",), ("/a/n.t\nx",)], "p string")
    got = [tuple(r) for r in df.select(dirname("p"), basename("p"), extension(basename("p"), "P")).collect()]
    assert got == [("/", "x.txt", ".txt"), ("/a/b\nc", "d.txt", ".txt"), ("", "bare", ""), ("/a", "n.t\nx", ".t\nx")]


def test_tier_text_is_lenient(spark):
    q = spark.createDataFrame([("a", 1)], "path string, size long")
    assert transfer_plan(q, variant="P", tier=" cool ").first().tier == "Cool"
    with pytest.raises(ValueError):
        transfer_plan(q, variant="P", tier="warm")


def test_session_of_a_job_keeps_the_submitters_settings():
    import subprocess
    import sys
    code = ("from pyspark.sql import SparkSession\n"
            "SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '777')"
            ".config('spark.ui.enabled', 'false').config('spark.sql.autoBroadcastJoinThreshold', '5')"
            ".getOrCreate()\n"
            "from snapplan.session import build_session\n"
            "s = build_session()\n"
            "print('GOT', s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'),"
            " s.conf.get('spark.sql.autoBroadcastJoinThreshold'))\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert "GOT local[2] 777 5" in out.stdout, out.stderr[-1500:]


def test_dry_run_leaves_no_files(spark, tmp_path):
    _write(tmp_path / "data" / "a.txt", "one")
    r = run_snapshot(spark, run_id="20240101T000000", dry_run=True, **_args(tmp_path)).first()
    assert (r.n_files, r.n_queued, r.n_copied, r.dry_run_lines) == (1, 1, 0, 1)
    assert sorted(os.listdir(tmp_path)) == ["data"]


def test_variant_p_run(spark, tmp_path):
    """Junk names are skipped, empty files have the digest 0, a second run puts nothing, a lost file ends the run."""
    top = tmp_path / "t"
    (top / "d").mkdir(parents=True)
    for name, text in (("a.txt", "one"), ("d/b.txt", "two"), ("Thumbs.db", "junk"), ("empty", ""), ("c.txt", "three")):
        (top / name).write_text(text)
    kw = dict(roots=[str(top)], store_root=str(tmp_path / "store"), state_dir=str(tmp_path / "state"),
              work_dir=str(tmp_path / "work"), mode="fast", variant="P", retries=0, delay=0)
    one = run_snapshot(spark, run_id="20240101T000000", **kw).first()
    assert (one.n_files, one.n_queued, one.n_copied) == (4, 3, 3)
    state = {r.path.removeprefix(f"{top}/"): r.st_hash for r in read_state(spark, str(tmp_path / "state")).collect()}
    assert state["empty"] == "0" and "Thumbs.db" not in state
    assert run_snapshot(spark, run_id="20240101T000100", **kw).first().n_queued == 0
    (top / "new").write_text("four")

    class Broken(DirectoryStore):
        def put(self, queue, content_col=None):
            return super().put(queue.selectExpr("concat(path, '.gone') as path", "dest", "hash", "size"))

    with pytest.raises(RuntimeError, match="retries exhausted"):
        run_snapshot(spark, run_id="20240101T000200", store=Broken(spark, str(tmp_path / "store")), **kw)
    text = "".join(p.read_text() for p in sorted((tmp_path / "store" / "metadata").rglob("part-*.txt")))
    assert "Backup configuration:" in text
