"""Scenario tests on real directories: the inventory source, the store
sink and a full run."""

import os

import pytest
from pyspark.sql import functions as F

from snapplan.operators.store import DirectoryStore, write_results
from snapplan.plans import snapshot as S
from snapplan.plans.run import read_state, run_snapshot
from snapplan.sources import inventory as INV


@pytest.fixture()
def tree(tmp_path):
    r = tmp_path / "root"
    (r / "sub" / "deep").mkdir(parents=True)
    (r / "node_modules").mkdir()
    (r / "empty.txt").write_bytes(b"")
    (r / ".hidden").write_text("hidden")
    (r / "_under.txt").write_text("under")
    (r / "a,b.tar.gz").write_text("comma")
    (r / "sub" / "same1.txt").write_text("same content")
    (r / "sub" / "deep" / "same2.log").write_text("same content")
    (r / "node_modules" / "x.js").write_text("ignored")
    (r / "junk.tmp").write_text("ignored too")
    os.symlink(r / "sub" / "same1.txt", r / "link_file")
    os.symlink(r / "sub", r / "link_dir")
    os.symlink(r / "missing-target", r / "broken")
    return r


def scan_rows(spark, roots, ignore=()):
    return {(x.root_ord, os.path.basename(x.path)): x for x in
            INV.files_only(INV.inventory(spark, roots, list(ignore))).collect()}


def test_inventory_semantics(spark, tree):
    rows = scan_rows(spark, [str(tree)], ["node_modules", "*.TMP"])
    names = {n for _, n in rows}
    assert {"empty.txt", ".hidden", "_under.txt", "a,b.tar.gz", "same1.txt", "same2.log",
            "link_file", "link_dir", "broken"} == names
    assert rows[(0, "empty.txt")].size == 0
    assert rows[(0, "link_dir")].is_symlink and rows[(0, "broken")].is_symlink
    assert rows[(0, "broken")].link_target.endswith("missing-target")
    assert rows[(0, ".hidden")].ext == ".hidden" and rows[(0, "a,b.tar.gz")].ext == ".gz"
    assert rows[(0, "same1.txt")].mtime > 1_000_000_000_000_000     # microseconds


def test_overlapping_and_missing_roots(spark, tree):
    scan = INV.inventory(spark, [str(tree), str(tree / "nope"), str(tree / "sub")])
    issues = INV.scan_issues(scan).collect()
    assert [(i.root_ord, i.issue) for i in issues] == [(1, "missing root")]
    files = INV.files_only(scan)
    same1 = files.filter(F.col("name") == "same1.txt").select("root_ord").collect()
    assert sorted(r.root_ord for r in same1) == [0, 2]            # reached twice


def test_ignored_root_and_subtree(spark, tree):
    assert scan_rows(spark, [str(tree / "sub")], ["SUB"]) == {}
    rows = scan_rows(spark, [str(tree)], ["deep"])
    assert "same2.log" not in {n for _, n in rows}


def test_small_work_units_same_result(spark, tree):
    a = set(scan_rows(spark, [str(tree)], ["node_modules"]))
    b = {(k[0], k[1]) for k in scan_rows(spark, [str(tree)], ["node_modules"])}
    c = {(x.root_ord, os.path.basename(x.path)) for x in INV.files_only(
        INV.inventory(spark, [str(tree)], ["node_modules"], max_units=1)).collect()}
    assert a == b == c


def empty_state(spark):
    return spark.createDataFrame([], "path string, st_hash string, st_hash_mtime long, backup_mtime long")


def test_plan_on_real_files(spark, tree):
    files = INV.files_only(INV.inventory(spark, [str(tree)], ["node_modules", "*.tmp"]))
    p = S.plan(files, empty_state(spark), None, S.PlanOptions(mode="fast")).collect()
    by = {os.path.basename(r.path): r for r in p}
    assert by["link_file"].hash.startswith("SYM-") and not by["link_file"].queued
    assert by["link_file"].in_queue == "x"                       # flag before link exclusion
    assert by["empty.txt"].hash == "d41d8cd98f00b204e9800998ecf8427e" and not by["empty.txt"].queued
    assert by["same1.txt"].hash == by["same2.log"].hash
    assert by["same1.txt"].queued != by["same2.log"].queued      # one representative
    assert by["same1.txt"].in_queue == by["same2.log"].in_queue == "x"
    q = [r for r in p if r.queued]
    assert len({r.hash for r in q}) == len(q)


def test_put_is_idempotent(spark, tree, tmp_path):
    files = INV.files_only(INV.inventory(spark, [str(tree)], ["node_modules"]))
    p = S.plan(files, empty_state(spark), None, S.PlanOptions(mode="fast"))
    store = DirectoryStore(spark, str(tmp_path / "store"))
    r1 = write_results(store.put(S.queue(p)), str(tmp_path / "r1")).collect()
    r2 = write_results(store.put(S.queue(p)), str(tmp_path / "r2")).collect()
    assert {r.status for r in r1} == {"copied"} and {r.status for r in r2} == {"exists"}
    listed = {r.hash: r.size for r in store.list().collect()}
    assert listed == {r.hash: r.bytes for r in r1}
    dest = next(r.dest for r in r1 if r.path.endswith("same1.txt") or r.path.endswith("same2.log"))
    h = dest.split("/")[-1].split(".")[0]
    assert dest.startswith(f"{h[0]}/{h[1]}/{h[2]}/")


def test_run_twice_queues_nothing(spark, tree, tmp_path):
    kw = dict(roots=[str(tree)], store_root=str(tmp_path / "store"), state_dir=str(tmp_path / "state"),
              work_dir=str(tmp_path / "work"), ignore=["node_modules"], mode="safe")
    r1 = run_snapshot(spark, run_id="20240101T000000", **kw).first()
    r2 = run_snapshot(spark, run_id="20240101T000100", **kw).first()
    assert r1.n_copied == r1.n_queued > 0 and r1.n_failed == 0
    assert r2.n_queued == 0
    st = read_state(spark, str(tmp_path / "state"))
    assert st.count() == r1.n_files
    manifests = list((tmp_path / "store" / "metadata" / "job" / "2024" / "01").iterdir())
    assert len(manifests) == 2
    text = "".join(open(f).read() for f in sorted(manifests[0].glob("part-*")))
    lines = text.splitlines()
    assert lines[0].startswith("Backup run at: ") and "EOF" in lines
    assert lines[lines.index("EOF") + 2] == "Filename,Hash,Extension,Size,Modified Time,InQueue"
    body = lines[lines.index("EOF") + 3:]
    assert body[0].startswith("dir >> ")
    dirs = [ln[7:] for ln in body if ln.startswith("dir >> ")]
    assert dirs == sorted(dirs)
    mt = spark.read.parquet(str(tmp_path / "work" / "manifest_table"))
    assert mt.select("run_ts").distinct().count() == 2
    assert mt.filter(F.col("name") == "a,b.tar.gz").count() == 2      # lossless, both runs


def test_dry_run_writes_nothing(spark, tree, tmp_path):
    kw = dict(roots=[str(tree)], store_root=str(tmp_path / "store"), state_dir=str(tmp_path / "state"),
              work_dir=str(tmp_path / "work"), mode="fast", dry_run=True)
    r = run_snapshot(spark, run_id="20240101T000000", **kw).first()
    assert r.n_queued > 0 and r.dry_run_lines == r.n_queued
    assert not (tmp_path / "store").exists() and not (tmp_path / "state").exists()


def test_overlapping_roots_state_marks(spark, tree, tmp_path):
    kw = dict(roots=[str(tree), str(tree / "sub")], store_root=str(tmp_path / "store"),
              state_dir=str(tmp_path / "state"), work_dir=str(tmp_path / "work"),
              ignore=["node_modules"], mode="fast")
    run_snapshot(spark, run_id="20240101T000000", **kw)
    r2 = run_snapshot(spark, run_id="20240101T000100", **kw).first()
    st = {r.path: r.backup_mtime for r in read_state(spark, str(tmp_path / "state")).collect()}
    # same1.txt is reached from both roots, and through a linked directory; its content was copied once
    same = [p for p in st if os.path.basename(p) == "same1.txt"]
    assert len(same) == 2 and any(st[p] is not None for p in same)
    assert r2.n_queued <= 1          # at most the remaining duplicate of that content (D-4)


def test_variant_p_follows_links(spark, tree):
    files = INV.files_only(INV.inventory(spark, [str(tree)], ["node_modules", "broken"]))
    p = S.plan(files, empty_state(spark), None, S.PlanOptions(mode="fast", variant="P")).collect()
    by = {os.path.basename(r.path): r for r in p}
    assert "link_dir" not in by
    assert by["link_file"].hash == by["same1.txt"].hash          # content of the target
    assert by["empty.txt"].hash == "0"


def test_variant_p_digest_failure_aborts(spark, tree):
    files = INV.files_only(INV.inventory(spark, [str(tree)], ["node_modules"]))
    with pytest.raises(Exception, match="digest failed"):
        S.plan(files, empty_state(spark), None, S.PlanOptions(mode="fast", variant="P")).collect()


def test_job_entry_point(spark, tree, tmp_path, capsys):
    from snapplan.__main__ import main
    rules = tmp_path / "rules.txt"
    rules.write_text("# rules\nnode_modules\n\n")
    rc = main(["run", "--roots", f"{tree};{tree / 'sub'}", "--store", str(tmp_path / "s"),
               "--state", str(tmp_path / "st"), "--work", str(tmp_path / "w"),
               "--ignore", "*.tmp, broken", "--ignore-file", str(rules), "--mode", "safe"])
    assert rc == 0
    import json
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["n_failed"] == 0 and out["n_copied"] == out["n_queued"] > 0


def test_large_directory_split_into_shards(spark, tmp_path):
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(120):
        (flat / f"f{i:03d}.bin").write_text(str(i))
    r = INV.InventoryReader({"roots_json": f'["{flat}"]', "split_entries": "25"})
    units = r.partitions()
    assert len(units) == 5 and {u.shards for u in units} == {5}
    whole = {x.path for x in INV.files_only(INV.inventory(spark, [str(flat)])).collect()}
    split = {x.path for x in INV.files_only(INV.inventory(spark, [str(flat)], split_entries=25)).collect()}
    assert whole == split and len(split) == 120


def test_run_with_bucketed_state_tables(spark, tree, tmp_path):
    import uuid
    prefix = f"st{uuid.uuid4().hex[:6]}"
    kw = dict(roots=[str(tree)], store_root=str(tmp_path / "store"), state_dir=str(tmp_path / "unused"),
              work_dir=str(tmp_path / "work"), ignore=["node_modules"], mode="safe", state_table=prefix)
    r1 = run_snapshot(spark, run_id="20240101T000000", **kw).first()
    r2 = run_snapshot(spark, run_id="20240101T000100", **kw).first()
    assert r1.n_queued > 0 and r2.n_queued == 0
    names = sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix))
    assert len(names) == 2 and not (tmp_path / "unused").exists()


def test_unreadable_directory_becomes_issue_row(tree, monkeypatch):
    real = os.scandir
    blocked = str(tree / "sub")

    def fake(p="."):
        if str(p) == blocked:
            raise PermissionError(13, "Permission denied")
        return real(p)

    monkeypatch.setattr(INV.os, "scandir", fake)
    unit = INV._Unit(0, str(tree), str(tree), True)
    rows = list(INV._walk(unit, INV.name_test(INV.Rules.of(["node_modules"]))))
    issues = [r for r in rows if r[-1] is not None]
    files = {os.path.basename(r[3]) for r in rows if r[-1] is None}
    assert [(r[3], r[-1]) for r in issues] == [(blocked, "unreadable: Permission denied")]
    assert "same1.txt" not in files and "empty.txt" in files        # the rest of the tree goes on
