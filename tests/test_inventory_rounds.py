"""The scan in rounds against the scan in one go and against os.walk."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from snapplan.sources import inventory as INV
from snapplan.sources.rounds import inventory_rounds


def tree(tmp_path):
    top = tmp_path / "t"
    (top / "a" / "b").mkdir(parents=True)
    (top / "skip").mkdir()
    for name in ("a/x.txt", "a/b/y.tmp", "a/b/.hidden", "a/b/_z", "skip/n", "root.txt", "a/empty"):
        (top / name).write_text("" if name.endswith("empty") else name)
    d = top
    for i in range(12):                                      # deep on one side
        d = d / f"d{i}"
        d.mkdir()
        (d / f"f{i}.txt").write_text(str(i))
    os.symlink(top / "nowhere", top / "a" / "dangling")
    os.symlink(top / "root.txt", top / "a" / "to_file")
    return top


def paths(df):
    return sorted(r.path for r in INV.files_only(df).select("path").collect())


def test_rounds_equal_one_scan(spark, tmp_path):
    top = tree(tmp_path)
    roots, ignore = [str(top), str(top / "a"), str(tmp_path / "none")], ["*.tmp", "skip"]
    want = INV.inventory(spark, roots, ignore).collect()
    for budget, split in ((10**6, 10**6), (3, 2)):           # one round; many, with directories cut by name
        work = str(tmp_path / f"w{budget}")
        got = inventory_rounds(spark, roots, ignore, False, budget=budget, split=split, work=work).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
        n = len([d for d in os.listdir(work) if d.startswith("round=")])
        assert n == 2 if budget > 100 else n > 4


def test_tasks_of_a_one_sided_tree_are_even(spark, tmp_path):
    top, work = tree(tmp_path), str(tmp_path / "w")
    inventory_rounds(spark, [str(top)], budget=4, work=work).count()
    per = spark.read.option("basePath", work).parquet(work).groupBy("round", F.col("_metadata.file_name")).count()
    assert per.agg(F.max("count")).first()[0] <= 4 + 3        # the budget, and a directory more than begun


def test_linked_directories(spark, tmp_path):
    top = tree(tmp_path)
    other = tmp_path / "other"
    (other / "in").mkdir(parents=True)
    (other / "in" / "o.txt").write_text("o")
    os.symlink(other, top / "a" / "linked")
    os.symlink(other, top / "d0" / "linked too")
    os.symlink(top / "a", top / "a" / "b" / "loop")
    out = inventory_rounds(spark, [str(top)])
    got = paths(out)
    assert str(top / "a/linked/in/o.txt") in got and str(top / "d0/linked too/in/o.txt") in got
    issues = {(r.path, r.issue) for r in INV.scan_issues(out).collect()}
    assert issues == {(str(top / "a/b/loop"), "directory loop")}
    assert not any("/loop/" in p for p in got) and len(got) == len(set(got))
    assert paths(inventory_rounds(spark, [str(top)], follow_links=False)) == paths(INV.inventory(spark, [str(top)], []))
    assert inventory_rounds(spark, []).count() == 0


def test_a_wide_directory_needs_few_rounds(spark, tmp_path):
    """As many tasks as the names need; a round of a given number of tasks each took a hundred rounds before."""
    top, work = tmp_path / "wide", str(tmp_path / "w")
    top.mkdir()
    for i in range(600):
        (top / f"f{i}").write_text("x")
    out = inventory_rounds(spark, [str(top)], budget=6, split=3, tasks=4, work=work)
    assert paths(out) == sorted(str(top / f"f{i}") for i in range(600))
    assert len([d for d in os.listdir(work) if d.startswith("round=")]) <= 6
