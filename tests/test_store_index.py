"""The levelled index of a content store."""

from __future__ import annotations

import random

import pytest

from snapplan.operators import planning as P
from snapplan.plans.run import run_snapshot
from snapplan.sources.store_index import StoreIndex

ROWS = "hash string, size long"


@pytest.fixture
def index(spark, request):
    made = StoreIndex(spark, f"ix_{request.node.name}"[:40], buckets=4, fanout=3)
    yield made
    for t in spark.catalog.listTables(pattern=f"{made.name}*"):
        spark.sql(f"DROP TABLE {t.name}")


def test_runs_merge_and_the_newest_size_counts(spark, index):
    rng, want = random.Random(5), {}
    for k in range(11):
        rows = {f"h{rng.randrange(40)}": rng.randrange(100) for _ in range(12)}
        want |= rows
        index.append(spark.createDataFrame(list(rows.items()), ROWS))
    assert sorted(r.level for r in index.runs()) == [0, 0, 2]
    assert {r.hash: r["size"] for r in index.list().collect()} == want
    files = spark.createDataFrame([(f"p{i}", f"h{i}", i) for i in range(60)], "path string, hash string, size long")
    got = {r.hash: r.store_size for r in index.with_size(files).collect()}
    assert got == {f"h{i}": want.get(f"h{i}") for i in range(60)}
    listed = spark.createDataFrame(list(want.items()), ROWS)
    for hot in (None, ["h1", "h2"]):
        a, b = ({tuple(r) for r in P.flag_changed_safe(files, s, hot).select("path", "store_size", "upload_required").collect()}
                for s in (index, listed))
        assert a == b


def test_a_lookup_shuffles_no_run(spark, index):
    for k in range(2):
        index.append(spark.createDataFrame([(f"h{i}", i + k) for i in range(50)], ROWS))
    files = spark.createDataFrame([(f"p{i}", f"h{i}") for i in range(60)], "path string, hash string")
    text = index.with_size(files)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.count("Bucketed: true") == 2


def test_what_is_not_committed_does_not_count(spark, index):
    index.append(spark.createDataFrame([("a", 1)], ROWS))
    index.append(spark.createDataFrame([("b", 2)], ROWS))
    lost = f"{index.name}_l0_{3:012d}"
    spark.createDataFrame([("c", 3)], ROWS).write.saveAsTable(lost)           # a driver lost before the mark
    assert {r.hash for r in index.list().collect()} == {"a", "b"}
    index.append(spark.createDataFrame([("d", 4)], ROWS))                     # takes its place, and merges
    assert {r.hash for r in index.list().collect()} == {"a", "b", "d"} and [r.level for r in index.runs()] == [1]
    left = f"{index.name}_l0_{2:012d}"
    spark.createDataFrame([("b", 9)], ROWS).write.saveAsTable(left)           # a merged run that was not dropped
    spark.sql(f"ALTER TABLE {left} SET TBLPROPERTIES ('snapplan.committed' = 'true')")
    assert {(r.hash, r["size"]) for r in index.list().collect()} == {("a", 1), ("b", 2), ("d", 4)}


def test_the_second_run_lists_nothing(spark, index, tmp_path, monkeypatch):
    data = tmp_path / "data"
    data.mkdir()
    for i in range(5):
        (data / f"f{i}").write_text(f"text {i}")
    kw = dict(roots=[str(data)], store_root=str(tmp_path / "store"), state_dir=str(tmp_path / "state"),
              work_dir=str(tmp_path / "work"), mode="safe", store_index=index)
    one = run_snapshot(spark, run_id="20240101T000000", **kw).first()
    (data / "new").write_text("new")
    from snapplan.operators.store import DirectoryStore

    def no_listing(self):
        raise AssertionError("listed")

    monkeypatch.setattr(DirectoryStore, "list", no_listing)
    two = run_snapshot(spark, run_id="20240101T000100", **kw).first()
    assert (one.n_copied, two.n_queued, two.n_copied, two.n_files) == (5, 1, 1, 6)
