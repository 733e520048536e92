"""Tasks of equal bytes, and Python for stale files only."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from snapplan.functions.digest import balance_by_size, digest_files
from snapplan.plans import snapshot as S


def loads(df):
    return {r.p: (r.b, r.n) for r in df.groupBy(F.spark_partition_id().alias("p")).agg(
        F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}


def test_ranges_of_equal_bytes(spark):
    """Sizes from one byte to a tenth of a task, a third of them equal: every task within half a mean."""
    size = F.when(F.col("id") % 3 == 0, 700).otherwise(1 + F.pmod(F.xxhash64("id"), F.lit(1000))).cast("long")
    df = spark.range(20_000).select(F.concat(F.lit("/f"), F.col("id").cast("string")).alias("path"), size.alias("size"))
    total = df.agg(F.sum("size")).first()[0]
    got = loads(balance_by_size(df.repartition(7), 100_000))
    assert sum(b for b, _ in got.values()) == total and sum(n for _, n in got.values()) == 20_000
    mean = total / len(got)
    assert len(got) == -(-total // 100_000) and max(b for b, _ in got.values()) < 1.1 * mean


def test_huge_files_are_alone(spark):
    rows = [(f"/s{i}", 10) for i in range(100)] + [("/h1", 5000), ("/h2", 900), ("/n", None), ("/z", 0)]
    df = spark.createDataFrame(rows, "path string, size long").repartition(3)
    got = balance_by_size(df, 500).withColumn("p", F.spark_partition_id()).collect()
    tasks = {}
    for r in got:
        tasks.setdefault(r.p, []).append(r["size"])
    assert sorted(len(t) for t in tasks.values() if max(x or 0 for x in t) >= 500) == [1, 1]
    assert len(got) == 104 and all(sum(x or 0 for x in t) <= 510 for t in tasks.values() if max(x or 0 for x in t) < 500)
    assert balance_by_size(df.limit(0), 500).count() == 0


def test_only_stale_files_are_read(spark, tmp_path):
    files, state = [], []
    for i in range(20):
        p = tmp_path / f"f{i}"
        p.write_text(f"text {i}")
        files.append((0, str(p), str(tmp_path), p.name, "", p.stat().st_size, 100, False, None))
        if i % 2:                                            # known under the same mtime, with a digest of its own
            state.append((str(p), f"known{i}", 100, None))
    df = spark.createDataFrame(files, "root_ord int, path string, dir string, name string, ext string, size long, "
                                      "mtime long, is_symlink boolean, link_target string")
    st = spark.createDataFrame(state, "path string, st_hash string, st_hash_mtime long, backup_mtime long")
    got = {r.name: r.hash for r in S.plan(df, st).collect()}
    assert got == {f"f{i}": f"known{i}" if i % 2 else hashlib.md5(f"text {i}".encode()).hexdigest() for i in range(20)}
    read = digest_files(df.filter("name = 'f1'").select("path", "size")).collect()
    assert [r.fresh_hash for r in read] == [hashlib.md5(b"text 1").hexdigest()]
