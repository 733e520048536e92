"""Plan counters equal the expected table of FIXTURES.md (checked there in
Spark and DuckDB)."""

import pytest

import __spark_entry__ as E

EXPECTED = {
    ("0.001", "fast"): (200, 84, 150, 147, 139, 357284, 0),
    ("0.001", "safe"): (200, 84, 114, 110, 104, 275512, 69),
    ("0.01", "fast"): (1000, 417, 750, 736, 673, 1712777, 0),
    ("0.01", "safe"): (1000, 417, 563, 544, 501, 1266860, 367),
    ("0.1", "fast"): (10000, 4167, 7500, 7358, 6794, 17111126, 0),
    ("0.1", "safe"): (10000, 4167, 5718, 5529, 5004, 12737960, 3528),
}


@pytest.mark.parametrize("sf,mode", sorted(EXPECTED))
def test_plan_summary(spark, sf, mode):
    q = "plan_summary" if mode == "safe" else "plan_summary_fast"
    r = E.queries()[q](spark, f"/root/testdata/sf{sf}").first()
    got = (r.n_files, r.n_stale, r.n_flagged, r.n_marked, r.n_queued, r.queued_bytes, r.n_repaired)
    assert got == EXPECTED[(sf, mode)]


def test_plan_summary_through_hot_path(spark):
    """Same counters when hot hashes (the empty file, repeated documents)
    take the bounded-broadcast path."""
    from snapplan.catalog import planned  # noqa: F401
    from snapplan.fixtures import Fixtures
    from snapplan.operators import planning as P
    from snapplan.plans import snapshot as S
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        fx = Fixtures(spark, "/root/testdata/sf0.01")
        seen = []
        orig = P.hot_keys
        P.hot_keys = lambda *a, **k: seen.append(orig(*a, **k)) or seen[-1]
        try:
            p = S.plan(fx.files, fx.state, fx.store, S.PlanOptions(mode="safe", order=("path",), hot_min_rows=0))
        finally:
            P.hot_keys = orig
        assert seen and "d41d8cd98f00b204e9800998ecf8427e" in seen[0]
        r = S.plan_summary(p).first()
        assert (r.n_files, r.n_stale, r.n_flagged, r.n_marked, r.n_queued, r.queued_bytes, r.n_repaired) == \
            EXPECTED[("0.01", "safe")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
