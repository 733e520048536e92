"""Physical plans: the shapes the design relies on."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from snapplan.operators import ignore as IG
from snapplan.operators import planning as P


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_retry_outcome_limits_before_shuffle(spark):
    txt = plan_text(E.queries()["retry_outcome"](spark, SF001))
    assert "WindowGroupLimit" in txt


def test_plans_have_no_cartesian_product(spark):
    for name in ["plan_safe", "plan_fast", "plan_variant_p", "table_snapshot_orders", "overlay_missing",
                 "manifest_rows", "state_merge", "overlap_roots"]:
        txt = plan_text(E.queries()[name](spark, SF001))
        assert "CartesianProduct" not in txt, name
        assert "BroadcastNestedLoopJoin" not in txt, name


def test_rule_joins_are_equi_joins(spark):
    for name in ("ignore_rule_join", "ignore_rule_table"):
        txt = plan_text(E.queries()[name](spark, SF001))
        assert "NestedLoop" not in txt and "CartesianProduct" not in txt, name


def test_many_rules_join_without_nested_loop(spark):
    """100 000 globs: an equi-join over anchors; few pairs are left to test."""
    rules = spark.range(100_000).select(F.concat(F.lit("*/x"), F.col("id").cast("string"), F.lit("?z*.t*")).alias("pattern"))
    files = spark.range(2000).select(F.lit("/r").alias("root"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name")
                                     ).withColumn("path", F.concat(F.lit("/r/x17az/"), "name", F.lit(".txt")))
    out = IG.apply_ignore_table(files, rules, subtree=True)
    txt = plan_text(out)
    assert "NestedLoop" not in txt and "CartesianProduct" not in txt and "_salt" in txt
    assert out.count() == 0
    other = files.withColumn("path", F.replace("path", F.lit("x17az"), F.lit("x17az0")))
    assert IG.apply_ignore_table(other.withColumn("path", F.replace("path", F.lit("z0"), F.lit("y0"))), rules).count() == 2000


def test_scans_prune_columns(spark):
    df = E.queries()["plan_fast"](spark, SF001)
    txt = df._jdf.queryExecution().executedPlan().toString()
    # documents carries n_chars, which the plan never needs
    assert "n_chars" not in txt


def test_codegen_spans(spark):
    df = E.queries()["table_snapshot_orders"](spark, SF001)
    df.collect()                                   # final adaptive plan
    assert "*(" in plan_text(df)                   # "*(n)" marks a whole-stage codegen span


def test_hot_key_split_equals_plain_join(spark):
    rows = [(f"p{i}", "HOT" if i % 3 == 0 else f"h{i}", 10) for i in range(3000)]
    df = spark.createDataFrame(rows, "path string, hash string, size long")
    store = spark.createDataFrame([("HOT", 10), ("h1", 11), ("h2", 10)], "hash string, size long")
    hot = P.hot_keys(df, "hash", partitions=8, min_hot_rows=0)
    assert P.hot_keys(df, "hash", partitions=8) == []          # too small to straggle
    assert hot == ["HOT"]
    a = {tuple(r) for r in P.flag_changed_safe(df, store, hot).select("path", "upload_required").collect()}
    b = {tuple(r) for r in P.flag_changed_safe(df, store).select("path", "upload_required").collect()}
    assert a == b


def test_first_per_key_is_aggregate(spark):
    df = spark.createDataFrame([("a", "p2"), ("a", "p1"), ("b", "p3")], "hash string, path string")
    got = {(r.hash, r.path) for r in P.first_per_key(df, "hash", ["path"]).collect()}
    assert got == {("a", "p1"), ("b", "p3")}
    txt = plan_text(P.first_per_key(df, "hash", ["path"]))
    assert "Window" not in txt


def test_bucketed_state_join_shuffles_one_side(spark):
    import uuid
    from snapplan.fixtures import Fixtures
    from snapplan.sources.state import write_state_bucketed
    fx = Fixtures(spark, SF001)
    name = f"state_{uuid.uuid4().hex[:8]}"
    write_state_bucketed(fx.state, name, int(spark.conf.get("spark.sql.shuffle.partitions")))
    j = P.with_state(fx.files.select("path", "size", "mtime"), spark.table(name))
    txt = j._jdf.queryExecution().executedPlan().toString()
    assert txt.count("Exchange hashpartitioning") == 1
    assert j.count() == fx.files.count()


def test_globs_with_a_common_start_meet_few_strings(spark):
    """What all globs share is nobody's anchor, however long it is."""
    from snapplan.operators import globs as GL
    rules = spark.range(20_000).select(F.concat(F.lit("/data/common/*/EN/*"), F.col("id").cast("string"), F.lit("?.*")).alias("p"))
    got = GL.anchored(rules, "p")
    assert got.count() == 20_000
    assert got.groupBy("_kind", "_len", "_text").count().agg(F.max("count")).first()[0] < 200
    paths = spark.range(300).select("id", F.format_string("/data/common/s%d/en/f%d7.txt", F.col("id") % 3, F.col("id") * 100).alias("x"))
    for most in (10_000, 0):
        assert {r.id for r in GL.glob_matches(paths, "x", ["id"], rules, "p", most).collect()} == set(range(300))
