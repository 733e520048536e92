"""Column functions on edge values (small in-memory inputs)."""

from pyspark.sql import functions as F

from snapplan.functions import digest as FD
from snapplan.functions import encodings as FE
from snapplan.functions import masking as FM
from snapplan.functions import paths as FP
from snapplan.operators import ignore as IG


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_extension_variants(spark):
    cases = {".DS_Store": (".DS_Store", ""), "name.": ("", "."), "x.tar.gz": (".gz", ".gz"),
             "plain": ("", ""), "..x.y": (".y", ".y"), "a,b.tar.gz": (".gz", ".gz")}
    for name, (c, p) in cases.items():
        assert one(spark, FP.extension(F.col("v"), "C"), name) == c, name
        assert one(spark, FP.extension(F.col("v"), "P"), name) == p, name


def test_path_parts(spark):
    row = spark.createDataFrame([("/a/b/c.tar.gz",)], "p string").select(
        *[v.alias(k) for k, v in FP.path_parts("p").items()]).first()
    assert (row.dir, row.name, row.stem) == ("/a/b", "c.tar.gz", "c.tar")


def test_shard_path_depths(spark):
    df = spark.createDataFrame([("abcdef", ".txt"), ("ab", "")], "h string, e string")
    got = df.select(FP.shard_path("h", "e", 3).alias("d3"), FP.shard_path("h", "e", 0).alias("d0")).collect()
    assert got[0].d3 == "a/b/c/abcdef.txt" and got[0].d0 == "/abcdef.txt"
    assert got[1].d3 == "a/b/ab"                       # depth capped by the hash length


def test_symlink_digest_no_line_breaks(spark):
    long_target = "/very/long/" + "x" * 300
    v = one(spark, FD.symlink_digest(F.col("v")), long_target)
    assert v.startswith("SYM-") and "\r" not in v and "\n" not in v
    import base64
    assert base64.b64decode(v[4:]).decode() == long_target
    assert one(spark, FD.symlink_digest(F.col("v")), None) == \
        "SYM-" + base64.b64encode(FD.UNRESOLVED_LINK_TARGET.encode()).decode()


def test_filetime_and_parse(spark):
    assert one(spark, FE.mtime_filetime(F.col("v")), 1704067200, "v long") == 133485408000000000
    assert one(spark, FE.mtime_parse(F.col("v"), "C"), "bad") == float("-inf")
    assert one(spark, FE.mtime_parse(F.col("v"), "P"), "bad") == 0.0
    assert one(spark, FE.mtime_parse(F.col("v"), "P"), "12.5") == 12.5


def test_lenient_casts(spark):
    assert one(spark, FE.as_int(F.col("v"), 7), "x1") == 7
    assert one(spark, FE.as_int(F.col("v"), 7), "42") == 42
    assert one(spark, FE.as_bool(F.col("v"), "C"), "TRUE") is True
    assert one(spark, FE.as_bool(F.col("v"), "C"), "yes") is False
    assert one(spark, FE.as_bool(F.col("v"), "P"), " Yes ") is True
    assert one(spark, FE.as_bool(F.col("v"), "P"), None) is False


def test_split_list(spark):
    assert one(spark, FE.split_list(F.col("v")), " a, b;;c ,") == ["a", "b", "c"]


def test_size_mib(spark):
    assert one(spark, FE.size_mib(F.col("v")), 1572864, "v long") == 1.5


def test_glob_translation():
    assert IG.glob_to_like("*.tmp") == "%.tmp"
    assert IG.glob_to_like("a_b%?") == "a\\_b\\%_"
    r = IG.Rules.of(["", "  ", "*.tmp", "SRC7"])
    assert r.exact == ("SRC7",) and r.globs == ("%.tmp",)


def test_glob_semantics(spark):
    rules = IG.Rules.of(["*.TMP", "??4", "bin"])
    df = spark.createDataFrame([(n,) for n in ["x.tmp", "a.TmP", "104", "1004", "BIN", "bin2", "a/b.tmp"]],
                               "n string")
    hits = {r.n for r in df.filter(IG.match_one("n", rules)).collect()}
    assert hits == {"x.tmp", "a.TmP", "104", "BIN", "a/b.tmp"}   # '*' spans '/'


def test_subtree_pruning(spark):
    rules = IG.Rules.of(["skip", "/r/keep/deep"])
    rows = [("/r", "/r/a.txt", "a.txt"), ("/r", "/r/skip/b.txt", "b.txt"),
            ("/r", "/r/keep/deep/c.txt", "c.txt"), ("/r", "/r/keep/d.txt", "d.txt"),
            ("/skip", "/skip/e.txt", "e.txt")]
    df = spark.createDataFrame(rows, "root string, path string, name string")
    left = {r.path for r in df.filter(~IG.ignored("name", "path", "root", rules)).collect()}
    # the root itself is tested (so /skip goes), directories above it are not
    assert left == {"/r/a.txt", "/r/keep/d.txt"}


def test_rule_table_join_matches_inline(spark):
    rows = [("/r", "/r/a.txt", "a.txt"), ("/r", "/r/x/b.log", "b.log"), ("/r", "/r/y/c.md", "c.md")]
    files = spark.createDataFrame(rows, "root string, path string, name string")
    pats = spark.createDataFrame([("*.LOG",), ("y",), ("# not a glob",)], "pattern string")
    got = {r.path for r in IG.apply_ignore_table(files, pats, subtree=True, max_broadcast=1).collect()}
    assert got == {"/r/a.txt"}


def test_masking_order_and_idempotence(spark):
    secrets = spark.createDataFrame([("abc",), ("abcdef",), ("ABC",), ("  ",)], "secret string")
    lits = FM.ordered_secret_list(secrets)
    assert lits == ["abcdef", "ABC"]          # blank dropped, case-duplicates merged, longest first
    df = spark.createDataFrame([("xabcdefx abc ABC",)], "t string")
    once = FM.mask_secrets(df, secrets, ["t"])
    twice = FM.mask_secrets(once, secrets, ["t"])
    assert once.first().t == "x***SECRET***x abc ***SECRET***"
    assert twice.first().t == once.first().t


def test_masking_chunks_equal_single_pass(spark):
    lits = [f"s{i:03d}" for i in range(50)]
    df = spark.createDataFrame([(" ".join(lits),)], "t string")
    a = df.select(FM.mask_literals("t", lits, chunk_size=7).alias("m")).first().m
    b = df.select(FM.mask_literals("t", lits, chunk_size=1000).alias("m")).first().m
    assert a == b and "s0" not in a


def test_sensitive_keys(spark):
    df = spark.createDataFrame([("STORAGE_KEY", "x"), ("ApiKey", "y"), ("region", "zz-secret-zz")],
                               "k string, v string")
    got = [r.o for r in df.select(FM.mask_by_key("k", "v", ["secret"]).alias("o")).collect()]
    assert got == ["***SECRET***", "***SECRET***", "zz-***SECRET***-zz"]


def test_registry_add_remove(spark):
    reg = spark.createDataFrame([("Alpha",), ("beta",)], "secret string")
    new = spark.createDataFrame([("ALPHA",), ("gamma",), ("",)], "secret string")
    gone = spark.createDataFrame([("BETA",)], "secret string")
    out = FM.registry_remove(FM.registry_add(reg, new), gone)
    assert sorted(r.secret for r in out.collect()) == ["Alpha", "gamma"]


def test_secret_chunks_keep_global_order(spark):
    vals = [f"{'x' * (i % 7 + 1)}{i:04d}" for i in range(600)]
    secrets = spark.createDataFrame([(v,) for v in vals], "secret string")
    chunks = list(FM.secret_chunks(secrets, chunk_size=50))
    flat = [s for c in chunks for s in c]
    assert len(chunks) > 3 and flat == FM.ordered_secret_list(secrets)
    df = spark.createDataFrame([(" ".join(vals[::-7]),)], "t string")
    a = FM.mask_secrets(df, secrets, ["t"]).first().t
    b = df.select(FM.mask_literals("t", flat).alias("t")).first().t
    assert a == b


def test_mtime_unix_text_roundtrip(spark):
    vals = [1704067260000000, 1704067260500000, 1704067260123456, 0, -1500000]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    got = [r.t for r in df.select(FE.mtime_unix("v").alias("t")).collect()]
    assert got == ["1704067260", "1704067260.5", "1704067260.123456", "0", "-1.5"]
    back = [r.b for r in df.select(FE.mtime_micros_from_text(FE.mtime_unix("v")).alias("b")).collect()]
    assert back == vals


def test_bucket_of_two_level_search(spark):
    from snapplan.operators.windows import bucket_of
    bounds = list(range(0, 1000, 7))            # 143 sorted bounds -> chunks of 11
    keys = [-5, 0, 3, 7, 500, 994, 995, 2000]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = [r.b for r in df.select(bucket_of(F.col("k"), bounds).alias("b")).collect()]
    assert got == [sum(1 for b in bounds if b <= k) for k in keys]


def test_bucketed_running_matches_window(spark):
    from pyspark.sql import Window
    from snapplan.operators.windows import bucketed_running
    rows = [(i % 3 if i % 5 else 0, (i * 7919) % 1000, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g long, k long, v long")
    got = {(r.g, r.k, r.v): (r.run_n, r.run_v) for r in
           bucketed_running(df, ["g"], "k", ["v"], ["v"], n_buckets=16).collect()}
    w = Window.partitionBy("g").orderBy("k", "v").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.g, r.k, r.v): (r.n, r.s) for r in
            df.select("*", F.count(F.lit(1)).over(w).alias("n"), F.sum("v").over(w).alias("s")).collect()}
    assert got == want


def test_as_int_follows_integer_parse_rules(spark):
    # whitespace and a sign are fine; decimals, exponents, hex, junk, overflow are not
    vals = {" 12 ": 12, "+7": 7, "-3": -3, "1.0": -1, "1e3": -1, "0x10": -1, "12a": -1, "": -1,
            "2147483648": -1}
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = {r.v: r.i for r in df.select("v", FE.as_int("v", -1).alias("i")).collect()}
    assert got == vals


def test_secret_chunks_resplit_when_sample_is_coarse(spark, monkeypatch):
    monkeypatch.setattr(FM, "MAX_BOUND_SAMPLE", 10)
    vals = [f"{'y' * (i % 5 + 1)}{i:04d}" for i in range(800)]
    secrets = spark.createDataFrame([(v,) for v in vals], "secret string")
    chunks = list(FM.secret_chunks(secrets, chunk_size=40))
    assert max(len(c) for c in chunks) <= 80
    assert [s for c in chunks for s in c] == FM.ordered_secret_list(secrets)
