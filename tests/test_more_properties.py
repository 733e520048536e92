"""Generated-input checks of scalar operators against plain Python."""

import os
import re

from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapplan.functions import masking as FM
from snapplan.plans import snapshot as S
from snapplan.functions import paths as FP
from snapplan.operators import ignore as IG

names = st.text(alphabet="ab.", min_size=1, max_size=6)


def ext_c(name: str) -> str:
    i = name.rfind(".")
    return "" if i < 0 or i == len(name) - 1 else name[i:]


@settings(max_examples=10, deadline=None)
@given(st.lists(names, min_size=10, max_size=30, unique=True))
def test_extensions_match_python(spark, ns):
    df = spark.createDataFrame([(n,) for n in ns], "n string")
    got = {r.n: (r.c, r.p) for r in df.select("n", FP.extension("n", "C").alias("c"),
                                              FP.extension("n", "P").alias("p")).collect()}
    assert got == {n: (ext_c(n), os.path.splitext(n)[1]) for n in ns}


secret_s = st.text(alphabet="abS*ET", min_size=1, max_size=4)


@settings(max_examples=10, deadline=None)
@given(st.lists(secret_s, min_size=1, max_size=8, unique=True),
       st.lists(st.text(alphabet="abS*ETR x", max_size=30), min_size=5, max_size=15))
def test_one_pass_masking_equals_sequential(spark, secrets, texts):
    order = sorted(set(secrets), key=lambda s: (-len(s), s))
    def seq(t):
        for s in order:
            t = t.replace(s, FM.SECRET_PLACEHOLDER)
        return t
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.m for r in df.select("i", FM.mask_found("t", order).alias("m")).collect()}
    assert got == {i: seq(t) for i, t in enumerate(texts)}


seg = st.sampled_from(["a", "b", "skip", "x.tmp", "Deep", "c.md"])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(seg, min_size=1, max_size=4), min_size=5, max_size=20),
       st.lists(st.sampled_from(["skip", "*.TMP", "deep", "/r/a/b", "?.md", "c*"]), min_size=1, max_size=3))
def test_subtree_ignore_equals_walk(spark, paths, patterns):
    rows = sorted({("/r", "/r/" + "/".join(p), p[-1]) for p in paths})
    def hit(s):
        for pat in patterns:
            if "*" in pat or "?" in pat:
                rx = "^" + re.escape(pat).replace(r"\*", ".*").replace(r"\?", ".") + "$"
                if re.match(rx, s, re.IGNORECASE | re.DOTALL):
                    return True
            elif s.upper() == pat.upper():
                return True
        return False
    def ignored(path):
        parts = path.split("/")            # ['', 'r', ...]
        for i in range(2, len(parts) + 1):  # the root '/r' and below, the file last
            if hit(parts[i - 1]) or hit("/".join(parts[:i])):
                return True
        return False
    want = {p for _, p, _ in rows if not ignored(p)}
    df = spark.createDataFrame(rows, "root string, path string, name string")
    got = {r.path for r in IG.apply_ignore(df, patterns, subtree=True).collect()}
    assert got == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["/a", "/a/b", "/b", "/a b", "/ä"]),
                          st.text(alphabet="xyz.", min_size=1, max_size=4)), min_size=1, max_size=30, unique=True))
def test_manifest_text_order(spark, entries):
    import tempfile
    from snapplan.operators import manifest as MF
    rows = [{"dir": d, "path": f"{d}/{n}", "name": n, "hash": "h" + n, "ext": "", "size": len(n),
             "mtime": 1704067200, "in_queue": "x"} for d, n in entries]
    df = spark.createDataFrame(rows, "dir string, path string, name string, hash string, ext string, "
                                     "size long, mtime long, in_queue string")
    out = tempfile.mkdtemp(prefix="snapplan-manifest-") + "/m"
    MF.write_manifest(MF.manifest_lines(MF.manifest_rows(df), ["run"]), out, partitions=3)
    import glob
    text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(out + "/part-*")))
    want = ["run", "EOF", "", MF.MANIFEST_HEADER]
    for d in sorted({r["dir"] for r in rows}, key=lambda s: s.encode()):
        want.append("dir >> " + d)
        for r in sorted((r for r in rows if r["dir"] == d), key=lambda r: r["path"].encode()):
            want.append(f"{r['name']},{r['hash']},,{r['size']},133485408000000000,x")
    assert text.splitlines() == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["K1", "K2"]),
                          st.one_of(st.none(), st.text(alphabet="ab", min_size=1, max_size=2)),
                          st.sampled_from(["default", "file", "env", "cmdline"])), min_size=1, max_size=40))
def test_overlay_resolution_equals_bruteforce(spark, rows):
    from snapplan.operators import overlay as OV
    data = [(job, "S", k, v, layer, i) for i, (job, k, v, layer) in enumerate(rows)]
    df = spark.createDataFrame(data, "job long, section string, skey string, value string, layer string, seq long")
    got = {(r.job, r.skey): (r.value, r.layer) for r in OV.resolve_layers(df).collect()}
    want = {}
    for job, sec, k, v, layer, seq in data:
        if v is None:
            continue
        cand = (OV.LAYER_RANK[layer], seq, v, layer)
        if (job, k) not in want or cand[:2] > want[(job, k)][:2]:
            want[(job, k)] = cand
    assert got == {key: (c[2], c[3]) for key, c in want.items()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["i1", "i2", "i3"]), st.integers(0, 5), st.booleans(),
                          st.integers(1, 99)), min_size=1, max_size=30), st.integers(0, 3))
def test_retry_outcome_equals_bruteforce(spark, rows, max_retries):
    import datetime as dt
    from snapplan.operators import runlog as RL
    data = [(1, item, dt.datetime(2024, 1, 1, 0, 0, sec), i, ok, b) for i, (item, sec, ok, b) in enumerate(rows)]
    df = spark.createDataFrame(data, "job int, item string, ts timestamp_ntz, event_id long, ok boolean, bytes long")
    got = {r.item: (r.status, r.tries, r.saved_event_id) for r in RL.retry_outcome(df, max_retries).collect()}
    want = {}
    for item in {d[1] for d in data}:
        att = sorted((d for d in data if d[1] == item), key=lambda d: (d[2], d[3]))[: max_retries + 1]
        first_ok = next((n for n, d in enumerate(att, 1) if d[4]), None)
        if first_ok:
            want[item] = ("saved", first_ok, att[first_ok - 1][3])
        elif len(att) == max_retries + 1:
            want[item] = ("exhausted", len(att), None)
        else:
            want[item] = ("pending", len(att), None)
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a/", "b/c/", ""]), st.sampled_from(["h1", "h2", "", ".x"]),
                          st.sampled_from(["", ".bin", ".tar.gz", "."]), st.integers(0, 3)),
                min_size=1, max_size=20))
def test_store_from_listing_equals_bruteforce(spark, rows):
    from snapplan.sources.listings import store_from_listing
    listing = sorted({(d + h + e, s) for d, h, e, s in rows})
    df = spark.createDataFrame(listing, "path string, size long")
    got = {r.hash: r.size for r in store_from_listing(df).collect()}
    want = {}
    for path, size in sorted(listing):                  # greatest path listed last wins
        name = path.rsplit("/", 1)[-1]
        stem = name[: name.rfind(".")] if "." in name else name
        if stem and size > 0:
            want[stem] = size
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.sampled_from(["d1", "d2", "d3", "d4"]), min_size=1, max_size=20),
       st.dictionaries(st.integers(0, 30), st.sampled_from(["d1", "d2", "d9"]), max_size=20))
def test_table_snapshot_equals_bruteforce(spark, cur, prev):
    from snapplan.plans import snapshot as S
    c = spark.createDataFrame(sorted(cur.items()), "k long, digest string")
    p = spark.createDataFrame(sorted(prev.items()), "k long, digest string")
    got = {r.k: (r.status, r.queued) for r in S.table_snapshot(c, p).collect()}
    status = {k: "new" if k not in prev else ("changed" if prev[k] != d else "unchanged") for k, d in cur.items()}
    first = {}
    for k in sorted(cur):
        if status[k] != "unchanged":
            first.setdefault(cur[k], k)
    assert got == {k: (status[k], first.get(cur[k]) == k) for k in cur}


@settings(max_examples=8, deadline=None)
@example(["/", "/a", "//a", "a", "/a/b.c", "//", "a/"])
@given(st.lists(st.text(alphabet="ab./", min_size=1, max_size=10), min_size=5, max_size=20, unique=True))
def test_path_parts_equal_python(spark, paths):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    parts = FP.path_parts("p")
    got = {r.p: (r.dir, r.name, r.stem) for r in df.select("p", *[v.alias(k) for k, v in parts.items()]).collect()}
    def ref(p):
        d, sep, n = p.rpartition("/")
        stem = n[: n.rfind(".")] if "." in n else n
        return ("/" if sep and n and not d else d, n, stem)
    assert got == {p: ref(p) for p in paths}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["/x", "/y", "/z"]),
                          st.sampled_from(["user.md5_hash_value", "user.md5_hash_mtime", "user.job_backup_mtime",
                                           "user.other"]),
                          st.sampled_from(["7", "12", "abc"])), min_size=1, max_size=15))
def test_state_wide_equals_bruteforce(spark, rows):
    from snapplan.sources import state as SS
    kv = {}
    for p, a, v in rows:                       # one value per (path, attribute): keep the greatest
        kv[(p, a)] = max(kv.get((p, a), v), v)
    df = spark.createDataFrame([(p, a, v) for (p, a), v in kv.items()], "path string, attr string, value string")
    got = {tuple(r) for r in SS.state_wide(df).collect()}
    want = set()
    for p in {p for p, _ in kv}:
        h = kv.get((p, "user.md5_hash_value"))
        hm, bm = kv.get((p, "user.md5_hash_mtime")), kv.get((p, "user.job_backup_mtime"))
        as_long = lambda v: int(v) if v is not None and v.isdigit() else None
        row = (p, h, as_long(hm), as_long(bm))
        if any(x is not None for x in row[1:]):
            want.add(row)
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="0123456789abcdef", min_size=1, max_size=6),
                          st.sampled_from(["", ".txt", ".tar.gz"])), min_size=1, max_size=15),
       st.integers(0, 8))
def test_shard_path_equals_python(spark, rows, depth):
    df = spark.createDataFrame(rows, "h string, e string")
    got = [r.d for r in df.select(FP.shard_path("h", "e", depth).alias("d")).collect()]
    want = ["/".join(h[i] for i in range(min(depth, len(h)))) + "/" + h + e for h, e in rows]
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab ,;\t", max_size=12), min_size=1, max_size=15))
def test_split_list_equals_python(spark, values):
    from snapplan.functions import encodings as FE
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.l for r in df.select("i", FE.split_list("v").alias("l")).collect()}
    want = {i: [x.strip() for x in v.replace(";", ",").split(",") if x.strip()] for i, v in enumerate(values)}
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_digests_equal_hashlib(spark, texts):
    import hashlib
    from snapplan.functions import digest as FD
    texts = [t.encode("utf-8", "surrogatepass").decode("utf-8", "ignore") for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.m, r.s1, r.s2) for r in df.select("i", FD.digest("t", "md5").alias("m"),
                                                    FD.digest("t", "sha1").alias("s1"),
                                                    FD.digest("t", "sha256").alias("s2")).collect()}
    want = {i: tuple(hashlib.new(a, t.encode("utf-8")).hexdigest() for a in ("md5", "sha1", "sha256"))
            for i, t in enumerate(texts)}
    assert got == want


def test_table_snapshot_with_repeated_keys(spark):
    """A key may come twice, changed and unchanged, and be the first of two digests."""
    cur = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"), ("c", "z"), ("c", "z")]
    prev = [("a", "y"), ("b", "z"), ("b", "q")]
    got = sorted(tuple(r) for r in S.table_snapshot(spark.createDataFrame(cur, "k string, digest string"),
                                                    spark.createDataFrame(prev, "k string, digest string")).collect())
    want = []
    for k, d in cur:
        olds = [p for j, p in prev if j == k] or [None]
        want += [(k, d, "new" if p is None else "changed" if p != d else "unchanged") for p in olds]
    first = {}
    for k, d, status in want:
        if status != "unchanged":
            first[d] = min(first.get(d, k), k)
    assert got == sorted((k, d, s, s != "unchanged" and first[d] == k) for k, d, s in want)
