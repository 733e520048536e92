"""plan() against a brute-force loop over the files in listing order, on
generated inventories (content collisions, empty files, links, missing or
stale state, store entries with wrong sizes)."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapplan.plans import snapshot as S

FILE = st.tuples(st.sampled_from(["", "a", "b", "abc", "zz"]),      # content
                 st.booleans(),                                      # is link
                 st.integers(0, 2),                                  # state kind
                 st.integers(0, 2))                                  # backup kind


def brute(files, state, store, mode):
    out, queued_hashes = {}, set()
    for f in sorted(files, key=lambda r: r["path"]):
        st_ = state.get(f["path"])
        stale = st_ is None or st_["st_hash_mtime"] != f["mtime"] or not st_["st_hash"]
        if stale:
            h = ("SYM-" + __import__("base64").b64encode(f["link_target"].encode()).decode()
                 if f["is_symlink"] else hashlib.md5(f["content"].encode()).hexdigest())
        else:
            h = st_["st_hash"]
        backup = st_["backup_mtime"] if st_ else None
        repair = False
        if mode == "safe":
            req = h not in store or store[h] != f["size"]
            repair = (not req) and backup != f["mtime"]
        else:
            req = backup != f["mtime"]
        mark = "x" if req and f["size"] > 0 else ""
        eligible = req and f["size"] > 0 and not h.startswith("SYM-")
        q = eligible and h not in queued_hashes
        if q:
            queued_hashes.add(h)
        out[f["path"]] = (h, stale, req, mark, q, repair)
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(FILE, min_size=1, max_size=25), st.sampled_from(["safe", "fast"]))
def test_plan_equals_bruteforce(spark, spec, mode):
    files, state, store = [], {}, {}
    for i, (content, link, skind, bkind) in enumerate(spec):
        path = f"/r/d{i % 3}/f{i:02d}.txt"
        mtime = 1000 + i
        f = {"path": path, "dir": f"/r/d{i % 3}", "name": f"f{i:02d}.txt", "ext": ".txt",
             "content": content, "size": len(content), "mtime": mtime, "is_symlink": link,
             "link_target": f"/t/{content}" if link else None}
        files.append(f)
        real = hashlib.md5(content.encode()).hexdigest()
        if skind == 1:
            state[path] = {"st_hash": real, "st_hash_mtime": mtime,
                           "backup_mtime": [None, mtime, mtime - 1][bkind]}
        elif skind == 2:
            state[path] = {"st_hash": real, "st_hash_mtime": mtime - 5,
                           "backup_mtime": [None, mtime, mtime - 1][bkind]}
        if i % 2 == 0 and content:
            store[real] = len(content) + (1 if i % 4 == 0 else 0)
    fdf = spark.createDataFrame(files, "path string, dir string, name string, ext string, content string, "
                                       "size long, mtime long, is_symlink boolean, link_target string")
    sdf = spark.createDataFrame([{"path": p, **v} for p, v in state.items()],
                                "path string, st_hash string, st_hash_mtime long, backup_mtime long")
    stdf = spark.createDataFrame(list(store.items()), "hash string, size long")
    got = S.plan(fdf, sdf, stdf if mode == "safe" else None,
                 S.PlanOptions(mode=mode, order=("path",), hot_min_rows=0)).collect()
    want = brute(files, state, store, mode)
    assert {r.path: (r.hash, r.stale, r.upload_required, r.in_queue, r.queued, r.repair) for r in got} == want


def brute_p(files, state, store, mode):
    out, queued_hashes = {}, set()
    for f in sorted(files, key=lambda r: r["path"]):
        st_ = state.get(f["path"])
        hm = st_["st_hash_mtime"] if st_ and st_["st_hash_mtime"] is not None else 0
        h_old = st_["st_hash"] if st_ else None
        stale = hm != f["mtime"] or h_old is None
        h = ("0" if f["size"] == 0 else hashlib.md5(f["content"].encode()).hexdigest()) if stale else h_old
        backup = st_["backup_mtime"] if st_ and st_["backup_mtime"] is not None else 0
        repair = False
        if mode == "safe":
            req = h not in store or store[h] != f["size"]
            repair = (not req) and hm != f["mtime"]
        else:
            req = backup != f["mtime"]
        mark = "x" if req and f["size"] > 0 else ""
        eligible = req and f["size"] > 0
        q = eligible and h not in queued_hashes
        if q:
            queued_hashes.add(h)
        out[f["path"]] = (h, stale, req, mark, q, repair)
    return out


@settings(max_examples=10, deadline=None)
@given(st.lists(FILE, min_size=1, max_size=25), st.sampled_from(["safe", "fast"]))
def test_plan_variant_p_equals_bruteforce(spark, spec, mode):
    files, state, store = [], {}, {}
    for i, (content, link, skind, bkind) in enumerate(spec):
        path = f"/r/d{i % 3}/f{i:02d}.txt"
        mtime = 1000 + i
        files.append({"path": path, "dir": f"/r/d{i % 3}", "name": f"f{i:02d}.txt", "ext": ".txt",
                      "content": content, "size": len(content), "mtime": mtime, "is_symlink": link,
                      "link_target": f"/t/{content}" if link else None})
        real = hashlib.md5(content.encode()).hexdigest() if content else "0"
        if skind == 1:
            state[path] = {"st_hash": real, "st_hash_mtime": mtime, "backup_mtime": [None, mtime, mtime - 1][bkind]}
        elif skind == 2:
            state[path] = {"st_hash": real, "st_hash_mtime": None, "backup_mtime": [None, mtime, mtime - 1][bkind]}
        if i % 2 == 0 and content:
            store[real] = len(content) + (1 if i % 4 == 0 else 0)
    fdf = spark.createDataFrame(files, "path string, dir string, name string, ext string, content string, "
                                       "size long, mtime long, is_symlink boolean, link_target string")
    sdf = spark.createDataFrame([{"path": p, **v} for p, v in state.items()],
                                "path string, st_hash string, st_hash_mtime long, backup_mtime long")
    stdf = spark.createDataFrame(list(store.items()), "hash string, size long")
    got = S.plan(fdf, sdf, stdf if mode == "safe" else None,
                 S.PlanOptions(mode=mode, variant="P", order=("path",))).collect()
    want = brute_p(files, state, store, mode)
    assert {r.path: (r.hash, r.stale, r.upload_required, r.in_queue, r.queued, r.repair) for r in got} == want
