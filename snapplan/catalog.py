"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, all reading the driver's tables through the
fixture views (``fixtures.Fixtures``)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fixtures import Fixtures
from .functions import digest as FD
from .functions import encodings as FE
from .functions import masking as FM
from .functions import paths as FP
from .operators import aggregates as AG
from .operators import ignore as IG
from .operators import manifest as MF
from .operators import overlay as OV
from .operators import planning as P
from .operators import runlog as RL
from .operators import store as ST
from .plans import snapshot as S
from .session import cut_lineage
from .sources import listings as LS
from .sources import rules as RU
from .sources import state as SS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _fx(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)


def planned(fx: Fixtures, mode: str = "safe", variant: str = "C") -> DataFrame:
    files = fx.files
    if variant == "P":
        files = IG.apply_ignore_fixed(files)
    opts = S.PlanOptions(mode=mode, variant=variant, order=("path",))
    return S.plan(files, fx.state, fx.store if mode == "safe" else None, opts)


def rule_patterns(fx: Fixtures) -> list[str]:
    """The ignore rules of the fixture rule file, inlined into expressions
    (rule tables go through ``apply_ignore_table``, O-43)."""
    rules = RU.clean_rule_lines(fx.rule_lines)
    return [r["pattern"] for r in rules.orderBy("ord").collect()]


# ==========================================================================
# Pipelines (O-58 .. O-61, O-16)
# ==========================================================================

@query("plan_safe")
def q_plan_safe(spark, sf_dir):
    return planned(_fx(spark, sf_dir), "safe")


@query("plan_fast")
def q_plan_fast(spark, sf_dir):
    return planned(_fx(spark, sf_dir), "fast")


@query("plan_variant_p")
def q_plan_variant_p(spark, sf_dir):
    return planned(_fx(spark, sf_dir), "fast", "P")


@query("plan_variant_p_safe")
def q_plan_variant_p_safe(spark, sf_dir):
    return planned(_fx(spark, sf_dir), "safe", "P")


@query("plan_summary")
def q_plan_summary(spark, sf_dir):
    return S.plan_summary(planned(_fx(spark, sf_dir), "safe"))


@query("plan_summary_fast")
def q_plan_summary_fast(spark, sf_dir):
    return S.plan_summary(planned(_fx(spark, sf_dir), "fast"))


@query("dry_run_report")
def q_dry_run(spark, sf_dir):
    return S.dry_run_report(planned(_fx(spark, sf_dir), "safe"))


# ==========================================================================
# Projections and scalar functions (O-17 .. O-26)
# ==========================================================================

@query("path_parts")
def q_path_parts(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    files = fx.files.select(F.lit("file").alias("src"), F.col("doc_id").alias("id"), "path")
    pages = fx.table("pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"),
                                     F.regexp_replace("url", "^[a-z]+://", "/").alias("path"))
    parts = FP.path_parts("path")
    return files.unionByName(pages).select("src", "id", "path", *[v.alias(k) for k, v in parts.items()])


@query("mtime_encodings")
def q_mtime(spark, sf_dir):
    f = _fx(spark, sf_dir).files
    txt = FE.mtime_text("mtime")
    return f.select("path", txt.alias("mtime_text"), FE.mtime_filetime("mtime").alias("filetime"),
                    FE.mtime_parse(txt).alias("parsed"),
                    FE.mtime_parse("name", "C").alias("name_parsed_c"),
                    FE.mtime_parse("name", "P").alias("name_parsed_p"))


@query("file_extension")
def q_extension(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    names = fx.files.select("name")
    words = (fx.table("documents").select(F.explode(F.split("text", r"\s+")).alias("name"))
             .filter(F.col("name").contains(".")))
    pages = fx.table("pages").select(FP.basename(F.regexp_replace("url", "^[a-z]+://", "/")).alias("name"))
    all_names = names.unionByName(words).unionByName(pages).distinct()
    return all_names.select("name", FP.extension("name", "C").alias("ext_c"),
                            FP.extension("name", "P").alias("ext_p"))


@query("content_digest")
def q_content_digest(spark, sf_dir):
    f = _fx(spark, sf_dir).files.filter(~F.col("is_symlink"))
    return f.select("path", FD.digest("content", "md5").alias("md5"),
                    FD.digest("content", "sha1").alias("sha1"),
                    FD.digest("content", "sha256").alias("sha256"))


@query("symlink_digest")
def q_symlink_digest(spark, sf_dir):
    f = _fx(spark, sf_dir).files
    return f.select("path", "is_symlink", FD.symlink_digest("link_target").alias("link_digest"))


@query("empty_digest")
def q_empty_digest(spark, sf_dir):
    f = _fx(spark, sf_dir).files
    return f.select("path", "size", FD.digest("content").alias("digest_c"),
                    FD.digest_or_zero("content", "size").alias("digest_p"))


@query("digest_roundtrip")
def q_digest_roundtrip(spark, sf_dir):
    f = _fx(spark, sf_dir).files.filter(~F.col("is_symlink"))
    b = FD.digest_bytes("hash")
    return f.select("path", F.octet_length(b).alias("n_bytes"), FD.digest_hex(b).alias("back"))


@query("shard_path")
def q_shard_path(spark, sf_dir):
    f = _fx(spark, sf_dir).files
    return f.select("path", FP.shard_path("hash", "ext", 3).alias("dest3"),
                    FP.shard_path("hash", "ext", 1).alias("dest1"),
                    FP.shard_path("hash", "ext", 0).alias("dest0"))


@query("size_mib")
def q_size_mib(spark, sf_dir):
    f = _fx(spark, sf_dir).files
    return f.select("path", FE.size_mib("size").alias("size_mib"))


@query("lenient_casts")
def q_lenient(spark, sf_dir):
    lay = _fx(spark, sf_dir).layers
    return lay.select("seq", FE.as_int("value", -1).alias("v_int"), FE.as_int("skey", 0).alias("k_int"),
                      FE.as_bool("value", "C").alias("b_c"), FE.as_bool("value", "P").alias("b_p"))


@query("mask_literal_secrets")
def q_mask_literal(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    docs = fx.table("documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"),
                                        F.lit(0).cast("long").alias("turn"), "text")
    conv = fx.table("conversations").select(F.lit("conv").alias("src"), F.col("conv_id").alias("id"),
                                            "turn", "text")
    return FM.mask_secrets(docs.unionByName(conv), fx.secrets, ["text"])


@query("mask_sensitive_keys")
def q_mask_keys(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    s = fx.settings
    return s.select("src", "id", "pos", "skey", FM.mask_by_key("skey", "value", fx.secrets).alias("shown"))


@query("mask_flagged")
def q_mask_flagged(spark, sf_dir):
    s = _fx(spark, sf_dir).settings
    flagged = F.col("skey").isin("token", "STORAGE_KEY")
    return s.select("src", "id", "pos", "skey", FM.mask_flagged("value", flagged).alias("shown"))


def _registry_inputs(fx: Fixtures):
    d = fx.table("documents")
    tok = F.explode(F.regexp_extract_all("text", F.lit(r'token = "([0-9a-f]{40})"'), 1))
    each = d.select("doc_id", tok.alias("secret"))
    new = each.filter("doc_id % 2 = 0").select(F.upper("secret").alias("secret"))
    gone = each.filter("doc_id % 3 = 0").select("secret")
    return new, gone


@query("secret_registry")
def q_registry(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    new, gone = _registry_inputs(fx)
    return FM.registry_remove(FM.registry_add(fx.secrets, new), gone)


# ==========================================================================
# Filters (O-31 .. O-37, O-43)
# ==========================================================================

@query("ignore_exact")
def q_ignore_exact(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return IG.ignore_exact(fx.files, rule_patterns(fx)).select("path")


@query("ignore_glob")
def q_ignore_glob(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return IG.ignore_glob(fx.files, rule_patterns(fx)).select("path")


@query("ignore_full_path")
def q_ignore_full(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return IG.ignore_full_path(fx.files, rule_patterns(fx)).select("path")


@query("ignore_subtree")
def q_ignore_subtree(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return IG.apply_ignore(fx.files, rule_patterns(fx), subtree=True).select("path")


@query("ignore_fixed")
def q_ignore_fixed(spark, sf_dir):
    return IG.apply_ignore_fixed(_fx(spark, sf_dir).files).select("path")


@query("ignore_rule_join")
def q_ignore_rule_join(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    rules = RU.clean_rule_lines(fx.rule_lines)
    return IG.apply_ignore_table(fx.files, rules, "pattern", subtree=True).select("path")


@query("ignore_rule_table")
def q_ignore_rule_table(spark, sf_dir):
    """Files against globs of every form, one rule per customer: a rule set that grows with the data."""
    fx = _fx(spark, sf_dir)
    return IG.apply_ignore_table(fx.files, fx.rule_table, "pattern", subtree=True).select("path")


@query("queue_eligible")
def q_queue_eligible(spark, sf_dir):
    p = planned(_fx(spark, sf_dir), "safe")
    return p.filter(P.queue_eligible("C")).select("path", "hash", "size")


@query("digest_failures")
def q_digest_failures(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    d = P.with_state_digest(fx.files, fx.state)
    ok, bad = P.split_undigested(d)
    return (ok.select("path", F.lit(True).alias("digest_ok"))
            .unionByName(bad.select("path", F.lit(False).alias("digest_ok"))))


# ==========================================================================
# Joins (O-38 .. O-42)
# ==========================================================================

@query("files_with_state")
def q_files_with_state(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return P.with_state(fx.files, fx.state).select("path", "size", "mtime", *P.STATE_COLS)


@query("stale_digests")
def q_stale(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return P.with_state_digest(fx.files, fx.state).select("path", "stale", "hash")


@query("changed_fast")
def q_changed_fast(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return P.flag_changed_fast(P.with_state(fx.files, fx.state)).select("path", "upload_required")


@query("changed_safe")
def q_changed_safe(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    d, _ = P.split_undigested(P.with_state_digest(fx.files, fx.state))
    return P.flag_changed_safe(d, fx.store).select("path", "hash", "size", "store_size", "upload_required")


@query("status_repair")
def q_status_repair(spark, sf_dir):
    p = planned(_fx(spark, sf_dir), "safe")
    return p.filter("repair").select("path", F.col("mtime").alias("backup_mtime"))


# ==========================================================================
# Aggregations, windows, sets (O-44 .. O-57)
# ==========================================================================

@query("dedup_first")
def q_dedup_first(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    d, _ = P.split_undigested(P.with_state_digest(fx.files, fx.state))
    flagged = P.flag_changed_safe(d, fx.store)
    return P.first_per_key(flagged.filter(P.queue_eligible("C")), "hash", ["path"])


@query("overlap_roots")
def q_overlap_roots(spark, sf_dir):
    f = _fx(spark, sf_dir).files
    first_src = f.agg(F.min("root").alias("root_b"))
    a = f.select(F.lit(0).alias("root_ord"), F.lit("/data").alias("root"), "path")
    b = (f.join(first_src, f.root == first_src.root_b, "inner")
         .select(F.lit(1).alias("root_ord"), F.col("root_b").alias("root"), "path"))
    inv = a.unionByName(b)                                            # O-57 union of roots
    uniq = P.unique_paths(inv).select("root_ord", "path", F.lit(1).alias("_u"))   # O-46
    return (inv.join(uniq, ["root_ord", "path"], "left")
            .agg(F.count(F.lit(1)).alias("n_indexed"), F.count("_u").alias("n_manifest")))


@query("inventory_counts")
def q_inventory_counts(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return AG.inventory_counts(fx.files, fx.store, RU.clean_rule_lines(fx.rule_lines),
                               planned(fx, "safe"))


@query("queue_totals")
def q_queue_totals(spark, sf_dir):
    return AG.queue_totals(S.queue(planned(_fx(spark, sf_dir), "safe")))


@query("manifest_rows")
def q_manifest_rows(spark, sf_dir):
    return MF.manifest_rows(planned(_fx(spark, sf_dir), "safe"))


@query("manifest_rows_p")
def q_manifest_rows_p(spark, sf_dir):
    return MF.manifest_rows(planned(_fx(spark, sf_dir), "fast", "P"), variant="P")


@query("manifest_lines")
def q_manifest_lines(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    run_s = fx.files.agg(F.max("mtime")).first()[0]          # one value
    run_ts = dt.datetime.fromtimestamp(run_s, dt.timezone.utc)
    return MF.manifest_lines(MF.manifest_rows(planned(fx, "safe")),
                             MF.manifest_preamble("C", run_ts, ["mode=safe"]))


@query("manifest_archive_path")
def q_archive(spark, sf_dir):
    a = _fx(spark, sf_dir).attempts
    return a.groupBy("job").agg(F.max("ts").alias("run_ts")).select(
        "job", MF.archive_path("job", "run_ts").alias("archive"))


@query("state_pivot")
def q_state_pivot(spark, sf_dir):
    return SS.state_wide(_fx(spark, sf_dir).state_kv, job="job")


@query("state_prune")
def q_state_prune(spark, sf_dir):
    """O-15: state of files that a scan of some roots no longer found goes; below a directory that raised an
    issue it stays."""
    from .plans.run import prune_state
    fx = _fx(spark, sf_dir)
    stored = fx.state.select("path", "st_hash", "st_hash_mtime",
                             F.create_map(F.lit("job"), "backup_mtime").alias("marks"))
    seen = fx.files.filter("doc_id % 4 <> 0").select("dir", "path", F.lit(None).cast("string").alias("issue"))
    troubled = (fx.files.filter("startswith(path, '/data/src3/en/')").select(F.lit("/data/src3/en").alias("dir"))
                .distinct().select("dir", F.col("dir").alias("path"), F.lit("unreadable").alias("issue")))
    roots = ["/data/src3", "/data/src5", "/data/src1"]
    return prune_state(stored, seen.unionByName(troubled), roots).select("path", "st_hash")


@query("state_merge")
def q_state_merge(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return SS.merge_state(fx.state, SS.state_updates(planned(fx, "safe")))


@query("store_listing_by_name")
def q_listing_name(spark, sf_dir):
    return LS.store_from_listing(_fx(spark, sf_dir).listing)


@query("store_listing_checksum")
def q_listing_checksum(spark, sf_dir):
    return LS.store_from_objects(_fx(spark, sf_dir).objects)


@query("store_listing_attr")
def q_listing_attr(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return LS.store_from_kv(fx.state_kv, fx.files.select("path", "size"), attr="user.md5_hash_value")


@query("ignore_rules_from_lines")
def q_rules_from_lines(spark, sf_dir):
    d = _fx(spark, sf_dir).table("documents").select("doc_id", "text")
    return RU.clean_rule_lines(RU.text_lines(d)).select("doc_id", "line_no", "pattern")


@query("split_list_explode")
def q_split_list(spark, sf_dir):
    d = _fx(spark, sf_dir).table("documents").select("doc_id", "text")
    return RU.explode_list(d, "text").select("doc_id", "pos", "item")


@query("ignore_rules_union")
def q_rules_union(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    a = RU.clean_rule_lines(fx.rule_lines).select(F.col("ord").cast("long").alias("ord"), "pattern")
    d = fx.table("documents").select("doc_id", "text")
    b = RU.clean_rule_lines(RU.text_lines(d)).select(
        (F.col("doc_id") * 100000 + F.col("line_no")).cast("long").alias("ord"), "pattern")
    return RU.union_rules(a, b)


@query("overlay_resolve")
def q_overlay_resolve(spark, sf_dir):
    return OV.resolve_layers(_fx(spark, sf_dir).layers)


@query("overlay_report")
def q_overlay_report(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return OV.layer_report(OV.resolve_layers(fx.layers), fx.secrets)


REQUIRED_KEYS = [("DEFAULT", "1-URGENT"), ("DEFAULT", "2-HIGH"), ("DEFAULT", "3-MEDIUM"),
                 ("DEFAULT", "4-NOT SPECIFIED"), ("DEFAULT", "5-LOW"), ("DEFAULT", "BACKUP_TYPE")]


@query("overlay_missing")
def q_overlay_missing(spark, sf_dir):
    lay = _fx(spark, sf_dir).layers
    return OV.missing_keys(OV.resolve_layers(lay), lay, REQUIRED_KEYS)


@query("retry_outcome")
def q_retry(spark, sf_dir):
    out = RL.retry_outcome(_fx(spark, sf_dir).attempts, max_retries=1)
    return out.select("job", "item", "status", "tries", "saved_event_id", "saved_bytes")


@query("run_summary")
def q_run_summary(spark, sf_dir):
    return RL.run_summary(_fx(spark, sf_dir).attempts, max_retries=1)


@query("progress_reports")
def q_progress(spark, sf_dir):
    return RL.progress_reports(_fx(spark, sf_dir).attempts, max_retries=1, every=10)


@query("digest_progress")
def q_digest_progress(spark, sf_dir):
    return RL.digest_progress(planned(_fx(spark, sf_dir), "safe").filter("stale"), every=100)


# ==========================================================================
# Sinks decided as data (O-10 .. O-12)
# ==========================================================================

@query("transfer_class")
def q_transfer(spark, sf_dir):
    return ST.transfer_plan(S.queue(planned(_fx(spark, sf_dir), "safe")))


@query("blob_append_set")
def q_blob_append(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    q = S.queue(planned(fx, "fast"))
    return ST.blob_append_set(q, fx.store).select("hash", "size", "ext", "shard")


@query("put_outcome")
def q_put_outcome(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return ST.put_outcome(S.queue(planned(fx, "fast")), fx.listing, "skip")


# ==========================================================================
# Table snapshots (O-63)
# ==========================================================================

@query("table_snapshot_orders")
def q_snap_orders(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return S.table_snapshot(fx.orders_digest, fx.orders_prev)


@query("table_snapshot_lineitem")
def q_snap_lineitem(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return S.table_snapshot(fx.lineitem_digest.drop("_m"), fx.lineitem_prev)


# ==========================================================================
# Real files (O-01, O-02, O-09, O-62): the fixture files are written below a
# fresh folder of the shared checkpoint area by a Spark job, then scanned.
# ==========================================================================

def _real_files(spark, sf_dir):
    from .plans.run import materialize_files
    from .session import shared_path
    fx = _fx(spark, sf_dir)
    base = shared_path(spark, "files")
    materialize_files(fx.files, base)
    return fx, base


@query("inventory_scan")
def q_inventory_scan(spark, sf_dir):
    from .sources import inventory as INV
    _, base = _real_files(spark, sf_dir)
    scan = INV.inventory(spark, [f"{base}/data"], [])
    n = len(base) + 1
    return INV.files_only(scan).select(
        "root_ord", F.expr(f"substring(path, {n})").alias("path"), "name", "ext",
        F.when(~F.col("is_symlink"), F.col("size")).alias("size"),
        F.when(~F.col("is_symlink"), F.floor(F.col("mtime") / 1_000_000).cast("long")).alias("mtime_s"),
        "is_symlink")


@query("inventory_rounds")
def q_inventory_rounds(spark, sf_dir):
    """The scan in rounds of small tasks; half of the links lead to a directory, which is descended under the link's path."""
    from .plans.run import materialize_files
    from .sources import inventory as INV
    from .sources.rounds import inventory_rounds
    fx, base = _real_files(spark, sf_dir)
    inside = fx.files.filter("is_symlink and doc_id % 82 = 0").select(
        F.concat("link_target", F.lit("/in.txt")).alias("path"), F.col("name").alias("content"), "mtime",
        F.lit(False).alias("is_symlink"), F.lit(None).cast("string").alias("link_target"))
    materialize_files(inside, base)
    scan = inventory_rounds(spark, [f"{base}/data"], ["*.tmp"], budget=100, split=20)
    n = len(base) + 1
    return INV.files_only(scan).select(F.expr(f"substring(path, {n})").alias("path"), "name",
                                       F.when(~F.col("is_symlink"), F.col("size")).alias("size"), "is_symlink")


@query("scan_issues")
def q_scan_issues(spark, sf_dir):
    from .sources import inventory as INV
    _, base = _real_files(spark, sf_dir)
    # the whole tree, a missing root, and an overlapping sub-root
    roots = [f"{base}/data", f"{base}/data/no-such-root", f"{base}/data/src3"]
    scan = INV.inventory(spark, roots, ["*.LOG"])
    n = len(base) + 1
    issues = INV.scan_issues(scan).select("root_ord", F.expr(f"substring(path, {n})").alias("path"), "issue")
    counts = (INV.files_only(scan).groupBy("root_ord").agg(F.count(F.lit(1)).alias("n"))
              .select("root_ord", F.lit("").alias("path"), F.concat(F.lit("files: "), F.col("n").cast("string")).alias("issue")))
    return issues.unionByName(counts)


@query("store_put_if_absent")
def q_store_put(spark, sf_dir):
    from .operators.store import DirectoryStore, write_results
    from .session import shared_path
    from .sources import inventory as INV
    _, base = _real_files(spark, sf_dir)
    files = INV.files_only(INV.inventory(spark, [f"{base}/data"], []))
    empty_state = spark.createDataFrame([], "path string, st_hash string, st_hash_mtime long, backup_mtime long")
    p = S.plan(files, empty_state, None, S.PlanOptions(mode="fast"))
    store = DirectoryStore(spark, shared_path(spark, "store"))
    first = write_results(store.put(S.queue(p)), shared_path(spark, "results"))
    again = write_results(store.put(S.queue(p)), shared_path(spark, "results"))   # idempotent re-run
    n = len(base) + 1
    return (first.withColumn("attempt", F.lit(1)).unionByName(again.withColumn("attempt", F.lit(2)))
            .select("attempt", F.expr(f"substring(path, {n})").alias("path"), "dest", "hash", "status", "bytes"))


@query("store_index")
def q_store_index(spark, sf_dir):
    """Files against an index of the store in runs: its listing, then what two plans queued; two runs merge."""
    import uuid
    from .sources.store_index import StoreIndex
    fx = _fx(spark, sf_dir)
    index = StoreIndex(spark, f"snapplan_index_{uuid.uuid4().hex}", fanout=2)
    index.append(fx.store)
    for mode in ("fast", "safe"):
        index.append(S.queue(planned(fx, mode)).select("hash", "size"))
    d = P.with_state_digest(fx.files, fx.state).select("path", "size", "hash")
    flagged = P.flag_changed_safe(d, index).select("path", "hash", "store_size", "upload_required")
    out = cut_lineage(flagged)
    for run in index.runs():
        spark.sql(f"DROP TABLE {run.table}")
    return out


@query("blob_sink")
def q_blob_sink(spark, sf_dir):
    """Real files put into a blob table twice, in blocks of 4 KiB; what is stored, read back."""
    from .operators.blobs import blob_contents, put_blobs, read_blocks
    from .operators.store import write_results
    from .session import shared_path
    from .sources import inventory as INV
    _, base = _real_files(spark, sf_dir)
    files = INV.files_only(INV.inventory(spark, [f"{base}/data"], []))
    empty_state = spark.createDataFrame([], "path string, st_hash string, st_hash_mtime long, backup_mtime long")
    q = write_results(S.queue(S.plan(files, empty_state, None, S.PlanOptions(mode="fast"))), shared_path(spark, "queue"))
    table = shared_path(spark, "blobs")
    first = put_blobs(q, table, block_bytes=4096)
    again = put_blobs(q, table, block_bytes=4096)
    stored = blob_contents(spark, table).select("hash", F.md5("content").alias("stored_md5"))
    blocks = read_blocks(spark, table).groupBy("hash").agg(F.count(F.lit(1)).alias("n_blocks"))
    n = len(base) + 1
    return (first.withColumn("attempt", F.lit(1)).unionByName(again.withColumn("attempt", F.lit(2)))
            .join(stored, "hash").join(blocks, "hash")
            .select("attempt", F.expr(f"substring(path, {n})").alias("path"), "hash", "status", "bytes", "stored_md5",
                    "n_blocks"))


@query("run_snapshot_blobs")
def q_run_snapshot_blobs(spark, sf_dir):
    """Two whole runs into a blob table; the second one finds everything there."""
    from .operators.store import BlobTableStore
    from .plans.run import run_snapshot
    from .session import shared_path
    _, base = _real_files(spark, sf_dir)
    root, state, work = (shared_path(spark, x) for x in ("store", "state", "work"))
    kw = dict(roots=[f"{base}/data"], store_root=root, state_dir=state, work_dir=work, ignore=["*.tmp"], mode="safe",
              store=BlobTableStore(spark, f"{root}/blobs"))
    r1 = run_snapshot(spark, run_id="20240101T000000", **kw).withColumn("run", F.lit(1))
    r2 = run_snapshot(spark, run_id="20240101T000100", **kw).withColumn("run", F.lit(2))
    return r1.unionByName(r2)


@query("run_snapshot")
def q_run_snapshot(spark, sf_dir):
    from .plans.run import run_snapshot
    from .session import shared_path
    _, base = _real_files(spark, sf_dir)
    store, state, work = (shared_path(spark, x) for x in ("store", "state", "work"))
    kw = dict(roots=[f"{base}/data"], store_root=store, state_dir=state, work_dir=work,
              ignore=["*.tmp"], mode="safe")
    r1 = run_snapshot(spark, run_id="20240101T000000", **kw).withColumn("run", F.lit(1))
    r2 = run_snapshot(spark, run_id="20240101T000100", **kw).withColumn("run", F.lit(2))
    return r1.unionByName(r2)


# ==========================================================================
# Streaming (O-64 .. O-67): inputs are the fixture tables written as ordered
# parquet batches, consumed with an availableNow trigger.
# ==========================================================================

def _state_parts(spark) -> int:
    """State partitions for these demo streams: one per core (the input
    is a few batches of a fixture table)."""
    return max(1, spark.sparkContext.defaultParallelism)


def _stream_files(spark, sf_dir, n_batches=4):
    from .session import shared_path
    from .streaming import stream as ST_
    fx = _fx(spark, sf_dir)
    src = shared_path(spark, "stream-in")
    files = fx.files.drop("hash")
    ST_.write_batches(files, src, "doc_id", n_batches)
    return fx, ST_.read_stream(spark, src, files.schema)


def _stream_attempts(spark, sf_dir, n_batches=4):
    from .session import shared_path
    from .streaming import stream as ST_
    fx = _fx(spark, sf_dir)
    src = shared_path(spark, "stream-attempts")
    ST_.write_batches(fx.attempts, src, FE.epoch_micros("ts"), n_batches)
    return fx, ST_.read_stream(spark, src, fx.attempts.schema)


@query("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    from .session import shared_path
    from .streaming import stream as ST_
    fx, sdf = _stream_files(spark, sf_dir)
    hashed = sdf.select("path", F.when(F.col("is_symlink"), FD.symlink_digest("link_target"))
                        .otherwise(F.md5("content")).alias("hash"))
    out, ck = shared_path(spark, "stream-out"), shared_path(spark, "stream-ck")
    ST_.use_rocksdb(spark)
    ST_.run_to_parquet(ST_.stream_dedup(hashed, "hash"), out, ck, partitions=_state_parts(spark))
    return spark.read.parquet(out).select("hash")


@query("stream_plan")
def q_stream_plan(spark, sf_dir):
    from .session import cut_lineage, shared_path
    from .streaming import stream as ST_
    fx = _fx(spark, sf_dir)
    files, state = fx.files.drop("hash"), cut_lineage(fx.state)
    src, blobs, results, ck, ups = (shared_path(spark, x) for x in
                                    ("stream-in", "stream-blobs", "stream-results", "stream-ck", "stream-state"))
    folders = ST_.write_batches(files, src, "doc_id", 4)
    for sdf in ST_.arrivals(spark, folders, files.schema):
        ST_.stream_plan(sdf, state, blobs, results, ck, mode="safe", state_updates_dir=ups)
    return spark.read.parquet(results).select("path", "hash", "size", "queued", "upload_required")


@query("stream_retry")
def q_stream_retry(spark, sf_dir):
    from .session import shared_path
    from .streaming import stream as ST_
    attempts = _fx(spark, sf_dir).attempts
    src, out, ck = (shared_path(spark, x) for x in ("stream-attempts", "stream-out", "stream-ck"))
    folders = ST_.write_batches(attempts, src, FE.epoch_micros("ts"), 4)
    for sdf in ST_.arrivals(spark, folders, attempts.schema):
        ST_.run_to_parquet(ST_.stream_retry(sdf, max_retries=1), out, ck, partitions=_state_parts(spark))
    return spark.read.parquet(out)


def _scanned(spark, sf_dir):
    """Real files and their scan, as rows of a streamed inventory (mtime in seconds)."""
    from .sources import inventory as INV
    fx, base = _real_files(spark, sf_dir)
    files = INV.files_only(INV.inventory(spark, [f"{base}/data"], []))
    return fx, base, files.select(
        "path", F.lit(1).alias("scan"), "size", F.floor(F.col("mtime") / 1_000_000).cast("long").alias("mtime"), "is_symlink",
        "link_target")


@query("stream_snapshot")
def q_stream_snapshot(spark, sf_dir):
    """Two scans of the same files, one after the other; the second finds later mtimes of a third of them.

    It is judged against what the first one left: digests, marks of what was saved, nothing else.
    """
    from .operators.blobs import put_blobs
    from .session import shared_path
    from .streaming import snapshot_stream as SN
    from .streaming import stream as ST_
    fx, base, scan = _scanned(spark, sf_dir)
    later = FP.stem("name").cast("long") % 3 == 1
    second = scan.withColumn("name", FP.basename("path")).select(
        "path", F.lit(2).alias("scan"), "size", F.when(later, F.col("mtime") + 60)
        .otherwise(F.col("mtime")).alias("mtime"), "is_symlink", "link_target")
    src, work, table = (shared_path(spark, x) for x in ("stream-in", "stream-work", "blobs"))
    scan.write.parquet(f"{src}/a")
    second.write.parquet(f"{src}/b")
    n = len(base) + 1
    known = fx.state.withColumn("path", F.concat(F.lit(base), "path"))
    for k in ("a", "b"):                       # one scan arrives when the other has been dealt with
        seen = ST_.read_stream(spark, f"{src}/" + ("{a}" if k == "a" else "{a,b}"), scan.schema, 1000)
        q = SN.snapshot_query(seen, lambda queue, i: put_blobs(queue, table, commit=f"batch-{i}"), work, known,
                              max_retries=1, delay_s=1, trigger_s=0.2, partitions=_state_parts(spark))
        SN.run_until_done(q, spark, work, 1)
    rows = SN.planned_rows(spark, work).filter(~F.col("hash").startswith("SYM-"))     # a link's mtime is this run's
    return rows.select(F.expr(f"substring(path, {n})").alias("path"), "scan", "mtime", "hash", "stale", "upload_required",
                       "action")


@query("stream_retry_delay")
def q_stream_retry_delay(spark, sf_dir):
    """Files put from a stream into a store that fails some of them up to five times; each comes back after its delay."""
    from .operators.store import copy_to_store
    from .session import shared_path
    from .streaming import snapshot_stream as SN
    from .streaming import stream as ST_
    _, base, scan = _scanned(spark, sf_dir)
    src, work, root = (shared_path(spark, x) for x in ("stream-in", "stream-work", "store"))
    scan.write.parquet(src)

    def put(queue, batch_id):
        # stand-in of a failing store: the file is not found before its try number is above a digit of its hash
        fails = F.col("try_count") < F.conv(F.left("hash", F.lit(1)), 16, 10).cast("int") % 6
        tried = queue.withColumn("path", F.when(fails, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")))
        return copy_to_store(tried, root).withColumn("path", F.regexp_replace("path", r"\.gone$", ""))

    seen = ST_.read_stream(spark, src, scan.schema, 1000)
    q = SN.snapshot_query(seen, put, work, max_retries=3, delay_s=1, trigger_s=0.2, partitions=_state_parts(spark))
    SN.run_until_done(q, spark, work, 3)
    r = SN.put_results(spark, work)
    n = len(base) + 1
    per = r.groupBy("path").agg(F.count(F.lit(1)).alias("attempts"), F.max("tries").alias("tries"),
                                F.max_by("status", "tries").alias("last"), (F.max("at_ms") - F.min("at_ms")).alias("took"))
    return per.select(F.expr(f"substring(path, {n})").alias("path"), "attempts", "tries",
                      F.when(F.col("last") == "failed", "exhausted").otherwise("saved").alias("status"),
                      (F.col("took") >= 1000 * (F.col("attempts") - 1)).alias("delayed"))


@query("stream_totals")
def q_stream_totals(spark, sf_dir):
    from .session import shared_path
    from .streaming import stream as ST_
    _, sdf = _stream_attempts(spark, sf_dir)
    out, ck = shared_path(spark, "stream-out"), shared_path(spark, "stream-ck")
    ST_.run_complete_to_parquet(ST_.stream_totals(sdf), out, ck, partitions=_state_parts(spark))
    return ST_.latest_epoch(spark, out)


# ==========================================================================
# Variant P forms of the decision operators (O-39, O-40, O-42)
# ==========================================================================

@query("stale_digests_p")
def q_stale_p(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    files = IG.apply_ignore_fixed(fx.files)
    return P.with_state_digest(files, fx.state, "P").select("path", "stale", "hash")


@query("changed_fast_p")
def q_changed_fast_p(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return P.flag_changed_fast(P.with_state(fx.files, fx.state), "P").select("path", "upload_required")


@query("status_repair_p")
def q_status_repair_p(spark, sf_dir):
    p = planned(_fx(spark, sf_dir), "safe", "P")
    return p.filter("repair").select("path", F.col("mtime").alias("backup_mtime"))


@query("table_plan_orders")
def q_table_plan_orders(spark, sf_dir):
    """O-63 through ``plan()``: orders as an inventory (key -> path, row
    payload -> content, payload hash -> version) against the state a full
    backup of the previous version left behind."""
    o = _fx(spark, sf_dir).table("orders")
    cols = [F.col("o_custkey").cast("string"), "o_orderstatus", S.stable_text("o_totalprice", "money"),
            S.stable_text("o_orderdate", "date"), "o_orderpriority"]
    cur = S.table_files(o, ["o_orderkey"], cols, "orders")
    prev_src = o.filter(o.o_orderkey % 10 != 0).withColumn(
        "o_orderpriority", F.when(o.o_orderkey % 7 == 0, F.lit("9-OLD")).otherwise(o.o_orderpriority))
    prev = S.table_files(prev_src, ["o_orderkey"], cols, "orders")
    state = prev.select("path", F.md5("content").alias("st_hash"), F.col("mtime").alias("st_hash_mtime"),
                        F.col("mtime").alias("backup_mtime"))
    p = S.plan(cur, state, None, S.PlanOptions(mode="fast", order=("path",)))
    return p.select("path", "name", "hash", "size", "stale", "upload_required", "in_queue", "queued", "dest")


# ==========================================================================
# Inputs on which both sides of a decision occur
# ==========================================================================

@query("put_outcome_mixed")
def q_put_outcome_mixed(spark, sf_dir):
    """Both policies, against a store that has half of the destinations."""
    fx = _fx(spark, sf_dir)
    q = S.queue(planned(fx, "fast"))
    half = fx.listing.filter("doc_id % 2 = 0")
    return (ST.put_outcome(q, half, "skip").withColumn("policy", F.lit("skip"))
            .unionByName(ST.put_outcome(q, half, "overwrite").withColumn("policy", F.lit("overwrite"))))


@query("transfer_class_large")
def q_transfer_large(spark, sf_dir):
    """All classes, both variants, with tiers: the files as if each byte were 100 000."""
    fx = _fx(spark, sf_dir)
    q = S.queue(planned(fx, "safe")).withColumn("size", F.col("size") * 100_000)
    return (ST.transfer_plan(q, is_metadata=True).withColumn("variant", F.lit("C"))
            .unionByName(ST.transfer_plan(q, variant="P", tier=" cool ").withColumn("variant", F.lit("P"))))


@query("lenient_casts_mixed")
def q_lenient_mixed(spark, sf_dir):
    """Spellings of numbers and truth values, one per order, beside its key."""
    o = _fx(spark, sf_dir).table("orders")
    spelled = F.array(*map(F.lit, ("TRUE", "true ", "Yes", "on", "1", "0", "false", "-17", "+5", "1.5", " 42 ", "", "x1")))
    v = F.when(F.col("o_orderkey") % 14 < 13, F.element_at(spelled, (F.col("o_orderkey") % 13 + 1).cast("int")))
    d = o.select(F.col("o_orderkey").alias("k"), v.alias("value"))
    return d.select("k", "value", FE.as_int("value", -1).alias("v_int"), FE.as_bool("value", "C").alias("b_c"),
                    FE.as_bool("value", "P").alias("b_p"))


_NAMED = ["12.LOG", "13.md", "no/such", "/data/src1/*/?1.*", "*/SRC2/de/?.*"]


@query("ignore_exact_mixed")
def q_ignore_exact_mixed(spark, sf_dir):
    return IG.ignore_exact(_fx(spark, sf_dir).files, _NAMED).select("path")


@query("ignore_full_path_mixed")
def q_ignore_full_mixed(spark, sf_dir):
    """Rules that match bare names, and others that match full paths only."""
    return IG.ignore_full_path(_fx(spark, sf_dir).files, _NAMED).select("path")


@query("ignore_fixed_mixed")
def q_ignore_fixed_mixed(spark, sf_dir):
    """Junk names and the same in another case, which stay."""
    k = F.col("doc_id") % 10
    name = (F.when(k == 1, "Thumbs.db").when(k == 2, "thumbs.db").when(k == 3, ".DS_Store").when(k == 4, "desktop.ini")
            .when(k == 5, "Desktop.ini").otherwise(F.col("name")))
    return IG.apply_ignore_fixed(_fx(spark, sf_dir).files.withColumn("name", name)).select("path", "name")


@query("digest_failures_mixed")
def q_digest_failures_mixed(spark, sf_dir):
    """Payloads that could not be read for some rows: a failure where the digest is stale."""
    fx = _fx(spark, sf_dir)
    files = fx.files.withColumn("content", F.when(F.col("doc_id") % 7 != 2, F.col("content")))
    ok, bad = P.split_undigested(P.with_state_digest(files, fx.state))
    return (ok.select("path", F.lit(True).alias("digest_ok"))
            .unionByName(bad.select("path", F.lit(False).alias("digest_ok"))))


@query("manifest_order")
def q_manifest_order(spark, sf_dir):
    """The lines of a written manifest with their places, file after file."""
    from .session import shared_path
    fx = _fx(spark, sf_dir)
    rows = MF.manifest_rows(planned(fx, "safe"))
    path = MF.write_manifest(MF.manifest_lines(rows, MF.manifest_preamble("C", dt.datetime(2024, 1, 1), [])),
                             shared_path(spark, "manifest"), partitions=4)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), F.col("value"))
    lines = files.select("f", F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("k", "line"))
    sizes = lines.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)        # one row per part file
    before = sizes.select("f", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return lines.join(before, "f").select((F.col("before") + F.col("k")).cast("long").alias("place"), "line")
