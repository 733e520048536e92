"""DuckDB oracle SQL, one statement per registered query.

Each statement reads only the raw tables (pre-registered views) through the
fixture CTEs of ``fixtures.FX_SQL``; its column names equal the Spark
query's.  Written independently of the Spark code path, in plain SQL.
"""

from __future__ import annotations

from .fixtures import with_fx

# --------------------------------------------------------------------------
# Snapshot plans
# --------------------------------------------------------------------------

_SHARD3 = "concat(substr(hash, 1, 1), '/', substr(hash, 2, 1), '/', substr(hash, 3, 1), '/', hash, ext)"


def _plan_ctes(mode: str, variant: str = "C") -> list[str]:
    """Extra CTEs ending in ``plan`` with the 13 plan columns."""
    if variant == "C":
        base = "select * from fx_files"
        ext = "ext"
        stale = ("(s.st_hash_mtime is null or s.st_hash_mtime <> f.mtime "
                 "or s.st_hash is null or s.st_hash = '')")
        fresh = ("case when is_symlink then concat('SYM-', base64(cast(link_target as binary))) "
                 "else md5(content) end")
        eligible_extra = " and not starts_with(hash, 'SYM-')"
        keep = "where hash is not null and hash <> ''"
        fast_req = "(backup_mtime is null or backup_mtime <> mtime)"
        repair_safe = "(not upload_required and (backup_mtime is null or backup_mtime <> mtime))"
    else:
        base = "select * from fx_files where name not in ('.DS_Store', 'Thumbs.db', 'desktop.ini')"
        ext = r"regexp_extract(name, '^\.*[^.].*(\.[^.]*)$', 1)"
        stale = "(coalesce(s.st_hash_mtime, 0) <> f.mtime or s.st_hash is null)"
        fresh = "case when size = 0 then '0' else md5(content) end"
        eligible_extra = ""
        keep = ""
        fast_req = "(coalesce(backup_mtime, 0) <> mtime)"
        repair_safe = "(not upload_required and coalesce(st_hash_mtime, 0) <> mtime)"
    if mode == "safe":
        flag = f"""p_flag as (
  select d.*, st.size as store_size, (st.size is null or st.size <> d.size) as upload_required
  from p_dig d left join fx_store st on d.hash = st.hash),
p_flag2 as (select *, {repair_safe} as repair from p_flag)"""
    else:
        flag = f"""p_flag2 as (select *, {fast_req} as upload_required, false as repair from p_dig)"""
    return [
        f"""p_files as ({base})""",
        f"""p_join as (
  select f.path, f.dir, f.name, {ext} as ext, f.size, f.mtime, f.is_symlink, f.link_target, f.content,
         s.st_hash, s.st_hash_mtime, s.backup_mtime, {stale} as stale
  from p_files f left join fx_state s on f.path = s.path)""",
        f"""p_dig as (
  select * from (select *, case when stale then {fresh} else st_hash end as hash from p_join) {keep})""",
        flag,
        f"""p_elig as (
  select *, case when upload_required and size > 0 then 'x' else '' end as in_queue,
         (upload_required and size > 0{eligible_extra}) as eligible
  from p_flag2)""",
        """p_reps as (select hash as r_hash, min(path) as r_path from p_elig where eligible group by hash)""",
        f"""plan as (
  select path, dir, name, ext, hash, size, mtime, stale, upload_required, in_queue,
         (eligible and r_path is not null) as queued,
         case when eligible and r_path is not null then {_SHARD3} end as dest, repair
  from p_elig left join p_reps on hash = r_hash and path = r_path)""",
    ]


def plan_sql(mode: str, variant: str, body: str = "select * from plan") -> str:
    need = ["fx_files", "fx_state"] + (["fx_store"] if mode == "safe" else [])
    return with_fx(need, body, _plan_ctes(mode, variant))


PLAN_SUMMARY_BODY = """select count(*) as n_files, cast(count_if(stale) as bigint) as n_stale, cast(count_if(upload_required) as bigint) as n_flagged,
  cast(count_if(in_queue = 'x') as bigint) as n_marked, cast(count_if(queued) as bigint) as n_queued,
  cast(coalesce(sum(case when queued then size end), 0) as bigint) as queued_bytes,
  cast(count_if(repair) as bigint) as n_repaired, cast(count_if(starts_with(hash, 'SYM-')) as bigint) as n_links,
  cast(count_if(size = 0) as bigint) as n_empty
from plan"""


ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


oracle("plan_safe", plan_sql("safe", "C"))
oracle("plan_fast", plan_sql("fast", "C"))
oracle("plan_variant_p", plan_sql("fast", "P"))
oracle("plan_summary", plan_sql("safe", "C", PLAN_SUMMARY_BODY))
oracle("plan_summary_fast", plan_sql("fast", "C", PLAN_SUMMARY_BODY))


# --------------------------------------------------------------------------
# Plan-derived operators
# --------------------------------------------------------------------------

oracle("plan_variant_p_safe", plan_sql("safe", "P"))
oracle("dry_run_report", plan_sql("safe", "C", """select path, dest,
  concat('[DRY RUN] would copy ', path, ' to ', dest) as line from plan where queued"""))
oracle("queue_eligible", plan_sql("safe", "C", """select path, hash, size from plan
  where upload_required and size > 0 and not starts_with(hash, 'SYM-')"""))
oracle("status_repair", plan_sql("safe", "C", "select path, mtime as backup_mtime from plan where repair"))
oracle("queue_totals", plan_sql("safe", "C", """select count(*) as n_items,
  cast(coalesce(sum(size), 0) as bigint) as total_bytes from plan where queued"""))
oracle("transfer_class", plan_sql("safe", "C", """select path, size,
  case when size > 104857600 then 8 else 4 end as concurrency,
  case when size > 104857600 then 8388608 else 4194304 end as block_bytes,
  cast(null as varchar) as tier, size > 1073741824 as is_large
  from plan where queued"""))
oracle("blob_append_set", with_fx(["fx_files", "fx_state", "fx_store"], """select q.hash, q.size, q.ext,
  substr(q.hash, 1, 1) as shard
  from plan q where q.queued and not exists (select 1 from fx_store s where s.hash = q.hash and s.size = q.size)""",
                                  _plan_ctes("fast", "C")))
oracle("put_outcome", with_fx(["fx_files", "fx_state", "fx_listing"], """select q.path, q.dest,
  case when exists (select 1 from fx_listing l where l.path = q.dest) then 'exists' else 'copied' end as outcome
  from plan q where q.queued""", _plan_ctes("fast", "C")))
oracle("manifest_rows", plan_sql("safe", "C", """select dir, 1 as kind, path,
  concat_ws(',', name, hash, ext, cast(size as varchar), cast(mtime * 10000000 + 116444736000000000 as varchar), in_queue) as line
  from plan
  union all
  select distinct dir, 0 as kind, '' as path, concat('dir >> ', dir) as line from plan"""))
oracle("manifest_rows_p", plan_sql("fast", "P", """select dir, 1 as kind, path,
  concat_ws(',',
    case when regexp_matches(name, '[,"\\r\\n]') then concat('"', replace(name, '"', '""'), '"') else name end,
    case when regexp_matches(hash, '[,"\\r\\n]') then concat('"', replace(hash, '"', '""'), '"') else hash end,
    case when regexp_matches(ext, '[,"\\r\\n]') then concat('"', replace(ext, '"', '""'), '"') else ext end,
    cast(size as varchar), concat(cast(mtime as varchar), '.0'), in_queue) as line
  from plan
  union all
  select distinct dir, 0 as kind, '' as path, concat('dir >> ', dir) as line from plan"""))
oracle("manifest_lines", plan_sql("safe", "C", """select 1 as section, 0 as seq, dir, 1 as kind, path,
  concat_ws(',', name, hash, ext, cast(size as varchar), cast(mtime * 10000000 + 116444736000000000 as varchar), in_queue) as line
  from plan
  union all
  select distinct 1, 0, dir, 0, '', concat('dir >> ', dir) from plan
  union all
  select 0, 0, '', 0, '', concat('Backup run at: ', strftime(make_timestamp(max(mtime) * 1000000), '%Y-%m-%d %H:%M:%S')) from fx_files
  union all select 0, 1, '', 0, '', 'mode=safe'
  union all select 0, 2, '', 0, '', 'EOF'
  union all select 0, 3, '', 0, '', ''
  union all select 0, 4, '', 0, '', 'Filename,Hash,Extension,Size,Modified Time,InQueue'"""))
oracle("digest_progress", plan_sql("safe", "C", """select n, total, n * 100.0::double / total as pct from (
  select row_number() over (order by path) as n, count(*) over () as total from plan where stale)
  where n % 100 = 0"""))
oracle("inventory_counts", with_fx(["fx_files", "fx_state", "fx_store", "fx_rule_lines"], """
select 'files_per_root' as metric, root as scope, count(*) as value from fx_files group by root
union all select 'files_total', '', count(*) from fx_files
union all select 'store_hashes', '', count(*) from fx_store
union all select 'patterns', '', count(*) from fx_rule_lines
  where regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '' and not starts_with(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '#')
union all select 'files_indexed', '', count(*) from plan
union all select 'files_to_upload', '', cast(count_if(queued) as bigint) from plan""", _plan_ctes("safe", "C")))

# --------------------------------------------------------------------------
# Joins
# --------------------------------------------------------------------------

_JOIN = """select f.*, s.st_hash, s.st_hash_mtime, s.backup_mtime from fx_files f left join fx_state s on f.path = s.path"""
_STALE = "(st_hash_mtime is null or st_hash_mtime <> mtime or st_hash is null or st_hash = '')"
_FRESH = "case when is_symlink then concat('SYM-', base64(cast(link_target as binary))) else md5(content) end"
_DIG = f"""j as ({_JOIN}),
d as (select *, {_STALE} as stale2 from j),
h as (select * exclude (hash), stale2 as stale, case when stale2 then {_FRESH} else st_hash end as hash from d)"""

oracle("files_with_state", with_fx(["fx_files", "fx_state"], "select path, size, mtime, st_hash, st_hash_mtime, backup_mtime from j",
                                   [f"j as ({_JOIN})"]))
oracle("stale_digests", with_fx(["fx_files", "fx_state"], "select path, stale, hash from h", [_DIG]))
oracle("digest_failures", with_fx(["fx_files", "fx_state"],
                                  "select path, (hash is not null and hash <> '') as digest_ok from h", [_DIG]))
oracle("changed_fast", with_fx(["fx_files", "fx_state"],
                               "select path, (backup_mtime is null or backup_mtime <> mtime) as upload_required from j",
                               [f"j as ({_JOIN})"]))
oracle("changed_safe", with_fx(["fx_files", "fx_state", "fx_store"], """select h.path, h.hash, h.size, st.size as store_size,
  (st.size is null or st.size <> h.size) as upload_required
  from h left join fx_store st on h.hash = st.hash where h.hash is not null and h.hash <> ''""", [_DIG]))
oracle("dedup_first", with_fx(["fx_files", "fx_state", "fx_store"], """select h.hash, min(h.path) as path
  from h left join fx_store st on h.hash = st.hash
  where h.hash is not null and h.hash <> '' and (st.size is null or st.size <> h.size)
    and h.size > 0 and not starts_with(h.hash, 'SYM-')
  group by h.hash""", [_DIG]))
oracle("overlap_roots", with_fx(["fx_files"], """select count(*) as n_indexed, count(distinct path) as n_manifest from (
  select path from fx_files
  union all select path from fx_files where root = (select min(root) from fx_files))"""))

# --------------------------------------------------------------------------
# Scalars
# --------------------------------------------------------------------------

oracle("path_parts", with_fx(["fx_files"], r"""select src, id, path,
  case when len(parts) = 2 and parts[1] = '' then '/' else array_to_string(parts[1:len(parts) - 1], '/') end as dir,
  parts[len(parts)] as name,
  case when strpos(parts[len(parts)], '.') = 0 then parts[len(parts)]
       else array_to_string(string_split(parts[len(parts)], '.')[1:len(string_split(parts[len(parts)], '.')) - 1], '.')
  end as stem
from (select *, string_split(path, '/') as parts from (select 'file' as src, doc_id as id, path from fx_files
      union all select 'page', page_id, regexp_replace(url, '^[a-z]+://', '/') from pages))"""))
oracle("mtime_encodings", with_fx(["fx_files"], """select path, cast(mtime as varchar) as mtime_text,
  mtime * 10000000 + 116444736000000000 as filetime,
  coalesce(try_cast(cast(mtime as varchar) as double), '-inf'::double) as parsed,
  coalesce(try_cast(name as double), '-inf'::double) as name_parsed_c,
  coalesce(try_cast(name as double), 0.0::double) as name_parsed_p
from fx_files"""))
oracle("file_extension", with_fx(["fx_files"], r"""select name,
  regexp_extract(name, '(\.[^.]+)$', 1) as ext_c,
  regexp_extract(name, '^\.*[^.].*(\.[^.]*)$', 1) as ext_p
from (select name from fx_files
      union select w from (select unnest(string_split_regex(text, '\s+')) as w from documents) where contains(w, '.')
      union select regexp_extract(regexp_replace(url, '^[a-z]+://', '/'), '([^/]*)$', 1) from pages)"""))
oracle("content_digest", with_fx(["fx_files"], """select path, md5(content) as md5, sha1(content) as sha1,
  sha256(content) as sha256 from fx_files where not is_symlink"""))
oracle("symlink_digest", with_fx(["fx_files"], """select path, is_symlink,
  concat('SYM-', to_base64(encode(coalesce(link_target, 'Ziel nicht verfügbar')))) as link_digest from fx_files"""))
oracle("empty_digest", with_fx(["fx_files"], """select path, size, md5(content) as digest_c,
  case when size = 0 then '0' else md5(content) end as digest_p from fx_files"""))
oracle("digest_roundtrip", with_fx(["fx_files"], """select path, cast(octet_length(unhex(hash)) as integer) as n_bytes,
  lower(hex(unhex(hash))) as back from fx_files where not is_symlink"""))
oracle("shard_path", with_fx(["fx_files"], """select path,
  concat(substr(hash, 1, 1), '/', substr(hash, 2, 1), '/', substr(hash, 3, 1), '/', hash, ext) as dest3,
  concat(substr(hash, 1, 1), '/', hash, ext) as dest1,
  concat('/', hash, ext) as dest0 from fx_files"""))
oracle("size_mib", with_fx(["fx_files"], "select path, round(size / 1048576.0::double, 2) as size_mib from fx_files"))
oracle("lenient_casts", with_fx(["fx_layers"], """select seq,
  coalesce(try_cast(value as integer), -1) as v_int, coalesce(try_cast(skey as integer), 0) as k_int,
  coalesce(lower(value) = 'true', false) as b_c,
  coalesce(lower(trim(value)) in ('1', 'true', 'yes', 'on'), false) as b_p from fx_layers"""))

_SECLIST = """sec as (select coalesce(list(secret order by length(secret) desc, secret), []) as arr from (
  select min(secret) as secret from fx_secrets where trim(secret) <> '' group by upper(secret)))"""


def _masked(x: str) -> str:
    return f"list_reduce(list_prepend({x}, sec.arr), lambda acc, s: replace(acc, s, '***SECRET***'))"


_SENSITIVE = ("(contains(lower(skey), 'key') or contains(lower(skey), 'secret') or contains(lower(skey), 'password') "
              "or contains(lower(skey), 'token') or contains(lower(skey), 'credential') or contains(lower(skey), 'apikey'))")

oracle("mask_literal_secrets", with_fx(["fx_secrets"], f"""select src, id, turn, {_masked('text')} as text from (
  select 'doc' as src, doc_id as id, cast(0 as bigint) as turn, text from documents
  union all select 'conv', conv_id, turn, text from conversations) t, sec""", [_SECLIST]))
oracle("mask_sensitive_keys", with_fx(["fx_secrets", "fx_settings"], f"""select src, id, pos, skey,
  case when {_SENSITIVE} then '***SECRET***' else {_masked('value')} end as shown
  from fx_settings, sec""", [_SECLIST]))
oracle("mask_flagged", with_fx(["fx_settings"], """select src, id, pos, skey,
  case when skey in ('token', 'STORAGE_KEY') then 'hidden' else value end as shown from fx_settings"""))
oracle("secret_registry", with_fx(["fx_secrets"], """select secret from (
  select secret, row_number() over (partition by upper(secret) order by r, secret) as rn from (
    select secret, 0 as r from fx_secrets where trim(secret) <> ''
    union all
    select upper(t), 1 from (select doc_id, unnest(regexp_extract_all(text, 'token = "([0-9a-f]{40})"', 1)) as t
      from documents) where doc_id % 2 = 0))
  where rn = 1 and upper(secret) not in (
    select upper(t) from (select doc_id, unnest(regexp_extract_all(text, 'token = "([0-9a-f]{40})"', 1)) as t
      from documents) where doc_id % 3 = 0)"""))

# --------------------------------------------------------------------------
# Ignore rules (regex form of the globs, independent of the LIKE translation)
# --------------------------------------------------------------------------

_RULES = r"""rules as (
  select ord, pattern, (contains(pattern, '*') or contains(pattern, '?')) as is_glob,
         concat('^', replace(replace(regexp_escape(pattern), '\*', '.*'), '\?', '.'), '$') as rx
  from (select ord, regexp_replace(line, '^\s+|\s+$', '', 'g') as pattern from fx_rule_lines)
  where pattern <> '' and not starts_with(pattern, '#'))"""


def _hit(x: str, kinds: str = "all") -> str:
    g = f"(r.is_glob and regexp_full_match({x}, r.rx, 'i'))"
    e = f"(not r.is_glob and upper({x}) = upper(r.pattern))"
    cond = {"all": f"{g} or {e}", "glob": g, "exact": e}[kinds]
    return f"exists (select 1 from rules r where {cond})"


oracle("ignore_exact", with_fx(["fx_files", "fx_rule_lines"],
                               f"select path from fx_files where not {_hit('name', 'exact')}", [_RULES]))
oracle("ignore_glob", with_fx(["fx_files", "fx_rule_lines"],
                              f"select path from fx_files where not {_hit('name', 'glob')}", [_RULES]))
oracle("ignore_full_path", with_fx(["fx_files", "fx_rule_lines"],
                                   f"select path from fx_files where not ({_hit('name')} or {_hit('path')})", [_RULES]))
_ANC = r"""anc as (
  select path, unnest(list_transform(range(lo, len(parts)),
                      lambda i: struct_pack(n := parts[i], p := array_to_string(parts[1:i], '/')))) as a
  from (select path, string_split(path, '/') as parts,
               len(string_split(regexp_replace(root, '/+$', ''), '/')) as lo from fx_files))"""
_SUBTREE = f"""select path from fx_files f where not ({_hit('f.name')} or {_hit('f.path')})
  and not exists (select 1 from anc where anc.path = f.path and ({_hit('anc.a.n')} or {_hit('anc.a.p')}))"""
oracle("ignore_subtree", with_fx(["fx_files", "fx_rule_lines"], _SUBTREE, [_RULES, _ANC]))
oracle("ignore_rule_join", with_fx(["fx_files", "fx_rule_lines"], _SUBTREE, [_RULES, _ANC]))
_TABLE_HIT = "exists (select 1 from like_rules r where {x}.n ilike r.p or {x}.q ilike r.p)"
oracle("ignore_rule_table", with_fx(["fx_files", "fx_rule_table"], f"""select path from (select path, name as n, path as q from fx_files) f
  where not {_TABLE_HIT.format(x="f")} and path not in (
    select anc.path from anc join (select * from (select distinct a.n as n, a.p as q from anc) t
                                   where {_TABLE_HIT.format(x="t")}) bad on anc.a.p = bad.q)""", [
    "like_rules as (select translate(pattern, '*?', '%_') as p from fx_rule_table)", _ANC]))
oracle("ignore_fixed", with_fx(["fx_files"],
                               "select path from fx_files where name not in ('.DS_Store', 'Thumbs.db', 'desktop.ini')"))

# --------------------------------------------------------------------------
# Sources, state, rules
# --------------------------------------------------------------------------

_STEM_OF_PATH = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '')"
oracle("store_listing_by_name", with_fx(["fx_listing"], f"""select hash, max_by(size, path) as size from (
  select {_STEM_OF_PATH} as hash, size, path from fx_listing) where size > 0 and hash <> '' group by hash"""))
oracle("store_listing_checksum", with_fx(["fx_objects"], f"""select hash, max_by(size, path) as size from (
  select case when content_md5 is not null and octet_length(content_md5) > 0 then lower(hex(content_md5))
              else {_STEM_OF_PATH} end as hash, size, path
  from fx_objects where size > 0) where hash is not null and hash <> '' group by hash"""))
oracle("store_listing_attr", with_fx(["fx_state_kv", "fx_files"], """select hash, max_by(size, path) as size from (
  select kv.value as hash, f.size, f.path from fx_state_kv kv join fx_files f on kv.path = f.path
  where kv.attr = 'user.md5_hash_value') group by hash"""))
oracle("state_pivot", with_fx(["fx_state_kv"], """select path,
  max(case when attr = 'user.md5_hash_value' then value end) as st_hash,
  try_cast(max(case when attr = 'user.md5_hash_mtime' then value end) as bigint) as st_hash_mtime,
  try_cast(max(case when attr = 'user.job_backup_mtime' then value end) as bigint) as backup_mtime
from fx_state_kv group by path"""))
oracle("state_prune", with_fx(["fx_files", "fx_state"], """select path, st_hash from fx_state
  where path in (select path from fx_files where doc_id % 4 <> 0)
     or not (starts_with(path, '/data/src3/') or starts_with(path, '/data/src5/') or starts_with(path, '/data/src1/'))
     or starts_with(path, '/data/src3/en/')"""))
oracle("state_merge", plan_sql("safe", "C", """select coalesce(o.path, u.path) as path,
  coalesce(u.new_hash, o.st_hash) as st_hash,
  coalesce(u.new_hash_mtime, o.st_hash_mtime) as st_hash_mtime,
  coalesce(u.new_backup_mtime, o.backup_mtime) as backup_mtime
from fx_state o full outer join (
  select * from (select path,
    case when stale then hash end as new_hash,
    case when stale then mtime end as new_hash_mtime,
    case when repair or queued or starts_with(hash, 'SYM-') then mtime end as new_backup_mtime from plan)
  where new_hash is not null or new_hash_mtime is not null or new_backup_mtime is not null) u on o.path = u.path"""))

_LINES = r"""ln as (
  select doc_id, cast(unnest(range(1, len(ls) + 1)) as integer) as line_no, unnest(ls) as line
  from (select doc_id, string_split(text, chr(10)) as ls from documents)),
cl as (select doc_id, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') as pattern from ln)"""
oracle("ignore_rules_from_lines", with_fx([], """select doc_id, line_no, pattern from cl
  where pattern <> '' and not starts_with(pattern, '#')""", [_LINES]))
oracle("ignore_rules_union", with_fx(["fx_rule_lines"], r"""select 0 as source, cast(ord as bigint) as ord, pattern from (
  select ord, regexp_replace(line, '^\s+|\s+$', '', 'g') as pattern from fx_rule_lines)
  where pattern <> '' and not starts_with(pattern, '#')
union all
select 1, cast(doc_id * 100000 + line_no as bigint), pattern from cl
  where pattern <> '' and not starts_with(pattern, '#')""", [_LINES]))
oracle("split_list_explode", with_fx([], r"""select doc_id, cast(unnest(range(len(arr))) as integer) as pos, unnest(arr) as item from (
  select doc_id, list_filter(list_transform(string_split_regex(text, '[,;]'),
         lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as arr from documents)"""))

# --------------------------------------------------------------------------
# Overlay
# --------------------------------------------------------------------------

_RESOLVED = """resolved as (
  select job, section, skey, value, layer from (
    select *, row_number() over (partition by job, section, skey order by
      case layer when 'cmdline' then 4 when 'env' then 3 when 'file' then 2 when 'default' then 1 else 0 end desc,
      seq desc) as rn
    from fx_layers where value is not null) where rn = 1)"""
oracle("overlay_resolve", with_fx(["fx_layers"], "select * from resolved", [_RESOLVED]))
oracle("overlay_report", with_fx(["fx_layers", "fx_secrets"], f"""select job, section, 1 as kind, skey,
  concat(skey, '=', case when {_SENSITIVE} then '***SECRET***' else {_masked('value')} end, ' (', layer, ')') as line
  from resolved, sec
  union all select distinct job, section, 0, '', concat('[', section, ']') from resolved""", [_RESOLVED, _SECLIST]))
oracle("overlay_missing", with_fx(["fx_layers"], """select j.job, k.section, k.skey
  from (select distinct job from fx_layers) j
  cross join (values ('DEFAULT', '1-URGENT'), ('DEFAULT', '2-HIGH'), ('DEFAULT', '3-MEDIUM'),
                     ('DEFAULT', '4-NOT SPECIFIED'), ('DEFAULT', '5-LOW'), ('DEFAULT', 'BACKUP_TYPE')) k(section, skey)
  where not exists (select 1 from resolved r where r.job = j.job and r.section = k.section and r.skey = k.skey)""",
                                  [_RESOLVED]))

# --------------------------------------------------------------------------
# Run log (max_retries = 1)
# --------------------------------------------------------------------------

_OUTCOME = """att as (select *, row_number() over (partition by job, item order by ts, event_id) as n from fx_attempts),
lim as (select * from att where n <= 2),
g as (select job, item, count(*) as tries_seen, min(case when ok then n end) as sn from lim group by job, item),
outcome as (
  select g.job, g.item,
         case when sn is not null then 'saved' when tries_seen >= 2 then 'exhausted' else 'pending' end as status,
         cast(coalesce(sn, tries_seen) as integer) as tries, l.ts as saved_ts,
         l.event_id as saved_event_id, l.bytes as saved_bytes
  from g left join lim l on l.job = g.job and l.item = g.item and l.n = g.sn),
items as (select job, item, max(bytes) as size from fx_attempts group by job, item),
tot as (select job, count(*) as total_files, cast(sum(size) as bigint) as total_bytes from items group by job)"""
oracle("retry_outcome", with_fx(["fx_attempts"],
                                "select job, item, status, tries, saved_event_id, saved_bytes from outcome", [_OUTCOME]))
oracle("run_summary", with_fx(["fx_attempts"], """select s.job, s.saved_files, t.total_files, s.saved_bytes, t.total_bytes,
  round(s.saved_bytes / 1048576.0::double, 2) as saved_mb, d.duration_s,
  case when s.saved_bytes > 0 and d.duration_s > 0 then (s.saved_bytes / 1048576.0::double) / d.duration_s else 0.0 end as mb_per_s
from (select job, cast(count_if(status = 'saved') as bigint) as saved_files,
             cast(coalesce(sum(case when status = 'saved' then saved_bytes end), 0) as bigint) as saved_bytes
      from outcome group by job) s
join tot t on s.job = t.job
join (select job, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::double as duration_s
      from fx_attempts group by job) d on s.job = d.job""", [_OUTCOME]))
oracle("progress_reports", with_fx(["fx_attempts"], """select r.job, r.n as saved_files, t.total_files,
  r.cum as saved_bytes, t.total_bytes,
  case when t.total_files > 0 then r.n * 100.0::double / t.total_files else 0.0 end as pct_files,
  case when t.total_bytes > 0 then r.cum * 100.0::double / t.total_bytes else 0.0 end as pct_bytes,
  t.total_files - r.n as remaining_files, t.total_bytes - r.cum as remaining_bytes,
  (r.k - st.start_us) / 1000000.0::double as elapsed_s,
  case when (r.k - st.start_us) / 1000000.0::double > 0
       then (r.cum / 1048576.0::double) / ((r.k - st.start_us) / 1000000.0::double) else 0.0 end as mb_per_s,
  case when r.cum > 0 and t.total_bytes > 0
       then ((r.k - st.start_us) / 1000000.0::double) / (r.cum / t.total_bytes)
            - ((r.k - st.start_us) / 1000000.0::double) else 0.0 end as eta_s
from (select job, epoch_us(saved_ts) as k,
             count(*) over w as n, cast(sum(saved_bytes) over w as bigint) as cum
      from outcome where status = 'saved'
      window w as (partition by job order by epoch_us(saved_ts), saved_event_id
                   rows between unbounded preceding and current row)) r
join tot t on r.job = t.job
join (select job, min(epoch_us(ts)) as start_us from fx_attempts group by job) st on r.job = st.job
where r.n % 10 = 0 or r.n = t.total_files""", [_OUTCOME]))
oracle("manifest_archive_path", with_fx(["fx_attempts"], """select job, concat('metadata/', cast(job as varchar), '/',
  strftime(t, '%Y'), '/', strftime(t, '%m'), '/backup_', strftime(t, '%Y-%m-%d_%H-%M-%S'), '.csv') as archive
from (select job, max(ts) as t from fx_attempts group by job)"""))

# --------------------------------------------------------------------------
# Table snapshots
# --------------------------------------------------------------------------


def _snapshot_sql(cur: str, prev: str) -> str:
    return f"""select k, digest, status, (status <> 'unchanged' and r_k is not null) as queued from (
  select c.k, c.digest,
         case when p.digest is null then 'new' when p.digest <> c.digest then 'changed' else 'unchanged' end as status
  from {cur} c left join {prev} p on c.k = p.k) s
left join (select digest as r_digest, min(k) as r_k from (
  select c.k, c.digest from {cur} c left join {prev} p on c.k = p.k
  where p.digest is null or p.digest <> c.digest) group by digest) r on s.digest = r.r_digest and s.k = r.r_k"""


oracle("table_snapshot_orders", with_fx(["fx_orders_prev"], _snapshot_sql("fx_orders", "fx_orders_prev")))
oracle("table_snapshot_lineitem", with_fx(["fx_lineitem_prev"],
                                          _snapshot_sql("(select k, digest from fx_lineitem)", "fx_lineitem_prev")))


# --------------------------------------------------------------------------
# Variant P decision operators
# --------------------------------------------------------------------------

oracle("stale_digests_p", with_fx(["fx_files", "fx_state"], """select path, stale, hash from (
  select f.path, (coalesce(s.st_hash_mtime, 0) <> f.mtime or s.st_hash is null) as stale,
         case when coalesce(s.st_hash_mtime, 0) <> f.mtime or s.st_hash is null
              then (case when f.size = 0 then '0' else md5(f.content) end) else s.st_hash end as hash
  from fx_files f left join fx_state s on f.path = s.path
  where f.name not in ('.DS_Store', 'Thumbs.db', 'desktop.ini'))"""))
oracle("changed_fast_p", with_fx(["fx_files", "fx_state"], """select f.path,
  coalesce(s.backup_mtime, 0) <> f.mtime as upload_required
  from fx_files f left join fx_state s on f.path = s.path"""))
oracle("status_repair_p", plan_sql("safe", "P", "select path, mtime as backup_mtime from plan where repair"))


_ORDER_PAYLOAD = """concat_ws('|', cast(o_custkey as varchar), o_orderstatus,
    cast(cast(round(o_totalprice * 100) as bigint) as varchar), cast(cast(o_orderdate as date) as varchar), {prio})"""
oracle("table_plan_orders", f"""with
cur as (select concat('/orders/', cast(o_orderkey as varchar)) as path, cast(o_orderkey as varchar) as name,
               {_ORDER_PAYLOAD.format(prio="o_orderpriority")} as content from orders),
prev as (select concat('/orders/', cast(o_orderkey as varchar)) as path,
                {_ORDER_PAYLOAD.format(prio="case when o_orderkey % 7 = 0 then '9-OLD' else o_orderpriority end")} as content
         from orders where o_orderkey % 10 <> 0),
j as (select c.path, c.name, md5(c.content) as hash, cast(strlen(c.content) as bigint) as size,
             (p.content is null or p.content <> c.content) as changed
      from cur c left join prev p on c.path = p.path),
e as (select *, changed as stale, changed as upload_required,
             case when changed and size > 0 then 'x' else '' end as in_queue, (changed and size > 0) as eligible from j),
r as (select hash as r_hash, min(path) as r_path from e where eligible group by hash)
select path, name, hash, size, stale, upload_required, in_queue, (eligible and r_path is not null) as queued,
       case when eligible and r_path is not null
            then concat(substr(hash, 1, 1), '/', substr(hash, 2, 1), '/', substr(hash, 3, 1), '/', hash) end as dest
from e left join r on hash = r_hash and path = r_path""")


# --------------------------------------------------------------------------
# Streaming results that do not depend on how rows fall into micro-batches
# --------------------------------------------------------------------------

oracle("stream_dedup", with_fx(["fx_files"], "select distinct hash from fx_files"))
oracle("stream_totals", with_fx(["fx_attempts"], """select job, count(*) as n_attempts,
  cast(count_if(ok) as bigint) as n_saved,
  cast(coalesce(sum(case when ok then bytes end), 0) as bigint) as saved_bytes
from fx_attempts group by job"""))
oracle("stream_retry", with_fx(["fx_attempts"], """select a.job, a.item,
  case when a.ok then 'saved' when a.n = 2 then 'exhausted' else 'retry' end as status,
  cast(a.n as integer) as tries, a.event_id, case when a.ok then a.bytes end as bytes
from (select *, row_number() over (partition by job, item order by ts, event_id) as n from fx_attempts) a
join (select job, item, min(case when ok then n end) as first_ok
      from (select *, row_number() over (partition by job, item order by ts, event_id) as n from fx_attempts)
      group by job, item) f on a.job = f.job and a.item = f.item
where a.n <= 2 and (f.first_ok is null or a.n <= f.first_ok)"""))


# stream_plan: four micro-batches by doc_id value ranges; each batch is planned
# (safe mode, fixture state) against the blobs appended by earlier batches.  A
# hash is stored before batch b exactly when an earlier batch held a non-link,
# non-empty row with that hash (its first such batch appended it).
oracle("stream_plan", with_fx(["fx_files", "fx_state"], """select path, h as hash, size,
  (eligible and r_path is not null) as queued, upload_required
from (
  select e.*, (fb.first_batch is null or fb.first_batch >= e.batch) as upload_required,
         ((fb.first_batch is null or fb.first_batch >= e.batch) and e.elig_type) as eligible
  from e left join (select h as fh, min(batch) as first_batch from e where elig_type group by h) fb on e.h = fb.fh) g
left join (
  select h as r_h, batch as r_b, min(path) as r_path from (
    select e.*, ((fb.first_batch is null or fb.first_batch >= e.batch) and e.elig_type) as eligible
    from e left join (select h as fh, min(batch) as first_batch from e where elig_type group by h) fb on e.h = fb.fh)
  where eligible group by h, batch) r
  on g.h = r.r_h and g.batch = r.r_b and g.path = r.r_path""", [
    """bt as (select f.*, cast(floor((f.doc_id - m.lo) / ((cast(m.hi - m.lo as double) + 1.0) / 4.0)) as integer) as batch
  from fx_files f, (select min(doc_id) as lo, max(doc_id) as hi from fx_files) m)""",
    """j as (select bt.path, bt.batch, bt.size,
         case when s.st_hash_mtime is null or s.st_hash_mtime <> bt.mtime or s.st_hash is null or s.st_hash = ''
              then bt.hash else s.st_hash end as h
  from bt left join fx_state s on bt.path = s.path)""",
    """e as (select *, (size > 0 and not starts_with(h, 'SYM-')) as elig_type from j where h is not null and h <> '')""",
]))


# --------------------------------------------------------------------------
# Real files written from fx_files (paths shown relative to the written tree)
# --------------------------------------------------------------------------

oracle("inventory_scan", with_fx(["fx_files"], """select 0 as root_ord, path, name, ext,
  case when not is_symlink then size end as size, case when not is_symlink then mtime end as mtime_s, is_symlink
from fx_files"""))
_NOT_LOG = "not regexp_full_match(name, '^.*\\.log$', 'i')"
oracle("scan_issues", with_fx(["fx_files"], f"""select 1 as root_ord, '/data/no-such-root' as path, 'missing root' as issue
union all select 0, '', concat('files: ', cast(count(*) as varchar)) from fx_files where {_NOT_LOG} group by 1 having count(*) > 0
union all select 2, '', concat('files: ', cast(count(*) as varchar)) from fx_files
  where root = '/data/src3' and {_NOT_LOG} group by 1 having count(*) > 0"""))
oracle("store_put_if_absent", with_fx(["fx_files"], """select 1 as attempt, path, dest, hash, 'copied' as status, size as bytes from q
union all select 2, path, dest, hash, 'exists', cast(0 as bigint) from q""", [
    """q as (select f.path, concat(substr(f.hash, 1, 1), '/', substr(f.hash, 2, 1), '/', substr(f.hash, 3, 1), '/', f.hash, f.ext) as dest,
         f.hash, f.size
  from fx_files f join (select hash as rh, min(path) as rpath from fx_files where not is_symlink and size > 0 group by hash) r
    on f.path = r.rpath)"""]))
oracle("run_snapshot", with_fx(["fx_files"], """select n as n_files, d as n_queued, d as n_copied, cast(0 as bigint) as n_exists,
  cast(0 as bigint) as n_failed, cast(0 as bigint) as n_repaired, 1 as run from c
union all
select n, cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), e - d, 2 from c""", [
    """kept as (select * from fx_files where not regexp_full_match(name, '^.*\\.tmp$', 'i'))""",
    """c as (select (select count(*) from kept) as n,
                (select count(distinct hash) from kept where not is_symlink and size > 0) as d,
                (select count(*) from kept where not is_symlink and size > 0) as e)"""]))
_FIRST_FILES = """q as (select f.path, f.hash, f.size
  from fx_files f join (select hash as rh, min(path) as rpath from fx_files where not is_symlink and size > 0 group by hash) r
    on f.path = r.rpath)"""
oracle("blob_sink", with_fx(["fx_files"], """select attempt, path, hash, case attempt when 1 then 'copied' else 'exists' end as status,
  case attempt when 1 then size else 0 end as bytes, hash as stored_md5, (size + 4095) // 4096 as n_blocks
from q, (values (1), (2)) a(attempt)""", [_FIRST_FILES]))
oracle("run_snapshot_blobs", ORACLES["run_snapshot"])
oracle("stream_snapshot", with_fx(["fx_files", "fx_state"], """select path, scan, mtime, hash, stale, upload_required,
  case when upload_required and size > 0 then 'put' else 'plan' end as action
from (
  select path, 1 as scan, mtime, hash, stale1 as stale, required1 as upload_required, size from one
  union all
  select path, 2, case when later then mtime + 60 else mtime end, hash, later, later or (required1 and size = 0), size
  from one)""", [
    """one as (
  select f.path, f.mtime, f.size, md5(f.content) as hash, f.doc_id % 3 = 1 as later,
         (s.st_hash_mtime is null or s.st_hash_mtime <> f.mtime or s.st_hash is null) as stale1,
         (s.backup_mtime is null or s.backup_mtime <> f.mtime) as required1
  from fx_files f left join fx_state s on f.path = s.path where not f.is_symlink)"""]))
oracle("stream_retry_delay", with_fx(["fx_files"], """select path, cast(least(k + 1, 4) as bigint) as attempts,
  cast(least(k + 1, 4) as integer) as tries, case when k > 3 then 'exhausted' else 'saved' end as status, true as delayed
from (select path, (strpos('0123456789abcdef', substr(hash, 1, 1)) - 1) % 6 as k
      from fx_files where not is_symlink and size > 0)"""))
_QUEUED = "select hash, size from plan where queued"
oracle("store_index", with_fx(["fx_files", "fx_state", "fx_store"], """select h.path, h.hash, i.size as store_size,
  (i.size is null or i.size <> h.size) as upload_required
from h left join (select hash, size from put union all select hash, size from fx_store where hash not in (select hash from put)) i
  on h.hash = i.hash where h.hash is not null and h.hash <> ''""", [
    _DIG, f"put as (select hash, size from ({plan_sql('fast', 'C', _QUEUED)}) union select hash, size from ({plan_sql('safe', 'C', _QUEUED)}))"]))

# --------------------------------------------------------------------------
# Inputs on which both sides of a decision occur
# --------------------------------------------------------------------------

oracle("put_outcome_mixed", with_fx(["fx_files", "fx_state", "fx_listing"], """select q.path, q.dest, policy,
  case when not exists (select 1 from fx_listing l where l.path = q.dest and l.doc_id % 2 = 0) then 'copied'
       when policy = 'skip' then 'exists' else 'overwritten' end as outcome
  from plan q, (values ('skip'), ('overwrite')) p(policy) where q.queued""", _plan_ctes("fast", "C")))
oracle("transfer_class_large", plan_sql("safe", "C", """select path, size * 100000 as size,
  case when size * 100000 > 104857600 then 8 else 4 end as concurrency,
  case when size * 100000 > 104857600 then 8388608 else 4194304 end as block_bytes,
  case variant when 'C' then 'Cold' else 'Cool' end as tier,
  size * 100000 > case variant when 'C' then 1073741824 else 68157440 end as is_large, variant
  from plan, (values ('C'), ('P')) v(variant) where queued"""))
oracle("lenient_casts_mixed", """select k, value,
  coalesce(case when regexp_full_match(trim(value), '[+-]?[0-9]+') then try_cast(trim(value) as integer) end, -1) as v_int,
  coalesce(lower(value) = 'true', false) as b_c, coalesce(lower(trim(value)) in ('1', 'true', 'yes', 'on'), false) as b_p
from (select o_orderkey as k, case when o_orderkey % 14 < 13 then
  (['TRUE', 'true ', 'Yes', 'on', '1', '0', 'false', '-17', '+5', '1.5', ' 42 ', '', 'x1'])[o_orderkey % 13 + 1] end as value
  from orders)""")
_NAMED = """(upper(name) in ('12.LOG', '13.MD'))"""
oracle("ignore_exact_mixed", with_fx(["fx_files"], f"select path from fx_files where not {_NAMED}"))
oracle("ignore_full_path_mixed", with_fx(["fx_files"], f"""select path from fx_files where not ({_NAMED}
  or regexp_full_match(path, '/data/src1/.*/.1\\..*', 'i') or regexp_full_match(path, '.*/src2/de/.\\..*', 'i'))"""))
oracle("ignore_fixed_mixed", with_fx(["fx_files"], """select path, name from (select path, case doc_id % 10
    when 1 then 'Thumbs.db' when 2 then 'thumbs.db' when 3 then '.DS_Store' when 4 then 'desktop.ini'
    when 5 then 'Desktop.ini' else name end as name from fx_files)
  where name not in ('Thumbs.db', '.DS_Store', 'desktop.ini')"""))
oracle("digest_failures_mixed", with_fx(["fx_files", "fx_state"], """select path,
  case when stale then is_symlink or doc_id % 7 <> 2 else hash is not null end as digest_ok from h""", [_DIG]))
oracle("manifest_order", plan_sql("safe", "C", """select row_number() over (order by section, seq, dir, kind, path) - 1 as place, line
from (
  select 1 as section, 0 as seq, dir, 1 as kind, path,
    concat_ws(',', name, hash, ext, cast(size as varchar), cast(mtime * 10000000 + 116444736000000000 as varchar), in_queue) as line
  from plan
  union all select distinct 1, 0, dir, 0, '', concat('dir >> ', dir) from plan
  union all select 0, seq, '', 0, '', line from (values (0, 'Backup run at: 2024-01-01 00:00:00'), (1, 'EOF'), (2, ''),
    (3, 'Filename,Hash,Extension,Size,Modified Time,InQueue')) pre(seq, line))"""))
oracle("inventory_rounds", with_fx(["fx_files"], """select path, name, case when not is_symlink then size end as size, is_symlink
from fx_files where ext <> '.tmp' and not (is_symlink and doc_id % 82 = 0)
union all
select concat(path, '/in.txt'), 'in.txt', strlen(name), false from fx_files where ext <> '.tmp' and is_symlink and doc_id % 82 = 0
union all
select concat(link_target, '/in.txt'), 'in.txt', strlen(name), false from fx_files where is_symlink and doc_id % 82 = 0"""))
