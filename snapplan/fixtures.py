"""Fixture views derived deterministically from the driver's tables.

Two forms of the same derivation:

* ``Fixtures`` builds each view lazily as a Spark DataFrame (DataFrame API),
* ``FX_SQL`` holds the CTE text used by the DuckDB oracles.

Both read only the given parquet tables, so every query built on them grows
with the data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.digest import symlink_digest
from .session import apply_runtime_conf

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


class Fixtures:
    """Lazily built fixture DataFrames for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        apply_runtime_conf(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        d = self.table("documents")
        ext = (F.when(d.doc_id % 5 == 0, ".txt").when(d.doc_id % 5 == 1, ".tmp")
               .when(d.doc_id % 5 == 2, ".log").when(d.doc_id % 5 == 3, ".MD").otherwise(""))
        link = d.doc_id % 41 == 0
        return d.select(
            "doc_id",
            F.concat(F.lit("/data/"), "source").alias("root"),
            F.concat(F.lit("/data/"), "source", F.lit("/"), "lang").alias("dir"),
            ext.alias("ext"),
            F.when(d.doc_id % 53 == 0, F.lit("")).otherwise(d.text).alias("content"),
            link.alias("is_symlink"),
            F.when(link, F.concat(F.lit("/data/shared/"), d.doc_id.cast("string"))).alias("link_target"),
            (F.lit(1704067200) + d.doc_id * 60).alias("mtime"),
        )

    @cached_property
    def files(self) -> DataFrame:
        r = self.raw
        name = F.concat(r.doc_id.cast("string"), r.ext)
        return r.select(
            "doc_id", "root", "dir", name.alias("name"), "ext",
            F.concat(r.dir, F.lit("/"), name).alias("path"),
            "content", F.octet_length("content").cast("long").alias("size"), "mtime",
            "is_symlink", "link_target",
            F.when(r.is_symlink, symlink_digest("link_target")).otherwise(F.md5("content")).alias("hash"),
        )

    @cached_property
    def state(self) -> DataFrame:
        f = self.files
        return f.filter(f.doc_id % 4 != 0).select(
            "path",
            F.when(f.doc_id % 12 == 1, F.lit(None).cast("string")).otherwise(f.hash).alias("st_hash"),
            F.when(f.doc_id % 6 == 1, f.mtime - 60).otherwise(f.mtime).alias("st_hash_mtime"),
            F.when(f.doc_id % 3 == 0, f.mtime).when(f.doc_id % 3 == 1, f.mtime - 60).alias("backup_mtime"),
        )

    @cached_property
    def state_kv(self) -> DataFrame:
        s = self.state
        a = s.filter(s.st_hash.isNotNull()).select("path", F.lit("user.md5_hash_value").alias("attr"),
                                                     F.col("st_hash").alias("value"))
        b = s.select("path", F.lit("user.md5_hash_mtime").alias("attr"),
                     F.col("st_hash_mtime").cast("string").alias("value"))
        c = s.filter(s.backup_mtime.isNotNull()).select(
            "path", F.lit("user.job_backup_mtime").alias("attr"),
            F.col("backup_mtime").cast("string").alias("value"))
        return a.unionByName(b).unionByName(c)

    @cached_property
    def store(self) -> DataFrame:
        f = self.files
        return (f.filter((f.doc_id % 2 == 0) & ~f.is_symlink & (f.size > 0))
                .groupBy("hash")
                .agg(F.max(f.size + F.when(f.doc_id % 14 == 0, 1).otherwise(0)).alias("size")))

    @cached_property
    def listing(self) -> DataFrame:
        f = self.files
        return f.filter(~f.is_symlink).select(
            F.concat(F.substring("hash", 1, 1), F.lit("/"), F.substring("hash", 2, 1), F.lit("/"),
                     F.substring("hash", 3, 1), F.lit("/"), "hash", "ext").alias("path"),
            "size", "doc_id")

    @cached_property
    def objects(self) -> DataFrame:
        l, f = self.listing.alias("l"), self.files.alias("f")
        return l.join(f, F.col("l.doc_id") == F.col("f.doc_id")).select(
            F.col("l.path"), F.col("l.size"),
            F.when(F.col("l.doc_id") % 6 != 0, F.unhex(F.col("f.hash"))).alias("content_md5"))

    @cached_property
    def rule_lines(self) -> DataFrame:
        rows = [(1, "# comment"), (2, ""), (3, "  *.tmp  "), (4, "*.md"), (5, "SRC7"),
                (6, "/data/src3/en"), (7, "bin/Debug"), (8, "??4")]
        return self.spark.createDataFrame(rows, "ord int, line string")

    @cached_property
    def rule_table(self) -> DataFrame:
        """Globs with an anchor at their start, at their end and inside, and exact names."""
        k = F.col("c_custkey").cast("string")
        n = F.col("c_custkey") % 4
        return self.table("customer").select(
            F.when(n == 0, F.concat(F.lit("*3"), k, F.lit(".T?p")))
            .when(n == 1, F.concat(k, F.lit(".L*")))
            .when(n == 2, F.concat(F.lit("/data/*/EN/*"), k, F.lit("?.*")))
            .otherwise(F.concat(k, F.lit(".md"))).alias("pattern"))

    @cached_property
    def secrets(self) -> DataFrame:
        d = self.table("documents")
        tok = F.explode(F.regexp_extract_all("text", F.lit(r'token = "([0-9a-f]{40})"'), 1))
        return d.select(tok.alias("secret")).distinct()

    @cached_property
    def attempts(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            (e.user_id % 10).cast("int").alias("job"),
            F.concat(e.user_id.cast("string"), F.lit("/"), e.ts.cast("date").cast("string")).alias("item"),
            "ts", "event_id", (e.event_type != "error").alias("ok"),
            F.round(e.value * 10000).cast("long").alias("bytes"),
        )

    @cached_property
    def layers(self) -> DataFrame:
        o = self.table("orders")
        k = o.o_orderkey
        return o.select(
            o.o_custkey.alias("job"), F.lit("DEFAULT").alias("section"), o.o_orderpriority.alias("skey"),
            F.when(k % 9 != 0, k.cast("string")).alias("value"),
            F.when(k % 4 == 0, "default").when(k % 4 == 1, "file").when(k % 4 == 2, "env")
            .otherwise("cmdline").alias("layer"),
            k.alias("seq"),
        )


    # ---- table snapshots (O-63) -------------------------------------------
    @cached_property
    def orders_digest(self) -> DataFrame:
        o = self.table("orders")
        payload = F.concat_ws("|", o.o_custkey.cast("string"), o.o_orderstatus,
                              F.round(o.o_totalprice * 100).cast("long").cast("string"),
                              o.o_orderdate.cast("date").cast("string"), o.o_orderpriority)
        return o.select(o.o_orderkey.alias("k"), F.md5(payload).alias("digest"))

    @cached_property
    def orders_prev(self) -> DataFrame:
        c = self.orders_digest
        return c.filter(c.k % 10 != 0).select(
            "k", F.when(c.k % 7 == 0, F.md5("digest")).otherwise(c.digest).alias("digest"))

    @cached_property
    def lineitem_digest(self) -> DataFrame:
        li = self.table("lineitem")
        key = F.concat_ws("|", *[li[c].cast("string") for c in
                                 ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
        money = [F.round(li[c] * 100).cast("long").cast("string") for c in
                 ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
        payload = F.concat_ws("|", *money, li.l_returnflag, li.l_linestatus,
                              li.l_shipdate.cast("date").cast("string"))
        return li.select(key.alias("k"), (li.l_orderkey + li.l_linenumber).alias("_m"),
                         F.md5(payload).alias("digest"))

    @cached_property
    def lineitem_prev(self) -> DataFrame:
        c = self.lineitem_digest
        return c.filter(c._m % 10 != 0).select(
            "k", F.when(c._m % 7 == 0, F.md5("digest")).otherwise(c.digest).alias("digest"))

    # ---- settings found in texts (key = "value") -------------------------
    @cached_property
    def doc_settings(self) -> DataFrame:
        d = self.table("documents")
        pat = r'([A-Za-z_]+)\s*=\s*"([^"]*)"'
        pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pat), 1).alias("k"),
                             F.regexp_extract_all("text", F.lit(pat), 2).alias("v"))
        return (d.select("doc_id", F.posexplode(pairs).alias("pos", "kv"))
                .select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "pos",
                        F.col("kv.k").alias("skey"), F.col("kv.v").alias("value")))

    @cached_property
    def settings(self) -> DataFrame:
        """Key/value settings from two real sources: the layered orders
        table and ``key = "value"`` pairs inside documents."""
        lay = self.layers.select(F.lit("layers").alias("src"), F.col("seq").alias("id"),
                                 F.lit(0).alias("pos"), "skey", "value")
        return lay.unionByName(self.doc_settings)


# --------------------------------------------------------------------------
# The same views as SQL text (valid in DuckDB and Spark SQL), in dependency
# order.  ``with_fx`` prefixes the CTEs a query body needs.
# --------------------------------------------------------------------------

FX_SQL: dict[str, str] = {
    "fx_raw": """fx_raw as (
  select doc_id,
         concat('/data/', source) as root,
         concat('/data/', source, '/', lang) as dir,
         case doc_id % 5 when 0 then '.txt' when 1 then '.tmp' when 2 then '.log' when 3 then '.MD' else '' end as ext,
         case when doc_id % 53 = 0 then '' else text end as content,
         doc_id % 41 = 0 as is_symlink,
         case when doc_id % 41 = 0 then concat('/data/shared/', cast(doc_id as string)) end as link_target,
         1704067200 + doc_id * 60 as mtime
  from documents)""",
    "fx_files": """fx_files as (
  select doc_id, root, dir, concat(cast(doc_id as string), ext) as name, ext,
         concat(dir, '/', cast(doc_id as string), ext) as path,
         content, cast(bit_length(content) / 8 as bigint) as size, mtime, is_symlink, link_target,
         case when is_symlink then concat('SYM-', base64(cast(link_target as binary))) else md5(content) end as hash
  from fx_raw)""",
    "fx_state": """fx_state as (
  select path,
         case when doc_id % 12 = 1 then null else hash end as st_hash,
         case when doc_id % 6 = 1 then mtime - 60 else mtime end as st_hash_mtime,
         case when doc_id % 3 = 0 then mtime when doc_id % 3 = 1 then mtime - 60 end as backup_mtime
  from fx_files where doc_id % 4 <> 0)""",
    "fx_state_kv": """fx_state_kv as (
  select path, 'user.md5_hash_value' as attr, st_hash as value from fx_state where st_hash is not null
  union all select path, 'user.md5_hash_mtime', cast(st_hash_mtime as string) from fx_state
  union all select path, 'user.job_backup_mtime', cast(backup_mtime as string) from fx_state where backup_mtime is not null)""",
    "fx_store": """fx_store as (
  select hash, max(size + case when doc_id % 14 = 0 then 1 else 0 end) as size
  from fx_files where doc_id % 2 = 0 and not is_symlink and size > 0 group by hash)""",
    "fx_listing": """fx_listing as (
  select concat(substr(hash, 1, 1), '/', substr(hash, 2, 1), '/', substr(hash, 3, 1), '/', hash, ext) as path, size, doc_id
  from fx_files where not is_symlink)""",
    "fx_objects": """fx_objects as (
  select l.path, l.size, case when l.doc_id % 6 <> 0 then unhex(f.hash) end as content_md5
  from fx_listing l join fx_files f on l.doc_id = f.doc_id)""",
    "fx_rule_lines": """fx_rule_lines as (
  select * from (values (1, '# comment'), (2, ''), (3, '  *.tmp  '), (4, '*.md'), (5, 'SRC7'), (6, '/data/src3/en'),
                        (7, 'bin/Debug'), (8, '??4')) as t(ord, line))""",
    "fx_rule_table": """fx_rule_table as (
  select case c_custkey % 4 when 0 then concat('*3', cast(c_custkey as string), '.T?p')
              when 1 then concat(cast(c_custkey as string), '.L*')
              when 2 then concat('/data/*/EN/*', cast(c_custkey as string), '?.*')
              else concat(cast(c_custkey as string), '.md') end as pattern
  from customer)""",
    "fx_secrets": """fx_secrets as (
  select distinct unnest(regexp_extract_all(text, 'token = "([0-9a-f]{40})"', 1)) as secret from documents)""",
    "fx_attempts": """fx_attempts as (
  select cast(user_id % 10 as int) as job, concat(cast(user_id as string), '/', cast(cast(ts as date) as string)) as item,
         ts, event_id, event_type <> 'error' as ok, cast(round(value * 10000) as bigint) as bytes
  from events)""",
    "fx_layers": """fx_layers as (
  select o_custkey as job, 'DEFAULT' as section, o_orderpriority as skey,
         case when o_orderkey % 9 <> 0 then cast(o_orderkey as string) end as value,
         case o_orderkey % 4 when 0 then 'default' when 1 then 'file' when 2 then 'env' else 'cmdline' end as layer,
         o_orderkey as seq
  from orders)""",
    "fx_orders": """fx_orders as (
  select o_orderkey as k, md5(concat_ws('|', cast(o_custkey as string), o_orderstatus,
         cast(cast(round(o_totalprice * 100) as bigint) as string), cast(cast(o_orderdate as date) as string), o_orderpriority)) as digest
  from orders)""",
    "fx_orders_prev": """fx_orders_prev as (
  select k, case when k % 7 = 0 then md5(digest) else digest end as digest from fx_orders where k % 10 <> 0)""",
    "fx_lineitem": """fx_lineitem as (
  select concat_ws('|', cast(l_orderkey as string), cast(l_partkey as string), cast(l_suppkey as string),
                   cast(l_linenumber as string)) as k,
         l_orderkey + l_linenumber as m,
         md5(concat_ws('|', cast(cast(round(l_quantity * 100) as bigint) as string),
             cast(cast(round(l_extendedprice * 100) as bigint) as string),
             cast(cast(round(l_discount * 100) as bigint) as string),
             cast(cast(round(l_tax * 100) as bigint) as string),
             l_returnflag, l_linestatus, cast(cast(l_shipdate as date) as string))) as digest
  from lineitem)""",
    "fx_lineitem_prev": """fx_lineitem_prev as (
  select k, case when m % 7 = 0 then md5(digest) else digest end as digest from fx_lineitem where m % 10 <> 0)""",
    "fx_doc_settings": """fx_doc_settings as (
  select 'doc' as src, doc_id as id, cast(unnest(range(len(ks))) as integer) as pos, unnest(ks) as skey, unnest(vs) as value
  from (select doc_id, regexp_extract_all(text, '([A-Za-z_]+)\\s*=\\s*"([^"]*)"', 1) as ks,
               regexp_extract_all(text, '([A-Za-z_]+)\\s*=\\s*"([^"]*)"', 2) as vs from documents))""",
    "fx_settings": """fx_settings as (
  select 'layers' as src, seq as id, 0 as pos, skey, value from fx_layers
  union all select src, id, pos, skey, value from fx_doc_settings)""",
}

_DEPS = {
    "fx_raw": [], "fx_files": ["fx_raw"], "fx_state": ["fx_files"], "fx_state_kv": ["fx_state"],
    "fx_store": ["fx_files"], "fx_listing": ["fx_files"], "fx_objects": ["fx_listing", "fx_files"],
    "fx_rule_lines": [], "fx_rule_table": [], "fx_secrets": [], "fx_attempts": [], "fx_layers": [], "fx_orders": [],
    "fx_orders_prev": ["fx_orders"], "fx_lineitem": [], "fx_lineitem_prev": ["fx_lineitem"],
    "fx_doc_settings": [], "fx_settings": ["fx_layers", "fx_doc_settings"],
}


def with_fx(names: list[str], body: str, extra: list[str] | None = None) -> str:
    """``with <needed fixture CTEs>[, extra CTEs] <body>``."""
    need: set[str] = set()

    def visit(n: str) -> None:
        if n in need:
            return
        for d in _DEPS[n]:
            visit(d)
        need.add(n)

    for n in names:
        visit(n)
    ctes = [FX_SQL[n] for n in FX_SQL if n in need] + list(extra or [])
    if not ctes:
        return body
    return "with " + ",\n".join(ctes) + "\n" + body
