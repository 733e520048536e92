"""Index of a content store in levelled runs, in place of a full listing (O-03, O-41).

A run is a catalog table of ``(hash, size)``, bucketed and sorted by hash.
The first run comes from one listing of the store; every job then appends
what it has put.  When a level holds ``FANOUT`` runs they are merged into one
of the next level, so there are few runs, and each row is rewritten once per
level.  A lookup joins rows with all runs on the buckets: the rows are
shuffled once, the index never.

A run counts when its commit mark is set.  Merged runs are dropped after
that; one that is left over by a lost driver is older than a committed run of
a higher level and is not read.  A job that dies between its puts and its
append puts the same items again, which finds them there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITTED = "snapplan.committed"
#: runs of a level that are merged
FANOUT = 8


@dataclass(frozen=True, order=True)
class Run:
    """Runs in order of age: ``seq`` of the newest append they hold."""

    seq: int
    level: int
    table: str


class StoreIndex:
    """``name``: prefix of the tables in the current database of a persistent
    catalog.  ``buckets`` is fixed for the life of the index."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.name, self.fanout = spark, name.lower(), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _committed(self, table: str) -> bool:
        return any(r.key == COMMITTED for r in self.spark.sql(f"SHOW TBLPROPERTIES {table}").collect())

    def runs(self) -> list[Run]:
        """The runs that hold the index, newest first."""
        found = []
        for t in self.spark.catalog.listTables(pattern=f"{self.name}_l*"):
            m = re.fullmatch(re.escape(self.name) + r"_l(\d+)_(\d+)", t.name)
            if m and self._committed(t.name):
                found.append(Run(int(m[2]), int(m[1]), t.name))
        return sorted((r for r in found if not any(o.level > r.level and o.seq >= r.seq for o in found)), reverse=True)

    def _write(self, rows: DataFrame, level: int, seq: int) -> None:
        table = f"{self.name}_l{level}_{seq:012d}"
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")          # only an attempt that was never committed
        (rows.select("hash", "size").repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash")
         .sortBy("hash").saveAsTable(table))
        self.spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{COMMITTED}' = 'true')")

    def append(self, rows: DataFrame) -> None:
        """Add ``(hash, size)`` rows of one job, one per hash; the newest size of a hash counts."""
        newest = max((r.seq for r in self.runs()), default=0)
        self._write(rows.groupBy("hash").agg(F.max("size").alias("size")), 0, newest + 1)
        self._compact()

    def _compact(self) -> None:
        while True:
            runs = self.runs()
            full = [lv for lv in sorted({r.level for r in runs}) if sum(r.level == lv for r in runs) >= self.fanout]
            if not full:
                return
            merged = [r for r in runs if r.level == full[0]]
            self._write(self._newest(merged), full[0] + 1, merged[0].seq)
            for r in merged:
                self.spark.sql(f"DROP TABLE IF EXISTS {r.table}")

    def _newest(self, runs: list[Run]) -> DataFrame:
        out = None
        for r in runs:
            rows = self.spark.table(r.table).withColumn("_seq", F.lit(r.seq))
            out = rows if out is None else out.unionByName(rows)
        return out.groupBy("hash").agg(F.max_by("size", "_seq").alias("size"))

    def list(self) -> DataFrame:
        """``(hash, size)`` of the whole index."""
        runs = self.runs()
        return self._newest(runs) if runs else self.spark.createDataFrame([], "hash string, size long")

    def sizes_of(self, hashes: list[str]) -> DataFrame:
        """``hash, store_size`` of a bounded list of hashes."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "hash string, store_size long")
        out = None
        for r in runs:
            rows = self.spark.table(r.table).filter(F.col("hash").isin(hashes)).withColumn("_seq", F.lit(r.seq))
            out = rows if out is None else out.unionByName(rows)
        return out.groupBy("hash").agg(F.max_by("size", "_seq").alias("store_size"))

    def with_size(self, rows: DataFrame) -> DataFrame:
        """Add ``store_size``, null where the index lacks the hash."""
        known = []
        rows = rows.repartition(self.buckets, "hash")
        for i, r in enumerate(self.runs()):
            rows = rows.join(self.spark.table(r.table).select("hash", F.col("size").alias(f"_size{i}")).hint("merge"),
                             "hash", "left")
            known.append(f"_size{i}")
        size = F.coalesce(*known) if known else F.lit(None).cast("long")
        return rows.withColumn("store_size", size).drop(*known)
