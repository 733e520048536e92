"""Operator 2: line dedup over levelled sorted runs of line hashes (DataFrame functions only).

The documents are cut into batches of descending doc_id.  The index of line
keys is a set of sorted runs: tables bucketed and sorted by the key's hash, a
key in one run at most.  Each batch is aggregated to one row per key and
merge-joined with the runs on their buckets, which moves no run: keys that
anti-join every run are new, and as ids descend their largest doc_id is known
for good; they become the batch's own run.  Keys already there only add to a
ledger of counts.  When a level holds ``FANOUT`` runs they are merged into one
run of the next level.  At the end runs and ledger give each key's documents,
and the lines of frequent keys go from all documents but the largest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapplan.session import shared_path

from .common import lookup, settle

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 2
#: stripped from both ends of a line
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lowered."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, _text (hash of the text), pos, h1, h2, first (of its key in the document) of every long line."""
    keyed = F.transform(F.split("text", "\n"), lambda x, i: F.struct(line_key(x).alias("k"), i.alias("i")))
    long = F.filter(keyed, lambda x: F.length(x["k"]) >= min_chars)
    hashed = F.transform(long, lambda x: F.struct(
        F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit(1), x["k"]).alias("h2"), x["i"].alias("pos")))
    rows = docs.select("doc_id", "_text", F.sort_array(hashed).alias("a"))
    def other(x: Column, i: Column) -> Column:
        before = F.col("a")[F.greatest(i - 1, F.lit(0))]
        return (i == 0) | (before["h1"] != x["h1"]) | (before["h2"] != x["h2"])
    flagged = F.transform("a", lambda x, i: F.struct(x["h1"], x["h2"], x["pos"], other(x, i).alias("first")))
    return rows.select("doc_id", "_text", F.inline(flagged))


class Runs:
    """Sorted runs on levels.  A run has h1, h2, keeper, n (documents) and lines, and is bucketed by h1, h2."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.ledger: list[DataFrame] = []
        self.names: list[str] = []

    def _store(self, rows: DataFrame) -> DataFrame:
        """Write rows, dealt by their key already, as a bucketed sorted table in the shared folder."""
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet")
         .option("path", shared_path(self.spark, "runs")).saveAsTable(name))
        self.names.append(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """``batch``: one row per key, dealt by the key."""
        new = batch = self._store(batch)
        old = []
        for run in self.runs():
            new = new.join(run.select(*KEY), KEY, "left_anti")
            old.append(batch.join(run.select(*KEY), KEY, "left_semi"))
        if old:
            new = self._store(new)
            self.ledger += [settle(o.select(*KEY, "n", "lines")) for o in old]
        self._push(new, 0)

    def _push(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self.merged(self.levels[level])
            self.levels[level] = []
            self._push(self._store(merged), level + 1)

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.repartition(self.buckets, *KEY)

    def totals(self) -> DataFrame:
        """h1, h2, keeper, n, lines of every key over all batches."""
        rows = None
        for r in [*self.runs(), *(x.withColumn("keeper", F.lit(None).cast("long")) for x in self.ledger)]:
            r = r.select(*KEY, "keeper", "n", "lines")
            rows = r if rows is None else rows.unionByName(r)
        return rows.groupBy(*KEY).agg(F.max("keeper").alias("keeper"), F.sum("n").alias("n"),
                                      F.sum("lines").alias("lines"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
               fanout: int = FANOUT) -> DataFrame:
    """The columns of ``docs`` with repeated lines taken out of ``text``, then n_lines (before) and n_dropped.

    A line whose key has ``min_chars`` code points and is in ``min_docs``
    documents stays only in the largest doc_id that has it.  Every row is a
    document of its own: repeated rows count once each, and all rows of the
    largest doc_id keep the line.  Null or empty text: one empty line.  A null
    doc_id is below all others.  Columns of ``docs`` called n_lines or
    n_dropped are replaced; all others pass through.  Empty table: no rows.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*keep).withColumn("text", F.coalesce("text", F.lit("")))
    keyed = docs.withColumn("_text", F.xxhash64("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [1 - i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = sum((F.when(F.col("doc_id") >= c, 0).otherwise(1) for c in dict.fromkeys(cuts)), F.lit(0))
    lines = _hashed_lines(keyed, min_chars)
    path = shared_path(spark, "lines")
    lines.withColumn("batch", F.coalesce(batch, F.lit(len(cuts)))).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema.add("batch", "integer")).parquet(path)

    index = Runs(spark, fanout)
    for k in range(len(dict.fromkeys(cuts)) + 1):
        own = lines.filter(F.col("batch") == k)
        index.add(own.groupBy(*KEY).agg(F.max("doc_id").alias("keeper"),
                                        F.sum(F.col("first").cast("long")).alias("n"),
                                        F.count("*").alias("lines")))
    frequent = settle(index.totals().filter(F.col("n") >= min_docs))
    found = lookup(lines.select("doc_id", "_text", "pos", *KEY), frequent, KEY, F.col("lines"), lines.count())
    lost = found.filter(F.col("doc_id").isNull() & F.col("keeper").isNotNull() | (F.col("doc_id") < F.col("keeper")))
    lost = lost.groupBy(F.col("doc_id").alias("_doc"), F.col("_text").alias("_hash")).agg(
        F.collect_list("pos").alias("_lost"))
    both = keyed.join(lost.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_doc"))
                      & (F.col("_text") == F.col("_hash")), "left")
    split = both.withColumn("_lines", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    kept = F.array_join(F.transform(stay, lambda i: F.col("_lines")[i]), "\n")
    n_lines = F.size("_lines").cast("long")
    values = {"text": F.when(F.col("_lost").isNull(), F.col("text")).otherwise(kept)}
    return split.withColumn("_stay", stay).select(
        *(values.get(c, F.col(c)).alias(c) for c in keep), n_lines.alias("n_lines"),
        F.when(F.col("_lost").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_stay")).cast("long")
        .alias("n_dropped"))


ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '{UPPER}', '{LOWER}') AS key
      FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS}),
m AS (SELECT k.*, f.key IS NOT NULL AND coalesce(k.doc_id < f.keeper, k.doc_id IS NULL AND f.keeper IS NOT NULL) AS lost
      FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY r"""
