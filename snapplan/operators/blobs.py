"""Blob-table sink with a commit protocol (O-10, O-68).

A blob table is a folder of commits, ``<path>/commit=<id>/shard=<s>/*.parquet``,
with rows ``(hash, size, ext, block, n_blocks, content)``: a payload is cut
into blocks, so a huge file is spread over many rows and tasks.

The sink is a Python Data Source writer.  Tasks write below a hidden staging
folder and report the files they finished; the driver's commit removes what
no finished attempt reported and makes the whole commit visible by one
rename.  An aborted write removes its staging folder.  Hence readers see all
of a commit or nothing, a second attempt of a task adds nothing twice, and a
commit id that is already there (a replayed batch) is left as it is.

What happened to each block is part of the same commit (``_results``), so
put results need no second run and no collecting on the driver.  A payload
counts as stored when all of its blocks are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import digest as FD
from ..functions import paths as FP
from ..session import few_rows, has_entries, shared_path, ship_package
from ..sources.storage import exists, file_system, read_range

FORMAT = "snapplan_blobs"
#: payload bytes of a row, and of a task (about)
BLOCK_BYTES = 8 * 1024 * 1024
TASK_BYTES = 256 * 1024 * 1024
#: payload bytes a task holds before it writes a row group
HELD_BYTES = 32 * 1024 * 1024

BLOCKS = pa.schema([("hash", pa.string()), ("size", pa.int64()), ("ext", pa.string()), ("block", pa.int32()),
                    ("n_blocks", pa.int32()), ("content", pa.binary())])
RESULTS = pa.schema([("path", pa.string()), ("dest", pa.string()), ("hash", pa.string()), ("block", pa.int32()),
                     ("n_blocks", pa.int32()), ("bytes", pa.int64()), ("error", pa.string())])
#: as Spark reads them back
BLOCKS_DDL = "hash string, size long, ext string, block int, n_blocks int, content binary, commit string, shard string"
RESULTS_DDL = "path string, dest string, hash string, block int, n_blocks int, bytes long, error string"


@dataclass
class Written(WriterCommitMessage):
    """Files that one finished attempt of a task wrote, relative to the staging folder."""

    files: list[str] = field(default_factory=list)


def staging_of(path: str, commit: str) -> str:
    return f"{path.rstrip('/')}/_staging/{commit}"


def commit_of(path: str, commit: str) -> str:
    return f"{path.rstrip('/')}/commit={commit}"


class _Files:
    """The Parquet files of one attempt: one per shard, and one of results."""

    def __init__(self, top: str):
        self.top, self.name, self.open = top, f"part-{uuid.uuid4().hex}.parquet", {}

    def write(self, folder: str, rows: list[dict], schema: pa.Schema) -> None:
        import pyarrow.parquet as pq
        if folder not in self.open:
            system, top = file_system(f"{self.top}/{folder}")
            system.create_dir(top, recursive=True)
            stream = system.open_output_stream(f"{top}/{self.name}")
            # payloads may not compress; names and numbers are small beside them
            self.open[folder] = stream, pq.ParquetWriter(stream, schema, compression="zstd")
        self.open[folder][1].write_table(pa.Table.from_pylist(rows, schema))

    def write_all(self, held: dict[str, list[dict]], schema: pa.Schema) -> None:
        """Write the rows of each folder, and hold them no longer."""
        while held:
            self.write(*held.popitem(), schema)

    def close(self) -> list[str]:
        for stream, writer in self.open.values():
            writer.close()
            stream.close()
        return [f"{folder}/{self.name}" for folder in self.open]


class BlobWriter(DataSourceArrowWriter):
    """Rows ``path, dest, hash, size, ext, shard, block, n_blocks, start,
    length, content``; a null content is read from ``path`` in the task."""

    def __init__(self, options: dict):
        self.path, self.id = options["path"], options["commit"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files = _Files(staging_of(self.path, self.id))
        for batch in iterator:
            held: dict[str, list[dict]] = {}
            n_held, results = 0, []
            for row in few_rows(batch):
                error, data = None, row["content"]
                try:
                    if data is None:
                        data = read_range(row["path"], row["start"], row["length"])
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
                results.append({k: row[k] for k in ("path", "dest", "hash", "block", "n_blocks")}
                               | {"bytes": 0 if error else len(data), "error": error})
                if error:
                    continue
                held.setdefault(f"shard={row['shard']}", []).append(
                    {k: row[k] for k in ("hash", "size", "ext", "block", "n_blocks")} | {"content": data})
                n_held += len(data)
                if n_held >= HELD_BYTES:
                    files.write_all(held, BLOCKS)
                    n_held = 0
            files.write_all(held, BLOCKS)
            if results:
                files.write("_results", results, RESULTS)
        return Written(files.close())

    def commit(self, messages: list[Written | None]) -> None:
        """Drop what no finished attempt reported, then show the rest at once."""
        from pyarrow import fs
        staging, final = staging_of(self.path, self.id), commit_of(self.path, self.id)
        if not exists(staging):
            return
        if exists(final):                       # a replay: the first commit stands
            self.abort(messages)
            return
        system, top = file_system(staging)
        listed = {f for m in messages if m for f in m.files}
        for info in system.get_file_info(fs.FileSelector(top, recursive=True)):
            if info.type == fs.FileType.File and info.path.removeprefix(top).lstrip("/") not in listed:
                system.delete_file(info.path)
        if listed:
            system.move(top, file_system(final)[1])

    def abort(self, messages: list[Written | None]) -> None:
        staging = staging_of(self.path, self.id)
        if exists(staging):
            system, top = file_system(staging)
            system.delete_dir(top)


class BlobSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return BLOCKS_DDL

    def writer(self, schema, overwrite: bool) -> BlobWriter:
        if overwrite:
            raise ValueError("a blob table only grows: use append")
        return BlobWriter(self.options)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """All committed blocks of a blob table."""
    if not has_entries(spark, path):
        return spark.createDataFrame([], BLOCKS_DDL)
    return spark.read.schema(BLOCKS_DDL).parquet(path)


def stored_blobs(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    """``(hash, size)`` of every payload that is stored whole, not counting
    the commit ``but``.  Payloads are not read."""
    blocks = read_blocks(spark, path)
    blocks = blocks if but is None else blocks.filter(F.col("commit") != but)
    return (blocks.groupBy("hash", "size")
            .agg(F.count_distinct("block").alias("_has"), F.max("n_blocks").alias("_needs"))
            .filter("_has = _needs").groupBy("hash").agg(F.max("size").alias("size")))


def blocks_of(rows: DataFrame, block_bytes: int = BLOCK_BYTES, shard_depth: int = 1) -> DataFrame:
    """One row per block of each ``path, dest, hash, size[, content]`` row."""
    n = F.greatest(F.lit(1), F.expr(f"(size + {block_bytes - 1}) div {block_bytes}")).cast("int")
    start = F.col("block").cast("long") * block_bytes
    cut = (rows.withColumn("n_blocks", n).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
           .withColumn("start", start).withColumn("length", F.least(F.lit(block_bytes).cast("long"), F.col("size") - start)))
    content = (F.col("content").cast("binary") if "content" in rows.columns else F.lit(None).cast("binary"))
    return cut.select("path", "dest", "hash", "size", FP.extension(FP.basename("path")).alias("ext"),
                      F.substring("hash", 1, shard_depth).alias("shard"), "block", "n_blocks", "start", "length",
                      F.substr(content, (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("content"))


def put_blobs(queue: DataFrame, path: str, commit: str | None = None, block_bytes: int = BLOCK_BYTES,
              task_bytes: int = TASK_BYTES) -> DataFrame:
    """Put queue rows ``path, dest, hash, size[, content][, try_count]`` into
    a blob table as one commit; returns the put results, one per row.

    Payloads that are stored whole, or that another row of the queue brings
    (the least path of a hash stands for all), are ``exists``; the others
    ``copied``, or ``failed`` where a block could not be read.  Blocks are
    dealt over tasks by their bytes; a task holds a few blocks at a time.
    A put under a commit id that is there already (a replayed batch) writes
    nothing and returns the same results again.
    """
    spark = queue.sparkSession
    ship_package(spark)
    spark.dataSource.register(BlobSink)
    commit = commit or uuid.uuid4().hex
    tries = F.coalesce(F.col("try_count"), F.lit(0)) if "try_count" in queue.columns else F.lit(0)
    narrow = queue.select("path", "dest", "hash", "size", (tries + 1).cast("int").alias("tries"))
    # what is to be written is decided once: the write below must not change it
    decided = shared_path(spark, "put")
    there = stored_blobs(spark, path, but=commit).withColumn("_there", F.lit(True)).hint("merge")
    first = narrow.groupBy("hash").agg(F.min("path").alias("_first")).hint("merge")
    (narrow.join(there, ["hash", "size"], "left").join(first, "hash")
     .withColumn("_new", F.col("_there").isNull() & (F.col("path") == F.col("_first")))
     .drop("_there", "_first").write.mode("errorifexists").parquet(decided))
    rows = spark.read.parquet(decided)
    new = rows.filter("_new").select("path", "dest", "hash", "size")
    total = new.agg(F.sum("size")).first()[0] or 0
    if "content" in queue.columns:
        new = new.join(queue.select("path", "dest", "content").hint("merge"), ["path", "dest"])
    blocks = blocks_of(new, block_bytes).repartition(FD.tasks_for_bytes(total, task_bytes), "hash", "block")
    blocks.write.format(FORMAT).option("path", path).option("commit", commit).mode("append").save()
    written = commit_of(path, commit)
    done = (spark.read.schema(RESULTS_DDL).parquet(f"{written}/_results") if has_entries(spark, written)
            else spark.createDataFrame([], RESULTS_DDL))
    # a block may be told of twice in a replay, a file is done when none of its blocks failed
    files = done.groupBy("path", "dest", "hash").agg(F.sum("bytes").alias("bytes"), F.max("error").alias("error"))
    return rows.join(files.hint("merge"), ["path", "dest", "hash"], "left").select(
        "path", "dest", "hash",
        F.when(~F.col("_new"), "exists").when(F.col("error").isNull() & F.col("bytes").isNotNull(), "copied")
        .otherwise("failed").alias("status"),
        "tries", F.when(F.col("_new") & F.col("error").isNull(), F.col("bytes")).otherwise(0).alias("bytes"), "error")


def blob_contents(spark: SparkSession, path: str) -> DataFrame:
    """``(hash, size, content)`` of payloads stored whole, their blocks joined again."""
    blocks = read_blocks(spark, path).dropDuplicates(["hash", "size", "block"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "content"))), lambda b: F.hex(b["content"]))
    return (blocks.groupBy("hash", "size").agg(F.count(F.lit(1)).alias("_has"), F.max("n_blocks").alias("_needs"),
                                               F.unhex(F.array_join(parts, "")).alias("content"))
            .filter("_has = _needs").drop("_has", "_needs"))
