"""Operator 13: token ids of all documents as binary files of patched frame-of-reference blocks.

Documents are dealt out in ranges of ascending doc_id; each task encodes its
range and writes files of blocks (see ``pfor``) with a table of their
documents behind them.  File names are fresh for every attempt of a task, and
only files that a finished attempt reports are part of the dataset: the list
of files is a table that Spark commits, so a lost executor or a second
attempt leaves nothing in it twice.  Reading goes by the files alone: each
gives back its documents and, by its index, the ids of any of them.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapplan.session import local_fs_path, shared_path

from .common import parts_for, python_ready, settle
from .pfor import PERCENTILE, Reader, Writer
from .tokenize import byte_level_ids, word_ids

#: ids of a file, about; a longer document is not cut
FILE_IDS = 16_000_000
#: ids read at a time, about
READ_IDS = 1 << 20

FILES = "part int, nth int, path string, length long, documents long, ids long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_DOC = np.dtype([("doc_id", "<i8"), ("tokens", "<u4"), ("known", "u1")])


def file_system(path: str):
    """The Arrow file system of a path or URI (local or mounted folders, and what Arrow was built with) and its path there."""
    from pyarrow import fs
    local = local_fs_path(path)
    return (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(local)


def text_ids(text: str, vocabulary: str, kind: str) -> np.ndarray:
    raw = word_ids(text, vocabulary) if kind == "words" else byte_level_ids(text, vocabulary)
    return np.frombuffer(raw, dtype="<u4")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, kind: str = "words",
                      file_ids: int = FILE_IDS, percentile: int = PERCENTILE) -> DataFrame:
    """Write all documents below ``folder`` in ascending doc_id order; the list of the files (FILES) as a table.

    Files stand in the order of (part, nth).
    """
    spark = docs.sparkSession
    end = np.array([end_id], dtype=np.uint32)
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # texts of 8 MiB a part, up to 64 parts; beyond, of 128 MiB
    parts = max(parts_for(chars, 128 << 20), min(parts_for(chars, 8 << 20), 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        nth, writer, stream, path, held = 0, None, None, None, []

        def finished() -> pa.RecordBatch:
            length = writer.close(np.concatenate(held).tobytes())
            stream.close()
            return pa.RecordBatch.from_pylist([{"part": part, "nth": nth, "path": path, "length": length,
                                                "documents": sum(map(len, held)), "ids": writer.values}], SCHEMA)

        for batch in batches:
            table = np.zeros(len(batch), dtype=_DOC)
            names = batch.column("doc_id")
            table["known"] = names.is_valid().to_numpy(zero_copy_only=False)
            table["doc_id"] = names.fill_null(0).to_numpy()
            begun = 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                if writer is None:
                    path = f"{folder}/part-{part:06d}-{nth:05d}-{uuid.uuid4().hex}.pfor"
                    fs, name = file_system(path)
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    stream = fs.open_output_stream(name)
                    writer, held, begun = Writer(stream, percentile), [], i
                ids = text_ids(text or "", vocabulary, kind)
                table["tokens"][i] = len(ids) + 1
                writer.add(ids)
                writer.add(end)
                if writer.values + writer.held >= file_ids:
                    held.append(table[begun:i + 1])
                    yield finished()
                    nth, writer, begun = nth + 1, None, i + 1
            if writer is not None:
                held.append(table[begun:])
        if writer is not None:
            yield finished()

    python_ready(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash"),
                       F.monotonically_increasing_id().alias("_salt"))
    keys = ["doc_id", "_hash", "_salt"]
    ranges = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return settle(ranges.mapInArrow(run, FILES))


SCHEMA = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("length", pa.int64()),
                    ("documents", pa.int64()), ("ids", pa.int64())])


def open_file(path: str, length: int) -> Reader:
    fs, name = file_system(path)
    return Reader(fs.open_input_file(name), length)


def documents_of(reader: Reader) -> tuple[np.ndarray, np.ndarray]:
    """The table of a file's documents, and where the ids of each begin in the file (one more place than documents)."""
    table = np.frombuffer(reader.own, dtype=_DOC)
    return table, np.append(0, np.cumsum(table["tokens"].astype(np.int64)))


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens, ids_crc32 of every document, decoded from the files."""
    n = files.count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part, and few files in each
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids")).select(
        "part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    listed = settle(files.withColumn("_inside", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
                    .join(parts.hint("merge"), "part").select(
                        (F.col("_before") + F.col("_inside")).alias("base"), "path", "length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = open_file(row["path"], row["length"])
                table, begin = documents_of(reader)
                at = 0
                while at < len(table):
                    # whole documents of about READ_IDS ids together
                    upto = max(at + 1, int(np.searchsorted(begin, begin[at] + READ_IDS, side="right")) - 1)
                    ids = memoryview(reader.read(int(begin[at]), int(begin[upto])).astype("<u4").tobytes())
                    places = (4 * (begin[at:upto + 1] - begin[at])).tolist()
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(places, places[1:], strict=False)]
                    some = table[at:upto]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some["doc_id"], mask=some["known"] == 0), pa.array(row["base"] + begin[at:upto]),
                         pa.array(some["tokens"].astype(np.int64)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = upto

    return listed.repartitionByRange(max(1, n), "base").mapInArrow(run, DOCUMENTS)


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2,
                kind: str = "words", folder: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all documents to files and return each document as the files have it.

    Null or empty text: the end id alone.  Null doc_id: before all others.
    Repeated doc_ids: ordered by a hash of their texts; repeated rows are kept.
    Other columns are ignored.  Empty table: no files, no rows.
    """
    folder = folder or shared_path(spark, "tokens")
    return read_documents(write_token_files(docs, folder, vocabulary, end_id, kind, file_ids))
