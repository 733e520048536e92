"""Operator 1: best-fit packing of documents into sequences by the sum of squares.

Every whole text becomes token ids with an end id; documents longer than a
sequence are cut.  Pieces go to groups of bounded size, by a hash or, where
the order of documents counts, as runs of that order; within a group the
sum-of-squares rule places each piece so that the sum, over all
residual gaps, of the squared number of open sequences with that gap becomes
smallest.  Only (document, piece, length) rows are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parts_for, python_ready, settle
from .tokenize import byte_level_ids

CAPACITY = 2048
#: pieces that one task packs together
GROUP = 8192
#: documents of a file that are numbered together
CHUNK = 512

#: columns of ``in_read_order``
ORDER = ["_part", "_file", "_row"]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n_ids`` ids: only the first may be shorter."""
    first = n_ids % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n_ids, capacity)]


def in_read_order(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents read from Parquet files, and the place of each: part, file and row in it."""
    name = F.col("_metadata.file_name")
    return docs.select("doc_id", "text", F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long").alias("_part"),
                       name.alias("_file"), F.col("_metadata.row_index").alias("_row"))


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and the columns ORDER if ``docs`` has them.

    Null text counts as empty.
    """
    place = [c for c in ORDER if c in docs.columns]
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = memoryview(byte_level_ids(text or "", vocabulary) + end)
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    at.append(i)
                    rows.append((k, s, n, zlib.crc32(ids[4 * s:4 * (s + n)])))
            piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                 *(batch.column(c).take(pa.array(at, pa.int64())) for c in place)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", *place])

    python_ready(docs.sparkSession)
    schema = ", ".join([PIECES, *(f"{c} {dict(docs.dtypes)[c]}" for c in place)])
    return docs.select("doc_id", "text", *place).mapInArrow(run, schema)


def numbered(pieces: DataFrame) -> DataFrame:
    """Rows of ``pieces_of`` with their number ``_at`` in read order, from 0 without gaps."""
    chunk = ["_part", "_file", "_chunk"]
    rows = pieces.withColumn("_chunk", F.expr(f"_row div {CHUNK}"))
    before = Window.orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*chunk).count().select(
        *(F.col(c).alias(f"{c}_") for c in chunk), F.coalesce(F.sum("count").over(before), F.lit(0))
        .alias("_before"))
    number = F.row_number().over(Window.partitionBy(*chunk).orderBy("_row", "piece")) - 1
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in chunk]
    return (rows.withColumn("_number", number).join(counts, same)
            .withColumn("_at", F.col("_before") + F.col("_number")).drop("_number", "_before", *chunk, "_row",
                                                                      *(f"{c}_" for c in chunk)))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order.

    ``open_[g]`` counts open bins with residual gap ``g``.  Placing ``n`` in
    gap ``g`` turns one bin of gap ``g`` into one of gap ``g - n`` (a full bin
    is closed and counts no more); the cheapest change of the sum of squares
    wins, then the tightest gap, then an open bin before a new one.
    """
    open_ = np.zeros(capacity + 1, dtype=np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made, never = 0, np.iinfo(np.int64).max
    for k, n in enumerate(lengths.tolist()):
        now = open_[n:capacity]
        best, fresh = never, 2 * open_[capacity - n] + 1 if n < capacity else 0
        if len(now):
            cost = 2 * (open_[:capacity - n] - now) + 2
            cost[0] = 1 - 2 * now[0]
            cost[now == 0] = never
            at = int(cost.argmin())
            best = cost[at]
        if best <= fresh:
            gap = n + at
            b = bins[gap].pop()
            open_[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        where[k], offset[k] = b, capacity - gap
        if gap > n:
            open_[gap - n] += 1
            bins[gap - n].append(b)
    return where, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows of ``pieces_of``.

    Long pieces come first within a group, which leaves the short ones to fill
    what remains.  Repeated rows are separate pieces.  Pieces with the columns
    ORDER go to groups as runs of that order, and sequence ids rise with it:
    from group to group, and within one by the first piece of each sequence.
    """
    ordered = set(ORDER) <= set(pieces.columns)

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), *([("_at", "ascending")] if ordered else []),
                             ("doc_id", "ascending"), ("piece", "ascending")])
        where, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        if ordered:
            opens = rows["_at"].to_numpy()[np.unique(where, return_index=True)[1]]
            rank = np.empty(len(opens), np.int64)
            rank[opens.argsort()] = np.arange(len(opens))
            where, rows = rank[where], rows.drop_columns("_at")
        first = rows["_group"][0].as_py() << 32
        return rows.drop_columns("_group").append_column("sequence_id", pa.array(first + where)).append_column(
            "offset", pa.array(offset))

    pieces = settle(pieces)
    total = pieces.count()
    groups = parts_for(total, group)
    if ordered:
        pieces, key = numbered(pieces), F.expr(f"_at * {groups}L div {total or 1}L")
    else:
        key = F.pmod(F.xxhash64("doc_id", "piece", "start", "length"), F.lit(groups))
    return (pieces.withColumn("_group", key).groupBy("_group")
            .applyInArrow(place, PACKED))


def best_fit_packing(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY,
                     group: int = GROUP) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Null or empty text: one piece that holds the end id alone.  Null doc_id:
    kept, packed like any other.  Repeated rows: packed once each.  Documents
    of ``in_read_order`` are packed in runs of that order.  Other columns than
    these are ignored.  Empty table: no rows.
    """
    return pack(pieces_of(docs, vocabulary, capacity), capacity, group)
