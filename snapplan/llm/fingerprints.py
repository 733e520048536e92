"""Operator 4: document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, those into longer phrases, and so on.
On each level runs of one symbol collapse, then deterministic coin tossing
gives each symbol a label of few values that depends on a handful of symbols
to its left; phrases begin at local maxima of the labels.  A phrase's name is
a hash of its symbols.  Where phrases begin and what they are called depends
on nearby symbols only, so equal substrings have equal phrases but for a few
at their ends, wherever they stand.  The fingerprint of a text is the set of
its phrase names on the highest level, kept as the smallest ``KEEP`` hashes;
short texts keep lower levels as well.

Finding the next document needs the documents in order of their ids: one range
partitioning of the texts, a streamed pass over each partition, and a second
pass over the first and last document of each partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, python_ready, settle
from .words import BASE, U, batches_of, mix, powers

LEVELS = 3
KEEP = 48                # hashes of a sketch
FEW = 8                  # with fewer phrases on a level, the level below is kept as well
ROWS = 8192              # documents of a partition
TOSSES = {np.dtype(np.uint8): 3, np.dtype(np.uint64): 4}


def _labels(symbols: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Coin tossing: labels below 6 that differ between neighbours (``head``: first symbols of texts)."""
    x = symbols
    for _ in range(TOSSES[symbols.dtype]):
        differ = x.copy()
        differ[1:] ^= x[:-1]
        differ[head] = 1
        low = differ & (~differ + x.dtype.type(1))
        k = np.bitwise_count(low - x.dtype.type(1)).astype(x.dtype)
        x = (k << x.dtype.type(1)) | ((x >> k) & x.dtype.type(1))
    return x.astype(np.uint8)


def _phrases(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of several texts; ``first`` has where each text begins, and the end."""
    if not len(symbols):
        return np.empty(0, U), np.zeros_like(first)
    heads = np.unique(first[:-1][first[:-1] < first[1:]])
    new = np.empty(len(symbols), dtype=bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[heads] = True
    at = np.flatnonzero(new)
    run = np.diff(at, append=len(symbols)).astype(U)
    symbols = symbols[at]
    head = np.searchsorted(at, heads)
    label = _labels(symbols, head)
    after = np.full(len(label), 255, dtype=np.uint8)
    after[:-1] = label[1:]
    after[head[1:] - 1] = 255                          # nothing follows a text's last symbol
    start = np.zeros(len(label), dtype=bool)
    start[1:] = (label[1:] > label[:-1]) & (label[1:] > after[1:])
    start[head] = True
    begin = np.flatnonzero(start)
    place = np.arange(len(label)) - np.repeat(begin, np.diff(begin, append=len(label)))
    terms = mix(symbols.astype(U) * BASE + run) * powers(int(place.max()) + 1)[0][place]
    return mix(np.add.reduceat(terms, begin)), np.searchsorted(begin, np.searchsorted(at, first))


def _smallest(names: np.ndarray, first: np.ndarray, keep: int) -> list[np.ndarray]:
    """The ``keep`` smallest 32-bit hashes of each text's names."""
    text = np.repeat(np.arange(len(first) - 1, dtype=U), np.diff(first))
    both = np.unique((text << U(32)) | (names >> U(32)))
    cuts = np.searchsorted(both, np.arange(len(first), dtype=U) << U(32))
    small = both.astype(np.uint32)
    return [small[a:min(b, a + keep)] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def sketches(texts: list[str], levels: int = LEVELS, keep: int = KEEP) -> list[bytes]:
    """Of each text, for its highest level and each lower one that is kept: a count and hashes (4 bytes each).

    An empty text has an empty sketch.
    """
    out: list[bytes] = []
    for lo, hi in batches_of(texts, 2 << 20):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
        symbols = np.frombuffer(b"".join(raw), dtype=np.uint8)
        first = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
        by_level = []
        for _ in range(levels):
            symbols, first = _phrases(symbols, first)
            by_level.append((symbols, first))
        own: list[list[bytes]] = [[] for _ in raw]
        wanted = np.flatnonzero(np.diff(first) > 0)
        for names, at in reversed(by_level):
            sizes = np.diff(at)
            if len(wanted) < len(raw):
                inside = np.zeros(len(raw), dtype=bool)
                inside[wanted] = True
                names = names[np.repeat(inside, sizes)]
                at = np.concatenate([[0], np.cumsum(sizes[wanted])])
            for i, s in zip(wanted.tolist(), _smallest(names, at, keep), strict=True):
                own[i].append(np.concatenate([[len(s)], s]).astype("<u4").tobytes())
            wanted = wanted[sizes[wanted] < FEW]
        out += [b"".join(o) for o in own]
    return out


def _levels(sketch: bytes) -> list[np.ndarray]:
    a, out = np.frombuffer(sketch, dtype="<u4"), []
    while len(a):
        n = int(a[0])
        out.append(a[1:1 + n])
        a = a[1 + n:]
    return out


def likeness(a: bytes, b: bytes, keep: int = KEEP) -> float:
    """Share of common phrases, twice over the sum of both, estimated on the highest level where either
    text has ``FEW`` phrases (or the lowest kept)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = _levels(a), _levels(b)
    level = min(len(x), len(y)) - 1
    p, q = set(x[level].tolist()), set(y[level].tolist())
    union = sorted(p | q)[:keep]
    both = sum(u in p and u in q for u in union)
    return 2 * both / (len(union) + both)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many first code points of the following text."""
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


FOUND = ("doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
         "near_edited double, near_next double")
NAMES = [c.split()[0] for c in FOUND.split(", ")]
EDGE = "part long, edge int, text string"


def _judge(rows: list[tuple], following: list[tuple]) -> list[tuple]:
    """Result rows of (doc_id, text, sketch) with the rows that follow them."""
    changed = [edited(r[1], n[1]) for r, n in zip(rows, following, strict=True)]
    return [(r[0], len(r[1]), hashlib.sha256(c.encode("utf-8", "surrogatepass")).digest(), r[2], s,
             likeness(r[2], s), likeness(r[2], n[2]))
            for r, n, c, s in zip(rows, following, changed, sketches(changed), strict=True)]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: a result for each row but the last, and the first (edge 0) and last row (edge 1) themselves."""
    part = TaskContext.get().partitionId()
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(),
             pa.int64(), pa.int32(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                          names=[*NAMES, "part", "edge", "text"])

    def edge(row: tuple, which: int) -> tuple:
        return row[0], None, None, row[2], None, None, None, part, which, row[1]

    held: list[tuple] = []
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for lo, hi in batches_of(texts, 2 << 20):
            rows = list(zip(ids[lo:hi], texts[lo:hi], sketches(texts[lo:hi]), strict=True))
            out = [edge(rows[0], 0)] if not held else []
            rows = held + rows
            yield table(out + [(*r, None, None, None) for r in _judge(rows[:-1], rows[1:])])
            held = rows[-1:]
    if held:
        yield table([edge(held[0], 1)])


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges in order of the parts: each last row is followed by the next first row, the very last by the first."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    head, last = None, None
    def result(row: tuple, following: tuple) -> pa.RecordBatch:
        columns = zip(*_judge([row], [following]), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)
    for batch in batches:
        for doc, text, sketch, which in zip(*(batch.column(c).to_pylist() for c in
                                              ("doc_id", "text", "fingerprint", "edge")), strict=True):
            row = (doc, text, sketch)
            if which == 0:
                head = head or row
                if last:
                    yield result(last, row)
            else:
                last = row
    if last:
        yield result(last, head)


def document_fingerprints(docs: DataFrame, rows_per_part: int = ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is the one with the next smaller doc_id; a null doc_id
    comes last, rows with one doc_id are ordered by a hash of their text, and
    the first document follows the last.  Null text counts as empty and has an
    empty fingerprint; two empty texts are alike (1), an empty and another are
    not (0).  A single document follows itself.  Other columns are ignored.
    Empty table: no rows.
    """
    spark = docs.sparkSession
    python_ready(spark)
    docs = docs.select("doc_id", "text")
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text"]
    rows = docs.repartitionByRange(parts_for(docs.count(), rows_per_part), F.col("doc_id").desc_nulls_last())
    found = settle(rows.sortWithinPartitions(*order).mapInArrow(_stream, f"{FOUND}, {EDGE}"))
    edges = found.filter(F.col("edge").isNotNull()).coalesce(1).sortWithinPartitions("part", "edge")
    both = found.filter(F.col("edge").isNull()).select(*NAMES).unionByName(
        edges.select("doc_id", "text", "fingerprint", "edge").mapInArrow(_join_edges, FOUND))
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
