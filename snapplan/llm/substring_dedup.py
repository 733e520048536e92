"""Operator 6: substring dedup with fixed-block anchors.

Any repeat of ``window`` words holds a whole block of (window + 1) / 2 words
of either document's grid of non-overlapping blocks.  These blocks are the
index; every rolling window of a block's length probes it.  Blocks and probes
meet by hash in one shuffle of numpy arrays, which gives each document the
hashes it has in common with others.  There a document's hits are extended:
all windows of ``window`` words over a hit are candidates, and the smallest
doc_id that holds such a window is found in a second, much smaller shuffle.
Windows found in a smaller document are removed; where they overlap they form
the maximal exact repeats.

Documents of the same words are one class; its smallest doc_id stands for it.
A hash that several classes of one task share is known to be common there: its
holders are told at once and only two of them go on, so a passage found
everywhere is not gathered in one place.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapplan.session import shared_path

from .common import lookup, parts_for, python_ready, settle
from .words import STEP2, U, batches_of, mix, powers, windows, words

WINDOW = 13
TOKENS = 1_000_000       # probes of a part of the first exchange, about
STARTS = 500_000         # windows of a part of the second
KEY_BITS = 39            # bits of a hash sent besides those that name its part
LOWEST = -(1 << 63)      # stands for a null doc_id


def _sequence_name(hashes: np.ndarray) -> int:
    """64-bit name of a sequence of words, as a signed number."""
    n = len(hashes)
    name = mix(np.array([(hashes * powers(n)[0]).sum(dtype=U) + U(n)]))
    return int(name.view(np.int64)[0])


def _documents(docs: DataFrame) -> DataFrame:
    """id, text_hash, cls (null without words), n_words and whole (SHA-256 of all words) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, sizes, digests = [], [], []
            for lo, hi in batches_of(texts):
                w = words(texts[lo:hi])
                for i in range(hi - lo):
                    h = w.hashes[w.first[i]:w.first[i + 1]]
                    names.append(_sequence_name(h) if len(h) else None)
                    sizes.append(len(h))
            for t in texts:
                digests.append(hashlib.sha256(b" ".join((t or "").encode("utf-8", "surrogatepass").split())).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(names, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())],
                names=["id", "text_hash", "cls", "n_words", "whole"])

    return docs.mapInArrow(run, "id long, text_hash long, cls long, n_words long, whole binary")


def _key(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each hash and what else is kept of it."""
    return (hashes % U(parts)).astype(np.int64), (hashes // U(parts)) & U((1 << KEY_BITS) - 1)


def _token(part: np.ndarray | int, key: np.ndarray, parts: int) -> np.ndarray:
    return (key * U(parts) + np.asarray(part).astype(U)).view(np.int64)


def _probe_rows(classes: list[tuple[int, np.ndarray]], block: int, parts: int) -> pa.RecordBatch:
    """Rows of a batch of classes (name, word hashes): probes by part, and hits known already by class."""
    names = np.array([c for c, _ in classes], dtype=np.int64)
    grams = [windows(h, block) for _, h in classes]
    own = np.repeat(np.arange(len(classes)), [len(g) for g in grams])
    anchor = np.concatenate([np.arange(len(g)) % block == 0 for g in grams])
    part, key = _key(np.concatenate(grams), parts)
    order = np.lexsort((own, key, part))
    part, key, own, anchor = part[order], key[order], own[order], anchor[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    size = np.diff(at, append=len(key))
    last = at + size - 1
    common = own[at] != own[last]                       # holders are sorted
    known = np.repeat(common, size)
    has_anchor = np.add.reduceat(anchor.astype(np.int64), at) > 0 if len(at) else at
    send = np.ones(len(key), dtype=bool)
    send[known] = False
    send[at[common]] = send[last[common]] = True
    anchor[at[common]] = has_anchor[common]
    hit_own, hit_token = own[known], _token(part[known], key[known], parts)
    by = np.argsort(hit_own, kind="stable")
    cuts = np.flatnonzero(np.diff(hit_own[by], prepend=-1))
    hit_lists = np.split(hit_token[by], cuts[1:]) if len(cuts) else []
    part, key, own, anchor = part[send], key[send], own[send], anchor[send]
    order = np.lexsort((own, part))
    part, key, own, anchor = part[order], key[order], own[order], anchor[order]
    flagged = (key << U(1)) | anchor.astype(U)
    at = np.flatnonzero(np.diff(part, prepend=-1))
    rows = []
    for a, b in zip(at.tolist(), np.append(at[1:], len(part)).tolist(), strict=True):
        o, n = np.unique(own[a:b], return_counts=True)
        f = flagged[a:b]
        rows.append(np.array([b - a, len(o)], dtype="<u4").tobytes() + names[o].tobytes() + n.astype("<u4").tobytes()
                    + f.astype("<u4").tobytes() + (f >> U(32)).astype(np.uint8).tobytes())
    k, m = len(rows), len(hit_lists)
    hit_names = names[hit_own[by][cuts]] if m else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([part[at], np.abs(hit_names % parts)]).astype(np.int32)),
         pa.array(rows + [None] * m, pa.binary()), pa.array([None] * k + hit_names.tolist(), pa.int64()),
         pa.array([None] * k + [x.tolist() for x in hit_lists], pa.list_(pa.int64()))],
        names=["part", "probes", "cls", "tokens"])


def _probes(docs: DataFrame, block: int, window: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in batches_of(texts):
                w = words(texts[lo:hi])
                classes = []
                for i in range(hi - lo):
                    h = w.hashes[w.first[i]:w.first[i + 1]]
                    if len(h) >= window:
                        name = _sequence_name(h)
                        if name not in done:
                            done.add(name)
                            classes.append((name, h))
                if classes:
                    yield _probe_rows(classes, block, parts)

    return docs.select("text").mapInArrow(run, "part int, probes binary, cls long, tokens array<long>")


def _hits(parts: int):
    def run(block: pa.Table) -> pa.Table:
        """cls, token: what each class of a part has in common with an anchor or probe of another class."""
        is_probe = pc.is_valid(block["probes"])
        names, keys = [np.empty(0, np.int64)], [np.empty(0, dtype=U)]
        for r in block.filter(is_probe)["probes"].to_pylist():
            n, k = np.frombuffer(r, dtype="<u4", count=2).tolist()
            own = np.frombuffer(r, dtype=np.int64, count=k, offset=8)
            counts = np.frombuffer(r, dtype="<u4", count=k, offset=8 + 8 * k)
            low = np.frombuffer(r, dtype="<u4", count=n, offset=8 + 12 * k)
            high = np.frombuffer(r, dtype=np.uint8, count=n, offset=8 + 12 * k + 4 * n)
            names.append(np.repeat(own, counts))
            keys.append(low.astype(U) | (high.astype(U) << U(32)))
        own, key = np.concatenate(names), np.concatenate(keys)
        anchor, key = (key & U(1)).astype(bool), key >> U(1)
        order = np.lexsort((own, key))
        own, key, anchor = own[order], key[order], anchor[order]
        at = np.flatnonzero(np.diff(key, prepend=key[:1] + U(1))) if len(key) else np.empty(0, np.int64)
        size = np.diff(at, append=len(key))
        hit = (own[at] != own[at + size - 1]) & (np.add.reduceat(anchor.astype(np.int64), at) > 0) if len(at) else at
        hit = np.repeat(hit, size).astype(bool)
        own, token = own[hit], _token(block["part"][0].as_py(), key[hit], parts)
        rest = block.filter(pc.invert(is_probe))
        lists = rest["tokens"].combine_chunks()
        known = np.repeat(rest["cls"].to_numpy(), pc.list_value_length(lists).to_numpy())
        return pa.table({"cls": np.concatenate([own, known.astype(np.int64)]),
                         "token": np.concatenate([token, lists.flatten().to_numpy()])})
    return run


def _candidates(rows: DataFrame, block: int, window: int, parts: int, to: int) -> DataFrame:
    """Fat rows of candidate windows: per part the documents (id, class, count), then hashes and starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids, names = (np.array(batch.column(c).to_pylist(), dtype=np.int64) for c in ("id", "cls"))
            tokens = batch.column("tokens")
            for lo, hi in batches_of(texts):
                w = words(texts[lo:hi])
                own, start, first, second = [], [], [], []
                for i in range(hi - lo):
                    h = w.hashes[w.first[i]:w.first[i + 1]]
                    grams = _token(*_key(windows(h, block), parts), parts)
                    hit = np.isin(grams, tokens[lo + i].values.to_numpy())
                    # a window of words that begins at most window - block before a hit covers it
                    reach = np.convolve(hit, np.ones(window - block + 1, dtype=np.int64))[window - block:]
                    at = np.flatnonzero(reach[:len(h) - window + 1])
                    own.append(np.full(len(at), lo + i))
                    start.append(at)
                    first.append(windows(h, window)[at])
                    second.append(windows(h, window, STEP2)[at])
                own, start, first, second = map(np.concatenate, (own, start, first, second))
                part = (first % U(to)).astype(np.int64)
                order = np.lexsort((own, part))
                part, own, start, first, second = (x[order] for x in (part, own, start, first, second))
                at = np.flatnonzero(np.diff(part, prepend=-1))
                rows_ = []
                for x, y in zip(at.tolist(), np.append(at[1:], len(part)).tolist(), strict=True):
                    o, n = np.unique(own[x:y], return_counts=True)
                    rows_.append(np.array([y - x, len(o)], dtype="<u4").tobytes() + ids[o].tobytes()
                                 + names[o].tobytes() + first[x:y].tobytes() + n.astype("<u4").tobytes()
                                 + second[x:y].astype("<u4").tobytes() + start[x:y].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(rows_, pa.binary())],
                                                 names=["part", "windows"])

    return rows.select("id", "cls", "text", "tokens").mapInArrow(run, "part int, windows binary")


def _removed(block: pa.Table) -> pa.Table:
    """cls, start: the windows of a part that a smaller document holds as well."""
    cols = [], [], [], [], []
    for r in block["windows"].to_pylist():
        n, k = np.frombuffer(r, dtype="<u4", count=2).tolist()
        counts = np.frombuffer(r, dtype="<u4", count=k, offset=8 + 16 * k + 8 * n)
        cols[0].append(np.repeat(np.frombuffer(r, dtype=np.int64, count=k, offset=8), counts))
        cols[1].append(np.repeat(np.frombuffer(r, dtype=np.int64, count=k, offset=8 + 8 * k), counts))
        cols[2].append(np.frombuffer(r, dtype=U, count=n, offset=8 + 16 * k))
        at = 8 + 20 * k + 8 * n
        cols[3].append(np.frombuffer(r, dtype="<u4", count=n, offset=at))
        cols[4].append(np.frombuffer(r, dtype="<u4", count=n, offset=at + 4 * n))
    ids, names, first, second, start = map(np.concatenate, cols)
    order = np.lexsort((ids, second, first))
    ids, names, first, second, start = (x[order] for x in (ids, names, first, second, start))
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(new)
    lost = ids > np.repeat(ids[at], np.diff(at, append=len(ids)))
    return pa.table({"cls": pa.array(names[lost], pa.int64()), "start": pa.array(start[lost].astype(np.int32))})


def _spans(starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal spans (begin, end) of words covered by windows."""
    s = np.unique(starts)
    new = np.concatenate([[True], s[1:] > s[:-1] + window])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return np.stack([s[new], s[last] + window], axis=1)


KEPT = "cls long, n_removed long, kept string, spans array<array<long>>"


def _cut(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, spans = [], [], []
            starts = batch.column("starts")
            for i, text in enumerate(batch.column("text").to_pylist()):
                all_words = (text or "").encode("utf-8", "surrogatepass").split()
                found = _spans(starts[i].values.to_numpy(), window)
                out, at = [], 0
                for a, b in found.tolist():
                    out += all_words[at:a]
                    at = b
                out += all_words[at:]
                kept.append(b" ".join(out).decode("utf-8", "surrogatepass"))
                removed.append(len(all_words) - len(out))
                spans.append(found.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                names=["cls", "n_removed", "kept", "spans"])

    return rows.select("cls", "text", "starts").mapInArrow(run, KEPT)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by one space), kept_sha256, spans of every row.

    ``spans`` are the maximal removed stretches as [first word, end).  ``kept``
    is null where nothing is removed or nothing is left: the digest tells the
    two apart.  A null doc_id is below all others; rows of one doc_id do not
    take words from each other.  Null or empty text has no words.  Repeated
    rows are kept once each with equal results.  Windows are compared by 96
    bits of hashes.  Other columns are ignored.  Empty table: no rows.
    """
    spark = docs.sparkSession
    python_ready(spark)
    block = (window + 1) // 2
    docs = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"dedup_texts_{uuid.uuid4().hex}"
    # texts are joined twice below: bucketed by id they are not shuffled
    docs.write.bucketBy(buckets, "id").format("parquet").option("path", shared_path(spark, "texts")).saveAsTable(name)
    texts = spark.table(name)
    found = settle(_documents(docs))
    total = found.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    parts = parts_for(total, TOKENS)
    hits = settle(_probes(docs, block, window, parts).groupBy("part").applyInArrow(
        _hits(parts), "cls long, token long"))
    hits = hits.groupBy("cls").agg(F.collect_list("token").alias("tokens"))
    heads = found.filter(F.col("n_words") >= window).groupBy("cls").agg(
        F.min(F.struct("id", "text_hash")).alias("r"), F.count("*").alias("rows"))
    heads = settle(heads.select("cls", "r.id", "r.text_hash", "rows"))
    def at_texts(by_class: DataFrame) -> DataFrame:
        """One text of each class beside what ``by_class`` has."""
        there = heads.join(by_class, "cls").select("id", F.col("text_hash").alias("_hash"), "cls", by_class.columns[1])
        return texts.join(there.hint("shuffle_hash"), "id").filter(F.col("text_hash") == F.col("_hash"))

    windows_ = _candidates(at_texts(hits), block, window, parts, parts_for(total // 4, STARTS))
    removed = settle(windows_.groupBy("part").applyInArrow(_removed, "cls long, start int"))
    removed = removed.groupBy("cls").agg(F.collect_list("start").alias("starts"))
    cut = settle(_cut(at_texts(removed), window)).dropDuplicates(["cls"])
    low = heads.select("cls", F.col("id").alias("_low"), "rows")
    rows = lookup(found.filter(F.col("n_words") >= window), low, ["cls"], F.col("rows"), found.count()).drop("rows")
    first = rows.filter(F.col("id") == F.col("_low")).join(cut, "cls", "left")
    rest = rows.filter(F.col("id") > F.col("_low")).unionByName(
        found.filter(F.col("n_words") < window).withColumn("_low", F.col("id")))
    all_rows = first.unionByName(rest, allowMissingColumns=True)
    copy = F.col("id") > F.col("_low")
    none = F.unhex(F.sha2(F.lit(""), 256))
    digest = F.when(copy, none).when(F.col("kept").isNotNull(), F.unhex(F.sha2("kept", 256))).otherwise(F.col("whole"))
    return all_rows.select(
        F.when(F.col("id") == LOWEST, F.lit(None)).otherwise(F.col("id")).cast("long").alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(~copy, F.col("kept")).alias("kept"), F.lower(F.hex(digest)).alias("kept_sha256"),
        F.when(copy, F.array(F.array(F.lit(0).cast("long"), F.col("n_words")))).otherwise(F.col("spans"))
        .alias("spans"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS low FROM win) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM hit)),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n
         FROM pos ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
