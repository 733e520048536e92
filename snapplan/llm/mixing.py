"""Operator 3: mixing sources to target weights by Pfair scheduling.

The documents of a source, in hash order, form blocks of ``block`` documents.
One block is emitted per slot.  With a share of W / Q of the slots, block j of
a source is released at floor(j Q / W) and due at ceil((j + 1) Q / W);
earliest deadline first among the released blocks meets every deadline, so at
any slot a source is less than one block away from its share, however long the
run.  Shares are whole numbers W of Q = 2^40.  The driver schedules the blocks
and hands every bucket of documents the slots of its own blocks.  When a source
ends, a new phase begins with the weights of the rest.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parts_for

BLOCK = 16
SLOTS = 1 << 40          # shares are whole numbers of so many slots
BUCKET = 8192            # documents of a source that are put in order together
PLANNED = ("phase", "release", "deadline", "slot", "missing")
ADDED = ("block", "phase", "release", "deadline", "slot", "position")


def whole_weights(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Weights as whole slots that add up to ``slots``, at least one each (largest remainders)."""
    total = sum(map(Fraction, weights.values()))
    spare = slots - len(weights)
    exact = {s: Fraction(w) / total * spare for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    rest = slots - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:rest]:
        out[s] += 1
    return out


def edf(weights: dict[str, int], slots: int) -> Iterator[str]:
    """Earliest deadline first without end: the source of each slot, by weights that add up to ``slots``."""
    released, coming, done = [], [(0, -(-slots // w), s) for s, w in weights.items()], dict.fromkeys(weights, 0)
    heapq.heapify(coming)
    t = 0
    while True:
        while coming and coming[0][0] <= t:
            _, due, s = heapq.heappop(coming)
            heapq.heappush(released, (due, s))
        due, s = heapq.heappop(released)
        if t >= due:
            raise AssertionError("a deadline was missed")
        yield s
        done[s] = j = done[s] + 1
        w = weights[s]
        heapq.heappush(coming, (j * slots // w, -(-(j + 1) * slots // w), s))
        t += 1


def frame_of(weights: dict[str, int], slots: int) -> dict[str, list[int]]:
    """The slots of each source within the first ``slots``, after which the schedule repeats."""
    out: dict[str, list[int]] = {s: [] for s in weights}
    for t, s in zip(range(slots), edf(weights, slots), strict=False):
        out[s].append(t)
    return out


def schedule(documents: dict[str, int], weights: dict[str, float], block: int, slots: int) -> dict[str, np.ndarray]:
    """For each source its blocks in order: phase, release, deadline, slot and the documents that blocks before
    its phase lack of being full.  A phase ends with the last block of a source."""
    left = {s: parts_for(n, block) for s, n in documents.items() if n}
    plan: dict[str, list[np.ndarray]] = {s: [] for s in left}
    begin, missing, phase = 0, 0, 0
    while left:
        whole = whole_weights({s: weights[s] for s in left}, slots)
        if len(left) == 1:
            (last, n), = left.items()
            at = {last: np.arange(n)}
        else:
            at = {s: array("q") for s in left}
            for t, last in enumerate(edf(whole, slots)):
                at[last].append(t)
                if len(at[last]) == left[last]:
                    break
        for s in left:
            own, w = np.array(at[s], np.int64), whole[s]
            starts = [j * slots // w for j in range(len(own))]
            ends = [-(-(j + 1) * slots // w) for j in range(len(own))]
            plan[s].append(np.stack([np.full(len(own), phase), np.array(starts, np.int64), np.array(ends, np.int64),
                                     begin + own, np.full(len(own), missing)]))
            left[s] -= len(own)
        begin += sum(len(x) for x in at.values())
        missing += -documents[last] % block
        phase += 1
        del left[last]
    return {s: np.concatenate(p, axis=1) for s, p in plan.items()}


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK,
                slots: int = SLOTS, seed: int = 0) -> DataFrame:
    """The columns of ``docs``, then block, phase, release, deadline, slot (release and deadline within the
    phase) and position, which numbers all documents from 0 without gaps in mixed order.

    ``weights`` are target shares by source; a source that is not named gets
    the smallest one named, and without weights a source's share is the square
    root of its number of documents.  Every row is kept once.  A null source
    is a source of its own; a null doc_id is ordered like any other; repeated
    rows are rows of their own.  Columns of ``docs`` named like the added ones
    are replaced.  Empty table: no rows.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ADDED]
    named = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    rows = docs.select(*keep, named.alias("_source"), F.xxhash64(F.lit(seed), "doc_id").alias("_order"),
                       (F.xxhash64("text") if "text" in keep else F.lit(0)).alias("_tie"))
    sizes = {r[0]: r[1] for r in rows.groupBy("_source").count().collect()}
    total = sum(sizes.values())
    if weights is None:
        share = {s: n ** 0.5 for s, n in sizes.items()}
    else:
        given = {"" if s is None else f"={s}": w for s, w in weights.items()}
        share = {s: given.get(s, min(given.values())) for s in sizes}
    buckets = parts_for(total, BUCKET)
    rows = rows.withColumn("_bucket", F.pmod("_order", F.lit(buckets)))
    group = ["_source", "_bucket"]
    plan = schedule(sizes, share, block, max(slots, 16 * len(sizes)))
    places, before = [], dict.fromkeys(sizes, 0)
    for r in rows.groupBy(*group).count().orderBy(*group).toLocalIterator():
        s, b, n = r
        lo, hi = before[s] // block, (before[s] + n - 1) // block + 1
        places.append((s, b, before[s], lo, *plan[s][:, lo:hi]))
        before[s] += n
    names = ["_source", "_bucket", "_before", "_first", *(f"_{c}" for c in PLANNED)]
    kinds = [pa.string(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * len(PLANNED)]
    columns = list(zip(*places, strict=True)) or [()] * len(names)
    places = spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names))

    number = F.row_number().over(Window.partitionBy(*group).orderBy("_order", "doc_id", "_tie")) - 1
    rows = rows.withColumn("_number", number).join(places, group)
    rows = rows.withColumn("_at", F.col("_number") + F.col("_before"))
    rows = rows.withColumn("block", F.floor(F.col("_at") / block).cast("long"))
    own = (F.col("block") - F.col("_first")).cast("int")
    values = {"block": F.col("block"), **{c: F.col(f"_{c}")[own] for c in PLANNED}}
    values["position"] = values["slot"] * block + F.col("_at") % block - values.pop("missing")
    return rows.select(*keep, *(v.cast("int" if c == "phase" else "long").alias(c) for c, v in values.items()))
