"""Large groups of the similarity join: how often a pair meets, and what the parity maps rule out."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import snapplan.llm.ngram_join as op


def test_a_pair_of_a_large_group_meets_a_few_times(spark, monkeypatch):
    """A family of borderline copies shares some hundred tokens; its pairs come out once for few of them."""
    rng, made, blocks = random.Random(3), [], op._block_pairs
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([4, 9, 13, 20])):
            w[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(w)))

    def counted(*args):
        out = blocks(*args).cache()
        made.append((out.count(), out.select(F.least("a", "b"), F.greatest("a", "b")).distinct().count()))
        return out

    monkeypatch.setattr(op, "_block_pairs", counted)
    op.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    rows_out, pairs = made[0]
    assert 0 < pairs <= rows_out <= 20 * pairs


def test_parity_maps_of_long_sets(spark):
    """Sets of other sizes have maps of other sizes; both bounds are the same in SQL and in numpy, and tell long sets apart."""
    rng = np.random.default_rng(1)
    tokens = np.unique(rng.integers(0, 1 << 63, 8000, dtype=np.int64)).view(op.U)
    sets = [tokens[:3000], tokens[600:3600], tokens[:4100], tokens[100:4150], tokens[:120], tokens[10:130]]
    maps = [op.parity(s) for s in sets]
    assert len({len(m) for m in maps}) == 3
    n, cls = [len(s) for s in sets], list(range(len(sets)))
    pairs = [(a, b) for a in cls for b in cls if a < b]
    group = pa.RecordBatch.from_arrays(
        [pa.array(cls * 2), pa.array(n * 2), pa.array([m.tolist() for m in maps] * 2, pa.list_(pa.int64())),
         pa.array(cls * 2), pa.array([0] * len(cls) + [1] * len(cls))], names=["cls", "n", "bits", "comp", "side"])
    differ = op._differ(group, *np.array(pairs).T)
    for (a, b), d in zip(pairs, differ.tolist(), strict=True):
        assert d <= len(np.setxor1d(sets[a], sets[b]))
    classes = spark.createDataFrame([(c, k, m.tolist()) for c, k, m in zip(cls, n, maps, strict=True)],
                                    "cls long, n long, bits array<long>")
    sql = {tuple(r) for r in op._passed(spark.createDataFrame(pairs, "a long, b long"), classes, 75).collect()}
    blocks = {(int(x), int(y)) for a, b in op._cross_pairs(group, 75) for x, y in zip(a, b, strict=True) if x < y}
    linked = {(a, b) for a, b in pairs if 100 * len(np.intersect1d(sets[a], sets[b]))
              >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert (2, 3) in linked and (0, 1) not in linked
    assert linked <= sql == blocks and (0, 1) not in sql
