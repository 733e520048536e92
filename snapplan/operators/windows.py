"""Running counts and sums in a global order without one task per group.

A plain ``Window.partitionBy(group).orderBy(key)`` sends a whole group to
one task; a group may hold a third of all rows.  ``bucketed_running``
cuts the key range into buckets whose bounds come from a bounded sample
(at most ``n_buckets - 1`` values reach the driver), numbers rows inside
each ``(group, bucket)`` cell, and adds the totals of earlier buckets of
the same group, a prefix sum over a table of at most
``groups x buckets`` rows.  Results are exact; only the bucket bounds are
sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _numeric(df: DataFrame, key: str) -> bool:
    t = df.schema[key].dataType.typeName()
    return t in ("long", "integer", "short", "byte", "double", "float")


def _bounds(df: DataFrame, key: str, n_buckets: int, total: int | None) -> list:
    if n_buckets <= 1:
        return []
    if _numeric(df, key):
        # one pass, Greenwald-Khanna sketch; only n_buckets-1 numbers return
        probs = [i / n_buckets for i in range(1, n_buckets)]
        qs = df.approxQuantile(key, probs, 1.0 / (4 * n_buckets))
        return sorted(set(qs))
    if total is None:
        total = df.count()
    if total <= 0:
        return []
    frac = min(1.0, 20.0 * n_buckets / total)
    sample = df.select(key).sample(withReplacement=False, fraction=frac, seed=17)
    vals = [r[0] for r in sample.orderBy(key).collect() if r[0] is not None]
    if not vals:
        return []
    return sorted({vals[i * len(vals) // n_buckets] for i in range(1, n_buckets)})


def bucket_of(key_col, bounds: list):
    """Number of ``bounds`` (sorted) that are <= the key, by a two-level
    search: about ``2 * sqrt(len(bounds))`` comparisons per row."""
    if not bounds:
        return F.lit(0)
    per = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[i:i + per] for i in range(0, len(bounds), per)]
    if len(chunks) == 1:
        return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= key_col))
    coarse = F.array(*[F.lit(c[0]) for c in chunks[1:]])
    fine = F.array(*[F.array(*[F.lit(b) for b in c]) for c in chunks])
    c = F.size(F.filter(coarse, lambda b: b <= key_col))
    within = F.size(F.filter(F.element_at(fine, c + 1), lambda b: b <= key_col))
    return c * F.lit(per) + within


def bucketed_running(df: DataFrame, group: Sequence[str], key: str, tiebreak: Sequence[str] = (),
                     sums: Sequence[str] = (), n_buckets: int | None = None,
                     total: int | None = None, rows_per_bucket: int = 2_000_000) -> DataFrame:
    """Adds ``run_n`` (1-based position within the group in ``key,
    tiebreak`` order) and ``run_<c>`` (running sum) for each ``c`` in
    ``sums``.  ``key`` must be orderable; buckets split on it.  The bucket
    count grows with the data (``rows_per_bucket``), so a cell stays small
    even for a group holding a third of all rows."""
    if n_buckets is None:
        if total is None:
            total = df.count()
        n_buckets = max(64, -(-total // rows_per_bucket))
    bounds = _bounds(df, key, n_buckets, total)
    bucket = bucket_of(F.col(key), bounds)
    g = list(group)
    b = df.withColumn("_bucket", bucket)
    cell = Window.partitionBy(*g, "_bucket").orderBy(key, *tiebreak).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    b = b.withColumn("_cn", F.count(F.lit(1)).over(cell))
    for c in sums:
        b = b.withColumn(f"_cs_{c}", F.sum(c).over(cell))

    totals = b.groupBy(*g, "_bucket").agg(F.count(F.lit(1)).alias("_tn"),
                                          *[F.sum(c).alias(f"_ts_{c}") for c in sums])
    before = Window.partitionBy(*g).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(*g, "_bucket",
                         F.coalesce(F.sum("_tn").over(before), F.lit(0)).alias("_on"),
                         *[F.coalesce(F.sum(f"_ts_{c}").over(before), F.lit(0)).alias(f"_os_{c}")
                           for c in sums])
    j = b.join(offs, [*g, "_bucket"], "inner")
    j = j.withColumn("run_n", F.col("_on") + F.col("_cn"))
    for c in sums:
        j = j.withColumn(f"run_{c}", F.col(f"_os_{c}") + F.col(f"_cs_{c}"))
    drop = ["_bucket", "_cn", "_on"] + [f"_cs_{c}" for c in sums] + [f"_os_{c}" for c in sums]
    return j.drop(*drop)
