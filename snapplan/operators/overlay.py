"""Layered settings with provenance (O-50, O-51, O-52), re-aimed at any
table of overrides: ``layers(job, section, skey, value, layer, seq)``.

Precedence: cmdline > env > file > default; within a layer the last row
(highest ``seq``) wins; null values never win.  The winner is one
``max_by`` aggregation per ``(job, section, skey)``, partial before the
shuffle, so a job with a third of all rows is combined map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masking import mask_by_key

LAYER_RANK = {"default": 1, "file": 2, "env": 3, "cmdline": 4}


def layer_rank(layer_col: str = "layer", ranks: dict[str, int] = LAYER_RANK):
    expr = F.lit(0)
    for name, r in sorted(ranks.items(), key=lambda kv: kv[1]):
        expr = F.when(F.col(layer_col) == name, F.lit(r)).otherwise(expr)
    return expr


def resolve_layers(layers: DataFrame, ranks: dict[str, int] = LAYER_RANK) -> DataFrame:
    """O-50 -> ``job, section, skey, value, layer``."""
    keyed = layers.filter(F.col("value").isNotNull()).withColumn("_rank", layer_rank("layer", ranks))
    won = keyed.groupBy("job", "section", "skey").agg(
        F.max_by(F.struct("value", "layer"), F.struct("_rank", "seq")).alias("_w"))
    return won.select("job", "section", "skey", F.col("_w.value").alias("value"),
                      F.col("_w.layer").alias("layer"))


def layer_report(resolved: DataFrame, secrets: "Sequence[str] | DataFrame") -> DataFrame:
    """O-51: per (job, section) a ``[section]`` header then
    ``key=value (layer)`` lines, values masked by key name or registry.
    Sort key ``job, section, kind, skey`` (no window)."""
    masked = mask_by_key("skey", "value", secrets)
    items = resolved.select("job", "section", F.lit(1).alias("kind"), "skey",
                            F.concat(F.col("skey"), F.lit("="), masked, F.lit(" ("), F.col("layer"),
                                     F.lit(")")).alias("line"))
    headers = (resolved.select("job", "section").distinct()
               .select("job", "section", F.lit(0).alias("kind"), F.lit("").alias("skey"),
                       F.concat(F.lit("["), F.col("section"), F.lit("]")).alias("line")))
    return headers.unionByName(items)


def missing_keys(resolved: DataFrame, jobs: DataFrame, required: Sequence[tuple[str, str]]) -> DataFrame:
    """O-52: required ``(section, key)`` pairs without a resolved value, per
    job.  The required list is a job parameter; it is expanded per job with
    a generator (no cross join)."""
    req = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("skey")) for s, k in required])
    wanted = jobs.select("job").distinct().select("job", F.inline(req))
    return wanted.join(resolved.select("job", "section", "skey"), ["job", "section", "skey"], "left_anti")
