"""Path parts, file extensions and sharded destinations (O-17, O-19, O-24).

All functions return Columns built from JVM-side expressions, so they stay
inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col


def dirname(path) -> Column:
    """Everything before the last ``/``: ``''`` for a bare name and for the
    root itself, ``/`` for an entry of the root."""
    p = col(path)
    before = F.substr(p, F.lit(1), F.length(p) - F.length(basename(p)) - 1)
    return (F.when((F.instr(p, "/") == 0) | (p == "/"), F.lit("")).when(F.length(p) == F.length(basename(p)) + 1, F.lit("/"))
            .otherwise(before))


def basename(path) -> Column:
    """Everything after the last ``/``."""
    return F.substring_index(col(path), "/", -1)


def stem(name) -> Column:
    """Name without its last extension: ``a.tar.gz`` -> ``a.tar``, ``.x`` -> ``''``."""
    return F.regexp_replace(col(name), r"\.[^.]*\z", "")


def extension(name, variant: str = "C") -> Column:
    """File extension of a bare name.

    Variant C: from the last dot to the end, empty when the name ends in a
    dot, so ``.DS_Store`` keeps its whole name as extension.
    Variant P: leading dots do not start an extension, and a trailing dot is
    an extension of its own (``.DS_Store`` -> ``''``, ``name.`` -> ``.``).
    """
    if variant.upper() == "C":
        return F.regexp_extract(col(name), r"(\.[^.]+)\z", 1)
    if variant.upper() == "P":
        return F.regexp_extract(col(name), r"(?s)^\.*[^.].*(\.[^.]*)\z", 1)
    raise ValueError(f"unknown variant {variant!r}")


def path_parts(path) -> dict[str, Column]:
    p = col(path)
    name = basename(p)
    return {"dir": dirname(p), "name": name, "stem": stem(name)}


def shard_path(hash_col, ext_col, depth: int = 3) -> Column:
    """``a/b/c/<hash><ext>``: the first ``min(depth, len(hash))`` characters
    of the hash, one directory each.  With depth 0 the result starts with
    ``/`` (an empty directory list joined, then the separator)."""
    h, e = col(hash_col), col(ext_col)
    if depth <= 0:
        prefix = F.lit("")
    else:
        n = F.least(F.lit(depth), F.length(h))
        idx = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
        chars = F.transform(idx, lambda i: F.substring(h, i, 1))
        prefix = F.when(n > 0, F.array_join(chars, "/")).otherwise(F.lit(""))
    return F.concat(prefix, F.lit("/"), h, F.coalesce(e, F.lit("")))
