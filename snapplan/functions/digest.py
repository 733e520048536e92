"""Content digests (O-20 .. O-23).

Table payloads are digested JVM-side with the built-in hash expressions.
Real files are digested inside Spark tasks by ``digest_files`` (a
``mapInPandas`` stage that streams each file in chunks), and only for the
rows the caller passes in - the stale subset.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ._util import col

# Fixed values (must stay as they are to read and write compatible state):
SYMLINK_PREFIX = "SYM-"
UNRESOLVED_LINK_TARGET = "Ziel nicht verfügbar"
EMPTY_DIGEST_P = "0"


def digest(content, algo: str = "md5") -> Column:
    """Lower-hex digest of a string or binary column."""
    c = col(content)
    algo = algo.lower()
    if algo == "md5":
        return F.md5(c)
    if algo == "sha1":
        return F.sha1(c)
    if algo in ("sha256", "sha2"):
        return F.sha2(c, 256)
    if algo == "sha512":
        return F.sha2(c, 512)
    raise ValueError(f"unsupported digest {algo!r}")


def symlink_digest(target) -> Column:
    """``SYM-`` + base64(UTF-8 target); unresolvable target -> placeholder.

    Base64 line chunking (CRLF every 76 characters) is stripped so the value
    does not depend on ``spark.sql.chunkBase64String.enabled``.
    """
    t = F.coalesce(col(target), F.lit(UNRESOLVED_LINK_TARGET))
    b64 = F.translate(F.base64(t.cast("binary")), "\r\n", "")
    return F.concat(F.lit(SYMLINK_PREFIX), b64)


def digest_or_zero(content, size) -> Column:
    """Variant P: an empty file's digest is the literal ``0``."""
    return F.when(col(size) == 0, F.lit(EMPTY_DIGEST_P)).otherwise(F.md5(col(content)))


def digest_bytes(hex_col) -> Column:
    return F.unhex(col(hex_col))


def digest_hex(bytes_col) -> Column:
    return F.lower(F.hex(col(bytes_col)))


def is_link_digest(hash_col) -> Column:
    return col(hash_col).startswith(SYMLINK_PREFIX)


# --------------------------------------------------------------------------
# Real files: chunked digest inside tasks.
# --------------------------------------------------------------------------

_CHUNK = 4 * 1024 * 1024


def _digest_one(path: str, algo: str, follow_links: bool = False) -> str | None:
    import os
    try:
        if not follow_links and os.path.islink(path):
            try:
                target = os.path.normpath(os.path.join(os.path.dirname(path), os.readlink(path)))
            except OSError:
                target = UNRESOLVED_LINK_TARGET
            import base64
            return SYMLINK_PREFIX + base64.b64encode(target.encode("utf-8")).decode("ascii")
        h = hashlib.new(algo)
        with open(path, "rb") as fh:
            while True:
                block = fh.read(_CHUNK)
                if not block:
                    break
                h.update(block)
        return h.hexdigest()
    except OSError:
        return None


def tasks_for_bytes(total_bytes: int, target_bytes: int = 256 * 1024 * 1024) -> int:
    return max(1, -(-int(total_bytes or 0) // target_bytes))


def balance_by_size(df: DataFrame, target_bytes: int = 256 * 1024 * 1024) -> DataFrame:
    """Deal file rows over tasks of about ``target_bytes`` each, by a running
    sum of their sizes.

    The rows are written once; within each written file and then over the
    files (a sum per file) their bytes are summed up, and the sum is cut into
    equal ranges, so a task exceeds its range by less than one file.  Files
    of ``target_bytes`` and more are alone in their tasks.  Null sizes count
    as empty."""
    rows = cut_lineage(df)
    bytes_ = F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0))
    placed = rows.select("*", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_r"),
                         F.when(bytes_ < target_bytes, bytes_).otherwise(0).alias("_small"),
                         (bytes_ >= target_bytes).cast("int").alias("_huge"))
    so_far = Window.partitionBy("_f").orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)      # one row per written file
    sums = placed.groupBy("_f").agg(F.sum("_small").alias("_s"), F.sum("_huge").alias("_h"))
    total, huge = sums.agg(F.sum("_s"), F.sum("_h")).first()
    small = tasks_for_bytes(total, target_bytes)
    before = sums.select(F.col("_f").alias("_f0"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0")
                                                     for c in ("_s", "_h")))
    task = F.when(F.col("_huge") == 1, F.lit(small - 1) + F.col("_h0") + F.sum("_huge").over(so_far)).otherwise(
        F.least(F.lit(small - 1), F.floor((F.col("_s0") + F.sum("_small").over(so_far) - F.col("_small"))
                                          / F.lit(target_bytes))))
    dealt = placed.join(before.hint("merge"), F.col("_f") == F.col("_f0")).withColumn("_task", task.cast("int"))
    return dealt.repartitionById(small + int(huge or 0), "_task").select(*df.columns)


def digest_files(files: DataFrame, path_col: str = "path", out_col: str = "fresh_hash",
                 algo: str = "md5", target_bytes: int | None = 256 * 1024 * 1024,
                 follow_links: bool = False) -> DataFrame:
    """Digest the files named in ``path_col`` inside Spark tasks.

    Work is spread by bytes (``balance_by_size``) when ``target_bytes`` is
    set.  Links get the ``SYM-`` pseudo digest unless ``follow_links``
    (variant P hashes the target's content).  A failure yields a null digest
    (the caller splits those rows off as issues, O-37)."""
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType(list(files.schema.fields) + [StructField(out_col, StringType(), True)])
    df = balance_by_size(files, target_bytes) if target_bytes else files

    def run(batches):
        for pdf in batches:
            out = pdf.copy()
            out[out_col] = [_digest_one(p, algo, follow_links) for p in pdf[path_col].tolist()]
            yield out

    return df.mapInPandas(run, schema)
