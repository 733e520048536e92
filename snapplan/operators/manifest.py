"""Manifest rows, text sink and archive layout (O-13, O-14, O-44, O-56).

The manifest is ordered by directory, then path, with a ``dir >> <dir>``
marker before each directory.  Instead of numbering rows inside a window
per directory (one task per directory - a directory may hold a third of
all files), every line carries its sort key ``(dir, kind, path)``: each
row emits its directory marker (``kind 0``) and its file line (``kind 1``)
and one distinct removes the repeats (markers are collapsed map-side).  The text sink range-partitions on that key, so even a hot
directory is split across tasks and the part files concatenate in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encodings import mtime_filetime, mtime_filetime_from_micros

# The manifest's structural lines.
MANIFEST_HEADER = "Filename,Hash,Extension,Size,Modified Time,InQueue"
DIR_MARKER = "dir >> "
END_OF_PREAMBLE = "EOF"


def csv_field(c) -> Column:
    """Minimal CSV quoting (variant P): quote when the field holds a comma,
    a quote or a line break; double inner quotes."""
    s = F.col(c) if isinstance(c, str) else c
    needs = s.rlike("[,\"\r\n]")
    return F.when(needs, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def _python_float_text(seconds) -> Column:
    """Text of a whole-second unix time as Python prints a float (``N.0``)."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.concat(s.cast("long").cast("string"), F.lit(".0"))


def manifest_rows(planned: DataFrame, variant: str = "C", mtime_unit: str = "s") -> DataFrame:
    """O-44: ``dir, kind, path, line`` (kind 0 = directory marker).

    ``mtime_unit``: ``s`` for unix seconds, ``us`` for microseconds (the
    inventory scan)."""
    size_txt = F.col("size").cast("string")
    if variant.upper() == "C":
        ft = mtime_filetime("mtime") if mtime_unit == "s" else mtime_filetime_from_micros("mtime")
        fields = [F.col("name"), F.col("hash"), F.col("ext"), size_txt, ft.cast("string"), F.col("in_queue")]
    else:
        secs = F.col("mtime") if mtime_unit == "s" else F.col("mtime") / F.lit(1_000_000)
        fields = [csv_field("name"), csv_field("hash"), csv_field("ext"), size_txt,
                  _python_float_text(secs), F.col("in_queue")]
    line = F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields])
    marker = F.struct(F.col("dir").alias("dir"), F.lit(0).alias("kind"), F.lit("").alias("path"),
                      F.concat(F.lit(DIR_MARKER), F.col("dir")).alias("line"))
    body = F.struct(F.col("dir").alias("dir"), F.lit(1).alias("kind"), F.col("path").alias("path"),
                    line.alias("line"))
    # every row yields its marker and its line; one distinct (partial
    # aggregation first) removes repeated markers and repeated paths
    return planned.select(F.explode(F.array(marker, body)).alias("_r")).select("_r.*").distinct()


def manifest_lines(rows: DataFrame, preamble: Sequence[str]) -> DataFrame:
    """O-13 lines: preamble (section 0, with ``EOF``, a blank line and the
    header appended) then the rows (section 1).  Sort key:
    ``section, seq, dir, kind, path``."""
    spark = rows.sparkSession
    pre = list(preamble) + [END_OF_PREAMBLE, "", MANIFEST_HEADER]
    pre_df = spark.createDataFrame([(0, i, "", 0, "", s) for i, s in enumerate(pre)],
                                   "section int, seq int, dir string, kind int, path string, line string")
    body = rows.select(F.lit(1).alias("section"), F.lit(0).alias("seq"), "dir", "kind", "path", "line")
    return pre_df.unionByName(body)


def manifest_preamble(variant: str, run_ts, config_lines=()) -> list[str]:
    """Preamble lines before ``EOF``: variant C starts with the run time,
    variant P with a fixed heading; then the documented settings."""
    if variant.upper() == "C":
        first = f"Backup run at: {run_ts:%Y-%m-%d %H:%M:%S}"
    else:
        first = "Backup configuration:"
    return [first, *config_lines]


def run_line(run_ts: Column, label: str = "Backup run at: ") -> Column:
    return F.concat(F.lit(label), F.date_format(run_ts, "yyyy-MM-dd HH:mm:ss"))


def write_manifest(lines: DataFrame, path: str, partitions: int | None = None) -> str:
    """O-13 sink: globally ordered text; part files concatenate in order."""
    by = ("section", "seq", "dir", "kind", "path")
    ordered = (lines.repartitionByRange(partitions, *by).sortWithinPartitions(*by) if partitions
               else lines.orderBy(*by))
    (ordered.select("line").write.mode("errorifexists").text(path))
    return path


def archive_path(job, run_ts) -> Column:
    """O-14: ``metadata/<job>/<yyyy>/<MM>/backup_<yyyy-MM-dd_HH-mm-ss>.csv``."""
    j = F.col(job) if isinstance(job, str) else job
    t = F.col(run_ts) if isinstance(run_ts, str) else run_ts
    return F.concat(F.lit("metadata/"), j.cast("string"), F.lit("/"), F.date_format(t, "yyyy"),
                    F.lit("/"), F.date_format(t, "MM"), F.lit("/backup_"),
                    F.date_format(t, "yyyy-MM-dd_HH-mm-ss"), F.lit(".csv"))


def manifest_table(planned: DataFrame) -> DataFrame:
    """Lossless manifest (Parquet form): one row per unique path."""
    return planned.dropDuplicates(["path"]).select(
        "dir", "name", "hash", "ext", "size", "mtime", "in_queue")


def write_manifest_table(planned: DataFrame, base: str, job: str, run_ts) -> str:
    """O-14 dataset form: the lossless manifest appended below ``base``,
    partitioned by ``job, year, month`` with the run timestamp as a column
    (names with commas survive here, unlike in the text form, D-9)."""
    ts = F.lit(run_ts).cast("timestamp")
    rows = (manifest_table(planned)
            .withColumn("run_ts", ts)
            .withColumn("job", F.lit(job))
            .withColumn("year", F.date_format(ts, "yyyy"))
            .withColumn("month", F.date_format(ts, "MM")))
    rows.write.mode("append").partitionBy("job", "year", "month").parquet(base)
    return base
