"""Time, size and setting encodings (O-18, O-25, O-26)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

# FILETIME counts 100 ns ticks since 1601-01-01; the offset to
# the unix epoch in ticks.
FILETIME_EPOCH_OFFSET = 116444736000000000
TRUE_WORDS_P = ("1", "true", "yes", "on")
MIB = 1048576


def epoch_micros(ts) -> Column:
    """Microseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ columns,
    independent of the session time zone for NTZ values."""
    return F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
        col(ts).cast("timestamp_ntz"))


def mtime_filetime(unix_seconds) -> Column:
    """Unix seconds (long) -> FILETIME ticks."""
    return col(unix_seconds).cast("long") * F.lit(10_000_000) + F.lit(FILETIME_EPOCH_OFFSET)


def mtime_filetime_from_micros(unix_micros) -> Column:
    return col(unix_micros).cast("long") * F.lit(10) + F.lit(FILETIME_EPOCH_OFFSET)


def mtime_text(unix_seconds) -> Column:
    """Unix seconds as text (whole seconds print without a fraction)."""
    return col(unix_seconds).cast("long").cast("string")


def mtime_unix(unix_micros) -> Column:
    """Unix seconds as text from microseconds: ``1704067260`` for whole
    seconds, otherwise the exact decimal with trailing zeros dropped
    (``1704067260.5``).  Exact, unlike a double's text."""
    dec = (col(unix_micros).cast("decimal(38,0)") / F.lit(1_000_000)).cast("decimal(38,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(dec, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def mtime_micros_from_text(text) -> Column:
    """Inverse of ``mtime_unix``: seconds text -> microseconds (null when bad)."""
    return (col(text).try_cast("decimal(38,6)") * F.lit(1_000_000)).cast("long")


def mtime_parse(text, on_bad: str = "C") -> Column:
    """Lenient parse of stored mtime text.

    Bad text: variant C falls back to the minimum value (``-inf`` here,
    which never equals a real mtime), variant P to ``0``.
    """
    parsed = col(text).try_cast("double")
    fallback = F.lit(float("-inf")) if on_bad.upper() == "C" else F.lit(0.0)
    return F.coalesce(parsed, fallback)


def size_mib(size) -> Column:
    """Bytes -> MiB with two decimals (no group separators)."""
    return F.round(col(size) / F.lit(float(MIB)), 2)


def as_int(value, default: int | None = None) -> Column:
    v = col(value).try_cast("int")
    return v if default is None else F.coalesce(v, F.lit(default))


def as_bool(value, variant: str = "C", default: bool | None = None) -> Column:
    """C: the text equals ``true`` ignoring case; P: one of 1/true/yes/on,
    trimmed.  A null value takes the default (false when none)."""
    v = col(value)
    if variant.upper() == "C":
        b = F.lower(v) == F.lit("true")
    else:
        b = F.lower(F.trim(v)).isin(*TRUE_WORDS_P)
    return F.coalesce(b, F.lit(bool(default)))


def split_list(value, pattern: str = "[,;]") -> Column:
    """``a, b;;c`` -> ``[a, b, c]``: split, trim whitespace, drop blanks."""
    parts = F.split(col(value), pattern)
    trimmed = F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: x != F.lit(""))
