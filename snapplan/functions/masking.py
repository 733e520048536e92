"""Secret masking and the secret registry (O-27 .. O-30).

The registry is a DataFrame ``secrets(secret string)``.  Masking replaces
every registered literal, longest first then by value, with a placeholder.
The registry reaches the executors in chunks of at most ``CHUNK_SIZE``
secrets, taken in the global masking order (range bounds from a bounded
sample); chunks are applied one after another, which equals one sequential
pass over the whole registry.  Neither the driver nor a task ever holds
more than one chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ._util import col

# Fixed values (placeholders and the key-name words that mark a setting as
# sensitive).
SECRET_PLACEHOLDER = "***SECRET***"
FLAGGED_PLACEHOLDER = "hidden"
SENSITIVE_KEY_WORDS = ("key", "secret", "password", "token", "credential", "apikey")

# Secrets carried as literals in one chunk.
CHUNK_SIZE = 5_000


def clean_registry(secrets: DataFrame, secret_col: str = "secret") -> DataFrame:
    """Blank entries dropped, duplicates ignoring case removed (the least
    value per case-folded key represents it)."""
    s = col(secret_col)
    return (secrets.select(s.alias("secret"))
            .filter(F.col("secret").isNotNull() & (F.trim(F.col("secret")) != ""))
            .groupBy(F.upper("secret").alias("_k"))
            .agg(F.min("secret").alias("secret"))
            .select("secret"))


def registry_add(secrets: DataFrame, new: DataFrame) -> DataFrame:
    """Set union ignoring case; an already registered spelling wins."""
    old = clean_registry(secrets).withColumn("_r", F.lit(0))
    add = clean_registry(new).withColumn("_r", F.lit(1))
    both = old.unionByName(add)
    return (both.groupBy(F.upper("secret").alias("_k"))
            .agg(F.min_by("secret", F.struct("_r", "secret")).alias("secret"))
            .select("secret"))


def registry_remove(secrets: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove entries whose case-folded value is in ``gone``."""
    g = clean_registry(gone).select(F.upper("secret").alias("_k"))
    return (secrets.withColumn("_k", F.upper("secret"))
            .join(g, "_k", "left_anti").drop("_k"))


def ordered_secret_list(secrets: DataFrame) -> list[str]:
    """The registry in masking order, longest first, then by value, on the
    driver: for small registries and tests."""
    rows = clean_registry(secrets).orderBy(F.length("secret").desc(), F.col("secret")).collect()
    return [r["secret"] for r in rows]


def _order_key(len_col, sec_col):
    return F.struct((-len_col).alias("l"), sec_col.alias("s"))


MAX_BOUND_SAMPLE = 200_000


def secret_chunks(secrets: DataFrame, chunk_size: int = CHUNK_SIZE):
    """Yield the cleaned registry as lists in masking order (longest first,
    then by value), each of at most about ``chunk_size`` secrets.

    Range bounds come from a sample of at most ``MAX_BOUND_SAMPLE`` rows; a
    range that still holds too many secrets is split again from a sample of
    its own, so the driver never holds more than the sample or one chunk."""
    reg = cut_lineage(clean_registry(secrets).select("secret", F.length("secret").alias("_len")))
    key = _order_key(F.col("_len"), F.col("secret"))
    yield from _chunks_of(reg, key, chunk_size, reg.count())


def _bound(k):
    return F.struct(F.lit(k[0]).alias("l"), F.lit(k[1]).alias("s"))


def _chunks_of(reg: DataFrame, key, chunk_size: int, n: int):
    if n == 0:
        return
    if n <= 2 * chunk_size:
        rows = reg.orderBy(F.col("_len").desc(), "secret").collect()
        yield [r["secret"] for r in rows]
        return
    n_chunks = -(-n // chunk_size)
    want = min(MAX_BOUND_SAMPLE, 20 * n_chunks)
    samp = reg.sample(withReplacement=False, fraction=min(1.0, want / n), seed=11).collect()
    keys = sorted({(-r["_len"], r["secret"]) for r in samp})
    step = max(1, len(keys) // n_chunks)
    bounds = keys[step::step]
    edges = [None, *bounds, None]
    for lo, hi in zip(edges[:-1], edges[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (key >= _bound(lo))
        if hi is not None:
            cond = cond & (key < _bound(hi))
        part = reg.filter(cond)
        m = part.count()
        if m > 2 * chunk_size and len(bounds) > 0:
            yield from _chunks_of(part, key, chunk_size, m)     # sample too coarse here: split again
        elif m:
            rows = part.orderBy(F.col("_len").desc(), "secret").collect()
            yield [r["secret"] for r in rows]


def mask_literals(text, secrets: Sequence[str], placeholder: str = SECRET_PLACEHOLDER,
                  chunk_size: int = CHUNK_SIZE) -> Column:
    """Sequential literal replacement, chunked so no projection carries more
    than ``chunk_size`` literals in one array."""
    out = col(text)
    for i in range(0, len(secrets), chunk_size):
        arr = F.array(*[F.lit(s) for s in secrets[i:i + chunk_size]])
        out = F.aggregate(arr, out, lambda acc, s: F.replace(acc, s, F.lit(placeholder)))
    return out


def _trie(words: Sequence[str]) -> dict:
    """Nested dictionaries by character; the key ``''`` marks the end of a word."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}
    return root


def _escaped(c: str) -> str:
    return c if c.isalnum() else f"\\x{{{ord(c):x}}}"


def literals_regex(words: Sequence[str]) -> str:
    """A regular expression for any of the words that takes the longest at a
    place; common beginnings are written once, so a place is given up at the
    first character that no word has there."""
    def write(node: dict) -> str:
        chain = ""
        while len(node) == 1 and "" not in node:           # a single way on
            (c, node), = node.items()
            chain += _escaped(c)
        ways = [_escaped(c) + write(n) for c, n in sorted(node.items()) if c]
        if not ways:
            return chain
        return f"{chain}(?:{'|'.join(ways)}){'?' if '' in node else ''}"

    return write(_trie(words))


def _may_form(secret: str, placeholder: str) -> bool:
    """Whether an inserted placeholder can be a part of an occurrence of the secret."""
    return (secret in placeholder or placeholder in secret
            or any(secret.endswith(placeholder[:k]) or secret.startswith(placeholder[-k:])
                   for k in range(1, len(placeholder))))


def mask_found(text, secrets: Sequence[str], placeholder: str = SECRET_PLACEHOLDER) -> Column:
    """Same result as ``mask_literals``; its replacements run only for secrets
    that the text holds.

    One pass of a regular expression over the text gives the longest secret
    at each place.  These, the secrets that they begin with, and those that
    an inserted placeholder may complete, are replaced one after another in
    the global order: no other secret can occur.  Texts without a hit stay
    as they are.
    """
    order = [s for s in secrets if s]
    if not order:
        return col(text)
    known = set(order)
    risky = [s for s in order if _may_form(s, placeholder)]
    begins = {s: [s[:k] for k in range(1, len(s)) if s[:k] in known] for s in order}
    found = F.regexp_extract_all(col(text), F.lit(f"(?=({literals_regex(order)}))"), F.lit(1))
    inner = {s: b for s, b in begins.items() if b}
    strings = "array<string>"
    extra = [F.array(*map(F.lit, risky)).cast(strings)] if risky else []
    if inner:
        shorter = F.create_map(*(x for s, b in inner.items() for x in (F.lit(s), F.array(*map(F.lit, b)))))
        extra.append(F.flatten(F.transform(found, lambda s: F.coalesce(F.element_at(shorter, s), F.array().cast(strings)))))
    here = F.array_distinct(F.concat(found, *extra) if extra else found)
    ranked = F.array_sort(F.transform(here, lambda s: F.struct((-F.length(s)).alias("l"), s.alias("s"))))
    masked = F.aggregate(ranked, col(text), lambda acc, r: F.replace(acc, r["s"], F.lit(placeholder)))
    return F.when(F.size(found) > 0, masked).otherwise(col(text))


def mask_secrets(df: DataFrame, secrets: DataFrame, cols: Iterable[str] | None = None,
                 placeholder: str = SECRET_PLACEHOLDER) -> DataFrame:
    """Mask every string column (or ``cols``) of ``df``."""
    names = list(cols) if cols is not None else [
        f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    for lits in secret_chunks(secrets):
        df = df.withColumns({c: mask_found(c, lits, placeholder) for c in names})
    return df


def is_sensitive_key(key) -> Column:
    k = F.lower(col(key))
    cond = F.lit(False)
    for w in SENSITIVE_KEY_WORDS:
        cond = cond | k.contains(w)
    return cond


def mask_by_key(key, value, secrets: "Sequence[str] | DataFrame") -> Column:
    """Hide the whole value of a sensitive key, else mask literals in it.
    ``secrets``: a list, or the registry DataFrame (applied chunk by chunk)."""
    masked = col(value)
    chunks = secret_chunks(secrets) if isinstance(secrets, DataFrame) else [list(secrets)]
    for chunk in chunks:
        if not chunk:
            continue
        masked = mask_found(masked, chunk)
    return F.when(is_sensitive_key(key), F.lit(SECRET_PLACEHOLDER)).otherwise(masked)


def mask_flagged(value, flag, placeholder: str = FLAGGED_PLACEHOLDER) -> Column:
    """Variant P: only settings flagged as secret are hidden."""
    return F.when(col(flag), F.lit(placeholder)).otherwise(col(value))
