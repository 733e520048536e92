"""Ignore rules (O-31 .. O-35, O-43).

A rule without ``*`` or ``?`` is an exact name, compared ignoring case.  A
rule with them is a glob: ``*`` any run (``/`` included), ``?`` one
character, everything else literal, anchored, ignoring case.  Globs become
``ILIKE`` patterns, which Catalyst simplifies (``*.tmp`` -> EndsWith) and
keeps inside codegen.  A row is ignored when its bare name or its full path
matches (O-33); with subtree pruning also when any directory between the
scan root and the file matches (O-34).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import col
from ..functions.paths import dirname
from .globs import MAX_BROADCAST, anchored, glob_matches

# The three junk names variant P always skips (case-sensitive).
FIXED_IGNORED_NAMES_P = (".DS_Store", "Thumbs.db", "desktop.ini")

def glob_to_like(pattern: str) -> str:
    """Glob -> LIKE pattern with ``\\`` as escape character."""
    out = []
    for ch in pattern:
        if ch in "\\%_":
            out.append("\\" + ch)
        elif ch == "*":
            out.append("%")
        elif ch == "?":
            out.append("_")
        else:
            out.append(ch)
    return "".join(out)


def is_glob(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


@dataclass(frozen=True)
class Rules:
    exact: tuple[str, ...]
    globs: tuple[str, ...]       # already translated to LIKE

    @classmethod
    def of(cls, patterns: Iterable[str]) -> "Rules":
        exact, globs = [], []
        for p in patterns:
            if p is None or not p.strip():
                continue
            (globs if is_glob(p) else exact).append(p)
        return cls(tuple(exact), tuple(glob_to_like(g) for g in globs))


#: says whether any of some names is ignored
NameTest = Callable[..., bool]


def _like_regex(like: str) -> str:
    """One LIKE pattern of ``Rules`` as a regular expression."""
    wild = {"%": "(?s:.*)", "_": "(?s:.)"}
    return "".join(wild.get(t) or re.escape(t[-1]) for t in re.findall(r"\\.|[^\\]", like, re.DOTALL))


def name_test(rules: Rules) -> NameTest:
    """``Rules`` as a plain function, for code that walks a file system in a
    task: the same exact names and LIKE patterns as the Column form."""
    literal = frozenset(e.upper() for e in rules.exact)
    any_glob = re.compile("|".join(f"(?:{_like_regex(g)})" for g in rules.globs) or "(?!)", re.IGNORECASE)

    def test(*names: str) -> bool:
        return any(n.strip() and (n.upper() in literal or any_glob.fullmatch(n) is not None) for n in names)

    return test


def match_one(x, rules: Rules) -> Column:
    """One string (a bare name or a full path) against the rules."""
    c = col(x)
    cond = F.lit(False)
    if rules.exact:
        cond = cond | F.upper(c).isin(*[p.upper() for p in rules.exact])
    for g in rules.globs:
        cond = cond | c.ilike(g)
    return F.coalesce(cond, F.lit(False))


def matches(name, path, rules: Rules) -> Column:
    """O-33: the bare name or the full path matches."""
    return match_one(name, rules) | match_one(path, rules)


def ancestors(path, root) -> Column:
    """Directories from the scan root (inclusive) down to the file's parent,
    as ``array<struct<name, path>>``.  Directories above the root are not
    part of it."""
    parts = F.split(col(path), "/")
    root_parts = F.split(F.regexp_replace(col(root), "/+$", ""), "/")
    lo, hi = F.size(root_parts), F.size(parts) - 1
    idx = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.struct(
        F.element_at(parts, i).alias("name"),
        F.array_join(F.slice(parts, 1, i), "/").alias("path")))


def ignored(name, path, root, rules: Rules, subtree: bool = True) -> Column:
    """O-34: the file or any directory from the root down matches."""
    hit = matches(name, path, rules)
    if subtree:
        hit = hit | F.exists(ancestors(path, root),
                             lambda a: matches(a["name"], a["path"], rules))
    return hit


def ignore_exact(df: DataFrame, patterns: Sequence[str], name: str = "name") -> DataFrame:
    """O-31: exact names only (globs ignored here)."""
    r = Rules.of([p for p in patterns if not is_glob(p)])
    return df.filter(~match_one(name, r))


def ignore_glob(df: DataFrame, patterns: Sequence[str], name: str = "name") -> DataFrame:
    """O-32: glob rules on the bare name."""
    r = Rules.of([p for p in patterns if is_glob(p)])
    return df.filter(~match_one(name, r))


def ignore_full_path(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """O-33: name or full path."""
    return df.filter(~matches("name", "path", Rules.of(patterns)))


def apply_ignore(df: DataFrame, patterns: Sequence[str], subtree: bool = True) -> DataFrame:
    """O-34: drop ignored files and everything below an ignored directory."""
    return df.filter(~ignored("name", "path", "root", Rules.of(patterns), subtree))


def apply_ignore_fixed(df: DataFrame, names: Sequence[str] = FIXED_IGNORED_NAMES_P) -> DataFrame:
    """O-35: variant P's fixed junk names, case-sensitive."""
    return df.filter(~F.col("name").isin(*names))


def apply_ignore_table(files: DataFrame, patterns: DataFrame, pattern_col: str = "pattern",
                       subtree: bool = False, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """O-43: rules held in a table, for rule sets too large to inline.

    Exact rules are an equi-join on the upper-cased text, globs one on their
    anchors (``globs.glob_matches``).  With ``subtree`` each directory from
    the root down is tested once, whatever the number of files below it.
    """
    p = (patterns.select(F.col(pattern_col).alias("_p"))
         .filter(F.col("_p").isNotNull() & (F.trim("_p") != "")))
    is_glob_ = F.col("_p").contains("*") | F.col("_p").contains("?")
    exact = p.filter(~is_glob_).select(F.upper("_p").alias("_k")).distinct()
    globs = p.filter(is_glob_)
    rules = anchored(globs, "_p")

    def hits(strings: DataFrame, keys: list[str]) -> DataFrame:
        """Keys of the rows whose ``_x`` any rule matches."""
        literal = strings.join(exact, F.upper("_x") == F.col("_k"), "left_semi").select(*keys)
        return literal.unionByName(glob_matches(strings, "_x", keys, globs, "_p", max_broadcast, rules)).distinct()

    def either(df: DataFrame, keys: list[str], name: str, path: str) -> DataFrame:
        """O-33: one row for the bare name and one for the full path."""
        return df.select(*keys, F.explode(F.array(F.col(name), F.col(path))).alias("_x"))

    keys = ["root", "path"] if subtree else ["path"]
    out = files.join(hits(either(files.select(*keys, "name"), keys, "name", "path"), keys), keys, "left_anti")
    if not subtree:
        return out
    dirs = (files.groupBy("root", dirname("path").alias("_dir")).agg(F.min("path").alias("_p"))
            .select("root", "_dir", F.explode(ancestors("_p", "root")).alias("_a"))
            .select("root", "_dir", F.col("_a.name").alias("_n"), F.col("_a.path").alias("_q")))
    tested = dirs.select("_n", "_q").distinct()
    bad = dirs.join(hits(either(tested, ["_q"], "_n", "_q"), ["_q"]), "_q", "left_semi").select(
        F.col("root").alias("_r"), "_dir").distinct()
    return (out.withColumn("_own", dirname("path"))
            .join(bad, F.col("root").eqNullSafe(F.col("_r")) & (F.col("_own") == F.col("_dir")), "left_anti").drop("_own"))
