"""Glob -> ILIKE translation against an independent regex form of the
same rule (``*`` any run, ``?`` one character, rest literal, anchored,
ignoring case), on generated patterns and names."""

import re

from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapplan.operators import ignore as IG
from snapplan.operators.globs import glob_matches

ALPHABET = "aB.*?_%\\/x-"
pattern_s = st.builds(lambda a, w, b: a + w + b, st.text(alphabet=ALPHABET, max_size=3),
                      st.sampled_from(["*", "?"]), st.text(alphabet=ALPHABET, max_size=3))
name_s = st.text(alphabet="aAbB._%\\/x-", min_size=0, max_size=7)


def reference(pattern: str, name: str) -> bool:
    rx = "^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$"
    return re.match(rx, name, re.IGNORECASE | re.DOTALL) is not None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(pattern_s, name_s), min_size=20, max_size=40))
def test_glob_like_matches_regex(spark, pairs):
    df = spark.createDataFrame(pairs, "p string, n string")
    exprs = [F.col("n").ilike(IG.glob_to_like(p)).alias(f"m{i}") for i, (p, _) in enumerate(pairs)]
    row = df.select(*exprs, "n").collect()
    for i, (p, n) in enumerate(pairs):
        got = next(r[f"m{i}"] for r in row if r["n"] == n)
        assert got == reference(p, n), (p, n)


free_s = st.text(alphabet=ALPHABET, min_size=1, max_size=9)


@settings(max_examples=12, deadline=None)
@example([("a*", "Abc"), ("*", ""), ("?", "x"), ("*?*", "ab"), ("*b.*", "a.B.c"), ("a?*?b", "axyB"), ("**", "q")])
@given(st.lists(st.tuples(free_s, name_s), min_size=10, max_size=40))
def test_anchored_join_matches_regex(spark, pairs):
    """Any globs against any strings, with the globs broadcast and salted."""
    globs = [p for p, _ in pairs if IG.is_glob(p)]
    names = sorted({n for _, n in pairs})
    rules = spark.createDataFrame([(g,) for g in globs], "p string")
    df = spark.createDataFrame(list(enumerate(names)), "k int, n string")
    want = {k for k, n in enumerate(names) if any(reference(g, n) for g in globs)}
    for most in (10_000, 0):
        assert {r.k for r in glob_matches(df, "n", ["k"], rules, "p", most).collect()} == want
