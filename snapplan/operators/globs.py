"""A table of globs against strings as an equi-join on anchors (O-43).

Every glob with a literal character has an anchor: text that all its matches
hold at a known place.  Each of the glob's literal runs offers some - the one
before the first wildcard (a match starts with it), the one after the last (a
match ends with it), those between wildcards (a match has them somewhere) -
cut at either end to one of a few lengths.  The glob takes the one that the
fewest globs offer: what many globs share, like a common top directory, tells
them apart from nothing.  A string gives the pieces of those lengths at those
places, so strings and globs meet by equality and only these pairs are tested.
Globs of wildcards alone say something about the length of a string only, and
meet it by that.

Distinct strings and globs meet by the hash of the piece.  Kinds and lengths
of anchors with few globs are broadcast, up to a checked number of globs
together; the others are shuffled, and a piece that very many strings have is
spread over many tasks by a salt, with its globs once per salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: anchors are cut to the largest of these lengths that fits
LENGTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: globs up to this number may be broadcast
MAX_BROADCAST = 10_000
#: tasks that strings with one anchor are spread over, if it is hot
SALTS = 64
#: a key of more than total / HOT_SHARE rows, and of HOT_LEAST, is hot; there are at most HOT_SHARE
HOT_SHARE, HOT_LEAST = 10_000, 10_000


def like_text(glob: Column) -> Column:
    """Glob text -> LIKE text (escape first, then wildcards)."""
    return F.translate(F.regexp_replace(glob, r"([\\%_])", r"\\$1"), "*?", "%_")


def _hot(counts: DataFrame) -> DataFrame:
    """The hot keys of counted ones (last column ``_n``), marked ``_hot``; few enough to be broadcast."""
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return F.broadcast(counts.filter(F.col("_n") > max(HOT_LEAST, total // HOT_SHARE)).withColumn("_hot", F.lit(True)))


def _dealt(rows: DataFrame) -> DataFrame:
    """Short rows with much work each, written and dealt over many tasks even when their table is small."""
    rows = cut_lineage(rows)
    n = rows.count()
    return rows.repartition(max(1, n // 100_000, min(2_000, n // 4_096)))


def anchored(globs: DataFrame, column: str) -> DataFrame:
    """Distinct globs, lower-cased, as ``_like, _kind, _len, _text, _star, _least``; written once.

    ``_kind`` is start, end, inside or length (no literal character);
    ``_star`` says whether the glob has a ``*``, ``_least`` how many
    characters a match has at least.
    """
    g = _dealt(globs.select(F.lower(column).alias("_g")).distinct())

    def offer(kind: str, n: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("_kind"), n.alias("_len"), text.alias("_text"))

    def offers(run: Column, place: str) -> Column:
        """Anchors of a literal run: its beginning and its end, where they are at that place."""
        n = F.greatest(F.lit(0), *(F.when(F.length(run) >= k, k) for k in LENGTHS))
        return F.array(offer("start" if place == "start" else "inside", n, F.left(run, n)),
                       offer("end" if place == "end" else "inside", n, F.right(run, n)))

    runs = F.split("_g", r"[*?]")
    inner = F.transform(F.slice(runs, 2, F.greatest(F.size(runs) - 2, F.lit(0))), lambda r: offers(r, "inside"))
    every = F.concat(offers(runs[0], "start"), offers(F.element_at(runs, -1), "end"), F.flatten(inner))
    g = cut_lineage(g.withColumn("_a", F.array_distinct(F.filter(every, lambda o: o["_len"] > 0))))
    kind = ["_kind", "_len", "_text"]
    offered = cut_lineage(g.select("_g", F.explode("_a").alias("_o")).select("_g", "_o.*"))
    counts = cut_lineage(offered.groupBy(*kind).agg(F.count(F.lit(1)).alias("_n")))
    hot = _hot(counts)
    first = offered.join(hot, kind, "left")
    counted = first.filter("_hot").drop("_hot").unionByName(
        first.filter("_hot is null").drop("_hot", "_n").join(counts, kind))
    # of anchors that are about as rare, one at an end has fewer pieces to meet
    rank = F.struct(F.ceil(F.log2("_n")).alias("rare"), (F.col("_kind") == "inside").alias("inside"),
                    (-F.col("_len")).alias("short"), "_kind", "_text")
    best = counted.groupBy("_g").agg(F.min_by(F.struct(*kind), rank).alias("_b"))
    free = g.filter(F.size("_a") == 0).select("_g", F.struct(
        F.lit("length").alias("_kind"), F.lit(0).alias("_len"), F.lit("").alias("_text")).alias("_b"))
    return cut_lineage(best.unionByName(free).select(
        like_text(F.col("_g")).alias("_like"), "_b.*", F.contains("_g", F.lit("*")).alias("_star"),
        F.length(F.replace(F.col("_g"), F.lit("*"), F.lit(""))).alias("_least")))


def piece_key(kind: Column, n: Column, text: Column) -> Column:
    return F.xxhash64(kind, n, text)


def pieces(x: Column, wanted: list[tuple[str, int]]) -> Column:
    """The keys (hashes of kind, length and text) that a string has for the wanted kinds and lengths."""
    def at(kind: str, n: int):
        return lambda i: piece_key(F.lit(kind), F.lit(n), F.substr(x, i, F.lit(n)))

    out = []
    for kind, n in wanted:
        if kind == "start":
            out.append(F.array(piece_key(F.lit(kind), F.lit(n), F.left(x, F.lit(n)))))
        elif kind == "end":
            out.append(F.array(piece_key(F.lit(kind), F.lit(n), F.right(x, F.lit(n)))))
        else:
            places = F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1)))
            out.append(F.transform(places, at(kind, n)))
    return F.array_distinct(F.concat(*out))


def glob_matches(strings: DataFrame, text: str, keys: list[str], globs: DataFrame, column: str,
                 max_broadcast: int = MAX_BROADCAST, rules: DataFrame | None = None) -> DataFrame:
    """``keys`` of the rows whose ``text`` matches any glob, ignoring case; rows may repeat.

    ``rules``: the globs as ``anchored`` gave them before, for a second call.
    At most one row per kind and anchor length (36), and a few numbers, reach
    the driver.
    """
    rules = anchored(globs, column) if rules is None else rules
    sizes = rules.filter("_kind <> 'length'").groupBy("_kind", "_len").agg(F.count(F.lit(1)).alias("_n")).collect()
    rows = strings.select(*keys, F.lower(text).alias("_x")).filter("_x is not null")
    found = []

    free = rules.filter("_kind = 'length'")
    least = free.filter("_star").agg(F.min("_least")).first()[0]
    if least is not None:
        found.append(rows.filter(F.length("_x") >= least).select(*keys))
    # one row per length of globs made of ? alone: no more than the longest glob has characters
    exact = free.filter("not _star").select(F.col("_least").alias("_n")).distinct()
    if not exact.isEmpty():
        found.append(rows.join(exact, F.length("_x") == F.col("_n"), "left_semi").select(*keys))

    if sizes:
        texts = _dealt(rows.select("_x").distinct())
        few, many, n = [], [], 0
        for r in sorted(sizes, key=lambda r: (r._n, r._kind, r._len)):
            n += r._n
            (few if n <= max_broadcast else many).append((r._kind, r._len))

        def met(wanted: list[tuple[str, int]], broadcast: bool) -> DataFrame:
            """Distinct strings that match a glob whose anchor is of a wanted kind and length."""
            kinds = F.array(*(F.struct(F.lit(k).alias("_kind"), F.lit(m).alias("_len")) for k, m in wanted))
            index = rules.filter(F.array_contains(kinds, F.struct("_kind", "_len"))).select(
                piece_key(F.col("_kind"), F.col("_len"), F.col("_text")).alias("_k"), "_like")
            probes = texts.select("_x", F.explode(pieces(F.col("_x"), wanted)).alias("_k"))
            if broadcast:
                pairs = probes.join(F.broadcast(index), "_k")
            else:
                # pieces that very many strings have, whether a glob has them as its anchor or not
                hot = _hot(cut_lineage(probes.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")))).drop("_n")
                salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_x"), F.lit(SALTS)).cast("int")).otherwise(0)
                each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
                probes = probes.join(hot, "_k", "left").withColumn("_salt", salt).drop("_hot")
                index = index.join(hot, "_k", "left").withColumn("_salt", F.explode(each)).drop("_hot")
                pairs = probes.join(index.hint("merge"), ["_k", "_salt"])
            return pairs.filter(F.like(F.col("_x"), F.col("_like"))).select("_x")

        parts = [met(wanted, wanted is few) for wanted in (few, many) if wanted]
        hit = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).distinct()
        found.append(rows.join(hit, "_x", "left_semi").select(*keys))
    out = found[0] if found else strings.select(*keys).limit(0)
    for f in found[1:]:
        out = out.unionByName(f)
    return out
