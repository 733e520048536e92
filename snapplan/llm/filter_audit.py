"""Operator 12: audit of how filters interact, by counting paths through the lattice of filter subsets.

Each document fails some set of the filters, and the number of documents per
part and set of failures is all that the order of filters acts on.  A state is
the set of filters applied so far; an edge adds one filter and removes the
documents that fail it and none of the state.  The number of orders that reach
a state (forward) times the number that leave the next one (backward) is the
number of orders over an edge: the removals of a filter's edges, weighted so,
add up to its Shapley sum.  The steps of every single order are read from the
same edges.

The lattice is fixed by the number of filters (32 states and 80 edges for
five).  All that grows with the documents is one pass over the texts and
aggregations of narrow rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, settle

LETTERS = "ABCDE"
WHITE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> list[Column]:
    """The conditions on a text alone: few words, few different words, many capitals, odd marks."""
    words = F.array_remove(F.split(text, WHITE), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 200, 100 * different < 50 * n, 100 * capitals > 3 * F.char_length(text), text.rlike("[#$%&*|]")]


def later_copies(rows: DataFrame) -> DataFrame:
    """Add ``copy``: whether a smaller doc_id has the same ``digest``.  A null doc_id is neither smaller nor larger.

    Only digests that rows share are joined back; those that many share, from
    a broadcast of bounded size.
    """
    shared = settle(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("held"), F.min("doc_id").alias("first"))
                    .filter("held > 1"))
    total = rows.count()
    found = lookup(rows, shared, ["digest"], F.col("held"), total, "left")
    return found.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("held", "first")


def failure_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bit i: filter i), good, toxic of every document."""
    text = F.coalesce("text", F.lit(""))
    # a narrow row for each text: the words are not needed again
    first = settle(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"),
                               F.unhex(F.sha2(text, 256)).alias("digest"),
                               *(c.alias(f"f{i}") for i, c in enumerate(text_failures(text)))))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = later_copies(first).withColumnRenamed("copy", f"f{len(LETTERS) - 1}")
    bits = [F.when(F.col(f"f{i}"), 1 << i).otherwise(0) for i in range(len(LETTERS))]
    rows = rows.select("doc_id", "part", sum(bits[1:], bits[0]).alias("fails"))
    return rows.join(marks.hint("merge"), "doc_id", "left").select(
        "part", "fails", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"))


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """Orders that reach each state from the empty one, and orders from each state to the full one."""
    size = 1 << n
    forward, backward = [1] + [0] * (size - 1), [0] * (size - 1) + [1]
    for s in range(size):
        for f in range(n):
            if not s >> f & 1:
                forward[s | 1 << f] += forward[s]
    for s in reversed(range(size)):
        for f in range(n):
            if not s >> f & 1:
                backward[s] += backward[s | 1 << f]
    return forward, backward


def lattice_edges(n: int) -> list[tuple[int, int, int, int]]:
    """(state, filter, the filter's bit, orders over the edge) of every edge."""
    forward, backward = path_counts(n)
    return [(s, f, 1 << f, forward[s] * backward[s | 1 << f]) for s in range(1 << n) for f in range(n) if not s >> f & 1]


def _rows_of(values: list[tuple], names: list[str]) -> Column:
    """An array literal of structs of whole numbers and strings."""
    return F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, row, strict=True))) for row in values))


def filter_interactions(failures: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and the counts of each step from rows of part, fails, good, toxic.

    Returns one row per part, order and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.
    """
    n = len(letters)
    counts = settle(failures.groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")))
    edges = _rows_of(lattice_edges(n), ["state", "filter", "bit", "orders"])
    # every edge of a part is there, those that remove nothing with zeros
    crossed = counts.withColumn("e", F.explode(edges))
    fails, before, bit = F.col("fails"), F.col("fails").bitwiseAND(F.col("e.state")) != 0, F.col("e.bit")
    on = fails.bitwiseAND(bit) != 0
    gone, alone, alive = on & ~before, fails == bit, ~on & ~before

    def total(which: Column, of: str) -> Column:
        return F.sum(F.when(which, F.col(of)).otherwise(0))

    edge = crossed.groupBy("part", F.col("e.state").alias("state"), F.col("e.filter").alias("filter"),
                           F.col("e.orders").alias("orders")).agg(
        total(gone, "n").alias("removed"), total(gone, "good").alias("good_lost"),
        total(gone, "toxic").alias("toxic_lost"), total(on, "n").alias("failing"),
        total(alone, "n").alias("unique_fails"), total(alive, "n").alias("kept"))
    edge = edge.withColumn("redundant", F.col("failing") - F.col("removed"))
    shapley = edge.groupBy("part", "filter").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))

    # one row per step of an order, on the edge that it takes
    steps: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in permutations(range(n)):
        state, name = 0, "".join(letters[f] for f in order)
        for k, f in enumerate(order, 1):
            steps.setdefault((state, f), []).append((name, k))
            state |= 1 << f
    taken = F.create_map(*(x for (s, f), at in sorted(steps.items())
                           for x in (F.lit(s * n + f), _rows_of(at, ["filter_order", "step"]))))
    return (edge.join(shapley.hint("merge"), ["part", "filter"])
            .select("*", F.explode(F.element_at(taken, F.col("state") * n + F.col("filter"))).alias("at"))
            .select("part", "at.filter_order", "at.step", "kept", "removed", "redundant", "unique_fails",
                    "good_lost", "toxic_lost", "shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters on the whole texts of ``docs``, per lang.

    Null text: an empty one, a copy of any other empty text.  Null lang: the
    part of the empty string.  Null doc_id: kept, unlabelled, never a later
    copy.  Repeated rows: each counts; equal doc_ids are not copies of each
    other.  Several labels of one doc_id: it is good or toxic if any says so;
    null labels say nothing.  Empty table: no rows.  Other columns are ignored.
    """
    return filter_interactions(failure_rows(docs.select("doc_id", "text", "lang"),
                                            labels.select("doc_id", "quality", "toxic")))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
firsts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first FROM documents GROUP BY 1),
marks AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 END), 0) AS good,
                 coalesce(max(CASE WHEN toxic = 1 THEN 1 END), 0) AS toxic FROM labels GROUP BY 1),
docs AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END ||
         CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END ||
         CASE WHEN 100 * len(regexp_replace(words.text, '[^A-Z]', '', 'g')) > 3 * len(words.text) THEN 'C' ELSE '' END ||
         CASE WHEN regexp_matches(words.text, '[#$%&*|]') THEN 'D' ELSE '' END ||
         CASE WHEN coalesce(doc_id > first, false) THEN 'E' ELSE '' END AS fails
  FROM words JOIN firsts ON words.text = firsts.text LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY 1, 2),
f(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM f a JOIN f b ON b.l <> a.l JOIN f c ON c.l NOT IN (a.l, b.l) JOIN f d ON d.l NOT IN (a.l, b.l, c.l)
  JOIN f e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
steps AS (SELECT filter_order, step, filter_order[step] AS own, left(filter_order, step - 1) AS before
          FROM orders, range(1, 6) t(step)),
flags AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, n, good, toxic,
         contains(fails, own) AS fail, fails = own AS lone,
         before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone
  FROM counts, steps),
per AS (
  SELECT part, filter_order, step, own,
         CAST(sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN lone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM flags GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM per
"""
