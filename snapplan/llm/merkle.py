"""Operator 11: Merkle manifest of a table by lag and lead windows.

Leaves stand in the order of a key within their group.  At each level the
nodes' siblings are lag and lead columns of fixed offsets, masked by the slot
of the node in its run and by the run's length, and the first child of each
run hashes the parent.  Runs never cross a block of ``fan ** LEVELS`` leaves,
so the windows of these levels are partitioned by block and a group of any
size is many bounded windows over one exchange; the blocks' tops are the
leaves of the next round.  The groups' tops, in the order of their keys, form
the last tree.

Places within a group come from files written in order, a row's number in its
file and the sum over earlier files: no window spans a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_order, settle, spread_over

FAN = 3
#: levels within one block of FAN ** LEVELS nodes
LEVELS = 6

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(values: list[Column]) -> Column:
    """The leaf of a row: each value as its byte count, a colon and its text, a null one as a dash."""
    texts = [v.cast("string") for v in values]
    return hashed(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def positions(rows: DataFrame, total: int, *order: str) -> DataFrame:
    """Add ``pos``, the place of a row in its group ``key`` by ``order``, and ``n``, the group's size."""
    placed = in_order(rows, spread_over(total), "key", *order)
    # a group's rows in one file: at most a file's rows, and only long groups are in several files
    pieces = placed.groupBy("_part", "_file", "key").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("key")
    before = group.orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_file", "key", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(group).alias("n"))
    return (placed.join(pieces.hint("merge"), ["_file", "key"])
            .withColumn("pos", F.col("_row") - F.col("_first") + F.col("_before"))
            .drop("_part", "_file", "_row", "_first", "_before"))


def _levels(rows: DataFrame, levels: int, fan: int) -> DataFrame:
    """Siblings of each row's ancestors in its block on ``levels`` levels, and the node above them.

    ``rows`` (key, block, pos, n, h) become rows with ``sibs``, an array of
    (left, right) per level, null where the group is one node already, and
    ``top``.  On level l a node stands in the row of its first leaf, so its
    siblings are multiples of ``fan ** l`` rows away.
    """
    block = Window.partitionBy("key", "block").orderBy("pos")
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    empty = F.lit("")
    node, pending = "_h0", {"_h0": F.col("h")}
    for level in range(levels):
        offset = fan ** level
        rows = rows.withColumns(pending)
        rows = rows.withColumns({f"_{way}{k}": of(node, k * offset).over(block)
                                 for k in range(1, fan) for way, of in (("lag", F.lag), ("lead", F.lead))})
        nodes = F.expr(f"(n + {offset - 1}) div {offset}")
        place = F.expr(f"pos div {offset}")
        slot = place % fan
        run = F.least(F.lit(fan), nodes - (place - slot))
        left = F.concat(*(F.when(slot >= k, F.col(f"_lag{k}")).otherwise(empty) for k in range(fan - 1, 0, -1)))
        right = F.concat(*(F.when(slot + k < run, F.col(f"_lead{k}")).otherwise(empty) for k in range(1, fan)))
        live = nodes > 1
        rows = rows.withColumns({
            f"_s{level}": F.when(F.col("pos") % offset == 0, F.struct(
                F.when(live, left).alias("left"), F.when(live, right).alias("right"))),
            f"_h{level + 1}": F.when(F.col("pos") % (offset * fan) == 0, F.when(
                live, hashed(F.col(node), right)).otherwise(F.col(node)))})
        rows = rows.drop(node, *(f"_{way}{k}" for k in range(1, fan) for way in ("lag", "lead")))
        # every leaf below a node has the node's siblings
        node, pending = f"_h{level + 1}", {f"_s{level}": F.last(f"_s{level}", ignorenulls=True).over(so_far)}
    rows = rows.withColumns(pending).withColumn("top", F.last(node, ignorenulls=True).over(so_far))
    done = [F.col(f"_s{i}") for i in range(levels)]
    sibs = F.array(*done) if done else F.expr("cast(array() as array<struct<left: string, right: string>>)")
    return rows.withColumn("sibs", sibs).drop(node, *(f"_s{i}" for i in range(levels)))


def depth_of(n: int, fan: int = FAN) -> int:
    """Levels above ``n`` leaves."""
    depth = 0
    while fan ** depth < n:
        depth += 1
    return depth


def climb(rows: DataFrame, most: int, total: int, fan: int = FAN, levels: int = LEVELS,
          above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows (key, pos, n, h, ...) with ``sibs`` of all levels of their group's tree and its ``top``.

    ``most`` is the largest ``n``, ``total`` the number of rows.  ``above``
    takes the rows of the last round, of which there are few per group.
    """
    depth, size = depth_of(most, fan), fan ** levels
    here = rows.withColumn("block", F.expr(f"pos div {size}")).repartition(spread_over(total), "key", "block")
    local = _levels(here, min(depth, levels), fan)
    if depth <= levels:
        return above(local.drop("block")) if above else local.drop("block")
    tops = settle(local.filter(F.col("pos") % size == 0).select(
        "key", F.col("block").alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("h")))
    up = climb(tops, -(-most // size), tops.count(), fan, levels, above)
    kept = [c for c in up.columns if c not in ("key", "pos", "n", "h", "sibs")]
    up = up.select(F.col("key").alias("_key"), F.col("pos").alias("_block"), F.col("sibs").alias("_up"), *kept)
    return (local.drop("top").join(up.hint("merge"), (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_block")))
            .withColumn("sibs", F.concat("sibs", "_up")).drop("_key", "_block", "_up", "block"))


def proof_text(sibs: Column) -> Column:
    """All siblings, level by level and left to right."""
    return F.array_join(F.transform(sibs, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, sibs: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(sibs, leaf, lambda h, s: F.when(s["left"].isNull(), h).otherwise(
        hashed(s["left"], h, s["right"])))


def merkle_manifest(rows: DataFrame, group: Column, order: list[str], fan: int = FAN,
                    levels: int = LEVELS) -> DataFrame:
    """Rows (leaf, ...) with ``subroot`` of their group's tree, ``root`` above all groups, and ``sibs`` of the way there.

    ``group`` is a string column, null first and then by bytes; within it
    leaves stand by ``order`` (nulls first) and then by themselves, so equal
    keys have a defined order.  Empty table: no rows.
    """
    keyed = settle(rows.withColumn("key", F.coalesce(F.concat(F.lit("="), group), F.lit(""))))
    total = keyed.count()
    placed = settle(positions(keyed, total, *order, "leaf").withColumn("h", F.col("leaf")))
    most = placed.agg(F.max("n")).first()[0] or 0

    def over_groups(last: DataFrame) -> DataFrame:
        tops = settle(last.filter("pos = 0").select(F.col("key").alias("own"), F.lit("").alias("key"),
                                                    F.col("top").alias("h")))
        groups = tops.count()
        tree = climb(settle(positions(tops, groups, "own")), groups, groups, fan, levels)
        tree = tree.select("own", F.col("sibs").alias("_over"), F.col("top").alias("root"))
        return (last.join(tree.hint("merge"), F.col("key") == F.col("own"))
                .withColumn("sibs", F.concat("sibs", "_over")).withColumnRenamed("top", "subroot")
                .drop("own", "_over"))

    return climb(placed, most, total, fan, levels, over_groups).drop("key", "pos", "n", "h")


def dataset_manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    ``tampered_text`` is what the text has become (null where it is as
    before, or where it is null); ``folded_root`` starts from that leaf.
    Null doc_id: before all others of its source.  Null source: a group of its
    own, before all others.  Repeated rows: a leaf each.  Null or empty text:
    a dash, or a count of zero.  Other columns are ignored.  Empty table: no rows.
    """
    values = [F.col(c) for c in FIELDS]
    changed = [F.coalesce(tampered_text, F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    other = F.when(tampered_text.isNotNull(), leaf_of(changed)) if tampered_text is not None else F.lit(None).cast("string")
    rows = docs.select("doc_id", "source", leaf_of(values).alias("leaf"), other.alias("tampered"))
    found = merkle_manifest(rows, F.col("source").cast("string"), ["doc_id"])
    folded_root = folded(F.coalesce("tampered", "leaf"), F.col("sibs"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("sibs")), 256).alias("proof_sha256"),
                        folded_root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS id, doc_id, source,
         list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
           lambda x: CAST(ord(x) AS BIGINT))),
           lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]),
                                 lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS unfinished_crc,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') ||
         coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') ||
         coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body,
         coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') AS tampered
  FROM documents),
placed AS (
  SELECT id, doc_id, coalesce('=' || source, '') AS key, sha256(head || body) AS leaf,
         sha256(head || CASE WHEN xor(unfinished_crc, 4294967295) % 2 = 0 THEN tampered ELSE body END) AS now,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(head || body)) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n
  FROM leaves),
nodes AS (
  SELECT key, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT key, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes
  WHERE n > 1 GROUP BY key, level, n, pos // 3),
subroots AS (
  SELECT key, level AS height, h AS subroot, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tree AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tree
  WHERE n > 1 GROUP BY level, n, pos // 3),
steps AS (
  SELECT p.id, o.level, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < o.pos), '') AS l,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > o.pos), '') AS r
  FROM placed p JOIN nodes o ON o.key = p.key AND o.n > 1 AND o.pos = p.pos // CAST(3 ** o.level AS BIGINT)
  JOIN nodes s ON s.key = o.key AND s.level = o.level AND s.pos // 3 = o.pos // 3 GROUP BY 1, 2
  UNION ALL
  SELECT p.id, 1000 + o.level, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < o.pos), ''),
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > o.pos), '')
  FROM placed p JOIN subroots r USING (key)
  JOIN tree o ON o.n > 1 AND o.pos = r.pos // CAST(3 ** o.level AS BIGINT)
  JOIN tree s ON s.level = o.level AND s.pos // 3 = o.pos // 3 GROUP BY 1, 2),
numbered AS (SELECT id, l, r, row_number() OVER (PARTITION BY id ORDER BY level) AS k FROM steps),
fold AS (
  SELECT id, 0 AS k, now AS h FROM placed
  UNION ALL
  SELECT f.id, f.k + 1, sha256(s.l || f.h || s.r) FROM fold f JOIN numbered s ON s.id = f.id AND s.k = f.k + 1),
ends AS (SELECT id, arg_max(h, k) AS folded_root FROM fold GROUP BY 1),
proofs AS (SELECT id, string_agg(l || r, '' ORDER BY k) AS way FROM numbered GROUP BY 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(way, '')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM placed JOIN subroots USING (key) CROSS JOIN (SELECT h AS root FROM tree WHERE n = 1)
LEFT JOIN proofs USING (id) JOIN ends USING (id)
"""
