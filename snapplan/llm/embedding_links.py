"""Operator 9: embedding near-duplicates by product quantisation.

Equal vectors of a label are one class.  On a bounded sample of unit vectors
k-means fits the centres of coarse lists and, for the residuals, a codebook of
each subspace.  Every class goes to the list of its nearest centre with a code
of its residual, and asks all lists that may hold a partner.  In a list the
distance of a query to a member is looked up from the member's code
(asymmetric distance); a member is dropped only if that distance exceeds the
radius by more than the error of its code, and all others are judged by exact
cosine in double precision.  Lists are dealt in blocks of members and queries,
so no list, however full, meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, parts_for, python_ready, settle
from .components import components

COSINE = 0.93
SAMPLE = 16_384          # vectors that centres and codebooks are fitted on, at most
LIST = 1024              # classes of a label in a list, about; also members of a block
LISTS = 4096             # lists, at most: bounds what every task holds
QUERIES = 4096           # queries of a block, about
SUBSPACE, CODES = 8, 256
SAFETY = 3.5             # a partner strays past a boundary by this many standard deviations at most


@dataclass(frozen=True)
class Index:
    dim: int
    centres: np.ndarray          # lists x dim
    books: list[np.ndarray]      # per subspace: codes x width

    def parts(self) -> list[slice]:
        return [slice(i, min(i + SUBSPACE, self.dim)) for i in range(0, self.dim, SUBSPACE)]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def k_means(x: np.ndarray, k: int, seed: int = 0, rounds: int = 12) -> np.ndarray:
    """Centres of at most ``k`` groups of rows."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = squared(x, centres).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def fit(sample: np.ndarray, lists: int) -> Index:
    """Coarse centres and residual codebooks of unit vectors."""
    centres = k_means(sample, lists)
    rest = sample - centres[squared(sample, centres).argmin(1)]
    dim = sample.shape[1]
    index = Index(dim, centres, [])
    return Index(dim, centres, [k_means(rest[:, p], CODES, 1) for p in index.parts()])


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List, code and code error of unit vectors."""
    near = squared(x, index.centres).argmin(1)
    rest = x - index.centres[near]
    code = np.empty((len(x), len(index.books)), dtype=np.uint8)
    made = np.empty_like(rest)
    for k, (p, book) in enumerate(zip(index.parts(), index.books, strict=True)):
        code[:, k] = squared(rest[:, p], book).argmin(1)
        made[:, p] = book[code[:, k]]
    return near, code, np.sqrt(((rest - made) ** 2).sum(1))


def probes(index: Index, x: np.ndarray, near: np.ndarray, radius: float) -> np.ndarray:
    """Which lists each unit vector asks: those whose boundary with its own list is near enough.

    A partner in another list lies beyond the plane between the two centres.
    The step to it is at most ``radius`` long and points anywhere, so it goes
    farther than SAFETY * radius / sqrt(dim) along one direction very rarely.
    """
    d = squared(x, index.centres)
    own = d[np.arange(len(x)), near]
    gap = np.sqrt(squared(index.centres, index.centres))[near]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(gap > 0, (d - own[:, None]) / (2 * gap), 0)
    ask = plane <= min(radius, SAFETY * radius / np.sqrt(index.dim))
    ask[np.arange(len(x)), near] = True
    return ask


def links(index: Index, at: int, members: np.ndarray, codes: np.ndarray, errors: np.ndarray, queries: np.ndarray,
          cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) places with exact cosine of at least ``cosine``, found through the codes."""
    radius = np.sqrt(max(0.0, 2 - 2 * cosine))
    mu, qu = unit(members), unit(queries)
    rest = qu - index.centres[at]
    far = np.zeros((len(queries), len(members)), dtype=np.float32)
    for k, (p, book) in enumerate(zip(index.parts(), index.books, strict=True)):
        far += squared(rest[:, p], book).astype(np.float32)[:, codes[:, k]]
    found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    near = np.sqrt(far) <= (radius + errors + 1e-4).astype(np.float32)[None]
    for lo in range(0, len(queries), 256):
        q, m = np.nonzero(near[lo:lo + 256])
        ok = np.einsum("ij,ij->i", qu[lo + q], mu[m]) >= cosine
        found[0].append(lo + q[ok])
        found[1].append(m[ok])
    return np.concatenate(found[0]), np.concatenate(found[1])


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its group) of the graph with edges a - b."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = both[:len(a)], both[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _classes(valid: DataFrame) -> DataFrame:
    """cls (any number), label, h1, h2, n (rows), low (smallest vec_id), embedding of every class."""
    same = valid.groupBy("label", "h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"),
                                                  F.first("embedding").alias("embedding"))
    return settle(same.withColumn("cls", F.monotonically_increasing_id()))


def _found(classes: DataFrame, index: Index, cosine: float) -> DataFrame:
    """cls, links (rows of other classes linked), root (an edge) from each block of each list."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    dim = index.dim

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(_vectors(batch.column("embedding"), dim))
            near, codes, errors = encode(index, x)
            ask = [np.flatnonzero(r) for r in probes(index, x, near, radius)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("cls", "label", "n", "embedding")), pa.array(near.astype(np.int32)),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors),
                 pa.array(ask, pa.list_(pa.int32()))],
                names=["cls", "label", "n", "embedding", "list", "code", "error", "ask"])

    def block(key: tuple, members: pa.Table, queries: pa.Table) -> pa.Table:
        at = key[1].as_py()
        none = pa.table({"cls": pa.array([], pa.int64()), "links": pa.array([], pa.int64()),
                         "root": pa.array([], pa.int64())})
        if not len(members) or not len(queries):
            return none
        codes = np.frombuffer(b"".join(members["code"].to_pylist()), dtype=np.uint8).reshape(len(members), -1)
        q, m = links(index, at, _vectors(members["embedding"].combine_chunks(), dim), codes,
                     members["error"].to_numpy(), _vectors(queries["q_embedding"].combine_chunks(), dim), cosine)
        mc, qc = members["cls"].to_numpy(), queries["q_cls"].to_numpy()
        other = mc[m] != qc[q]
        q, m = q[other], m[other]
        if not len(q):
            return none
        # a member that does not ask the query's list would not find this link by itself
        own = queries["q_own"].to_numpy()
        sizes = np.array([len(a) for a in members["ask"].to_pylist()])
        asked = np.repeat(np.arange(len(members)), sizes) * LISTS + np.asarray(
            members["ask"].combine_chunks().flatten(), dtype=np.int64)
        alone = ~np.isin(m * LISTS + own[q], asked)
        mn, qn = members["n"].to_numpy(), queries["q_n"].to_numpy()
        to_q = np.bincount(q, weights=mn[m], minlength=len(qc)).astype(np.int64)
        to_m = np.bincount(m[alone], weights=qn[q[alone]], minlength=len(mc)).astype(np.int64)
        node, root = spanning(qc[q], mc[m])
        cls = np.concatenate([qc[to_q > 0], mc[to_m > 0], node])
        n = np.concatenate([to_q[to_q > 0], to_m[to_m > 0], np.zeros(len(node), np.int64)])
        ends = np.concatenate([qc[to_q > 0], mc[to_m > 0], root])
        return pa.table({"cls": cls, "links": n, "root": ends})

    coded = settle(classes.select("cls", "label", "n", "embedding").mapInArrow(
        code, "cls long, label int, n long, embedding array<float>, list int, code binary, error double, "
        "ask array<int>"))
    place = ["label", "list"]
    asked = coded.select("cls", "label", "embedding", "n", F.col("list").alias("own"), F.explode("ask").alias("list"))
    sizes = (coded.groupBy(*place).agg(F.count("*").alias("_m"))
             .join(asked.groupBy(*place).agg(F.count("*").alias("_q")), place))
    sizes = settle(sizes.select(*place, F.ceil(F.col("_m") / LIST).alias("_blocks"),
                                F.ceil(F.col("_q") / QUERIES).alias("_salts"), "_m", "_q"))
    here = F.pmod(F.xxhash64("cls"), F.col("_blocks"))
    salt = F.pmod(F.xxhash64("cls", F.lit(7)), F.col("_salts"))
    members = lookup(coded, sizes, place, F.col("_m"), coded.count()).select(
        "cls", "n", "embedding", "code", "error", "ask", *place, here.alias("_block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("_salt"))
    queries = lookup(asked, sizes, place, F.col("_q"), asked.count()).select(
        F.col("cls").alias("q_cls"), F.col("n").alias("q_n"), F.col("embedding").alias("q_embedding"),
        F.col("own").alias("q_own"), F.col("label").alias("q_label"), F.col("list").alias("q_list"),
        salt.alias("q_salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("q_block"))
    return (members.groupBy(*place, "_block", "_salt")
            .cogroup(queries.groupBy("q_label", "q_list", "q_block", "q_salt"))
            .applyInArrow(block, "cls long, links long, root long"))


def embedding_links(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label).

    Two rows link when their labels are equal and not null and their cosine is
    at least ``cosine``, which vectors of different lengths have none.  Null or
    zero vectors, those with null, infinite or NaN components and rows without
    label link with nothing.  Repeated rows are vectors of their own
    and link with each other.  component_id is the smallest vec_id reachable,
    null ids left out; kept is vec_id = component_id (a null id is not kept).
    Centres and codebooks are fitted on at most ``sample`` classes of each
    length; every row is indexed.  Other columns are ignored.  Empty table: no rows.
    """
    spark = vectors.sparkSession
    python_ready(spark)
    finite = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))),
                        F.lit(False))
    some = F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = vectors.select(
        "vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<float>").alias("embedding"),
        F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    classes = _classes(rows.filter(finite & some & F.col("label").isNotNull()))
    found = spark.createDataFrame([], "cls long, links long, root long")
    # an index for each length of vectors: there are no more lengths than the longest vector has components
    for length in classes.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect():
        fits = classes.filter(F.size("embedding") == length.d)
        taken = fits.orderBy(F.xxhash64("h1", "h2")).limit(sample).select("embedding").toArrow()
        x = unit(_vectors(taken["embedding"].combine_chunks(), length.d))
        labels = fits.agg(F.approx_count_distinct("label")).first()[0]
        index = fit(x, min(LISTS, parts_for(length["count"], LIST * max(1, labels))))
        found = found.unionByName(settle(_found(fits, index, cosine)))
    edges = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("cls").agg(F.sum("links").alias("links"))
    by_class = (classes.select("cls", "label", "h1", "h2", "n", "low").join(linked, "cls", "left")
                .join(edges.withColumnRenamed("id", "cls"), "cls", "left")
                .withColumn("root", F.coalesce("root", "cls")))
    lows = by_class.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = settle(by_class.join(lows, "root").select(
        "label", "h1", "h2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    ok = finite & some & F.col("label").isNotNull()
    inside = lookup(rows.filter(ok).select("vec_id", "label", "h1", "h2"), by_class, ["label", "h1", "h2"], F.col("n"),
                    rows.count()).select("vec_id", "n_links", "component_id")
    outside = rows.filter(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                      F.col("vec_id").alias("component_id"))
    return inside.unionByName(outside).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
          UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) JOIN low USING (vec_id)
"""
