"""Operator 5: similarity join of documents on word n-grams, multiple-global-order filtering.

Documents with equal sets of shingles are one class.  Two sets with a Jaccard
similarity of at least t share a token among the first n - ceil(t n) + 1 ones
of each, under every global order of the tokens.  The first order puts rare
tokens before frequent ones; it is the index from which candidates come.  The
other orders go round the ring of hashes from different points; a candidate
must also share prefix tokens under each of them before it is verified on the
whole sets.

Before sets are fetched, a pair must also pass by size and by the parity maps
of both sets: bits that differ bound how many tokens differ from below.  A map
grows with its set; the larger of two is folded to the size of the smaller.

A large group of classes with a common prefix token gives no list of all its
pairs.  First a few members, the pivots, are compared with all others; linked
classes become one component.  Then only members of different components of a
group meet, block by block inside tasks, and only pairs that pass those two
bounds come out to be verified.  Classes that share many tokens meet once and
not for each of them: groups whose least member (by hash) is the same are one.
So every pair of linked classes ends in one component, whatever the size of
its groups.

Frequencies need each token beside its holders once: a token shared by a large
share of the documents is found first and broadcast (at most 1 / HOT per
average token of a document), all others meet in a shuffle of numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lookup, parts_for, python_ready, settle
from .components import components
from .exchange import FAT, distinct_pairs, pack, unpack
from .words import U, batches_of, mix, windows, words

WORDS, PERCENT = 5, 75
HOT = 200                # a token in more than 1 / HOT of the documents is hot
LOCAL, LOCAL_LEAST = 400, 8      # reported by a batch if in 1 / LOCAL of its documents and in LOCAL_LEAST
HALF = 1 << 63           # tokens below come first in the index order; the others are rarely needed
ORDERS = (1, 2, 3)       # further orders begin at these quarters of the ring
TOKENS = 500_000       # tokens of a part of the exchange, about
PIVOTS = 256             # pairs of one pivot in one task, about
SMALL = 16               # classes of a token whose pairs are joined outright
KINDS = 8                # pivots that a family of classes meets, about
BLOCK, LONG = 1024, 1024   # classes of a block in a large group; one more for each so many tokens of a class
MAPS = 1 << 18           # numbers of parity maps compared at once
BITS, PER_TOKEN = 512, 4   # bits of a class's parity map: at least, and for each token (the next power of two)


def shingle_sets(texts: list[str | None], n: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``n`` words make one shingle, none make none."""
    for lo, hi in batches_of(texts):
        w = words(texts[lo:hi], lower=True)
        whole = windows(w.hashes, n)
        for i in range(hi - lo):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= n:
                yield np.unique(whole[a:b - n + 1])
            elif b > a:
                yield windows(w.hashes[a:b], b - a) ^ U(b - a)
            else:
                yield np.empty(0, dtype=U)


def signature(tokens: np.ndarray) -> int:
    """Name of a set: 64 bits, the same for equal sets."""
    return int(mix(np.array([mix(tokens).sum(dtype=U) ^ U(len(tokens))]))[0])


def parity(tokens: np.ndarray) -> np.ndarray:
    """A map of bits in whole numbers: whether an odd number of tokens falls on each."""
    size = max(BITS, 1 << (PER_TOKEN * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_size(n: int | np.ndarray, percent: int = PERCENT):
    return n - -(-n * percent // 100) + 1


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a, dtype=U).view(np.int64))


def _document_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, cls (null without words), n of every row; and rows of locally frequent tokens: token, held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, seen, distinct = [], [], set(), []
            for s in shingle_sets(batch.column("text").to_pylist(), n):
                name = signature(s) if len(s) else None
                sizes.append(len(s))
                names.append(None if name is None else name - (1 << 64) * (name >> 63))
                if name is not None and name not in seen:
                    seen.add(name)
                    distinct.append(s)
            rows = len(sizes)
            token, held = np.unique(np.concatenate(distinct), return_counts=True) if distinct else ([], [])
            often = np.flatnonzero(np.asarray(held) >= max(LOCAL_LEAST, rows / LOCAL))
            k = len(often)
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.concat_arrays([batch.column(c), none]) for c in ("doc_id", "text_hash")),
                 pa.array(names + [None] * k, pa.int64()), pa.array(sizes + [None] * k, pa.int64()),
                 pa.concat_arrays([pa.nulls(rows, pa.int64()), _signed(np.asarray(token)[often]) if k else none]),
                 pa.array([None] * rows + (np.asarray(held)[often].tolist() if k else []), pa.int64())],
                names=["doc_id", "text_hash", "cls", "n", "token", "held"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, cls long, n long, token long, held long")


def _spread(docs: DataFrame, n: int, percent: int, hot: np.ndarray, parts: int) -> DataFrame:
    """Fat rows of the index tokens; and per class its size, its index tokens, and the hot tokens of its prefix."""
    hot_tokens = np.sort(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()

        def emit(sets: list[np.ndarray], names: list[int]) -> Iterator[pa.RecordBatch]:
            sizes, firsts, hots, tokens, bits = [], [], [], [], []
            for s in sets:
                bits.append(parity(s).tolist())
                p = prefix_size(len(s), percent)
                at = np.minimum(np.searchsorted(hot_tokens, s), max(len(hot_tokens) - 1, 0))
                is_hot = hot_tokens[at] == s if len(hot_tokens) else np.zeros(len(s), dtype=bool)
                cool = s[~is_hot]
                first = int(np.searchsorted(cool, U(HALF)))
                send = max(first, min(p, len(cool)))
                tokens.append(cool[:send])
                sizes.append(len(s))
                firsts.append(first)
                hots.append(s[is_hot][:max(0, p - len(cool))].view(np.int64).tolist())
            owner = np.repeat(np.arange(len(sets)), [len(t) for t in tokens])
            all_names = np.array(names, dtype=U)
            fat = pack(np.concatenate(tokens), owner, all_names, parts)
            k, m = len(fat), len(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([fat.column(0), pa.array((all_names % U(parts)).astype(np.int32))]),
                 pa.concat_arrays([fat.column(1), pa.nulls(m, pa.binary())]),
                 pa.concat_arrays([pa.nulls(k, pa.int64()), _signed(all_names)]),
                 pa.array([None] * k + sizes, pa.int64()), pa.array([None] * k + firsts, pa.int64()),
                 pa.array([None] * k + hots, pa.list_(pa.int64())),
                 pa.array([None] * k + bits, pa.list_(pa.int64()))],
                names=["part", "pairs", "cls", "n", "firsts", "hots", "bits"])

        for batch in batches:
            sets, names, held = [], [], 0
            for s in shingle_sets(batch.column("text").to_pylist(), n):
                name = signature(s) if len(s) else None
                if name is None or name in done:
                    continue
                done.add(name)
                sets.append(s)
                names.append(name)
                held += len(s)
                if held > TOKENS:
                    yield from emit(sets, names)
                    sets, names, held = [], [], 0
            if sets:
                yield from emit(sets, names)

    return docs.select("text").mapInArrow(run, f"{FAT}, cls long, n long, firsts long, hots array<long>, bits array<long>")


SHARED = "cls long, token long, df long, n long, firsts long, hots array<long>, bits array<long>"


def _shared(block: pa.Table) -> pa.Table:
    """The tokens of a part that several classes hold (cls, token, df), and the classes' own rows as they came."""
    is_fat = pc.is_valid(block["pairs"])
    hashes, owners, df = distinct_pairs(*unpack(block.filter(is_fat)["pairs"].to_pylist()))
    some = df > 1
    own = block.filter(pc.invert(is_fat))
    k, m = int(some.sum()), len(own)
    none = pa.nulls(k, pa.int64())
    def below(first: pa.Array, name: str) -> pa.Array:
        return pa.concat_arrays([first, own[name].combine_chunks()])
    return pa.table({
        "cls": below(_signed(owners[some]), "cls"), "token": pa.concat_arrays([_signed(hashes[some]),
                                                                               pa.nulls(m, pa.int64())]),
        "df": pa.concat_arrays([pa.array(df[some]), pa.nulls(m, pa.int64())]),
        "n": below(none, "n"), "firsts": below(none, "firsts"),
        "hots": below(pa.nulls(k, pa.list_(pa.int64())), "hots"),
        "bits": below(pa.nulls(k, pa.list_(pa.int64())), "bits")})


def postings(docs: DataFrame, sets: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """token, cls: the prefix of each class under the index order, without tokens that one class alone holds;
    and cls, n, bits of the classes."""
    rows = sets.filter("token is null")
    count, tokens = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = (sets.filter("token is not null").groupBy("token").agg(F.sum("held").alias("held"))
             .filter(F.col("held") * HOT > count).select("token").toArrow())
    hot = often["token"].to_numpy().view(U) if len(often) else np.empty(0, dtype=U)
    shared = settle(_spread(docs, n, percent, hot, parts_for(tokens // 2, TOKENS))
                    .groupBy("part").applyInArrow(_shared, SHARED))
    # a class may come from several tasks; the rows are equal
    own = shared.filter("token is null").groupBy("cls").agg(
        F.first("n").alias("n"), F.first("firsts").alias("firsts"), F.first("hots").alias("hots"), F.first("bits").alias("bits"))
    own = settle(own)
    held = shared.filter("token is not null").select("cls", "token", "df")
    by_class = Window.partitionBy("cls")
    late = F.col("token") < 0                          # from the upper half of the ring, as a signed number
    ranked = held.select("cls", "token", late.alias("late"),
                         F.row_number().over(by_class.orderBy(late, "df", "token")).alias("rank"),
                         F.sum((~late).cast("int")).over(by_class).alias("early"))
    prefix = F.expr(f"n - (n * {percent} + 99) div 100 + 1")
    inside = (ranked.join(own.select("cls", "n", "firsts"), "cls")
              .filter(F.col("late") | (F.col("rank") <= prefix - (F.col("firsts") - F.col("early")))))
    hots = own.select(F.explode("hots").alias("token"), "cls")
    return settle(inside.select("token", "cls").unionByName(hots)), own.select("cls", "n", "bits")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share prefix tokens under every order of the ring, and are similar enough."""
    na, nb = len(a), len(b)
    at = np.searchsorted(b, a)
    common = np.flatnonzero(b[np.minimum(at, nb - 1)] == a)
    if not len(common):
        return False
    there = at[common]
    pa_, pb = prefix_size(na, percent), prefix_size(nb, percent)
    for q in ORDERS:
        begin = U(q << 62)
        ra = (common - np.searchsorted(a, begin)) % na
        rb = (there - np.searchsorted(b, begin)) % nb
        if not ((ra < pa_) & (rb < pb)).any():
            return False
    both = len(common)
    return 100 * both >= percent * (na + nb - both)


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar; ``pairs`` must be settled."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    chosen = sets.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"))
    chosen = chosen.join(ends, "cls", "left_semi").select("cls", F.col("r.doc_id").alias("_doc"),
                                                          F.col("r.text_hash").alias("_hash"))
    wanted = docs.select("doc_id", "text").join(
        chosen.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_doc"))
        & (F.xxhash64("text") == F.col("_hash"))).select("cls", "text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), pa.array([s.tobytes() for s in
                                                shingle_sets(batch.column("text").to_pylist(), n)], pa.binary())],
                names=["cls", "tokens"])

    whole = settle(wanted.mapInArrow(tokens, "cls long, tokens binary").dropDuplicates(["cls"]))
    load = settle(pairs.groupBy("b").agg(F.count("*").alias("_pairs")).withColumn(
        "_salts", F.ceil(F.col("_pairs") / PIVOTS)))
    salted = lookup(pairs.select("a", "b"), load, ["b"], F.col("_pairs"), pairs.count()).select(
        "a", "b", F.pmod(F.xxhash64("a"), F.col("_salts")).alias("_salt"))
    left = salted.join(whole.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a")
    right = (whole.join(load, F.col("cls") == F.col("b")).select(
        "b", F.col("tokens").alias("tb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("_salt")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_linked(np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U), percent)
                  for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = left.join(right.hint("shuffle_hash"), ["b", "_salt"]).select("a", "b", "ta", "tb")
    return settle(both.mapInArrow(judge, "a long, b long"))


def _folded(bits: Column, k: Column) -> Column:
    """A parity map as one of ``k`` numbers, its own size or a smaller one."""
    return F.when(F.size(bits) == k, bits).otherwise(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.aggregate(
        F.sequence(i, F.size(bits) - 1, k), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get(bits, j)))))


def _passed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) that sizes and parity maps do not rule out."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for c in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"),
                                          F.col("bits").alias(f"bits{c}")), c)
    k = F.least(F.size("bitsa"), F.size("bitsb"))
    differ = F.aggregate(F.zip_with(_folded(F.col("bitsa"), k), _folded(F.col("bitsb"), k),
                                    lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    both = F.col("na") + F.col("nb")
    return pairs.filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
                        & (differ * (100 + percent) <= both * (100 - percent))).select("a", "b")


def _differ(group: pa.RecordBatch, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bits differ between the parity maps of rows ``i`` and ``j``."""
    bits = group.column("bits")
    flat, begin = bits.flatten().to_numpy(), bits.offsets.to_numpy()
    begin, words = begin[:-1] - begin[0], np.diff(begin)
    out = np.empty(len(i), dtype=np.int64)

    def maps(rows: np.ndarray, size: int, k: int) -> np.ndarray:
        whole = flat[begin[rows][:, None] + np.arange(size)]
        return np.bitwise_xor.reduce(whole.reshape(len(rows), size // k, k), axis=1)

    wi, wj = words[i], words[j]
    for a, b in {*zip(wi.tolist(), wj.tolist(), strict=True)}:
        at, k = np.flatnonzero((wi == a) & (wj == b)), min(a, b)
        step = max(1, MAPS // max(a, b))
        for some in (at[lo:lo + step] for lo in range(0, len(at), step)):
            out[some] = np.bitwise_count((maps(i[some], a, k) ^ maps(j[some], b, k)).view(U)).sum(axis=1, dtype=np.int64)
    return out


def _cross_pairs(group: pa.RecordBatch, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes of two blocks (side 0 and 1) in different components that the two bounds let pass."""
    cls, n, comp, side = (group.column(c).to_numpy() for c in ("cls", "n", "comp", "side"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for lo in range(0, len(left), 128):
        x = left[lo:lo + 128]
        nx, ny = n[x][:, None], n[right][None]
        ok = (comp[x][:, None] != comp[right][None]) & (np.minimum(nx, ny) * 100 >= np.maximum(nx, ny) * percent)
        i, j = np.nonzero(ok)
        i, j = x[i], right[j]
        near = _differ(group, i, j) * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
        yield cls[i[near]], cls[j[near]]


def _block_pairs(active: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components of large groups (token, cls, comp, m), met block by block.

    Groups with the same anchor, their least class by hash, are met as one: the
    groups of classes that share many tokens have few anchors, others rarely
    have the same.  The largest component of a group is one side; all other
    members, few after the pivots, meet it and each other.  A block of either
    side has about ``BLOCK`` members, and two blocks meet in one place.
    """
    anchors = active.groupBy("token").agg(F.min_by("cls", F.struct(F.xxhash64("cls"), "cls")).alias("anchor"),
                                          F.count("*").alias("_m"))
    active = lookup(active.select("token", "cls", "comp"), settle(anchors), ["token"], F.col("_m"), active.count())
    active = settle(active.select("anchor", "cls", "comp").distinct().join(classes, "cls"))
    weight = F.sum(1 + F.expr(f"n div {LONG}"))
    sizes = settle(active.groupBy("anchor", "comp").agg(F.count("*").alias("c"), weight.alias("w")))
    per = settle(sizes.groupBy("anchor").agg(F.max_by("comp", F.struct("w", "comp")).alias("main"), F.max("w").alias("c"),
                                             F.sum("w").alias("m"), F.sum("c").alias("_m")))
    per = per.select("anchor", "main", F.ceil(F.col("c") / BLOCK).alias("gb"), "_m",
                     F.ceil((F.col("m") - F.col("c")) / BLOCK).alias("pb"))
    rows = lookup(active, per, ["anchor"], F.col("_m"), active.count())
    rows = rows.withColumn("main", F.col("comp") == F.col("main"))
    mine = F.when(F.col("main"), F.pmod(F.xxhash64("cls"), F.col("gb"))).otherwise(
        F.col("gb") + F.pmod(F.xxhash64("cls"), F.col("pb")))
    rows = rows.withColumn("mine", mine)
    # blocks 0 .. gb-1 are the main component's; gb .. gb+pb-1 the others'; one of a pair is always of the others
    others = F.sequence(F.col("gb"), F.col("gb") + F.col("pb") - 1)
    meet = F.when(F.col("main"), others).otherwise(F.sequence(F.lit(0).cast("long"), F.col("gb") + F.col("pb") - 1))
    rows = rows.withColumn("other", F.explode(meet))
    place = F.struct(F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    # in its own block a member is on both sides
    sides = F.when(F.col("mine") == F.col("other"), F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.when(F.col("mine") < F.col("other"), 0).otherwise(1)))
    rows = rows.select("anchor", place.alias("place"), F.explode(sides).alias("side"), "cls", "n", "bits", "comp")
    rows = rows.select("anchor", F.col("place.x").alias("x"), F.col("place.y").alias("y"), "side", "cls", "n",
                       "bits", "comp")

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for a, b in _cross_pairs(pa.concat_batches(held), percent):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held, last = [], None
        for batch in batches:
            t, x, y = (batch.column(c).to_numpy() for c in ("anchor", "x", "y"))
            begin = np.flatnonzero((t[1:] != t[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for lo, hi in zip([0, *begin.tolist()], [*begin.tolist(), len(t)], strict=True):
                if lo == hi:
                    continue
                if held and last != (t[lo], x[lo], y[lo]):
                    yield from met(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = t[lo], x[lo], y[lo]
        if held:
            yield from met(held)

    dealt = rows.repartition("anchor", "x", "y").sortWithinPartitions("anchor", "x", "y")
    return dealt.mapInArrow(meeting, "a long, b long")


def class_links(docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """id and root of every class that is linked with another: the components of the similarity join."""
    index, classes = postings(docs, sets, n, percent)
    total = index.count()
    sizes = settle(index.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1"))
    members = settle(lookup(index, sizes, ["token"], F.col("m"), total))
    small, large = members.filter(F.col("m") <= SMALL), members.filter(F.col("m") > SMALL)
    other = small.select("token", F.col("cls").alias("b"))
    outright = small.select("token", F.col("cls").alias("a")).join(
        other, ["token"]).filter("a < b").select("a", "b")
    kind = F.pmod(F.col("token"), F.lit(KINDS))
    pivots = large.groupBy("token").agg(F.max("m").alias("_m"), F.min_by(
        "cls", F.struct(F.xxhash64(kind, "cls"), "cls")).alias("pivot"))
    met = lookup(large.select("token", "cls"), pivots, ["token"], F.col("_m"), total)
    met = met.filter("cls != pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b"))
    tried = settle(_passed(outright.unionByName(met), classes, percent))
    links = verified(tried, docs, sets, n, percent)
    roots = components(links)
    over = roots.select(F.col("id").alias("cls"), "root")
    active = large.join(over, "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")
    open_ = settle(active.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                               F.max("m").alias("_m")).filter("lo != hi").select("token", "_m"))
    active = settle(lookup(active, open_, ["token"], F.col("_m"), total).drop("_m"))
    more = _passed(_block_pairs(active, classes, percent), classes, percent).join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(verified(settle(more), docs, sets, n, percent))
    return components(links)


def ngram_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_shingles, component_id of every row.

    component_id is the smallest doc_id reachable by links, null ids left out.
    A null text, or one without words, has no shingles and its component is
    its own doc_id.  Rows with a null doc_id take part in the join; repeated
    rows are documents of their own.  Sets and classes go by 64-bit hashes.
    Other columns are ignored.  Empty table: no rows.
    """
    python_ready(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sets = settle(_document_sets(docs, n))
    roots = class_links(docs, sets, n, percent)
    rows = sets.filter("token is null").select("doc_id", "text_hash", "cls", "n")
    own = rows.filter("cls is not null").groupBy("cls").agg(F.count("*").alias("_rows"), F.min("doc_id").alias("low"))
    own = own.join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    own = settle(own)
    lows = own.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = settle(own.join(lows, "root").select("cls", "_rows", "component_id"))
    named = lookup(rows.filter("cls is not null"), by_class, ["cls"], F.col("_rows"), rows.count())
    alone = rows.filter("cls is null").withColumn("component_id", F.col("doc_id"))
    return named.drop("_rows").unionByName(alone).select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^ \t\n\v\f\r]+') AS w
  FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN
        [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WORDS} + 2),
        lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END)) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id
      GROUP BY 1, 2 HAVING 100 * count(*) >= {PERCENT} * ((SELECT n FROM n WHERE n.doc_id = x.doc_id)
        + (SELECT n FROM n WHERE n.doc_id = y.doc_id) - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.a = w.doc_id GROUP BY w.doc_id, n.n"""
