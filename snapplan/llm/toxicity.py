"""Operator 10: toxic passages by maximum-scoring segments.

1. Words (runs of letters and digits, A-Z lowered) and their first bytes are
   counted, once per document, over all documents and over the labelled ones
   of both classes.  Their log-odds between the classes use the whole corpus
   as an informative Dirichlet prior; a word scores what the log-odds of its
   strongest feature are sure to exceed, less a drift.
2. A linear-time scan finds all maximal scoring segments of a document.
3. Segment scores of clean text follow an extreme-value law; its two
   parameters are fitted, and each segment gets its expected number of equals
   by chance in a text of that length.  The evidence of a document is the sum
   over its significant segments, and a logistic curve fitted on the labelled
   documents turns evidence into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_ready, settle
from .words import ALNUM, U, Words, batches_of, mix, words

#: size of the model: at most so many words with a score, the surest ones
FEATURES = 1 << 18
#: labelled documents the classifier is fitted on, at most (taken in order of a hash of their ids)
LABELLED = 1 << 18
PREFIXES = (4, 5, 6)     # first bytes of a word that count as features of their own
HELD = 1_000_000         # features a task adds up before it hands them on
PRIOR_SHARE = 0.1        # strength of the prior against the labelled words
SURE = 2.0               # standard deviations taken off the log-odds
DRIFT = 0.5              # taken off every word, so that clean text drifts down
CHANCE = 0.05            # a segment is significant below this expected number by chance
THRESHOLD = 0.3
STEPS, MOST = 32, 50.0   # evidence counts up to MOST and is fitted in steps of 1 / STEPS


@dataclass(frozen=True)
class Model:
    keys: np.ndarray         # sorted word hashes
    scores: np.ndarray       # log-odds that are sure, drift not taken off
    rate: float              # lambda of the extreme-value law


def _features(w: Words, at: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words ``at`` and of their first bytes."""
    return [w.hashes[at], *(w.prefixes(n, at) for n in PREFIXES)]


def _summed(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.zeros((len(key), 3), dtype=np.int64)
    np.add.at(total, inverse, np.concatenate(counts))
    return key, total


def _count_words(docs: DataFrame) -> DataFrame:
    """word, n, toxic, clean: documents with the word or prefix, over all and over the labelled classes."""
    def emit(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        key, total = _summed(keys, counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), *(pa.array(total[:, k].copy()) for k in range(3))],
            names=["word", "n", "toxic", "clean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            texts = batch.column("text").to_pylist()
            label = pc.fill_null(batch.column("label"), -1).to_numpy()
            one = np.stack([np.ones_like(label), label == 1, label == 0], axis=1).astype(np.int64)
            for lo, hi in batches_of(texts):
                w = words(texts[lo:hi], ALNUM, lower=True)
                doc = np.repeat(np.arange(lo, hi), np.diff(w.first))
                salt = mix(np.arange(lo, hi).astype(U) + U(1))
                _, at = np.unique(w.hashes ^ salt[doc - lo], return_index=True)      # once per document
                doc = doc[at]
                for f in _features(w, at):
                    _, own = np.unique(f ^ salt[doc - lo], return_index=True)
                    key, total = _summed([f[own]], [one[doc[own]]])
                    keys.append(key)
                    counts.append(total)
                if sum(map(len, keys)) > HELD:
                    merged = _summed(keys, counts)
                    if len(merged[0]) > HELD // 2:
                        yield emit([merged[0]], [merged[1]])
                        keys, counts = [], []
                    else:
                        keys, counts = [merged[0]], [merged[1]]
        if keys:
            yield emit(keys, counts)

    each = docs.select("text", "label").mapInArrow(run, "word long, n long, toxic long, clean long")
    return each.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "toxic", "clean")))


def _log_odds(counts: DataFrame) -> DataFrame:
    """word, score, p (share of clean text) of the words whose log-odds are sure to differ from 0."""
    t = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "toxic", "clean"))).first()
    strength = max(1.0, PRIOR_SHARE * (t.toxic + t.clean))
    prior = F.col("n") * F.lit(strength / max(t.n, 1))
    def logit(c: str, total: int) -> Column:
        a = F.col(c) + prior
        return F.log(a / (total + strength - a + 1e-9))
    odds = logit("toxic", t.toxic) - logit("clean", t.clean)
    spread = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    sure = F.greatest(F.abs(odds) - SURE * spread, F.lit(0.0)) * F.signum(odds)
    return (counts.filter((F.col("toxic") > 0) | (F.col("clean") > 0))
            .select("word", sure.alias("score"), ((F.col("clean") + 0.5) / (t.clean + 1)).alias("p"))
            .filter(F.col("score") != 0))


def _rate(scores: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p e^(rate score) = 1 over clean text (all other words score -DRIFT)."""
    rest = max(0.0, 1.0 - float(p.sum()))
    def excess(x: float) -> float:
        return float((p * np.exp(np.minimum(x * scores, 600))).sum() + rest * np.exp(-x * DRIFT)) - 1
    if not len(scores) or scores.max() <= 0:
        return 1.0
    lo, hi = 1e-3, 1.0
    while excess(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return hi


def segments(places: np.ndarray, scores: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of one text, in linear time.

    ``places`` are the words that score above 0, ``scores`` their scores; every
    other word given scores what it scores, all words between score ``-drift``.
    Kept candidates have rising left sums; a new candidate joins those whose
    left sum is lower and whose right sum is not higher.
    """
    kept: list[tuple] = []                             # first, last, sum before, sum after, earlier one with lower sum
    total, before = 0.0, -1
    for at, s in zip(places.tolist(), scores.tolist(), strict=True):
        total -= drift * (at - before - 1)
        left, total, before = total, total + s, at
        if s <= 0:
            continue
        first, right = at, total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                break
            first, left = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((first, at, left, right, j))
    return [(a, b, r - l) for a, b, l, r, _ in kept]


def _scan(docs: DataFrame, model: Model, spans: bool) -> DataFrame:
    """Per document its segment scores and word count; or with ``spans`` one row per segment."""
    keys, scores = model.keys, model.scores
    schema = "doc_id long, text_hash long, n_words long, " + (
        "first_word long, last_word long, score double, passage string" if spans else "scores array<double>")
    kinds = [pa.int64(), *([pa.int64(), pa.int64(), pa.float64(), pa.string()] if spans
                           else [pa.list_(pa.float64())])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = []
            for lo, hi in batches_of(texts):
                w = words(texts[lo:hi], ALNUM, lower=True)
                _, one, word = np.unique(w.hashes, return_index=True, return_inverse=True)
                best = np.zeros(len(one))
                for f in _features(w, one):
                    at = np.minimum(np.searchsorted(keys, f), max(len(keys) - 1, 0))
                    own = np.where(keys[at] == f, scores[at], 0.0) if len(keys) else best
                    best = np.where(np.abs(own) > np.abs(best), own, best)
                hit = np.flatnonzero(best[word])
                value = best[word[hit]] - DRIFT
                cuts = np.searchsorted(hit, w.first)
                for i in range(hi - lo):
                    a, b, first = cuts[i], cuts[i + 1], w.first[i]
                    n = int(w.first[i + 1] - first)
                    if b > a and value[a:b].max() > 0:
                        found = segments(hit[a:b] - first, value[a:b])
                    else:
                        found = []
                    if spans:
                        rows += [(lo + i, n, *_span(w, int(first), x)) for x in found]
                    else:
                        rows.append((lo + i, n, [s for _, _, s in found]))
            names = ["n_words", *(["first_word", "last_word", "score", "passage"] if spans else ["scores"])]
            at, *columns = list(zip(*rows, strict=True)) or [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "text_hash")),
                 *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "text_hash", *names])

    python_ready(docs.sparkSession)
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def _span(w, first: int, found: tuple[int, int, float]) -> tuple[int, int, float, str]:
    a, b, s = found
    passage = w.data[w.begin[first + a]:w.end[first + b]].decode("utf-8", "replace")
    return a, b, s, passage


def learn(docs: DataFrame, label: Column, features: int = FEATURES) -> Model:
    """Fit word scores and the extreme-value law.

    ``label`` is 1, 0 or null per row of ``docs``; text and doc_id are read.
    Word counts cover all documents.  The model holds the ``features`` words
    whose scores are farthest from 0; that bound also bounds what is broadcast.
    """
    rows = docs.select("doc_id", "text", label.cast("int").alias("label"))
    python_ready(docs.sparkSession)
    odds = _log_odds(settle(_count_words(rows)))
    top = odds.orderBy(F.abs("score").desc(), "word").limit(features).toPandas()
    top = top.assign(key=top["word"].to_numpy(np.int64).view(np.uint64)).sort_values("key")
    scores = top["score"].to_numpy(float)
    model = Model(top["key"].to_numpy(np.uint64), scores, _rate(scores - DRIFT, top["p"].to_numpy(float)))
    return model


def evidence(found: DataFrame, rate: float, scale: float) -> Column:
    """Sum over the significant segments of log(CHANCE / expected number by chance)."""
    chance = F.log(F.lit(scale) * F.greatest(F.col("n_words"), F.lit(1)))
    gain = F.transform("scores", lambda s: F.greatest(F.lit(0.0), F.lit(float(np.log(CHANCE))) - chance + s * rate))
    return F.aggregate(gain, F.lit(0.0), lambda a, x: a + x)


def _scale(found: DataFrame, rate: float) -> float:
    """K of the law P(top < s) = exp(-K n e^(-rate s)): its likeliest value over the clean documents is their
    number over the sum of n e^(-rate top)."""
    top = F.coalesce(F.array_max("scores"), F.lit(0.0))
    r = found.filter((F.col("label") == 0) & (F.col("n_words") > 0)).agg(
        F.count("*").alias("n"), F.sum(F.col("n_words") * F.exp(-rate * top)).alias("s")).first()
    return float(r.n / r.s) if r.n and r.s else 1.0


def passages(docs: DataFrame, model: Model, scale: float) -> DataFrame:
    """One row per significant passage: doc_id, text_hash, n_words, first_word, last_word, score, passage."""
    found = _scan(docs, model, spans=True)
    return found.filter(F.log(F.lit(scale) * F.col("n_words")) - model.rate * F.col("score") < float(np.log(CHANCE)))


def _logistic(steps: pd.DataFrame) -> tuple[float, float]:
    """Offset and slope of P(1 | evidence) from counts per step of evidence; a weak prior keeps them finite."""
    x, y, n = (steps[c].to_numpy(float) for c in ("x", "toxic", "n"))
    if not n.sum():
        return -2.0, 1.0
    base = (y.sum() + 0.5) / (n.sum() + 1)
    a, b = np.log(base / (1 - base)), 0.1
    ridge = 1e-3
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        v = n * p * (1 - p)
        g = np.array([(y - n * p).sum() - ridge * a, (x * (y - n * p)).sum() - ridge * b])
        h = np.array([[v.sum() + ridge, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + ridge]])
        step = np.clip(np.linalg.solve(h + 1e-9 * np.eye(2), g), -1, 1)
        a, b = a + step[0], max(0.0, b + step[1])
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
             labelled: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; also evidence, n_words and
    text_hash (xxhash64 of the text).

    The classifier is fitted on at most ``labelled`` documents with a label, a
    bound that lets their ids go to every task in place of a shuffle of the
    texts; words are counted over all documents.
    Labels are learnt where ``held_out`` is false, ``toxic`` is 0 or 1 and the
    id is not null; of several labels for one id the largest counts.  Null or
    empty text has no evidence and gets the base score.  Null doc_id: scored,
    not held out, never learnt from.  Repeated rows are scored once each.
    Empty tables: no rows; without labels of both classes no word scores.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.max("toxic").alias("label")).filter(~held_out(F.col("doc_id")))
    known = F.broadcast(settle(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)))
    rows = docs.select("doc_id", "text").join(known, "doc_id", "left")
    model = learn(rows, F.col("label"))
    found = _scan(rows, model, spans=False)
    found = settle(found).join(known, "doc_id", "left")
    scale = _scale(found, model.rate)
    found = found.withColumn("evidence", F.least(evidence(found, model.rate, scale), F.lit(MOST)))
    step = F.round(F.col("evidence") * STEPS).cast("int")
    steps = found.filter(F.col("label").isNotNull()).groupBy(step.alias("step")).agg(
        F.sum("label").alias("toxic"), F.count("*").alias("n")).toPandas()
    a, b = _logistic(steps.assign(x=steps["step"] / STEPS))
    z = F.lit(a) + F.lit(b) * F.col("evidence")
    score = 1 / (1 + F.exp(-z))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
                        (score >= threshold).cast("int").alias("predicted"), "evidence", "n_words", "text_hash")
