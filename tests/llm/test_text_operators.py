"""Operators on documents against brute force, on the odd cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from snapplan.llm.fingerprints import document_fingerprints, likeness, sketches
from snapplan.llm.line_dedup import line_dedup
from snapplan.llm.mixing import BLOCK, SLOTS, frame_of, mix_sources, schedule, whole_weights
from snapplan.llm.ngram_join import ngram_components
from snapplan.llm.packing import best_fit_packing, sum_of_squares
from snapplan.llm.substring_dedup import substring_dedup
from snapplan.llm.token_count import count_tokens, token_counts
from snapplan.llm.tokenize import byte_level_ids, tokenizer

from .conftest import odd_documents

ROWS = odd_documents()
SPACE = " \t\n\x0b\x0c\r"


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def split(text: str) -> list[str]:
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_packing(odd):
    t = tokenizer("byte_bpe_50k.json")
    got = [r.asDict() for r in best_fit_packing(odd, capacity=512, group=40).collect()]
    want = Counter()
    for doc, text in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 512 or 512
        for k, s in enumerate([0, *range(first, len(ids), 512)]):
            n = first if k == 0 else 512
            crc = zlib.crc32(np.array(ids[s:s + n], dtype="<u4").tobytes())
            want[doc, k, s, n, crc] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 512
    assert len(by) <= 1.1 * -(-sum(r["length"] for r in got) // 512)


def test_sum_of_squares_rule():
    """Each placement is the cheapest one by the definition, worked out from scratch."""
    rng = random.Random(3)
    lengths = np.array([rng.randint(1, 20) for _ in range(300)])
    where, offset = sum_of_squares(lengths, 20)
    level: dict[int, int] = {}

    def cost(levels) -> int:
        return sum(n * n for n in Counter(20 - x for x in levels if x < 20).values())

    for n, b, o in zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True):
        options = [cost([*(x for k, x in level.items() if k != c), x0 + n])
                   for c, x0 in level.items() if x0 + n <= 20] + [cost([*level.values(), n])]
        assert o == level.get(b, 0)
        level[b] = o + n
        assert cost(level.values()) == min(options)


def test_byte_level_pieces_are_safe():
    t = tokenizer("byte_bpe_50k.json")
    rng = random.Random(1)
    parts = ["a", "b", "É", " ", "  ", "\n", ".", ",", "'s", "1", "½", "_", "́", "\x1c", " ",
             "<|endoftext|>", "..", "n't", "\t"]
    for _ in range(1500):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert byte_level_ids(x, "byte_bpe_50k.json") == ids


def test_token_counts(odd):
    t = tokenizer("word_bpe_49k.json")
    got = Counter(tuple(r) for r in token_counts(odd, limit=300, chunk=512, overlap=8).collect())
    want = Counter()
    for doc, text in ROWS:
        n = len(t.encode(text or "", add_special_tokens=False))
        want[doc, len((text or "").encode()), n, n > 300] += 1
    assert got == want


@pytest.mark.parametrize("text", ["x" * 3000, " " * 900 + "q" * 50, "ab " * 900, "é" * 700 + " z" * 700,
                                  "word <|startoftext|> " * 90])
def test_splicing_widens(text):
    t = tokenizer("word_bpe_49k.json")
    for chunk, overlap in ((64, 1), (200, 16)):
        assert count_tokens(text, "word_bpe_49k.json", chunk, overlap) == len(
            t.encode(text, add_special_tokens=False))


def test_line_dedup(odd):
    docs = [(d, (x or "").split("\n")) for d, x in ROWS]
    def key(line: str) -> str:
        return lower(line.strip(SPACE))
    held, keeper = Counter(), {}
    for d, lines in docs:
        for k in {key(x) for x in lines if len(key(x)) >= 40}:
            held[k] += 1
            keeper[k] = max(keeper.get(k, -1), -1 if d is None else d)
    want = Counter()
    for d, lines in docs:
        left = [x for x in lines if held[key(x)] < 5 or (-1 if d is None else d) >= keeper[key(x)]]
        want[d, "\n".join(left), len(lines), len(lines) - len(left), "a", 1, None] += 1
    out = line_dedup(odd)
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped, r.h1, r.cls, r.position) for r in out.collect())
    assert got == want
    assert sum(n for _, _, _, n, *_ in want.elements()) > 20


def test_line_dedup_levels(odd):
    """More batches and another fan-out find the same."""
    cols = ["doc_id", "text", "n_lines", "n_dropped"]
    a, b = (Counter(map(tuple, line_dedup(odd, batches=n, fanout=f).select(*cols).collect())) for n, f in
            ((1, 2), (7, 3)))
    assert a == b


def shingles(text: str | None) -> frozenset:
    w = split(lower(text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_ngram_components(odd):
    sets = [shingles(x) for _, x in ROWS]
    root = list(range(len(ROWS)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(ROWS):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    want = Counter((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in
                   enumerate(zip(ROWS, sets, strict=True)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(odd).collect())
    assert got == want


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    """Borderline families, more than a block in size, with pivots that link only a part of them."""
    import snapplan.llm.ngram_join as op
    monkeypatch.setattr(op, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([1, 3, 5, 8])):
            w[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in
           ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_substring_dedup(odd):
    docs = [(-1 << 63 if d is None else d, split(x or "")) for d, x in ROWS]
    low: dict[tuple, int] = {}
    for d, w in docs:
        for i in range(len(w) - 12):
            k = tuple(w[i:i + 13])
            low[k] = min(d, low.get(k, d))
    want = Counter()
    for (raw, _), (d, w) in zip(ROWS, docs, strict=True):
        lost = {i + k for i in range(len(w) - 12) if low[tuple(w[i:i + 13])] < d for k in range(13)}
        left = " ".join(x for i, x in enumerate(w) if i not in lost)
        want[raw, len(w), len(lost), hashlib.sha256(left.encode()).hexdigest()] += 1
    got = Counter(tuple(r) for r in substring_dedup(odd).select(
        "doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want


def test_fingerprints(odd):
    got = document_fingerprints(odd, rows_per_part=20).collect()
    assert len(got) == len(ROWS)
    order = sorted({d for d, _ in ROWS if d is not None}, reverse=True)
    text = {d: x or "" for d, x in ROWS if d is not None}
    for r in got:
        if r.doc_id is not None and text[r.doc_id] == (dict(ROWS)[r.doc_id] or "") and order[-1] != r.doc_id \
                and r.doc_id != 2:
            x, n = text[r.doc_id], len(text[r.doc_id])
            following = text[order[order.index(r.doc_id) + 1]]
            new = x[:n - n // 2] + following[:n // 2]
            assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(new.encode()).hexdigest())
            a, b, c = sketches([x, new, following])
            assert (r.near_edited, r.near_next) == (likeness(a, b), likeness(a, c))
    by_text = defaultdict(set)
    for r in got:
        if r.doc_id is not None:
            by_text[text[r.doc_id]].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_sketches_are_local():
    """A long common substring makes texts alike wherever it stands; a batch changes nothing."""
    rng = random.Random(2)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(3))
    x, y, z = sketches([a, "zz" + a + b[:40], c])
    assert likeness(x, y) > 0.85 and likeness(x, z) < 0.1
    assert sketches([a])[0] == x and 0.3 < likeness(*sketches([a, a[:2000] + c[:2000]])) < 0.7
    assert sketches([""]) == [b""] and likeness(b"", b"") == 1.0 and likeness(b"", x) == 0.0


def test_frames_meet_every_deadline():
    weights = whole_weights({"a": 5, "b": 2.5, "c": 0.1, "d": 1}, 256)
    assert sum(weights.values()) == 256
    frame = frame_of(weights, 256)
    for s, w in weights.items():
        for t in range(1, 257):
            assert abs(sum(x < t for x in frame[s]) - t * w / 256) < 1


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), "x") for i in range(900)] + [(5, "a", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    got = mix_sources(docs, {"a": 2, "b": 1, None: 1}, slots=64).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((d, s) for d, s, _ in rows)
    assert sorted(r.position for r in got) == list(range(len(rows)))
    first = [r for r in got if r.phase == 0]
    shares = whole_weights({"=a": 2, "=b": 1, "=c": 1, "": 1}, 64)
    slots = {r.slot: "" if r.source is None else f"={r.source}" for r in first}
    for t in range(1, max(slots) + 2):
        for s, w in shares.items():
            assert abs(sum(slots[x] == s for x in range(t)) - t * w / 64) < 1
    assert all(r.release <= r.slot < r.deadline for r in first)
    assert max(Counter((r.source, r.block) for r in got).values()) == BLOCK


@pytest.mark.parametrize("weights", [{f"s{k:02}": 1.0 for k in range(20)},
                                     {f"s{k:03}": 1 / 3 if k == 7 else 2 / 3 / 255 for k in range(256)},
                                     {"a": 1e-4, "b": 0.3333, "c": 0.6666}])
def test_shares_hold_over_long_runs(weights):
    slots = 60_000
    total = sum(weights.values())
    plan = schedule({s: int(w / total * slots) * 16 for s, w in weights.items()}, weights, 16, SLOTS)
    at = {s: p[3][p[0] == 0] for s, p in plan.items()}
    length = sum(len(x) for x in at.values())
    assert length > 0.9 * slots
    for s, x in at.items():
        done = np.cumsum(np.bincount(x, minlength=length))
        assert np.abs(done - np.arange(1, length + 1) * (weights[s] / total)).max() < 1 + 1e-6


@pytest.mark.parametrize("operator", [best_fit_packing, token_counts, line_dedup, ngram_components, substring_dedup,
                                      document_fingerprints])
def test_empty_table(empty, operator):
    assert operator(empty).collect() == []


def test_mixing_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, source string")).collect() == []
