"""Operators 11 to 13 against brute force, on odd rows and small trees."""

from __future__ import annotations

import hashlib
import io
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapplan.llm import pfor, tokenize
from snapplan.llm.filter_audit import LETTERS, filter_audit, lattice_edges, path_counts
from snapplan.llm.merkle import dataset_manifest, merkle_manifest
from snapplan.llm.token_files import documents_of, open_file, read_documents, token_files, write_token_files

from .conftest import odd_documents

ROWS = odd_documents()


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(leaves: list[str], fan: int = 3) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root and, for each leaf, (left, right) siblings per level."""
    ways: list[list[tuple[str, str]]] = [[] for _ in leaves]
    at, level = list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p - p % fan:p - p % fan + fan]
            ways[i].append(("".join(run[:p % fan]), "".join(run[p % fan + 1:])))
            at[i] = p // fan
        level = [H(*level[i:i + fan]) for i in range(0, len(level), fan)]
    return level[0], ways


def brute_manifest(rows: list[tuple]) -> Counter:
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    def null_first(v):
        return (v is not None, v if v is not None else 0)

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((null_first(r[0]), H(*map(field, r)), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:2])
        trees[s] = brute_tree([leaf for _, leaf, _ in groups[s]])
    root, over = brute_tree([trees[s][0] for s in names]) if names else (None, [])
    out = Counter()
    for s, up in zip(names, over, strict=True):
        for (_, leaf, r), way in zip(groups[s], trees[s][1], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            text = r[4].replace("\n", "") if hit and r[4] is not None else r[4]
            h = H(*map(field, (*r[:4], text)))
            for a, b in way + up:
                h = H(a, h, b)
            out[r[0], leaf, trees[s][0], root, H(*(a + b for a, b in way + up)), h, h == root] += 1
    return out


def tampered():
    return F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 2 = 0"), F.regexp_replace("text", "\n", ""))


FIELDS = "doc_id long, source string, lang string, n_chars long, text string, h string, key int, pos int, n int, top long"


def test_manifest_of_odd_rows(spark):
    rows = [(d, [None, "", "a", "b", "ä", "z", "a b"][i % 7], [None, "en"][i % 2], [None, 5][i % 3 > 0], t)
            for i, (d, t) in enumerate(ROWS)]
    rows += [(i, "hot", "en", 1, f"text\n{i}") for i in range(800)]       # more than one block of 3 ** 6
    df = spark.createDataFrame([(*r, "h", 1, 2, 3, 4) for r in rows], FIELDS).repartition(5)
    got = Counter(tuple(r) for r in dataset_manifest(df, tampered()).collect())
    assert got == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], FIELDS)
    out = dataset_manifest(df, tampered())
    assert out.count() == 0 and out.columns[:2] == ["doc_id", "leaf"]


@pytest.mark.parametrize("fan,levels,sizes", [(3, 1, [1, 2, 3, 4, 9, 10, 28]), (2, 2, [1, 2, 5, 17]), (4, 1, [1, 3, 5, 21])])
def test_trees_of_every_shape(spark, fan, levels, sizes):
    """Few levels a block, so that several rounds and ragged last runs occur."""
    rows = [(k, f"g{n:02d}", H(f"{n} {k}")) for n in sizes for k in range(n)]
    df = spark.createDataFrame(rows, "k int, g string, leaf string")
    got = merkle_manifest(df, F.col("g"), ["k"], fan, levels).collect()
    trees = {n: brute_tree([H(f"{n} {k}") for k in range(n)], fan) for n in sizes}
    root, over = brute_tree([trees[n][0] for n in sizes], fan)
    assert len(got) == len(rows)
    for r in got:
        n = int(r.g[1:])
        ways = trees[n][1][r.k] + over[sizes.index(n)]
        assert r.subroot == trees[n][0] and r.root == root
        assert [(s.left, s.right) for s in r.sibs if s.left is not None] == ways


def brute_audit(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    """Rows of (doc_id, text, lang) under all orders, one document at a time."""
    least: dict[str, int] = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    fails = defaultdict(list)
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "".join(c for c, is_ in zip(LETTERS, (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            re.search("[#$%&*|]", t) is not None, d is not None and least[t] < d), strict=True) if is_)
        fails[lang or ""].append((f, d is not None and d in good, d is not None and d in toxic))
    out = []
    for part, rows in fails.items():
        shapley, steps = Counter(), []
        for order in itertools.permutations(LETTERS):
            left = rows
            for k, c in enumerate(order, 1):
                gone = [r for r in left if c in r[0]]
                left = [r for r in left if c not in r[0]]
                shapley[c] += len(gone)
                steps.append((c, (part, "".join(order), k, len(left), len(gone), sum(c in r[0] for r in rows) - len(gone),
                                  sum(r[0] == c for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))))
        out += [(*row, shapley[c]) for c, row in steps]
    return set(out)


def test_audit(spark):
    docs = [(d, t, [None, "", "en", "de"][i % 4]) for i, (d, t) in enumerate(ROWS)]
    docs += [(400 + i, "A b c $ " * (i * 20), "en") for i in range(6)] + [(500 + i, "same text", "fr") for i in range(300)]
    labels = [(d, (d or 0) % 2, int((d or 0) % 3 == 0)) for d in range(0, 520)] + [(3, 0, 0), (4, None, None), (None, 1, 1)]
    df = spark.createDataFrame([(*r, 1, "n") for r in docs], "doc_id long, text string, lang string, n int, digest string")
    lab = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = [tuple(r) for r in filter_audit(df, lab).collect()]
    assert len(got) == 4 * 600
    assert set(got) == brute_audit(docs, labels)
    assert filter_audit(df.limit(0), lab).count() == 0
    assert len(filter_audit(df, lab.limit(0)).collect()) == 4 * 600


def test_lattice():
    forward, backward = path_counts(5)
    assert forward[-1] == backward[0] == 120 and len(lattice_edges(5)) == 80
    for f in range(5):
        assert sum(orders for _, g, _, orders in lattice_edges(5) if g == f) == 120


def brute_ids(rows: list[tuple]) -> Counter:
    t = tokenize.tokenizer("word_bpe_49k.json")
    out = Counter()
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out[d, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    return out


def test_token_files(spark, odd, tmp_path):
    rows = token_files(spark, odd, folder=str(tmp_path / "a"), file_ids=3000).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == brute_ids(ROWS)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    names = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert names == sorted(names, key=lambda d: (d is not None, d or 0))


def test_files_of_lost_attempts_do_not_count(spark, odd, tmp_path):
    files = write_token_files(odd, str(tmp_path), "word_bpe_49k.json", 2, file_ids=5000)
    n = files.count()
    assert n > 3
    (tmp_path / "part-000000-00000-lost.pfor").write_bytes(b"half a file")
    assert read_documents(files).count() == len(ROWS)
    first = files.orderBy("part", "nth").first()
    reader = open_file(first.path, first.length)
    table, begin = documents_of(reader)
    whole = reader.read(0, reader.values)
    for a, b in zip(begin, begin[1:], strict=False):             # the ids of any document alone
        assert (reader.read(int(a), int(b)) == whole[a:b]).all() and whole[b - 1] == 2


def test_no_documents_make_no_files(spark, empty, tmp_path):
    assert token_files(spark, empty, folder=str(tmp_path / "none")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.integers(1, 100),
       st.integers(0, 700), st.integers(0, 700))
def test_blocks_round_trip(values, percentile, a, b):
    v, stream = np.array(values, dtype=np.uint32), io.BytesIO()
    writer = pfor.Writer(stream, percentile)
    for i in range(0, len(v), 90):
        writer.add(v[i:i + 90])
    length = writer.close(b"own")
    reader = pfor.Reader(stream, length)
    a, b = sorted((min(a, len(v)), min(b, len(v))))
    assert reader.own == b"own" and (reader.read(a, b) == v[a:b]).all() and (reader.read(0, len(v)) == v).all()


def test_outliers_go_to_the_list():
    v = np.tile(np.arange(256, dtype=np.uint32) % 8, 40)
    small = len(pfor.pack_blocks(v)[0])
    v[::50] = 2**31
    assert len(pfor.pack_blocks(v)[0]) == small + 5 * len(v[::50])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1 \n\t.,_-é'<|>\x1c\xa0!́s", max_size=40))
def test_pieces_give_the_ids_of_the_text(text):
    assert [p for p in tokenize.SAFE.split(text) if p] == tokenize.PIECE.findall(text)
    for name, ids in (("byte_bpe_50k.json", tokenize.byte_level_ids(text, "byte_bpe_50k.json")),
                      ("word_bpe_49k.json", tokenize.word_ids(text, "word_bpe_49k.json"))):
        assert np.frombuffer(ids, "<u4").tolist() == tokenize.tokenizer(name).encode(text, add_special_tokens=False).ids


def test_a_small_memo_changes_no_ids(monkeypatch):
    texts = [t or "" for _, t in ROWS]
    want = [tokenize.byte_level_ids(t, "byte_bpe_50k.json") for t in texts]
    monkeypatch.setattr(tokenize, "MEMO", 5)
    monkeypatch.setattr(tokenize, "_IDS", {})

    assert [tokenize.byte_level_ids(t, "byte_bpe_50k.json") for t in texts] == want
    held = tokenize.memo("byte_bpe_50k.json", False)
    assert len(held) <= 5 and len(held.old) <= 5
