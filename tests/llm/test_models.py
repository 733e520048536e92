"""Toxicity, embeddings and pages: held-out accuracy, brute force, planted structure."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from snapplan.llm.components import components
from snapplan.llm.dom import parse, tree_match
from snapplan.llm.embedding_links import embedding_links, fit, links, encode, unit
from snapplan.llm.html_text import main_texts, page_texts
from snapplan.llm.toxicity import DRIFT, segments, toxicity

from .conftest import prose


def test_segments_match_brute_force():
    """Maximal scoring segments by their recursive definition: the best one, then those to its left and right."""
    rng = random.Random(4)
    for _ in range(300):
        values = [rng.choice([-DRIFT, -DRIFT, 2.0, 1.0, -1.75, 3.25]) for _ in range(rng.randint(1, 14))]

        def best(lo: int, hi: int) -> list:
            found = [(sum(values[a:b]), a - b, -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            found = [f for f in found if f[0] > 0]
            if not found:
                return []
            top = max(f[0] for f in found)
            _, _, _, a, b = max((f for f in found if f[0] == top), key=lambda f: (f[1], f[2]))
            return best(lo, a) + [(a, b - 1, top)] + best(b, hi)

        places = [i for i, v in enumerate(values) if v != -DRIFT]
        got = segments(np.array(places, dtype=int), np.array([values[i] for i in places], dtype=float))
        assert [s for _, _, s in got] == pytest.approx([s for _, _, s in best(0, len(values))])


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = prose(rng, 60).split(" ")
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), f"vile{rng.choice('abcdefgh')}{rng.choice('xyz')}")
        rows.append((i, " ".join(w), 1))
        labels.append((i, int(bad), "x"))
    rows += [(601, "", 1), (602, None, 1), (None, "vileax vileby " * 5, 1), rows[0]]
    labels += [(700, 1, "x"), (3, None, "x"), (None, 1, "x")]
    return (spark.createDataFrame(rows, "doc_id long, text string, label int"),
            spark.createDataFrame(labels, "doc_id long, toxic int, text string"))


def test_toxicity_held_out(toxic_docs):
    docs, labels = toxic_docs
    got = toxicity(docs, labels).collect()
    assert len(got) == 604
    held = [r for r in got if r.held_out]
    assert len(held) > 100
    right = [r.predicted == (r.doc_id % 6 == 0 and r.doc_id < 600) for r in held]
    assert sum(right) >= 0.98 * len(right)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    assert [r.predicted for r in got if r.doc_id in (601, 602)] == [0, 0]


def test_toxicity_without_labels(toxic_docs, spark):
    docs, labels = toxic_docs
    assert toxicity(docs, labels.filter("false")).count() == 604
    assert toxicity(docs.filter("false"), labels).collect() == []


def vectors() -> list[tuple]:
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24)).astype(np.float32)
    rows = [(i, base[i % 40] + (rng.normal(size=24) * 0.25 * (i // 40 % 3)).astype(np.float32), i % 3)
            for i in range(400)]
    rows = [(i, v.tolist(), label) for i, v, label in rows]
    v = rows[0][1]
    rows += [(500, v, 0), (501, v, None), (502, None, 0), (503, [0.0] * 24, 0), (504, [float("nan")] + v[1:], 0),
             (505, [None, *v[1:]], 0), (506, [float("inf")] + v[1:], 0), (507, [2 * x for x in v], 0),
             (508, [], 0), (509, [1.0, 2.0], 0), (510, [4.0, 8.1], 0), (511, [-1.0, 2.0], 0), (512, [2.0, 4.0], 1),
             (None, v, 0), (500, v, 0)]
    return rows


def test_embedding_links(spark):
    rows = vectors()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cls string")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_links(docs).collect())
    ok = [v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)
          and any(v) for _, v, label in rows]
    near = np.zeros((len(rows), len(rows)), dtype=bool)
    for n in (2, 24):                                 # vectors of one length are compared with each other
        at = [i for i, (_, v, _) in enumerate(rows) if ok[i] and len(v) == n]
        x = np.array([np.float32(rows[i][1]) for i in at], dtype=float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        near[np.ix_(at, at)] = x @ x.T >= 0.93
    for i, (_, _, a) in enumerate(rows):
        for j, (_, _, b) in enumerate(rows):
            near[i, j] &= i != j and a == b
    assert near[[r[0] for r in rows].index(509)].sum() == 1
    root = np.arange(len(rows))
    for _ in range(len(rows)):
        root = np.array([min([root[i], *root[near[i]]]) for i in range(len(rows))])
    want = Counter()
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        low = min(ids) if ids else None
        want[d, int(near[i].sum()), low if ok[i] else d, d is not None and d == (low if ok[i] else d)] += 1
    assert got == want
    assert embedding_links(docs.filter("false")).collect() == []


def test_codes_drop_no_partner():
    """In one list the codes lose nothing: links are those of brute force."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 32))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.2, 0.3)])
    index = fit(unit(x), 1)
    _, codes, errors = encode(index, unit(x))
    q, m = links(index, 0, x, codes, errors, x, 0.93)
    u = unit(x)
    assert set(zip(q.tolist(), m.tolist(), strict=True)) == set(map(tuple, np.argwhere(u @ u.T >= 0.93).tolist()))


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(v, v) == r for v, r in root.items())


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Home</a></header><nav><ul><li>a{i}<li>b</ul></nav><div class="cookie-notice">We use cookies {i}</div>
<div class=page><div class="story-{k}"><h1>Title {i} &amp; more</h1><p>First <b>bold{i}</b> text
 here<br>next<p>Second {i}: &eacute;&#233; &lt;x&gt;<p>Read more on our site</p><form><input><button>Go</button></form>
<ul><li>one {i}<li>two {i}</ul></div></div><div id="comments"><p>nice {i}</p></div><aside>side {i}</aside>
<footer>&copy; {i}</footer></body></html>"""


def test_wrapper_induction():
    pages = [PAGE.format(i=i, k=1) for i in range(20)]
    got = main_texts(pages)
    for i, t in enumerate(got):
        assert t == f"Title {i} & more\n\nFirst bold{i} text here next\n\nSecond {i}: éé <x>\n\none {i}\n\ntwo {i}"


def test_copies_of_a_page_keep_their_text():
    page = "<body><article><p>same text</p><p>again</p></article></body>"
    assert main_texts([page] * 30) == ["same text\n\nagain"] * 30


def test_pages(spark):
    rows = [(1, "http://h.org/a", None, "x"), (2, "http://h.org/b", "", "x"), (3, None, "<p>plain", "x"),
            (None, "http://H.org/c", "<article>a<p>b &amp", "x"), (4, "no url", "just text", "x"),
            (4, "no url", "just text", "x"), (5, "http://h.org/l", "<main>" + "<p>word " * 3000 + "</main>", "x")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = Counter((r.page_id, r.url, r.text if r.page_id != 5 else len(r.text), r.n_chars) for r in
                  page_texts(docs).collect())
    assert got == Counter([(1, "http://h.org/a", "", 0), (2, "http://h.org/b", "", 0), (3, None, "plain", 5),
                           (None, "http://H.org/c", "a\n\nb &", 6), (4, "no url", "just text", 9),
                           (4, "no url", "just text", 9), (5, "http://h.org/l", 17998, 17998)])
    assert page_texts(docs.filter("false")).collect() == []


def test_tree_match_is_the_largest():
    a = parse("<div><p>1</p><ul><li>x</li></ul><p>2</p></div>")
    b = parse("<div><ul><li>y</li><li>z</li></ul><p>3</p><span>s</span></div>")
    assert Counter(x.tag for x, _ in tree_match(a, b)) == Counter(["#page", "div", "ul", "li", "p"])


def test_deep_pages_are_matched():
    page = "<body>" + "<div>" * 3000 + "<p>text {i}</p>" + "</div>" * 3000
    a, b = parse(page.format(i=1)), parse(page.format(i=2))
    assert len(tree_match(a, b)) == 3003
    assert main_texts([page.format(i=i) for i in range(2)]) == ["text 0", "text 1"]


@pytest.mark.parametrize("n", [4, 30])
def test_long_notices_are_template(n):
    notice = "<div><p>" + "these words stand on every page of the host " * 20 + "</p></div>"
    pages = [f"<body>{notice}<div><p>short text {i}</p><p>more {i}</p></div></body>" for i in range(n)]
    want = [f"short text {i}\n\nmore {i}" for i in range(n)]
    assert main_texts(pages) == want
    copies = main_texts(pages + [pages[0]] * 40)       # copies do not outvote the rest
    assert copies == want + [want[0]] * 40


def test_near_copies_keep_their_article():
    pages = [f"<body><nav>{i}</nav><article><p>the same long text on all of them</p><p>at {i}</p></article></body>"
             for i in range(20)]
    assert main_texts(pages) == [f"the same long text on all of them\n\nat {i}" for i in range(20)]


@pytest.mark.parametrize("n", [1, 20])
def test_names_of_wrappers_and_paragraphs(n):
    page = ('<body><div class="{w}"><article class="post category-social"><p>one {i}</p><p class="search-term">two {i}'
            '</p><p class="related-work">three {i}</p></article><div class="related">see {i}</div></div></body>')
    for w in ("layout has-sidebar", "sidebar", "widget"):
        pages = [page.format(w=w, i=i) for i in range(n)]
        assert main_texts(pages) == [f"one {i}\n\ntwo {i}\n\nthree {i}" for i in range(n)]
    pages = [f'<body><div class="social"><p>long text {i} of the page</p></div><div class="share">b {i}</div></body>'
             for i in range(n)]
    assert main_texts(pages) == [f"long text {i} of the page" for i in range(n)]


def test_a_name_on_one_page_drops_nothing():
    pages = [f"<article><p>text {i} of the page</p><p>and more</p></article>" for i in range(20)]
    pages.append('<article><p>text 20 of the page</p><p class="related">its own words</p></article>')
    assert main_texts(pages)[-1].endswith("its own words")


def test_slots_come_before_markup():
    words = "many words of the text proper "
    page = (f"<body><header><h1>Site</h1></header><main><article><p>teaser {{i}}</p></article></main><div><div>"
            f"<p>{words * 9}{{i}}</p><p>{words * 8}{{i}}</p></div></div></body>")
    for i, t in enumerate(main_texts([page.format(i=i) for i in range(20)])):
        assert t == f"{words * 9}{i}\n\n{words * 8}{i}"


@pytest.mark.parametrize("n", [1, 20])
def test_sibling_articles_stay(n):
    pages = [f"<body><article><p>the first {i}</p></article><article><p>and a longer second {i}</p></article></body>"
             for i in range(n)]
    assert main_texts(pages) == [f"the first {i}\n\nand a longer second {i}" for i in range(n)]


def test_headline_outside_the_article_stays():
    pages = [f"<body><header><h1>Site</h1></header><h1>On {i}</h1><article><p>some text of page {i}</p></article></body>"
             for i in range(20)]
    assert main_texts(pages) == [f"On {i}\n\nsome text of page {i}" for i in range(20)]
