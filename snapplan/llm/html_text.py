"""Operator 7: main text of web pages by wrapper induction.

Pages of one host meet in blocks of bounded size (a large host has several
blocks).  The page of median size is the block's wrapper: all others are
aligned with it by simple tree matching.  A block of the wrapper whose text is
the same on nearly all pages is template (pages of equal text count once, and
at least ``LEAST`` others must have been compared); blocks
whose text varies are slots, and the part of the tree that holds most of the
varying text outside menus and the like is where the article is.  Markup
(article, main and the like) settles the edges of that part, and decides alone
on hosts with too few different pages to compare.  From each page that part is read, without template text and without elements that HTML
or their names mark as something else; a name (a whole class, id or role)
counts if it recurs on the host's pages and holds the smaller part of their
varying text, and nothing that holds the article is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, python_ready
from .dom import BLOCK, HIDDEN, Node, parse, tree_match

PAGES = 256              # pages of a block, about
ALIKE = 0.8              # share of pages with the same text that makes a node template
VOTES = 8                # pages that must have been compared for that, or all other pages of a smaller host,
LEAST = 3                # but at least so many
COPY = 0.5               # an article with this share of constant text stands on near copies and is no template
OFTEN = 0.1              # share of a host's pages that a name must stand on to mark parts beside the article
MOST = 0.6               # go down to a child that has this share of the varying text

# Elements and names that mark parts beside the article.
BESIDE = HIDDEN | frozenset("nav footer aside form button select textarea menu dialog header search".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies dialog disclaimer disqus footer gdpr login menu modal nav navbar navigation "
    "newsletter notice pager pagination popup promo promoted promotion related replies reply respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
CONTENT = frozenset("article articlebody content entry main post story".split())


def hidden(n: Node) -> bool:
    return n.tag in HIDDEN or "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" \
        or "display:none" in n.attrs.get("style", "").replace(" ", "").lower()


def masses(root: Node, mass: dict[int, int]) -> dict[int, int]:
    """Visible text of each element and all below it; ``mass`` has the own text of blocks."""
    order, rest = [], [root]
    while rest:
        n = rest.pop()
        if not hidden(n):
            order.append(n)
            rest.extend(n.elements())
    total = {id(n): mass.get(id(n), 0) for n in order}
    for n in reversed(order):
        if n is not root:
            total[id(n.parent)] += total[id(n)]
    return total


def side_names(trees: list[Node], totals: list[dict[int, int]]) -> frozenset[str]:
    """The NAMES that a host's pages confirm: on several of them, and with less than half of their varying text."""
    shares: dict[str, list[float]] = {}
    for t, total in zip(trees, totals, strict=True):
        found: dict[str, int] = {}
        for n in t.walk():
            for x in n.names & NAMES if id(n) in total else ():
                found[x] = max(found.get(x, 0), total[id(n)])
        for x, m in found.items():
            shares.setdefault(x, []).append(m / max(1, total[id(t)]))
    return frozenset(x for x, s in shares.items() if len(s) >= max(2, OFTEN * len(trees)) and sum(s) < 0.5 * len(s))


def beside(t: Node, total: dict[int, int], names: frozenset[str], sure: bool) -> set[int]:
    """The elements of a page that are something beside the article, by id.

    ``names`` mark such elements, besides HTML's own; ``sure`` if the host
    confirmed them.  What holds the page's largest article stays; without one,
    a form (and a named element, if not sure) that holds most of the text.
    """
    kept = {id(t)}
    marked = [n for n in t.walk() if total.get(id(n)) and (
        n.tag in ("article", "main") or n.attrs.get("itemprop", "").lower() == "articlebody")]
    whole = [n for n in marked if names.isdisjoint(n.names)] or marked
    at = max(whole, key=lambda n: total[id(n)], default=None)
    while at is not None:
        kept.add(id(at))
        at = at.parent
    out = set()
    for n in t.walk():
        if n.tag in ("html", "body", "#page"):
            continue
        named = not names.isdisjoint(n.names)
        if hidden(n):
            out.add(id(n))
        elif (named or n.tag in BESIDE) and id(n) not in kept:
            most = not marked and (n.tag == "form" or named and not sure) and n.tag not in BESIDE - {"form"} \
                and 2 * total.get(id(n), 0) > total[id(t)]
            if not most:
                out.add(id(n))
    return out


def _visible(root: Node, side: set[int]) -> Iterator[Node]:
    rest = [root]
    while rest:
        n = rest.pop()
        yield n
        rest.extend(k for k in reversed(n.elements()) if id(k) not in side)


#: what says that it is the article, strongest first
KINDS = (lambda n: n.tag == "article", lambda n: n.attrs.get("itemprop", "").lower() == "articlebody",
         lambda n: n.tag == "main" or "main" in n.attrs.get("role", ""),
         lambda n: n.tag in ("div", "section", "td") and not CONTENT.isdisjoint(n.words))


def _shown(root: Node, mass: dict[int, int], side: set[int]) -> dict[int, int]:
    """Text of each element with all below it, without the elements beside; ``mass`` has the own text of blocks."""
    total: dict[int, int] = {}
    for n in reversed(list(_visible(root, side))):
        total[id(n)] = mass.get(id(n), 0) + sum(total.get(id(k), 0) for k in n.elements())
    return total


def _outermost(root: Node, kind, total: dict[int, int]) -> list[Node]:
    """The elements of a kind that have text and stand in no other of it, in page order."""
    out, rest = [], [root]
    while rest:
        n = rest.pop()
        if kind(n) and n is not root:
            out.append(n)
        else:
            rest.extend(k for k in reversed(n.elements()) if total.get(id(k)))
    return out


def _heaviest(root: Node, total: dict[int, int]) -> Node:
    """Go down while one child with blocks of its own holds most of the varying text."""
    n = root
    while True:
        below = [k for k in n.elements() if total[id(n)] and total.get(id(k), 0) >= MOST * total[id(n)]]
        if not below or below[0].tag == "p" or n is not root and not any(k.is_block() for k in below[0].elements()):
            return n
        n = below[0]


def _marked(root: Node, total: dict[int, int]) -> list[Node]:
    """What a page says is its article: all of the strongest kind, but of elements only so named the largest."""
    for kind in KINDS:
        found = _outermost(root, kind, total)
        if found:
            return found if kind is not KINDS[-1] else [max(found, key=lambda n: total[id(n)])]
    return []


def by_slots(t: Node, total: dict[int, int], mass: dict[int, int], side: set[int]) -> list[Node]:
    """The parts of a page that hold its article, found by varying text.

    Markup settles the edges: the part grows to the nearest element around it
    that is marked as article (with sibling articles), or shrinks to marked
    elements in it that have most of its text.  A varying headline before it
    belongs to it.
    """
    part = _heaviest(t, total)
    around, n = [], part
    while n is not None:
        around.append(n)
        n = n.parent
    parts = [part]
    up = next((n for kind in KINDS for n in around if kind(n)), None)
    if up is not None:
        parts = [up]
        if KINDS[0](up):
            parts = [n for n in up.parent.elements() if n is up or KINDS[0](n) and total.get(id(n))]
    else:
        for kind in KINDS:
            found = _outermost(part, kind, total)
            if 2 * sum(total[id(n)] for n in found) > total[id(part)]:
                parts = found
                break
    heads, rest = [], [t]
    while rest:
        n = rest.pop()
        if n is parts[0]:
            break
        if n.tag == "h1" and mass.get(id(n)):
            heads.append(n)
        rest.extend(k for k in reversed(n.elements()) if id(k) not in side or k.tag == "header" and not hidden(k)
                    and NAMES.isdisjoint(k.names))
    return heads + parts


def blocks(root: Node, template: set[int], side: set[int]) -> list[str]:
    """Texts of the blocks below an element in page order, white space as one space."""
    out: list[str] = []
    text: list[str] = []

    def end() -> None:
        t = " ".join("".join(text).split())
        text.clear()
        if t:
            out.append(t)

    rest: list[Node | str | None] = [root]
    while rest:
        n = rest.pop()
        if n is None:
            end()
        elif isinstance(n, str):
            text.append(n)
        elif n is root or id(n) not in side or n.tag == "header" and NAMES.isdisjoint(n.names):
            if n.tag in ("br", "td", "th"):
                text.append(" ")
            kids = [k for k in n.kids if isinstance(k, Node) and any(x.is_block() for x in k.walk())] \
                if id(n) in template else list(n.kids)
            if n.tag in BLOCK:
                end()
                rest.append(None)
            rest.extend(reversed(kids))
    end()
    return out


def main_texts(pages: list[str]) -> list[str]:
    """Main texts of pages of one host: blocks joined by an empty line, empty if there are none."""
    trees = [parse(p) for p in pages]
    texts = [{id(n): n.own_text() for n in t.walk() if n.is_block()} for t in trees]
    sizes = [sum(1 for _ in t.walk()) for t in trees]
    middle = sorted(range(len(trees)), key=lambda i: (sizes[i], pages[i]))[len(trees) // 2]
    wrapper, own = trees[middle], texts[middle]
    seen: dict[int, int] = {}
    same: dict[int, int] = {}
    aligned = []
    distinct = {tuple(filter(None, own.values()))}     # copies have one vote together, the wrapper's have none
    for t, has in zip(trees, texts, strict=True):
        pairs = [(id(a), b, has[id(b)]) for a, b in tree_match(wrapper, t) if a.is_block()] \
            if t is not wrapper else []
        aligned.append(pairs)
        whole = tuple(filter(None, has.values()))
        if whole not in distinct:
            distinct.add(whole)
            for a, _, x in pairs:
                seen[a] = seen.get(a, 0) + 1
                same[a] = same.get(a, 0) + (x == own[a] != "")
    votes = max(LEAST, min(VOTES, len(distinct) - 1))
    fixed = {a for a, n in seen.items() if n >= votes and same[a] >= ALIKE * n}
    for article in (n for n in wrapper.walk() if n.tag == "article"):
        inside = {id(n): len(own[id(n)]) for n in article.walk() if n.is_block()}
        if sum(inside[a] for a in fixed & inside.keys()) > COPY * sum(inside.values()):
            fixed -= inside.keys()
    templates, totals, varying = [], [], []
    for t, has, pairs in zip(trees, texts, aligned, strict=True):
        templates.append(fixed if t is wrapper else {id(b) for a, b, x in pairs if a in fixed and x == own[a]})
        varying.append({n: len(x) for n, x in has.items() if n not in templates[-1]})
        totals.append(masses(t, varying[-1]))
    sure = len(distinct) > LEAST
    names = side_names(trees, totals) if sure else NAMES
    out = []
    for t, has, template, total, mass in zip(trees, texts, templates, totals, varying, strict=True):
        side = beside(t, total, names, sure)
        if sure and (shown := _shown(t, mass, side))[id(t)]:
            parts = by_slots(t, shown, mass, side)
        else:
            shown = _shown(t, {n: len(x) for n, x in has.items()}, side)
            parts = _marked(t, shown) or [_heaviest(t, _shown(t, mass, side))]
        out.append("\n\n".join(x for n in parts for x in blocks(n, template, side)))
    return out


def page_texts(pages: DataFrame, pages_per_block: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    The host is what stands between ``://`` and the next ``/``, ``?`` or ``#``
    of the url, lower-cased; pages without one form a host of their own.  Null
    or empty html has an empty text.  Null page_id and repeated rows are kept.
    Other columns are ignored.  Empty table: no rows.
    """
    def run(block: pa.Table) -> pa.Table:
        html = [h or "" for h in block["html"].to_pylist()]
        text = main_texts(html)
        return pa.table({"page_id": block["page_id"], "url": block["url"], "text": pa.array(text, pa.string()),
                         "n_chars": pa.array([len(t) for t in text], pa.int64())})

    python_ready(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"://([^/?#]+)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("_host"))
    sizes = rows.groupBy("_host").agg(F.count("*").alias("_pages"))
    rows = lookup(rows, sizes, ["_host"], F.col("_pages"), rows.count())
    spread = F.pmod(F.xxhash64("page_id", "url"), F.ceil(F.col("_pages") / pages_per_block))
    return (rows.withColumn("_block", spread).groupBy("_host", "_block")
            .applyInArrow(run, "page_id long, url string, text string, n_chars long"))
