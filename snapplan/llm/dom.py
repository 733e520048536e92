"""A small DOM of a web page and simple tree matching."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot "
    "thead title tr ul".split())
ENDS_P = BLOCK - {"body", "html", "li", "dd", "dt", "tbody", "tfoot", "thead", "title", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select body html article section div main td th blockquote".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "words", "names")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Node | str] = []
        names = " ".join((attrs.get(k) or "").lower() for k in ("class", "id", "role"))
        self.names = frozenset(names.split())
        self.words = frozenset(re.split(r"[\s_-]+", names))

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def walk(self):
        """This node and all elements below it, in page order (no recursion)."""
        rest = [self]
        while rest:
            n = rest.pop()
            yield n
            rest.extend(reversed(n.elements()))

    def own_text(self) -> str:
        """Text of the element and of inline elements in it, but of no block below."""
        out, rest = [], list(reversed(self.kids))
        while rest:
            k = rest.pop()
            if isinstance(k, str):
                out.append(k)
            elif k.tag not in BLOCK and k.tag not in HIDDEN:
                rest.extend(reversed(k.kids))
        return " ".join("".join(out).split())

    def is_block(self) -> bool:
        return self.tag in BLOCK or self.parent is None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#page", {}, None)

    def _close(self, tags: set[str] | frozenset[str], scope: frozenset[str]) -> None:
        n = self.at
        while n.parent is not None and n.tag not in scope:
            if n.tag in tags:
                self.at = n.parent
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, SCOPE - {"p"})
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], frozenset({"ul", "ol", "dl", "table", "select"}))
        if tag == "body":
            self._close({"head"}, frozenset())
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str) -> Node:
    """The tree of a page; unclosed and misplaced tags are forgiven."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def tree_match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of the largest order-keeping match of two trees whose roots match (simple tree matching).

    Children match only under matching parents and with equal tags and
    classes; the weight of a pair is the number of nodes matched below it.
    """
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def weigh(x: Node, y: Node) -> tuple[int, list]:
        """Weight and pairs of children of a pair whose children have been weighed."""
        p, q = x.elements(), y.elements()
        if not p or not q:
            return 1, []
        rows = [[0] * (len(q) + 1)]
        same = [[None] * len(q) for _ in p]
        for i, u in enumerate(p):
            above, row = rows[-1], [0] * (len(q) + 1)
            for j, v in enumerate(q):
                best = above[j + 1] if above[j + 1] >= row[j] else row[j]
                if u.tag == v.tag and u.words == v.words:
                    w = above[j] + memo[id(u), id(v)][0]
                    same[i][j] = w
                    if w > best:
                        best = w
                row[j + 1] = best
            rows.append(row)
        pairs, i, j = [], len(p), len(q)
        while i and j:
            if same[i - 1][j - 1] is not None and rows[i][j] == same[i - 1][j - 1] and \
                    rows[i][j] > rows[i - 1][j] and rows[i][j] > rows[i][j - 1]:
                i, j = i - 1, j - 1
                pairs.append((p[i], q[j]))
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((p[i], q[j]))
        return 1 + rows[-1][-1], pairs[::-1]

    todo: list[tuple[Node, Node, bool]] = [(a, b, False)]
    while todo:                                        # children first (no recursion)
        x, y, ready = todo.pop()
        if ready:
            memo[id(x), id(y)] = weigh(x, y)
            continue
        todo.append((x, y, True))
        q = y.elements()
        todo += [(u, v, False) for u in x.elements() for v in q if u.tag == v.tag and u.words == v.words]
    out, rest = [], [(a, b)]
    while rest:
        x, y = rest.pop()
        out.append((x, y))
        rest += memo[id(x), id(y)][1]
    return out
