"""Small helpers of the extraction operator: a block tree of a page, and simple tree matching of two of them.

A node is a block element; inline elements are text. Texts of a block without child blocks stand at the block, others are
leaves named ``#``. Optional end tags are closed as browsers do; texts of blocks deeper than 200 are leaves of the block at that depth.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np

DEPTH = 200
#: Cells of a matching's table that are kept whole, those of a table in plain lists, so many of which are kept, and rows of scores that wait for nodes alike.
CELLS = 1 << 22
SMALL = 1024
HELD = 5_000
ALIKE = 64
#: Stands for the text of a wrapper's node where pages differ: no page has it, and it equals nothing.
VARIES = "\0"
#: Elements that make blocks, that hold no text of the page, and that end an open element of their kind.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("head script style noscript template textarea select button svg iframe object canvas audio video math".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
OUTER_TAGS = frozenset("nav footer aside menu search dialog".split())
OUTER_ROLES = frozenset("navigation contentinfo complementary search dialog alert".split())
OUTER_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget widgets ad ads advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments disqus discussion replies respond reactions pager pagination login toolbar copyright".split())
HEAD_WORDS = frozenset("header masthead".split())
COMMENT_WORDS = frozenset("comment comments disqus discussion replies respond reactions".split())

_TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}

Node = list  # [label, kind, text, link characters, children]; kind has the bits below
OUTER, MAIN, ARTICLE, UNSEEN, HEADER, COMMENTS = 1, 2, 4, 8, 16, 32


def _kind(tag: str, attributes: str) -> tuple[str, int]:
    """Label (element and the words of its class) and kind of an element."""
    found = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    words = [w.lower() for c in found.get("class", "").split() for w in _CAMEL.split(c) if w]
    tokens = [*found.get("class", "").split(), found.get("id", "")]
    names = {*words, *(w.lower() for w in _CAMEL.split(tokens[-1])), *(_CAMEL.sub("", t).lower() for t in tokens)}  # side-bar and sideBar are sidebar too
    role = found.get("role", "").lower()
    kind = OUTER if tag in OUTER_TAGS or role in OUTER_ROLES or (tag not in ("body", "html", "main") and names & OUTER_WORDS) else 0
    kind |= HEADER if tag == "header" or role == "banner" or (tag not in ("body", "html") and names & HEAD_WORDS) else 0
    kind |= COMMENTS if tag not in ("body", "html", "main") and names & COMMENT_WORDS else 0
    kind |= MAIN if tag == "main" or role == "main" else 0
    kind |= ARTICLE if (tag == "article" or role == "article" or found.get("itemprop", "").lower() == "articlebody") else 0
    kind |= UNSEEN if "hidden" in found or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I) else 0
    return f"{tag}.{'.'.join(sorted(set(words)))}" if words else tag, kind


def parse(page: str | None, kinds: dict[tuple[str, str], tuple[str, int]] | None = None) -> Node:
    """The block tree of a page; a null or empty page is a root alone. ``kinds`` keeps labels between calls (at most 4,096)."""
    kinds = {} if kinds is None else kinds
    root: Node = ["root", 0, "", 0, []]
    stack: list[tuple[str, Node]] = [("root", root)]
    buffer: list[str] = []
    hidden: list[str] = []
    linked, in_link, at, page = 0, False, 0, page or ""

    def flush(closing: bool) -> None:
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                node = stack[min(len(stack), DEPTH) - 1][1]
                if closing and len(stack) <= DEPTH and not node[4] and not node[2]:
                    node[2], node[3] = text, linked
                else:
                    node[4].append(["#", 0, text, linked, []])
            buffer.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        buffer.append(text)
        if in_link:
            linked += len(text)

    def close(depth: int) -> None:
        while len(stack) > depth:
            flush(True)
            stack.pop()

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            if not hidden:
                add(page[at:])
            break
        if m.start() > at and not hidden:
            add(page[at : m.start()])
        at, tag = m.end(), m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in hidden:
                del hidden[len(hidden) - 1 - hidden[::-1].index(tag) :]
            elif hidden:
                pass
            elif tag == "a":
                in_link = False
            elif tag in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                else:
                    flush(False)
            continue
        if tag in ("body", "main", "article") or (tag in BLOCKS and hidden == ["head"]):  # an end tag is missing
            hidden.clear()
        if tag in RAW:
            end = _ENDS[tag].search(page, at)
            stop = end.start() if end else len(page)
            if tag not in HIDDEN and not hidden and tag != "title":
                add(page[at:stop])
            close_at = page.find(">", stop)
            at = len(page) if not end or close_at < 0 else close_at + 1
        elif tag in HIDDEN:
            if not m[3].rstrip().endswith("/"):
                hidden.append(tag)
        elif hidden:
            pass
        elif tag == "a":
            in_link = True
        elif tag == "br":
            add(" ")
        elif tag in BLOCKS:
            in_link = False
            ends, scope = CLOSES.get(tag, ()), SCOPES.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):  # an open paragraph ends where a block starts, an item where the next does
                if stack[k][0] == "p" or stack[k][0] in ends:
                    close(k)
                elif stack[k][0] in scope or not ends:
                    break
            flush(False)
            key = tag, m[3]
            if key not in kinds:
                if len(kinds) >= 4096:
                    kinds.clear()
                kinds[key] = _kind(tag, m[3])
            node: Node = [*kinds[key], "", 0, []]
            if len(stack) < DEPTH:
                stack[-1][1][4].append(node)
            if tag != "hr":
                stack.append((tag, node))
    close(1)
    flush(False)
    if _settle(root) and not articles(root, ARTICLE | MAIN):  # an end tag is missing, or the page stands in an outer element
        _settle(root, True)
    return root


def _settle(node: Node, clear: bool = False) -> bool:
    """Forms without article or title become outer; with ``clear``, outer elements (but comments) that hold an article are none. Whether there is one below."""
    below = [_settle(c, clear) for c in node[4]]
    if clear and any(below) and not node[1] & COMMENTS:
        node[1] &= ~(OUTER | HEADER)
    elif node[0].partition(".")[0] == "form" and not any(below) and not any(c[0] == "h1" for c in node[4]):
        node[1] |= OUTER
    return not node[1] & COMMENTS and (any(below) or bool(node[1] & (MAIN | ARTICLE) and not node[1] & OUTER))


def content_texts(node: Node, dropped: set[int] = frozenset(), inside: bool = False) -> list[str]:
    """Texts of the blocks in page order, without outer, unseen and dropped nodes (by identity); the header of an article holds its title and stays."""
    if node[1] & UNSEEN or id(node) in dropped:
        return []
    inside = inside or bool(node[1] & (ARTICLE | MAIN))
    own = [node[2]] if node[2] else []
    for c in node[4]:
        if not c[1] & OUTER and (inside or not c[1] & HEADER):
            own += content_texts(c, dropped, inside)
    return own


def articles(node: Node, bit: int) -> list[Node]:
    """Outermost nodes of the kind that aren't within outer or unseen ones."""
    if node[1] & (OUTER | UNSEEN | HEADER):
        return []
    return [node] if node[1] & bit else [x for c in node[4] for x in articles(c, bit)]


def mass(node: Node) -> int:
    """Characters of a node's own text where links aren't most of it."""
    return len(node[2]) if 2 * node[3] <= len(node[2]) else 0


def whole_mass(node: Node) -> int:
    """Characters outside links in a node and what is below it, but not in outer ones."""
    return 0 if node[1] & (OUTER | UNSEEN | HEADER) else mass(node) + sum(whole_mass(c) for c in node[4])


def heaviest(node: Node, share: float) -> Node:
    """The lowest node that holds at least the share of all characters outside links and outer nodes."""
    memo: dict[int, int] = {}

    def weigh(x: Node) -> int:
        memo[id(x)] = 0 if x[1] & (OUTER | UNSEEN | HEADER) else mass(x) + sum(weigh(c) for c in x[4])
        return memo[id(x)]

    whole = weigh(node)
    while whole:
        below = [c for c in node[4] if memo[id(c)] >= share * whole]
        if not below or below[0][0] in ("#", "p"):
            break
        node = below[0]
    return node


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the greatest number of pairs of equal labels that keeps order and parents; equal texts count twice.

    Rows of children are compared as arrays; of the leaves of ``a`` that are alike no more stay than ``b`` has children.
    Subtrees that differ only in texts of one side score alike and are compared once.
    """
    if a[0] != b[0]:
        return 0, []
    return _Matching(a, b).result()


class _Matching:
    """The state of one matching: numbers of subtrees that are alike, and the scores of their pairs."""

    def __init__(self, a: Node, b: Node) -> None:
        self.a, self.b = a, b
        self.said = _said(a, set()) & _said(b, set())
        self.known: dict[tuple, int] = {}
        self.number: dict[int, int] = {}
        self.scores: dict[tuple[int, int], int] = {}
        self.small: dict[tuple[int, int], list[list[int]]] = {}
        self._count(a)
        self._count(b)

    def result(self) -> tuple[int, list[tuple[Node, Node]]]:
        pairs: list[tuple[Node, Node]] = []
        score = self._score(self.a, self.b)
        self._pair(self.a, self.b, pairs)
        return score, pairs

    def _count(self, node: Node) -> int:
        key = node[0], node[2] if node[2] in self.said else "", tuple([self._count(c) for c in node[4]])
        self.number[id(node)] = self.known.setdefault(key, len(self.known))
        return self.number[id(node)]

    def _score(self, a: Node, b: Node) -> int:
        if a[0] != b[0]:
            return 0
        own = 1 + (a[2] == b[2] and a[2] in self.said)
        if not a[4] or not b[4]:
            return own
        key = self.number[id(a)], self.number[id(b)]
        if len(a[4]) * len(b[4]) <= SMALL:
            return own + self._table(key, a[4], b[4])[-1][-1]
        if key not in self.scores:
            row = np.zeros(len(b[4]) + 1, np.int32)
            for w in self._weights(_folded(a[4], b[4]), b[4]):
                row = _next(row, w)
            self.scores[key] = own + int(row[-1])
        return self.scores[key]

    def _table(self, key: tuple[int, int], left: list[Node], right: list[Node]) -> list[list[int]]:
        """The whole table of few children, kept for all nodes alike."""
        rows = self.small.get(key)
        if rows is None:
            above = [0] * (len(right) + 1)
            rows = [above]
            for c in left:
                label, text, inner, best, row = c[0], c[2], c[4], 0, [0]
                if text not in self.said:
                    text = VARIES
                for j, d in enumerate(right):
                    if above[j + 1] > best:
                        best = above[j + 1]
                    if d[0] == label:
                        score = above[j] + (self._score(c, d) if inner and d[4] else 2 if text == d[2] != VARIES else 1)
                        if score > best:
                            best = score
                    row.append(best)
                rows.append(row)
                above = row
            if len(self.small) >= HELD:
                self.small.clear()
            self.small[key] = rows
        return rows

    def _weights(self, left: list[Node], right: list[Node]) -> Iterator[np.ndarray]:
        """For each node on the left its scores with those on the right."""
        names = {c[0]: k for k, c in enumerate(right)}
        labels = np.fromiter((names[c[0]] for c in right), np.int32, len(right))
        said: dict[str, list[int]] = {}
        for j, c in enumerate(right):
            if c[2] in self.said:
                said.setdefault(c[2], []).append(j)
        inner = [j for j, c in enumerate(right) if c[4]]
        rows: dict[int, np.ndarray] = {}
        for c in left:
            w = rows.get(self.number[id(c)])
            if w is None:
                w = (labels == names.get(c[0], -1)).astype(np.int32)
                if c[2] in said:
                    w[said[c[2]]] *= 2
                if c[4]:
                    for j in inner:
                        if w[j]:
                            w[j] = self._score(c, right[j])
                if len(rows) >= ALIKE:
                    rows.clear()
                rows[self.number[id(c)]] = w
            yield w

    def _pair(self, a: Node, b: Node, pairs: list[tuple[Node, Node]]) -> None:
        pairs.append((a, b))
        if not a[4] or not b[4]:
            return
        if len(a[4]) * len(b[4]) <= SMALL:
            left, right, step = a[4], b[4], 1
            marks = self._table((self.number[id(a)], self.number[id(b)]), left, right)
        else:
            left, right = _folded(a[4], b[4]), b[4]
            marks, step = self._marks(left, right)
        i, j, chosen = len(left), len(right), []
        start, table = (0, marks) if step == 1 else (i, [])
        while i and j:
            if i <= start:
                start = (i - 1) // step * step
                table = [marks[start // step]]
                for w in self._weights(left[start:i], right):
                    table.append(_next(table[-1], w))
            here, above = table[i - start], table[i - start - 1]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                chosen.append((left[i], right[j]))
        for x, y in chosen:
            self._pair(x, y, pairs)

    def _marks(self, left: list[Node], right: list[Node]) -> tuple[list[np.ndarray], int]:
        """Rows of the table, of a large one every so many; those between are made again where the way back comes by."""
        step = 1 if len(left) * len(right) <= CELLS else math.isqrt(len(left)) + 1
        marks = [np.zeros(len(right) + 1, np.int32)]
        row = marks[0]
        for i, w in enumerate(self._weights(left, right)):
            row = _next(row, w)
            if (i + 1) % step == 0:
                marks.append(row)
        return marks, step


def _next(row: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row), np.int32)
    np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w), out=out[1:])
    return out


def _said(node: Node, found: set[str]) -> set[str]:
    if node[2] and node[2] != VARIES:
        found.add(node[2])
    for c in node[4]:
        _said(c, found)
    return found


def _folded(children: list[Node], others: list[Node]) -> list[Node]:
    """Of a run of leaves of one label, the first so many as the other side has children, and all whose text the other side has."""
    if len(children) <= 64:
        return children
    said, kept, run = {c[2] for c in others if c[2]}, [], 0
    for k, c in enumerate(children):
        run = run + 1 if k and c[0] == children[k - 1][0] and not c[4] else 1
        if run <= len(others) or c[4] or c[2] in said:
            kept.append(c)
    return kept
