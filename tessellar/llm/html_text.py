"""Main text of pages by wrapper induction.

Pages of one host and frame (the set of its structural tags, in order) share a wrapper, induced from all of them. Their trees,
texts as hashes, are dealt by the hash of the html to parts of some 64 pages; a part aligns its pages one after the other by simple tree
matching, and parts are aligned in the same way, sixteen at a time, until one is left. The order is that of the hashes, so the
result doesn't depend on how pages lie in files or tasks. The wrapper holds every node with the number of its pages and the
text that may be in most of them (a majority vote, which parts add up). A node that fewer than 1/32 of a part's pages
have is left out of it: what nine tenths of the pages have can't get lost in that way, not in all rounds of parts together.
Where a node of the content may have one text in nine tenths of the pages, or the content isn't known, all pages are aligned with the
wrapper once more and counted (partial counts in tasks, then one row a node).

The content of a wrapper is its articles, else its main elements, else the lowest node that holds at least 0.7 of the
characters in varying slots. Every page is aligned with the way to these nodes; its text is what stands there, but template
nodes and outer elements (menus, footers, sidebars, notices, adverts, forms, comments by element, role or class).
A node of the content is template if 0.9 of the pages have it with one text while their contents take eight different values
at least: a passage that pages happen to share, or copies of a page, are no template.

A null html is empty; a null url or one without ``://`` has the empty host. Rows that repeat are judged alike. Pages without
a wrapper's content (odd or cut ones) take their own articles, main elements or heaviest node. An empty text is ``''``.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.llm import dom
from tessellar.llm.common import ascii_lower, by_bytes, cut, small_batches

#: Pages of a part and parts folded into one; share of its pages that a node of a part is in at least.
PART = 64
FAN = 16
RARE = 1 / 32
CONTENT_SHARE = 0.7
TEMPLATE_SHARE = 0.9
TEMPLATE_CONTENTS = 8
BROADCAST_BYTES = 8 << 20
HELD = 20_000
KEYS = ["_host", "_frame"]
STRUCTURE = r"<(nav|header|footer|main|article|aside|section|form|table|body)[\s/>]"


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "^.*?://([^/?#]*)", 1), F.lit("")))


def keyed(pages: DataFrame, url: str, html: str) -> DataFrame:
    """The pages with their host, frame and the hash of their html."""
    frame = F.xxhash64(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{html}`"), F.lit(""))), F.lit(STRUCTURE), F.lit(1))))
    return pages.withColumn("_host", host_of(F.col(f"`{url}`"))).withColumn("_frame", frame).withColumn("_hash", F.xxhash64(F.coalesce(F.col(f"`{html}`"), F.lit(""))))


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def told(node: dom.Node) -> dom.Node:
    """The tree with hashes for texts, and each node of the page beside its own."""
    return [node[0], node[1], f"{hash_of(node[2]):x}" if node[2] else "", node[3], [told(c) for c in node[4]], node]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_host, _frame, _hash, _tree, _n): the trees of the pages of a task, copies that lie near each other once."""
    kinds: dict = {}

    def lean(node: dom.Node) -> list:
        return [node[0], node[1], f"{hash_of(node[2]):x}" if node[2] else "", 0, [lean(c) for c in node[4]]]

    for batch in by_bytes(batches, "html", 1 << 20, 256):
        copies = Counter(zip(*(batch.column(c).to_pylist() for c in (*KEYS, "_hash", "html")), strict=True))
        keys = list(zip(*copies, strict=True))
        trees = [json.dumps(lean(dom.parse(page, kinds)), separators=(",", ":")) for page in keys[3]]
        yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.int64()), pa.array(trees, pa.string()), pa.array(list(copies.values()), pa.int64())], names=[*KEYS, "_hash", "_tree", "_n"])


def _voted(node: list, n: int, votes: int, text: str) -> None:
    """Adds the pages of another node to a wrapper's: of different texts as many votes go on both sides."""
    node[5] += n
    if text == node[7]:
        node[6] += votes
    elif votes > node[6]:
        node[6], node[7] = votes - node[6], text
    else:
        node[6] -= votes
    node[2] = node[7] if 2 * node[6] >= node[5] else dom.VARIES


def merge(wrapper: list | None, tree: list, n: int = 1) -> list:
    """The wrapper with another tree in it, of n equal pages or of a part. Its nodes are [label, kind, text or dom.VARIES, 0, children, pages, votes, text voted for]."""

    def grown(node: list) -> list:
        return node if len(node) > 5 else [*node[:4], [grown(c) for c in node[4]], n, n, node[2]]

    if wrapper is None:
        return grown(tree)
    pairs = dom.match(tree, wrapper)[1]
    of = {id(a): b for a, b in pairs}
    for a, b in pairs:
        _voted(b, *(a[5:8] if len(a) > 5 else (n, n, a[2])))
        b[1] |= a[1] & (dom.MAIN | dom.ARTICLE)
        children, at = [], 0
        for c in a[4]:
            if id(c) in of:
                place = next(k for k in range(at, len(b[4])) if b[4][k] is of[id(c)]) + 1
                children += b[4][at:place]
                at = place
            else:
                children.append(grown(c))
        b[4] = children + b[4][at:]
    return wrapper


def _common(node: list, least: float) -> list:
    node[4] = [_common(c, least) for c in node[4] if c[5] >= least]
    return node


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_host, _frame, _part, _tree, _n) of rows that lie together and in order by these keys: one tree a part. _n is 0 for rows that are parts themselves."""
    key, wrapper, raw, copies = None, None, None, 0

    def out() -> pa.RecordBatch:
        whole = merge(wrapper, json.loads(raw), copies)
        whole = _common(whole, RARE * whole[5])
        return pa.RecordBatch.from_pydict({"_host": [key[0]], "_frame": [key[1]], "_part": [key[2]], "_tree": [json.dumps(whole, separators=(",", ":"))], "_n": [0]})

    for batch in by_bytes(batches, "_tree", 1 << 20, 256):
        hosts, frames, parts, trees, ns = (batch.column(c) for c in (*KEYS, "_part", "_tree", "_n"))
        for k in range(batch.num_rows):
            at, tree, n = (hosts[k].as_py(), frames[k].as_py(), parts[k].as_py()), trees[k].as_py(), ns[k].as_py()
            if at == key and tree == raw and n:
                copies += n
                continue
            if at == key:
                wrapper = merge(wrapper, json.loads(raw), copies)
            else:
                if key is not None:
                    yield out()
                key, wrapper = at, None
            raw, copies = tree, n
    if key is not None:
        yield out()


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            wrapper, open_ = settle(json.loads(batch.column("_tree")[k].as_py()))
            yield pa.RecordBatch.from_pydict({"_host": [batch.column("_host")[k].as_py()], "_frame": [batch.column("_frame")[k].as_py()], "_wrapper": [json.dumps(wrapper)], "_open": [open_]})


def settle(whole: list) -> tuple[list, bool]:
    """The nodes as [label, kind, text or dom.VARIES, 0, children, may be template, id], and whether pages have to be counted for it."""
    number = 0

    def numbered(x: list) -> list:
        nonlocal number
        me, number = number, number + 1
        return [x[0], x[1], x[2], 0, [numbered(c) for c in x[4]], may(x), me]

    def may(x: list) -> bool:
        return x[5] > 1 and bool(x[2]) and x[2] != dom.VARIES

    def common(x: list) -> bool:  # parts may have left out some of the pages of what nine tenths have, not as many as that
        return 2 * x[5] >= whole[5] and (may(x) or any(common(c) for c in x[4]))

    known = dom.articles(whole, dom.ARTICLE) or dom.articles(whole, dom.MAIN)
    return numbered(whole), not known or whole[5] >= TEMPLATE_CONTENTS and any(common(r) for r in known)


def wrappers(pages: DataFrame) -> DataFrame:
    """(_host, _frame, _wrapper, _open): one wrapper for each host and frame, of all its pages; open where the pages have to be counted."""
    sizes = cut(pages.groupBy(*KEYS).agg(F.ceil(F.count("*") / PART).alias("_parts")))
    keys, parts = sizes.agg(F.count("*"), F.max("_parts")).first()
    trees = pages.select(*KEYS, "_hash", "html").mapInArrow(_trees, "_host string, _frame long, _hash long, _tree string, _n long")
    dealt = trees.join(F.broadcast(sizes) if keys <= BROADCAST_BYTES // 64 else sizes, KEYS).withColumn("_part", F.expr("pmod(xxhash64(_hash, 7), _parts)"))
    part = "_host string, _frame long, _part long, _tree string, _n long"
    level = cut(dealt.repartition(*KEYS, "_part").sortWithinPartitions(*KEYS, "_part", "_hash", "_tree").select(*KEYS, "_part", "_tree", "_n").mapInArrow(_folded, part))
    while (parts or 1) > 1:
        parts = -(-parts // FAN)
        next_ = level.withColumn("_place", F.col("_part")).withColumn("_part", F.expr(f"_part div {FAN}"))
        level = cut(next_.repartition(*KEYS, "_part").sortWithinPartitions(*KEYS, "_part", "_place").select(*KEYS, "_part", "_tree", "_n").mapInArrow(_folded, part))
    return level.mapInArrow(_settled, "_host string, _frame long, _wrapper string, _open boolean")


def _known(texts: dict, host: str, frame: int, raw: pa.Scalar, read) -> object:
    """What ``read`` makes of the wrapper of a host and frame, kept for the task's next pages (at most 256 of them)."""
    key = host, frame
    if key not in texts:
        if len(texts) >= 256:
            texts.clear()
        texts[key] = read(raw.as_py())
    return texts[key]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_host, _frame, _node, _content, _n, _equal, _mass) of the pages of a task, summed before they leave it.

    Rows without a node tell of contents by their hashes: the eight least of a task, which is enough to know whether there are eight.
    """
    sums: dict[tuple, list[int]] = {}
    contents: dict[tuple, set[int]] = {}
    known: dict = {}
    kinds: dict = {}
    for batch in by_bytes(batches, "html", 1 << 20, 256):
        for k in range(batch.num_rows):
            key = batch.column("_host")[k].as_py(), batch.column("_frame")[k].as_py()
            wrapper = _known(known, *key, batch.column("_wrapper")[k], json.loads)
            tree = dom.parse(batch.column("html")[k].as_py(), kinds)
            pairs = dom.match(told(tree), wrapper)[1]
            met = {id(a) for a, _ in pairs}
            regions = dom.articles(tree, dom.ARTICLE) or dom.articles(tree, dom.MAIN) or [tree]
            least = contents.setdefault(key, set())
            least.add(hash_of(" ".join(t for r in regions for t in dom.content_texts(r))) - (1 << 63))
            if len(least) > TEMPLATE_CONTENTS:
                least.remove(max(least))
            for a, b in pairs:
                held = sums.setdefault((*key, b[6], None), [0, 0, 0])
                held[0] += 1
                held[1] += bool(b[5]) and a[2] == b[2]
                held[2] += dom.mass(a[5]) + sum(dom.whole_mass(c[5]) for c in a[4] if id(c) not in met)  # what the wrapper has no place for
        if len(sums) + len(contents) > HELD:
            yield _summed(sums, contents)
            sums.clear()
            contents.clear()
    if sums:
        yield _summed(sums, contents)


def _summed(sums: dict, contents: dict) -> pa.RecordBatch:
    rows = sums | {(*key, None, h): [0, 0, 0] for key, hashes in contents.items() for h in hashes}
    keys = list(zip(*rows, strict=True))
    values = list(zip(*rows.values(), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), *[pa.array(x, pa.int64()) for x in (*keys[1:], *values)]], names=["_host", "_frame", "_node", "_content", "_n", "_equal", "_mass"])


def decide(wrapper: list, counts: dict[int, tuple[int, int, int]], contents: int) -> list:
    """From the counts of nodes (pages, with the wrapper's text, characters) and the number of different contents the way to the content: nodes [label, kind, text, 0, children, mark], mark 'c' for content and 't' for template; only what leads to one of these."""
    pages = counts.get(0, (0, 0, 0))[0]
    template = {n for n, (seen, equal, _) in counts.items() if equal >= TEMPLATE_SHARE * max(seen, 2)}
    content = dom.articles(wrapper, dom.ARTICLE) or dom.articles(wrapper, dom.MAIN)
    if not content and counts:
        weight: dict[int, float] = {}

        def weigh(x: list) -> float:
            own = 0 if x[6] in template else counts.get(x[6], (0, 0, 0))[2]
            weight[x[6]] = 0 if x[1] & (dom.OUTER | dom.UNSEEN | dom.HEADER) else own + sum(weigh(c) for c in x[4])
            return weight[x[6]]

        whole, node = weigh(wrapper), wrapper
        while whole:
            below = [c for c in node[4] if weight.get(c[6], 0) >= CONTENT_SHARE * whole]
            if not below or below[0][0] in ("#", "p"):
                break
            node = below[0]
        content = [node] if whole else []
    regions = {c[6] for c in content}
    certain = {n for n in template if counts[n][0] >= TEMPLATE_SHARE * pages} if contents >= TEMPLATE_CONTENTS else set()

    def way(x: list, inside: bool) -> list | None:
        inside = inside or x[6] in regions
        below = [y for c in x[4] if (y := way(c, inside))]
        drop = inside and x[6] in certain
        if below or x[6] in regions or drop:
            # siblings of the way stay as leaves, so that the matching sees where they are
            mine = {y[6] for y in below}
            children = [next(y for y in below if y[6] == c[6]) if c[6] in mine else [c[0], c[1], c[2], 0, [], "", c[6]] for c in x[4]] if below else []
            return [x[0], x[1], x[2], 0, children, "c" if x[6] in regions else "t" if drop else "", x[6]]
        return None

    return way(wrapper, False) or []


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            counts = {c["_node"]: (c["_n"], c["_equal"], c["_mass"]) for c in batch.column("_counts")[k].as_py() or ()}
            way = decide(json.loads(batch.column("_wrapper")[k].as_py()), counts, batch.column("_contents")[k].as_py() or 0)
            yield pa.RecordBatch.from_pydict({"_host": [batch.column("_host")[k].as_py()], "_frame": [batch.column("_frame")[k].as_py()], "_way": [json.dumps(way)]})


def page_text(page: str | None, way: list, kinds: dict | None = None) -> str:
    """Main text of one page, found by the way of its wrapper ([]: by the page alone)."""
    tree = dom.parse(page, kinds)
    regions: list[dom.Node] = []
    dropped: set[int] = set()
    if way:
        for a, b in dom.match(told(tree), way)[1]:
            if b[5] == "c":
                regions.append(a[5])
            elif b[5] == "t" and a[2] == b[2]:
                dropped.add(id(a[5]))
    own = dom.articles(tree, dom.ARTICLE) or (not regions and dom.articles(tree, dom.MAIN)) or []
    regions += [r for r in own if not any(r is x for x in regions)]  # articles that the wrapper has no place for
    if not regions:
        regions = [dom.heaviest(tree, CONTENT_SHARE)]
    if len(regions) > 1:  # in page order, none within another
        chosen = {id(r) for r in regions}
        regions = _outermost(tree, chosen)
    return " ".join(t for r in regions for t in dom.content_texts(r, dropped))


def _outermost(node: dom.Node, chosen: set[int]) -> list[dom.Node]:
    return [node] if id(node) in chosen else [x for c in node[4] for x in _outermost(c, chosen)]


def _texts(carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        kinds: dict = {}
        for batch in by_bytes(batches, "html", 1 << 20, 256):
            hosts, frames, htmls, ways = (batch.column(c) for c in ("_host", "_frame", "html", "_way"))
            texts = []
            for k in range(batch.num_rows):
                way = _known(known, hosts[k].as_py(), frames[k].as_py(), ways[k], lambda raw: json.loads(raw) if raw else [])
                texts.append(page_text(htmls[k].as_py(), way, kinds))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(texts, pa.string())], names=[*carry, "text"])

    return run


def _bounded(df: DataFrame, column: str) -> DataFrame:
    """The frame broadcast if its texts are at most BROADCAST_BYTES; else it is joined by a shuffle."""
    size = df.agg(F.sum(F.length(column) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (by default all but html, and but columns named like the results), ``text``, the main text of each page, and n_chars, its code points."""
    spark = pages.sparkSession
    small_batches(spark)
    carry = [c for c in pages.columns if c not in (html, "text", "n_chars")] if carry is None else carry
    inner = [f"_c{k}" for k in range(len(carry))]
    plain = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, inner, strict=True)], F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    rows = keyed(plain, "url", "html")
    found = cut(wrappers(rows))
    open_ = found.where("_open").select(*KEYS, "_wrapper")
    if open_.isEmpty():
        counted = found.withColumn("_counts", F.lit(None).cast("array<struct<_node:bigint,_n:bigint,_equal:bigint,_mass:bigint>>")).withColumn("_contents", F.lit(None).cast("long"))
    else:
        sums = rows.select(*KEYS, "html").join(_bounded(open_, "_wrapper"), KEYS).mapInArrow(_counts, "_host string, _frame long, _node long, _content long, _n long, _equal long, _mass long")
        sums = sums.groupBy(*KEYS, "_node", "_content").agg(F.sum("_n").alias("_n"), F.sum("_equal").alias("_equal"), F.sum("_mass").alias("_mass"))
        one = F.when(F.col("_node").isNotNull(), F.struct("_node", "_n", "_equal", "_mass"))
        sums = sums.groupBy(*KEYS).agg(F.collect_list(one).alias("_counts"), F.count("_content").alias("_contents"))  # as many as a wrapper has nodes
        counted = found.join(sums, KEYS, "left")
    ways = cut(counted.select(*KEYS, "_wrapper", "_counts", "_contents").mapInArrow(_decided, "_host string, _frame long, _way string"))
    schema = ", ".join(f"`{n}` {k}" for n, k in plain.select(*inner).dtypes)
    out = rows.select(*inner, *KEYS, "html").join(_bounded(ways, "_way"), KEYS, "left").mapInArrow(_texts(inner), f"{schema + ', ' if schema else ''}text string")
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, inner, strict=True)], "text", F.length("text").cast("long").alias("n_chars"))
