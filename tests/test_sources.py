from pyspark.sql import functions as F

from tessellar.operators import graph
from tessellar.sources import markdown
from tessellar.sources.tables import cut

TEXT = """# One
text
## Two ##
```
# not a heading
- [ ] inside a fence
```
## Three
- [x] Done thing
- [ ] Same
- [~] same
# Last"""


def test_sections_end_before_the_next_as_deep(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(tuple(r) for r in markdown.sections(docs).collect())
    assert got == [(1, 1, 1, "One", 11), (1, 3, 2, "Two", 7), (1, 8, 2, "Three", 11), (1, 12, 1, "Last", 12)]


def test_todos_have_status_and_occurrence(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.line, r.status, r.title, r.occurrence) for r in markdown.todos(docs).collect())
    assert got == [(1, 9, "done", "Done thing", 1), (1, 10, "open", "Same", 1), (1, 11, "in-progress", "same", 2)]


def test_parents_and_long_titles(spark):
    text = "- [ ] a\n  - [ ] b\n      - [x] c\n  - [-] " + "t" * 300 + "\n  - [ ] " + "t" * 299 + "u\n- [/] a"
    rows = markdown.todos(spark.createDataFrame([("p.md", text)], "doc_id string, text string")).collect()
    by_line = {r.line: r for r in rows}
    assert [by_line[k].parent_key for k in range(1, 7)] == [None, by_line[1].source_key, by_line[2].source_key, by_line[1].source_key, by_line[1].source_key, None]
    assert by_line[4].title == "t" * 239 + "…" and by_line[4].occurrence == by_line[5].occurrence == 1 and by_line[6].source_key == by_line[1].source_key + "#2"
    assert [by_line[k].status for k in range(3, 7)] == ["done", "blocked", "open", "in-progress"]


def test_bytes_of_lines(spark):
    text = "é\r\nb\n\nñc"
    for r in markdown.lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect():
        assert text.encode()[r.start_byte : r.end_byte].decode() == r.text


def test_links_statements_and_paragraphs(spark):
    text = "See [a](b/c.md#x), ![no](i.png) and [[Note|n]] or `d.ts`.\nIt MUST work. It may\nrest.\n\n- An item SHOULD end here\n- Other. You MUST\n\n```\n[x](y)\n```"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert sorted(r.target for r in markdown.links(docs).collect()) == ["Note", "b/c.md#x"]
    assert [r.value for r in markdown.code_references(docs).collect()] == ["d.ts"]
    assert sorted((r.line, r.keyword, r.text) for r in markdown.statements(docs).collect()) == [(2, "MUST", "It MUST work."), (5, "SHOULD", "An item SHOULD end here"), (6, "MUST", "You MUST")]
    assert sorted((r.line, r.last_line) for r in markdown.paragraphs(docs).collect()) == [(1, 3), (5, 5), (6, 6)]


def test_tokens_of_sections(spark):
    docs = spark.createDataFrame([("a.md", "## ADR-7 — why\nG1 and OQ-3\n# ADR-7 again\n# ADR-8: no"), ("b.md", "# ADR-7 and more\nsee X-12, G1")], "doc_id string, text string")
    got = sorted((r.doc_id, r.token, r.line, r.home_rank) for r in markdown.declared_sections(docs).collect())
    assert got == [("a.md", "ADR-7", 1, 2), ("b.md", "ADR-7", 1, 101)]
    assert sorted((r.doc_id, r.token, r.line) for r in markdown.cited_tokens(docs, prefixes=["x"]).collect()) == [("a.md", "ADR-7", 1), ("a.md", "ADR-8", 4), ("a.md", "G1", 2), ("a.md", "OQ-3", 2), ("b.md", "ADR-7", 1), ("b.md", "G1", 2), ("b.md", "X-12", 2)]


def test_requirement_ids(spark):
    df = spark.createDataFrame([("see REQ-B2-X, REQ-A and REQ-A, notREQ-Z",)], "t string")
    assert df.select(markdown.requirement_ids(F.col("t"))).first()[0] == ["REQ-A", "REQ-B2-X"]


def test_pagerank_gives_loose_rank_to_the_seeds(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    edges = spark.createDataFrame([("a", "b", "x"), ("a", "b", "x"), ("b", "c", "x"), ("c", "c", "x"), ("a", "zz", "x")], "source string, target string, relation string")
    seeds = spark.createDataFrame([("d",), ("a",)], "id string")
    weights = {("a", "b"): 1.0, ("b", "a"): 2 / 3, ("b", "c"): 1 / 3, ("c", "b"): 1.0}
    start = {"a": 0.5, "b": 0, "c": 0, "d": 0.5}
    rank = dict(start)
    for _ in range(25):
        rank = {n: 0.25 * start[n] + 0.75 * (sum(rank[m] * w for (m, k), w in weights.items() if k == n) + rank["d"] * start[n]) for n in rank}
    got = {r["id"]: r["rank"] for r in graph.pagerank(nodes, edges, seeds).collect()}
    assert all(abs(got[n] - rank[n] / max(rank.values())) < 1e-9 for n in rank)


def test_cut_keeps_rows(spark):
    assert cut(spark.range(5)).count() == 5
