"""Blocks of Markdown: fences, containers, HTML, front matter and headings of both forms, against a text told by hand."""

from tessellar.sources import markdown

TEXT = """---
title: front
- [ ] no task
---
Heading one
===========
Text of it
with `a.ts` and more

Two words
---
- [ ] a task
  ```js
  - [ ] in a fence
  ~~~
  ```
- item
> quote
> ```
> - [ ] quoted fence
> ```
> The quote MUST end.

~~~~md
```
# no heading
~~~
~~~~
<div>
- [ ] in html [x](y)

- [x] after it
<!-- comment
# no heading

- [ ] none
-->
***
    ## too deep
 ### Three ###
<pre>
- [ ] raw

# raw
</pre>
``` not `a fence`
- [ ] last"""
KINDS = "front front front front setext under text text blank setext under text fence fence fence fence text text fence fence fence text blank fence fence fence fence fence html html blank text html html html html html rule text heading html html html html html text text".split()


def test_every_line_has_its_kind(spark):
    docs = spark.createDataFrame([("d", TEXT), ("n", None), ("e", "")], "doc_id string, text string")
    rows = sorted((r for r in markdown.marked(docs).collect() if r["doc_id"] == "d"), key=lambda r: r["line"])
    assert [(r["line"], r["kind"]) for r in rows] == list(enumerate(KINDS, 1))
    assert all(TEXT.encode()[r["start_byte"] : r["end_byte"]].decode() == r["text"] and r["last"] == len(KINDS) for r in rows)
    assert [r["kind"] for r in markdown.marked(docs).where("doc_id = 'e'").collect()] == ["blank"]


def test_readers_see_what_is_text(spark):
    docs = spark.createDataFrame([("d", TEXT)], "doc_id string, text string")
    lines = markdown.marked(docs)
    for given in (docs, lines):  # texts, or the table of lines made once
        heads = sorted((r["line"], r["depth"], r["title"], r["last_line"]) for r in markdown.sections(given).collect())
        assert heads == [(5, 1, "Heading one", 47), (10, 2, "Two words", 47), (40, 3, "Three", 47)]
        assert sorted((r["line"], r["status"]) for r in markdown.todos(given).collect()) == [(12, "open"), (32, "done"), (47, "open")]
        assert markdown.links(given).count() == 0
        assert [(r["line"], r["value"]) for r in markdown.code_references(given).orderBy("line").collect()] == [(8, "a.ts"), (46, "a fence")]
        assert [(r["line"], r["keyword"]) for r in markdown.statements(given).collect()] == [(22, "MUST")]
    texts = markdown.section_texts(docs, ["two words"]).collect()
    assert texts[0]["line"] == 10 and texts[0]["text"].startswith("- [ ] a task") and "---" not in texts[0]["text"].split("\n")


def test_odd_ends(spark):
    texts = [("a", "```\n- [ ] never closed\n# no"), ("b", "---\nno end\n# One"), ("c", "a\r\n===\r\n- [ ] t\r\n"), ("d", "===\n---"), ("e", "text\n\n---\n"), ("f", "x\n" * 30_000)]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    heads = {(r["doc_id"], r["line"], r["title"]) for r in markdown.sections(docs).collect()}
    assert heads == {("b", 3, "One"), ("c", 1, "a"), ("d", 1, "===")}
    assert {(r["doc_id"], r["line"], r["title"]) for r in markdown.todos(docs).collect()} == {("c", 3, "t")}
    assert markdown.lines(docs).where("doc_id = 'f'").count() == 30_001
