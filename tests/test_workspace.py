"""Views of a workspace on small inputs."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.operators import resolve, retrieval, workspace
from tessellar.plans import graphs


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_pages_of_edges_walk_without_gap(spark):
    edges = spark.createDataFrame([(f"e{i:03}", "a", "b", "x") for i in range(251)], "id string, source string, target string, relation string")
    seen, after = [], None
    while True:
        page, more = workspace.edge_page(edges, 3, 3, after, rows=100)
        seen += [r.id for r in page.orderBy("id").collect()]
        if not more:
            break
        after = seen[-1]
    assert seen == [f"e{i:03}" for i in range(251)]
    few, more = workspace.edge_page(edges, 3, None, rows=100, size=1)  # held to a kilobyte
    assert 0 < few.count() < 30 and more
    assert workspace.edge_page(edges, 3, None, after="e250")[0].count() == 0 and not workspace.edge_page(edges, 3, None, after="e250")[1]
    with pytest.raises(ValueError, match="revision"):
        workspace.edge_page(edges, 3, 2)


def test_bounded_reads(spark):
    df = spark.range(10)
    rows, cut = workspace.bounded(df, ["id"], 4)
    assert [r.id for r in rows.collect()] == [0, 1, 2, 3] and cut and not workspace.bounded(df, ["id"], 10)[1]
    assert [r.id for r in workspace.keyset(df, "id", 6, 2).collect()] == [7, 8] and [r.id for r in workspace.positional(df, ["id"], 3, 2).collect()] == [3, 4]
    assert retrieval.coverage({"artifacts": (2000, 2000), "routes": (5, 5), "sections": (3, 300)}, ["artifacts", "sections"]) == ("partial", ["artifacts was read up to 2000 rows"])


def test_receipts(spark):
    statement = {"subject": [{"name": "é"}], "predicate": {"b": 1, "a": [2, {"z": None}]}}
    canonical = '{"predicate":{"a":[2,{"z":null}],"b":1},"subject":[{"name":"é"}]}'
    digest = hashlib.sha256(canonical.encode()).hexdigest()
    rows = spark.createDataFrame([("1", json.dumps(statement), digest), ("2", json.dumps(statement), "x"), ("3", "{}", digest), ("4", "no", digest), ("5", None, None)], "id string, statement string, digest string")
    assert {(r.id, r.state) for r in workspace.verified_receipts(rows).collect()} == {("1", "verified"), ("2", "tampered"), ("3", "invalid"), ("4", "invalid"), ("5", "invalid")}


def test_provenance_and_excerpts(spark):
    text = '{"span": {"path": "a.md", "startLine": 3, "endLine": 4}, "tier": "resolved", "method": "doc-link"}'
    got = one(spark, workspace.provenance(F.lit(text)))
    assert tuple(got) == ("a.md", 3, 4, "resolved", "doc-link")
    assert tuple(one(spark, workspace.provenance(F.lit('{"span": {"path": "a"}, "tier": "odd"}'))))[:4] == ("", 0, 0, "unknown") and tuple(one(spark, workspace.provenance(F.lit("no"))))[:4] == ("", 0, 0, "unknown")
    kinds = spark.createDataFrame([("artifact", "c" * 300), ("requirement", None), ("evidence", None), ("finding", None), ("route", None)], "kind string, content string")
    shown = [r[0] for r in kinds.select(workspace.excerpt(F.col("kind"), F.col("content"), F.lit("s"), F.lit("supports"), F.lit("t"), F.lit("f"))).collect()]
    assert shown == ["c" * 280, "s", "f: supports", "t", "f"]


def test_saved_queries_and_summaries(spark):
    rows = [(1, "artifact", "code", [], "missing"), (2, "artifact", "code", ["tests", "references"], "current"), (3, "requirement", "doc", ["implements"], None), (4, "requirement", None, None, None)]
    nodes = spark.createDataFrame([(i, t, "s", "p", "d", u, None, r, s) for i, t, u, r, s in rows], "id int, type string, status string, path string, domain string, unit string, families array<string>, relations array<string>, summary_state string")
    ids = lambda name: [r.id for r in workspace.saved_query(nodes, name).collect()]
    assert ids("untested-code") == [1] and ids("undocumented-code") == [1] and ids("unimplemented-requirements") == [4]
    files = spark.createDataFrame([("a", "x", "x"), ("b", "x", "y"), ("c", None, "y"), ("d", "x", " ")], "path string, blob string, summary_blob string")
    assert [r.path for r in workspace.to_summarise(files).collect()] == ["b", "c", "d"]
    omitted = spark.createDataFrame([(1, "calls", 2, "old"), (2, "calls", 3, "new"), (1, "x", 1, "r")], "seq int, relation string, omitted int, reason string")
    assert {(r.relation, r.omitted, r.reason) for r in workspace.omitted_edges(omitted).collect()} == {("calls", 5, "new"), ("x", 1, "r")}
    kept, left = resolve.kept_edges(spark.createDataFrame([("a", "b", "calls"), ("a", "b", "odd"), ("b", "a", "odd")], "source string, target string, relation string"), spark.createDataFrame([("calls",)], "relation string"))
    assert kept.count() == 1 and [(r.relation, r.omitted) for r in left.collect()] == [("odd", 2)]


def test_symbols_around_files(spark):
    symbols = spark.createDataFrame([("s1", "f1"), ("s2", "f1"), ("s3", "f2"), ("s4", "f3")], "id string, file string")
    edges = spark.createDataFrame([("f1", "s1", "declares"), ("f1", "s2", "declares"), ("f2", "s3", "declares"), ("f3", "s4", "declares"), ("s1", "s3", "extends"), ("s3", "s4", "extends")], "source string, target string, relation string")
    artifacts = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "id string")
    kept, inside = workspace.symbol_layer(symbols, edges, artifacts, spark.createDataFrame([("f1",), ("unknown",)], "id string"))
    assert sorted(r.id for r in kept.collect()) == ["s1", "s2", "s3"]
    assert sorted((r.source, r.target) for r in inside.collect()) == [("f1", "s1"), ("f1", "s2"), ("f2", "s3"), ("s1", "s3")]
    both = workspace.merged_layers(kept, symbols.withColumn("file", F.lit("other")))
    assert sorted((r.id, r.file) for r in both.collect()) == [("s1", "f1"), ("s2", "f1"), ("s3", "f2"), ("s4", "other")]


def test_cards_stop_at_the_budget(spark):
    artifacts = spark.createDataFrame([(f"a{i}", f"p{i}", "code") for i in range(30)], "id string, path string, kind string")
    edges = spark.createDataFrame([("a0", "a1", "imports"), ("a0", "a2", "imports")], "source string, target string, relation string")
    cards = workspace.artifact_cards(artifacts, edges)
    assert {r.id: r.outgoing for r in cards.collect()}["a0"] == {"imports": 2}
    got = workspace.code_cards(cards, artifacts.select("id"), 10_000).collect()
    assert len(got) == 20
    cost = {r.id: r.cost for r in got}
    first = sorted(cost)[:3]
    assert [r.id for r in workspace.code_cards(cards, artifacts.select("id"), sum(cost[i] for i in first)).orderBy("id").collect()] == first


def test_pages_have_addresses(spark):
    slug = lambda scope, dirs: one(spark, workspace.page_slug(F.lit(scope), F.lit("id"), F.array(*[F.lit(d) for d in dirs])))
    assert slug("module", ["b", "a", "b"]) == hashlib.md5(b"module\nid\na\nb").hexdigest() and slug("repository", ["b"]) == hashlib.md5(b"repository\nid").hexdigest()
    files = spark.createDataFrame([("a/x.ts",), ("a/y.ts",), ("z.ts",)], "path string")
    clusters = spark.createDataFrame([("module:a/x.ts", "a/x.ts"), ("module:a/x.ts", "a/y.ts")], "key string, member string")
    assert sorted({(r.page, r.path) for r in workspace.page_set("r", clusters, files).collect()}) == [("directory:a", "a/x.ts"), ("directory:a", "a/y.ts"), ("module:a/x.ts", "a/x.ts"), ("module:a/x.ts", "a/y.ts"), ("repository:r", "a/x.ts"), ("repository:r", "a/y.ts"), ("repository:r", "z.ts")]


def test_communities_of_two_cliques(spark):
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    edges = spark.createDataFrame([("r", *p) for p in pairs], "repo string, source string, target string")
    nodes = spark.createDataFrame([("r", f"{c}{i}", f"src/{c}{i}") for c in "ab" for i in range(5)] + [("r", "lone", "docs/x.md"), ("r", "root", "x.md")], "repo string, id string, path string")
    got = {r.id: r.community for r in workspace.communities(edges, nodes).collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == len({got[f"b{i}"] for i in range(5)}) == 1 and got["a0"] != got["b0"]
    assert got["lone"] == "folder:docs" and got["root"] == "folder:."


def test_importance_and_views(spark):
    ranks = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.5)], "id string, rank double")
    got = {r.id: r.importance for r in workspace.importance(ranks, 3).collect()}
    assert np.isclose(got["a"], 1.5) and np.isclose(got["b"], 0.75)
    nodes = spark.createDataFrame([("a", "x", "broken", 1), ("b", "x", "verified", 0), ("q", "y", "odd", 2)], "id string, kind string, grade string, findings int")
    edges = spark.createDataFrame([("a", "b", "r", "resolved"), ("a", "gone", "r", "resolved"), ("a", "b", "r", "resolved"), ("a", "q", "r", None)], "source string, target string, relation string, tier string")
    needs = spark.createDataFrame([("q", "a")], "id string, source_id string")
    assert sorted((r.source, r.target, r.relation, r.derived) for r in graphs.graph.view(nodes, edges, needs).collect()) == [("a", "b", "r", False), ("a", "q", "r", False), ("a", "q", "references", True)]
    assert tuple(graphs.graph.tier_tally(edges).first()) == (0, 0, 0, 2, 1)
    kept, inside = graphs.graph.visible(nodes, edges, F.col("kind") == "x")
    assert kept.count() == 2 and inside.select("source", "target").distinct().count() == 1
    assert {(r.kind, r.grade, r.n) for r in graphs.graph.type_grades(nodes).collect()} == {("x", "broken", 1), ("x", "verified", 1), ("y", "odd", 1)}


def test_schema_edges_cards_and_contents(spark, tmp_path):
    links = spark.createDataFrame([("m.sql", "defines", None, "users"), ("m.sql", "references", "users", "teams"), ("gone.sql", "defines", None, "users"), ("m.sql", "defines", None, "odd")], "path string, kind string, source string, target string")
    got = resolve.schema_edges(links, spark.createDataFrame([("f", "m.sql")], "id string, path string"), spark.createDataFrame([("o1", "users"), ("o2", "teams")], "id string, name string"))
    assert {tuple(r) for r in got.collect()} == {("f", "o1", "defines"), ("o1", "o2", "references")}
    children = spark.createDataFrame([("a", 1), ("b", 2)], "path string, k int")
    assert [r.k for r in resolve.without_children(children, spark.createDataFrame([("a",)], "path string")).collect()] == [2]
    ids = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    got = workspace.node_content(ids, artifact=spark.createDataFrame([("1", "text")], "id string, content string"), finding=spark.createDataFrame([("2", "title")], "id string, content string"))
    assert {tuple(r) for r in got.collect()} == {("1", "artifact", "text"), ("2", "finding", "title"), ("3", None, None)}
    assert one(spark, workspace.page_prose_faults(F.lit("See [[a]] and [[b]], [[a]]"), F.array(F.lit("a")))) == ["b"]
    states = spark.createDataFrame([("r", "k", "ready", "s"), ("r", "l", "stale", None)], "repo string, key string, state string, summary string")
    files = spark.createDataFrame([("r", "x"), ("r", "y"), ("q", "z")], "repo string, path string")
    assert {tuple(r) for r in workspace.repository_overview(states, files).collect()} == {("r", 2, 2, 1), ("q", 1, 0, 0)}
    clusters = spark.createDataFrame([("r", "k", "x")], "repo string, key string, member string")
    assert [r.key for r in workspace.module_card(states, clusters, "x").collect()] == ["k"] and workspace.module_card(states, clusters, "y").collect() == []
    from tessellar.sources.reports import recorded_tree

    (tmp_path / "t.json").write_text('{\n "sha": "s",\n "tree": [{"path": "a", "mode": "100644", "type": "blob", "sha": "x", "size": 3},\n {"path": "d", "mode": "040000", "type": "tree", "sha": "y"}]\n}')
    assert [(r.path, r.size) for r in recorded_tree(spark, str(tmp_path / "t.json")).collect()] == [("a", 3), ("d", None)]


def test_brief_counts_all_consumers(spark):
    edges = spark.range(6000).select(F.concat(F.lit("c"), F.format_string("%05d", "id")).alias("source"), F.lit("n").alias("target"), F.lit("imports").alias("relation"))
    edges = edges.unionByName(spark.range(700).select(F.concat(F.lit("d"), F.format_string("%05d", "id")).alias("source"), F.concat(F.lit("c"), F.format_string("%05d", F.col("id") * 8)).alias("target"), F.lit("imports").alias("relation")))
    rows = workspace.change_brief(edges.select(F.col("source").alias("id"), F.col("source").alias("path")), edges, "n").collect()
    assert sorted(r.consumer for r in rows) == [f"c{i:05}" for i in range(25)]
    assert {(r.distance, r.omitted, r.complete, r.cost) for r in rows} == {(1, 6675, True, 50)}
