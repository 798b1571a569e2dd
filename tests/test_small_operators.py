"""Operators that no query reaches, and keys that are null or hot."""

import pytest
from pyspark.sql import functions as F

from tessellar.functions import paths, words
from tessellar.operators import progress, reports, resolve, retrieval, sinks, trials, workspace

ENTRY = "id string, name string, entry_key string, text string, anchor string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_memory_sections_and_lookup(spark):
    entries = spark.createDataFrame([("1", "notes", "k", "the token budget", "a.md"), ("2", "Budget", "token", "x", None), ("3", "n", "k", None, "b.md")], ENTRY)
    assert rows(retrieval.memory_hits(entries, "Token budget")) == [("1", "a.md", "path-symbol", 200.0), ("2", "memory/Budget/token", "path-symbol", 200.0)]
    assert rows(retrieval.memory_hits(entries, "?")) == []
    heads = spark.createDataFrame([("a.md", k, f"ADR-{k} on tokens", f"ADR-{k}") for k in (9, 2, 5, 7)] + [("b.md", 1, "other", "G-1")], "path string, line int, heading string, token string")
    found = retrieval.section_hits(heads, "tokens").collect()
    assert [(r["path"], [s["line"] for s in r["sections"]]) for r in found] == [("a.md", [2, 5, 7])]
    artifacts = spark.createDataFrame([("1", "r", "a.md"), ("2", "r", "b.md"), ("3", "s", "b.md")], "id string, repository string, path string")
    edges = spark.createDataFrame([("1", "2", "x"), ("3", "1", "x")], "source string, target string, relation string")
    assert rows(retrieval.lookup(artifacts, "a.md", edges)) == [("1", "r", "a.md", False, ["2", "3"])]
    assert rows(retrieval.lookup(artifacts, "b.md", edges)) == [("2", "r", "b.md", True, None), ("3", "s", "b.md", True, None)]
    assert rows(retrieval.lookup(artifacts, "none", edges)) == []


def test_sinks_and_orders(spark):
    held = spark.createDataFrame([("t1", "vitest", "ok"), ("t2", "junit", "ok")], "test string, source string, verdict string")
    now = spark.createDataFrame([("t3", "bad")], "test string, verdict string")
    assert rows(sinks.replaced_evidence(held, now, ["test"], "vitest")) == [("t2", "junit", "ok"), ("t3", "vitest", "bad")]
    outcomes = spark.createDataFrame([("applied",), ("missing",), ("applied",)], "outcome string")
    assert rows(sinks.tally(outcomes)) == [("applied", 2), ("missing", 1)]
    writes = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, None)], "k string, seq int, v string")
    assert rows(sinks.last_write(writes, ["k"], "seq", ["v"])) == [("a", "z"), ("b", None)]
    events = spark.createDataFrame([("b", 5), ("a", 5), ("c", None), ("d", 9)], "id string, at int")
    assert [r["id"] for r in events.orderBy(*progress.newest_first()).collect()] == ["c", "d", "a", "b"]
    handlers = spark.createDataFrame([("/x", "a/page.tsx"), ("/x", "a/b/page.tsx"), ("/x", "a/c/page.tsx"), ("/y", "z.py")], "url string, path string")
    assert rows(resolve.main_handlers(handlers)) == [("/x", "a/b/page.tsx"), ("/y", "z.py")]
    assert [r["signal"] for r in reports.unmeasured(spark, True, False).collect()] == ["dependency-audit"] and reports.unmeasured(spark, True, True).count() == 0


def test_modules_and_scalars(spark):
    files = spark.createDataFrame([("r", f"src/{d}/{k}.ts", f"src/{d}/{k}.ts") for d in "ab" for k in range(4)], "repo string, id string, path string")
    edges = spark.createDataFrame([("r", f"src/{d}/{i}.ts", f"src/{d}/{j}.ts", "imports") for d in "ab" for i in range(4) for j in range(i)] + [("r", "src/a/0.ts", "src/b/0.ts", "references")], "repo string, source string, target string, relation string")
    found = workspace.repository_modules(edges, files).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["key"], set()).add(r["member"])
    assert sorted(map(sorted, groups.values())) == [[f"src/{d}/{k}.ts" for k in range(4)] for d in "ab"]
    df = spark.createDataFrame([(None, 7, "resolved"), (None, -3, "reference")], "x double, n long, tier string")
    assert df.agg(trials.mean_or_zero(F.col("x"))).first()[0] == 0.0 and df.agg(trials.mean_or_zero(F.col("n"))).first()[0] == 2.0
    assert [tuple(r) for r in df.select(words.tokens_bytes(F.col("n")), paths.tier_confidence(F.col("tier"))).collect()] == [(2, 1.0), (0, 0.6)]


@pytest.mark.parametrize("gathered", [4096, 4])
def test_a_null_key_is_a_key(spark, monkeypatch, gathered):
    monkeypatch.setattr(retrieval, "GATHERED", gathered)
    items = [(None, k, 3) for k in range(9)] + [(1, k, 5) for k in range(9)] + [(2, None, 1), (2, 5, 1)]
    df = spark.createDataFrame(items, "k long, i long, c long")
    got = {r["k"]: (r["used"], r["items"]) for r in retrieval.pack(df, "k", [F.col("i")], "i", F.col("c"), 17).collect()}
    assert got == {None: (15, "0,1,2,3,4"), 1: (15, "0,1,2"), 2: (2, "5")}  # a null item is taken, and has no text
    taken = {(r["key"], r["item"]) for r in retrieval.first_fit(df, "k", [F.col("i")], "i", F.col("c"), 17).collect()}
    assert {i for k, i in taken if k is None} == {0, 1, 2, 3, 4}
    counts = {r["k"]: (r["n_batches"], r["largest"]) for r in retrieval.batches(df.where("i is not null"), "k", "i", F.col("c"), 10).collect()}
    assert counts == {None: (3, 9), 1: (5, 10), 2: (1, 1)}


def test_hot_names_stay_linear(spark):
    """One name that 30,000 files export and call: no caller has exactly one other exporter, and no pairs are made."""
    many = spark.range(30_000).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("get").alias("name"))
    few = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "two"), (None, "none")], "path string, name string")
    exports = many.unionByName(few).unionByName(few)
    called = many.unionByName(spark.createDataFrame([(p, n) for p in ("a", "b", "c", "d") for n in ("one", "two", "none", "other")], "path string, name string"))
    assert rows(resolve.name_matches(called, exports)) == [("b", "a", "one"), ("b", "c", "two"), ("c", "a", "one"), ("c", "b", "two"), ("d", "a", "one")]
    plan = resolve.name_matches(called, exports)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_tools_of_routes(spark):
    df = spark.createDataFrame([("graph",), ("search",)], "r string")
    got = [tuple(r) for r in df.select(*retrieval.route_tools(F.col("r"))).collect()]
    assert got == [(["search_index", "get_neighbors", "trace_path", "impact_of", "query_brain"], "search"), (["search_index", "get_artifact"], "graph")]
