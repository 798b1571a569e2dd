"""Search, packs, maps and communities against plain versions."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.operators import graph, retrieval


def test_search_has_four_tiers_and_connection(spark):
    rows = [("1", "a.md", "Token Budget", "k", ["Intro"], ["x"], []), ("2", "b.md", "Other", "k", ["the token"], ["budget"], []), ("3", "src/token.ts", "C", "k", [], [], ["useBudget"]), ("4", "d.md", "D", "k", [], [], []), ("5", "e.md", "E", "token  budget", [], [], []), ("6", "f.md", "F", "k", None, None, None)]
    entries = spark.createDataFrame(rows, "id string, path string, title string, search_key string, headings array<string>, tags array<string>, symbols array<string>")
    edges = spark.createDataFrame([("4", "1", "x"), ("6", "4", "x")], "source string, target string, relation string")
    got = {r.id: (r.tier, r.points) for r in retrieval.search(entries, edges, " Token\n budget ").collect()}
    assert got == {"1": ("exact", 400), "2": ("title-heading", 300), "3": ("path-symbol", 200), "4": ("graph-neighbor", 100), "5": ("exact", 400)}
    near = {r.id: r.points for r in retrieval.search(entries, edges, "token budget", connected=True).collect()}
    rank = plain_rank([x[0] for x in rows], [("4", "1"), ("6", "4")], [k for k in got if got[k][1] > 100])
    assert all(abs(near[k] - got[k][1] - 50 * rank[k]) < 1e-9 for k in got)
    assert retrieval.search(entries, edges, "?!").collect() == []
    page = retrieval.search_page(retrieval.search(entries, edges, "token budget"), 2).collect()
    assert [(r.id, r.eligible, r.omitted) for r in page] == [("1", 5, 3), ("5", 5, 3)]


def plain_fit(items, budget):
    used, taken = 0, []
    for item, cost in items:
        if used + cost <= budget:
            used += cost
            taken.append(item)
    return used, taken


def plain_batches(sizes, most):
    held, out = 0, []
    for s in sizes:
        if not out or held + s > most:
            out.append(s)
            held = s
        else:
            held += s
            out[-1] = held
    return len(out), max(out)


@pytest.mark.parametrize("gathered", [4096, 3])
def test_packs_and_batches_of_small_and_large_keys(spark, monkeypatch, gathered):
    monkeypatch.setattr(retrieval, "GATHERED", gathered)
    r = np.random.default_rng(gathered)
    rows = [(k, i, int(r.integers(0, 40))) for k, n in ((1, 60), (2, 5), (3, 1), (4, 25)) for i in range(n)] + [(5, 0, 1000), (5, 1, 1000), (5, 2, 3), (5, 3, 4), (5, 4, 0)]
    df = spark.createDataFrame(rows, "k long, i long, c long").repartition(3)
    by_key = {k: [(i, c) for kk, i, c in rows if kk == k] for k in {x[0] for x in rows}}
    got = {x.k: (x.used, x["items"]) for x in retrieval.pack(df, "k", [F.col("i")], "i", F.col("c"), 100).collect()}
    assert got == {k: (u, ",".join(map(str, t))) for k, v in by_key.items() for u, t in [plain_fit(v, 100)]}
    got = {x.k: (x.n_batches, x.largest) for x in retrieval.batches(df, "k", "i", F.col("c"), 50).collect()}
    assert got == {k: plain_batches([c for _, c in v], 50) for k, v in by_key.items()}


def plain_rank(nodes, edges, seeds):
    near = {n: [] for n in nodes}
    for a, b in edges:
        if a != b:
            near[a].append(b)
            near[b].append(a)
    start = {n: seeds.count(n) / len(seeds) if seeds else 1 / len(nodes) for n in nodes}
    rank = dict(start)
    for _ in range(25):
        lost = sum(rank[n] for n in nodes if not near[n])
        rank = {n: 0.25 * start[n] + 0.75 * (sum(rank[m] * near[m].count(n) / len(near[m]) for m in set(near[n])) + lost * start[n]) for n in nodes}
    return {n: v / max(rank.values()) for n, v in rank.items()}


def test_repo_map_is_ranked_and_cut(spark):
    r = np.random.default_rng(0)
    rows = [(f"n{i}", f"dir/file{i}.ts", "code", [f"symbol{j}" for j in range(i % 15)]) for i in range(40)]
    edges = [(f"n{a}", f"n{b}") for a, b in r.integers(0, 40, (60, 2)).tolist()]
    df = spark.createDataFrame(rows, "id string, path string, kind string, symbols array<string>")
    e = spark.createDataFrame([(*x, "imports") for x in edges], "source string, target string, relation string")
    got = [(x.path, x.line, x.used) for x in retrieval.repo_map(df, e, ["FILE3"], 300).orderBy("used").collect()]
    rank = plain_rank([x[0] for x in rows], edges, [x[0] for x in rows if "file3" in x[1]])
    want, used = [], 0
    for i, path, kind, symbols in sorted(rows, key=lambda x: (-round(rank[x[0]], 12), x[1])):
        line = f"{path} — " + ((", ".join(symbols[:12]) + (f" (+{len(symbols) - 12})" if len(symbols) > 12 else "")) if symbols else kind)
        used += math.ceil((len(line) + 1) / 4)
        if used > 300:
            break
        want.append((path, line, used))
    assert [x[0] for x in got] == [x[0] for x in want] and got == want


def test_communities_are_those_of_plain_propagation(spark):
    r = np.random.default_rng(2)
    for repo in ("a", "b"):
        names = [f"{'x' if i % 2 else 'y'}/f{i}" for i in range(30)]
        pairs = [(names[a], names[b]) for a, b in r.integers(0, 30, (40, 2)).tolist()]
        near = {n: [] for n in names}
        for a, b in pairs:
            if a != b:
                near[a].append(b)
                near[b].append(a)
        label = {n: n for n in names}
        for _ in range(10):
            old = dict(label)
            for n in sorted(names):
                if near[n]:
                    c = Counter(label[m] for m in near[n])
                    label[n] = min(c, key=lambda x: (-c[x], x))
            if old == label:
                break
        want = {(min(g), n) for g in [[m for m in names if label[m] == x] for x in set(label.values())] if len(g) > 1 for n in g}
        edges = spark.createDataFrame([(repo, *p) for p in pairs], "repo string, source string, target string")
        got = graph.modules(edges, spark.createDataFrame([(repo, n) for n in names], "repo string, path string")).collect()
        assert {(g.key.removeprefix("module:"), g.member) for g in got} == want


def test_trace_takes_the_first_edges_and_closure_stops(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("a", "c", "x"), ("b", "d", "x"), ("d", "c", "a"), ("d", "z", "x"), ("q", "q", "x")], "source string, target string, relation string")
    assert [(r.hop, r.explain) for r in graph.trace(e, "a", "z", 4).collect()] == [(1, "a -x-> b"), (2, "b -x-> d"), (3, "d -x-> z")]
    assert graph.trace(e, "a", "z", 2).collect() == [] and graph.trace(e, "a", "a", 2).collect() == [] and graph.trace(e, "a", "q", 9).collect() == []
    chain = spark.createDataFrame([(f"n{i + 1:02}", f"n{i:02}", "imports") for i in range(12)] + [("t", "n03", "tests"), ("n00", "n02", "imports")], "source string, target string, relation string")
    found, stopped = graph.dependency_closure(chain, "n00")
    got = {r.node: (r.distance, len(r.via)) for r in found.collect()}
    assert stopped == "distance" and got == {f"n{i:02}": (i, i) for i in range(1, 11)}
    few, stopped = graph.dependency_closure(chain, "n00", budget=3)
    assert stopped == "budget" and {r.node for r in few.collect()} == {"n01", "n02"}
    reasons = [r.reason for r in graph.bound_reasons("budget", spark.createDataFrame([("calls", 3, "unknown")], "relation string, omitted int, reason string"), [("sections", 300)]).collect()]
    assert len(reasons) == 3
    nodes = spark.createDataFrame([("n01", "artifact", "doc"), ("r", "route", None), ("q1", "requirement", None), ("db", "db_object", None)], "id string, kind string, class string")
    more = chain.unionByName(spark.createDataFrame([("r", "n01", "handles"), ("n01", "db", "queries")], "source string, target string, relation string"))
    assert sorted((x.what, x.id) for x in graph.affected(nodes, more, found.select("node")).collect()) == [("doc", "n01"), ("route", "r"), ("table", "db"), ("test", "t")]
