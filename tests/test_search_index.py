"""Search through the index against the pass over all entries."""

import random

from tessellar.operators import retrieval, search_index

ENTRY = "id string, path string, title string, search_key string, headings array<string>, tags array<string>, symbols array<string>"


def test_same_rows_and_few_folders(spark, tmp_path):
    rng = random.Random(4)
    words = ["token", "budget", "graph", "Ünïté", "small-ring", "a_b", "x", "of", "𐐨𐐩𐐪𐐫", "검색어", "tok en", "ﬁne", "Graphs"]
    some = lambda n: [" ".join(rng.choices(words, k=rng.randrange(1, 3))) for _ in range(rng.randrange(n))]
    rows = [(str(k), f"src/{rng.choice(words)}/{k}.md", rng.choice([None, " ".join(rng.choices(words, k=3))]) or "T", f"k{k}", some(3) or None, some(2), some(3) or None) for k in range(120)]
    rows += [("e1", "p", "", "", None, None, None), ("e2", "q", "token budget", "k", [], [], []), ("e3", "r\x01", "word " * 3000 + "zebra", "k", [], [], [])]
    entries = spark.createDataFrame(rows, ENTRY).repartition(3)
    edges = spark.createDataFrame([(str(k), str((k * 7) % 120), "x") for k in range(0, 120, 5)], "source string, target string, relation string")
    path = str(tmp_path / "index")
    search_index.write_index(entries, path, buckets=16, block=8)
    shown = lambda df: sorted((r["id"], r["path"], r["tier"], r["points"]) for r in df.collect())
    for query in ("token budget", "GRAPH", "small-ring", "of x", "x", "𐐨𐐩𐐪", "검색어 graph", "fine", "ünïté", "tok", "zebra", "nothing here", "?!", "", "token  budget", "a_b of"):
        assert shown(search_index.indexed_search(spark, path, edges, query)) == shown(retrieval.search(entries, edges, query)), query
    assert search_index.query_grams("tok of x") == ["tok"]
    found = search_index.candidates(spark, path, ["zeb"], 16, 8)
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "gram" in plan.split("PushedFilters: [")[1]
    read = search_index.candidates(spark, path, ["zeb"], 16, 8).inputFiles()
    every = spark.read.parquet(f"{path}/postings").inputFiles()
    assert len(read) <= len(every)


def test_nothing_indexed(spark, tmp_path):
    path = str(tmp_path / "index")
    edges = spark.createDataFrame([], "source string, target string, relation string")
    search_index.write_index(spark.createDataFrame([], ENTRY), path)
    assert search_index.indexed_search(spark, path, edges, "token").count() == 0
