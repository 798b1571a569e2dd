import os
import random

import pytest
from pyspark.sql import functions as F

from tessellar.operators import publish

NODES, EDGES = "id string, name string, at int", "a string, b string, relation string"
KEYS = {"nodes": ["id"], "edges": ["a", "b"]}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(path, name):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{path}/{name}") for f in fs if f.endswith(".parquet")}


def plain(before, plan, keys, keep, version):
    """The table and the outcomes that a plan gives, by dictionaries."""
    new = {}
    for r in sorted(plan, key=lambda r: [v is not None and str(v) or "" for v in r]):
        new[r[:keys]] = r
    out, told = {}, {}
    for k in {*before, *new}:
        if k not in new:
            outcome = "kept" if keep else "removed"
        elif k not in before:
            outcome = "inserted"
        else:
            outcome = "unchanged" if before[k][:-1] == new[k] else "updated"
        told[outcome] = told.get(outcome, 0) + 1
        if outcome in ("kept", "unchanged"):
            out[k] = before[k]
        elif outcome != "removed":
            out[k] = (*new[k], version)
    return out, told


def test_versions_equal_those_of_dictionaries(spark, tmp_path):
    """Null keys, null values that trade places, emptied tables, plans that change little: rows, versions and outcomes hold."""
    rng, path = random.Random(3), str(tmp_path / "store")
    nodes, edges, held_nodes, held_edges, version = {}, {}, {}, {}, 0
    for step in range(5):
        for i in rng.sample(range(60), 60 if step == 0 else 4):
            nodes[i] = (None if i == 0 else f"n{i}", rng.choice([None, "", "x"]), rng.choice([None, 1]))
        for i in rng.sample(range(60), 3):
            nodes.pop(i, None)
        if step == 3:
            nodes = {}
        plan_edges = {("a", None if i == 1 else f"n{i}"): ("a", None if i == 1 else f"n{i}", rng.choice("xyz")) for i in rng.sample(range(40), 6)}
        want_nodes, told_nodes = plain(held_nodes, list(nodes.values()), 1, False, version + 1)
        want_edges, told_edges = plain(held_edges, list(plan_edges.values()), 2, True, version + 1)
        told = publish.publish(spark, path, {"nodes": spark.createDataFrame(list(nodes.values()), NODES), "edges": spark.createDataFrame(list(plan_edges.values()), EDGES)}, KEYS, keep=["edges"], expected=version, buckets=8)
        held_nodes, held_edges, version = want_nodes, want_edges, version + 1
        assert publish.current_version(spark, path) == version
        assert rows(publish.read(spark, path, "nodes", NODES)) == sorted(held_nodes.values(), key=str)
        assert rows(publish.read(spark, path, "edges", EDGES)) == sorted(held_edges.values(), key=str)
        assert rows(publish.changed_since(spark, path, "nodes", NODES, version - 1)) == sorted((r for r in held_nodes.values() if r[-1] == version), key=str)
        got = {(r["table"], r["outcome"]): r["n"] for r in told.collect()}
        for name, want in (("nodes", told_nodes), ("edges", told_edges)):
            for outcome in ("inserted", "updated", "removed"):
                assert got.get((name, outcome), 0) == want.get(outcome, 0), (step, name, outcome)
            same = sum(want.get(o, 0) for o in ("unchanged", "kept"))
            assert sum(got.get((name, o), 0) for o in ("unchanged", "kept", "untouched")) == same


def test_unchanged_buckets_keep_their_files_and_half_a_plan_is_never_seen(spark, tmp_path):
    path = str(tmp_path / "store")
    nodes = spark.createDataFrame([(f"n{i}", "x", i) for i in range(200)], NODES)
    edges = spark.createDataFrame([("a", f"n{i}", "x") for i in range(50)], EDGES)
    publish.publish(spark, path, {"nodes": nodes, "edges": edges}, KEYS, buckets=16)
    first, first_edges = files(path, "nodes"), files(path, "edges")

    # the second table fails after the first one is written: readers keep the version they had
    moved = nodes.withColumn("name", F.when(F.col("id") == "n7", "y").otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        publish.publish(spark, path, {"nodes": moved, "edges": edges.withColumn("relation", F.raise_error(F.lit("lost")).cast("string"))}, KEYS)
    assert publish.current_version(spark, path) == 1
    assert rows(publish.read(spark, path, "nodes", NODES).drop("since")) == rows(nodes)

    told = publish.publish(spark, path, {"nodes": moved, "edges": edges}, KEYS)
    assert {(r["version"], r["table"], r["outcome"]): r["n"] for r in told.collect() if r["outcome"] == "updated"} == {(2, "nodes", "updated"): 1}
    assert first <= files(path, "nodes") and files(path, "edges") == first_edges
    assert len({f.split("bucket=")[1].split("/")[0] for f in files(path, "nodes") - first}) == 1
    assert rows(publish.read(spark, path, "nodes", NODES, 1).drop("since")) == rows(nodes)  # the first version is still read whole
    assert rows(publish.read(spark, path, "nodes", NODES).drop("since")) == rows(moved)

    # a plan that changes nothing makes no version; another's version is refused
    assert {r["outcome"] for r in publish.publish(spark, path, {"nodes": moved}, KEYS).collect()} == {"untouched"}
    assert publish.current_version(spark, path) == 2
    with pytest.raises(ValueError, match="version 2"):
        publish.publish(spark, path, {"nodes": nodes}, KEYS, expected=1)

    # what no version from the second on reads goes, what it reads stays
    assert publish.retire(spark, path, 2) == 2
    assert rows(publish.read(spark, path, "nodes", NODES).drop("since")) == rows(moved)
    assert len(rows(publish.read(spark, path, "edges", EDGES))) == 50


def test_of_equal_keys_one_row_counts(spark, tmp_path):
    path = str(tmp_path / "store")
    publish.publish(spark, path, {"nodes": spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("a", "y", 1), (None, "z", None), (None, "z", None)], NODES)}, KEYS)
    assert rows(publish.read(spark, path, "nodes", NODES)) == [("a", "y", 1, 1), (None, "z", None, 1)]
