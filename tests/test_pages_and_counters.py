"""Pages over a sorted layout, and counters kept by a stream."""

import datetime
import random

from pyspark.sql import functions as F

from tessellar.operators import pages
from tessellar.operators.reports import co_change_pairs
from tessellar.streaming import co_change


def test_pages_joined_are_the_table(spark, tmp_path):
    rows = [(k // 3, f"k{k:04}", "x" * (k % 7)) for k in range(1000)]
    random.Random(1).shuffle(rows)
    path, order = str(tmp_path / "sorted"), ["a", "b"]
    pages.write_sorted(spark.createDataFrame(rows, "a long, b string, c string"), order, path, rows_per_file=60, group_bytes=1 << 10)
    want, key, got = sorted(rows), None, []
    while True:
        page = pages.page_after(spark, path, order, key, 300).orderBy("position").collect()
        if not page:
            break
        assert page[0]["position"] == len(got) and page[0]["left_over"] == max(0, 1000 - len(got) - 300)
        got += [(r["a"], r["b"], r["c"]) for r in page]
        key = page[-1]["a"], page[-1]["b"]
    assert got == want
    assert [(r["a"], r["b"]) for r in pages.page_at(spark, path, order, 997, 10).orderBy("position").collect()] == [r[:2] for r in want[997:]]
    assert pages.page_at(spark, path, order, 2000, 10).count() == 0 and pages.page_after(spark, path, order, (10**6, ""), 5).count() == 0
    assert [r["b"] for r in pages.page_after(spark, path, order, (100, "zz"), 2).collect()] == ["k0303", "k0304"]
    few = pages.page_after(spark, path, order, (150, "k0450"), 20)
    every = spark.read.parquet(f"{path}/rows").inputFiles()
    assert len(few.inputFiles()) <= 3 < len(every) // 3
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(a,150)" in plan.split("PushedFilters: [")[1].split("]")[0] or "a#" in plan


def test_empty_table_has_no_pages(spark, tmp_path):
    path = str(tmp_path / "none")
    pages.write_sorted(spark.createDataFrame([], "a long"), ["a"], path)
    assert pages.page_at(spark, path, ["a"], 0, 5).count() == 0


def test_counters_after_replays(spark, tmp_path):
    rng = random.Random(2)
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    commits = [[(f"c{k}", f"f{i}", day(k)) for i in rng.sample(range(12), rng.randrange(1, 6))] for k in range(30)] + [[("big", f"f{i}", day(99)) for i in range(60)]]
    parts = [commits[:10], commits[10:18] + commits[4:6], commits[18:]]  # the second brings two commits again
    kind = "commit string, item string, at timestamp"
    frame = lambda part: spark.createDataFrame([r for c in part for r in c], kind)
    shown = lambda df: sorted(map(tuple, df.select("a", "b", "times", "last").collect()))
    want = lambda n: shown(co_change_pairs(frame([c for p in parts[:n] for c in p]).distinct()))
    path = str(tmp_path / "state")
    for k, part in enumerate(parts):
        co_change.merge_commits(frame(part), k, path, buckets=4)
        assert shown(co_change.counters(spark, path)) == want(k + 1)
        co_change.merge_commits(frame(part), k, path, buckets=4)  # the whole batch again
        assert shown(co_change.counters(spark, path)) == want(k + 1)
    for k, part in enumerate(parts):
        frame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    co_change.keep_counters(stream, str(tmp_path / "other"), str(tmp_path / "ck"), buckets=4).awaitTermination(300)
    assert shown(co_change.counters(spark, str(tmp_path / "other"))) == want(3)
    assert spark.read.parquet(f"{path}/seen").where(F.col("commit") == "c4").count() == 1
