"""Counters of files that change together, kept up to date by a stream of commits.

State is two tables below a path, each dealt to folders by a hash: ``seen`` (commit, batch) and ``pairs`` (a, b, times, last,
batch). A batch takes the commits that no earlier batch has seen, counts their pairs, and rewrites the folders of ``pairs`` that
these touch. The batch's number stands beside both: a commit counts in the batch that saw it first, and a folder that already
has a batch's number isn't merged again. So a batch that runs again, whole or from any point on, changes nothing, and a commit
that is delivered again doesn't count again. Batches come in the order of their numbers, as a stream gives them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessellar.operators.reports import co_change_pairs
from tessellar.sources.tables import cut, written

BUCKETS = 64


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table's rows; none where nothing has been written yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _kinds(touches: DataFrame) -> tuple[str, str, str]:
    return tuple(touches.schema[c].dataType.simpleString() for c in ("commit", "item", "at"))


def counters(spark: SparkSession, path: str, item: str = "string", at: str = "timestamp") -> DataFrame:
    """(a, b, times, last) as they stand."""
    return _table(spark, f"{path}/pairs", f"a {item}, b {item}, times long, last {at}, batch long, bucket int").select("a", "b", "times", "last")


def merge_commits(touches: DataFrame, batch: int, path: str, buckets: int = BUCKETS, least: int = 2, most: int = 50) -> None:
    """Counts a batch's commits (commit, item, at) in; all rows of a commit are in one batch."""
    spark = touches.sparkSession
    commit, item, at = _kinds(touches)
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    rows = written(touches.select("commit", "item", "at").where("commit is not null and item is not null"))
    ids = rows.select("commit").distinct().withColumn("bucket", bucket("commit"))
    held = sorted(r["bucket"] for r in ids.select("bucket").distinct().collect())  # no more than there are buckets
    if not held:
        return
    earlier = _table(spark, f"{path}/seen", f"commit {commit}, bucket int, batch long").where(F.col("bucket").isin(held) & (F.col("batch") < batch))
    fresh = cut(ids.join(earlier.select("commit").distinct(), "commit", "left_anti"))
    marks = fresh.select("commit", "bucket", F.lit(batch).cast("long").alias("batch"))
    marks.repartition("bucket").write.partitionBy("bucket", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/seen")

    new = cut(co_change_pairs(rows.join(fresh.select("commit"), "commit", "left_semi"), least, most).withColumn("bucket", bucket("a", "b")))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
    if not touched:
        return
    old = _table(spark, f"{path}/pairs", f"a {item}, b {item}, times long, last {at}, batch long, bucket int").where(F.col("bucket").isin(touched))
    done = [r["bucket"] for r in old.groupBy("bucket").agg(F.max("batch").alias("batch")).where(F.col("batch") >= batch).collect()]
    both = old.select("a", "b", "times", "last", "bucket").unionByName(new.select("a", "b", "times", "last", "bucket")).where(~F.col("bucket").isin(done) if done else F.lit(True))
    merged = both.groupBy("a", "b", "bucket").agg(F.sum("times").alias("times"), F.max("last").alias("last")).withColumn("batch", F.lit(batch).cast("long"))
    # made before a folder is replaced, as it is read from there
    ready = written(merged.select("a", "b", "times", "last", "batch", "bucket"))
    ready.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/pairs")


def keep_counters(commits: DataFrame, path: str, checkpoint: str, **options: int) -> StreamingQuery:
    """Runs the counters over a stream of (commit, item, at) until it has no more input."""
    return commits.writeStream.foreachBatch(lambda rows, batch: merge_commits(rows, batch, path, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
