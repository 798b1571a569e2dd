"""A plan published into several tables at once: readers see all of it or none, and buckets that it doesn't change keep their files.

A store is a folder. Each table's rows lie in folders of the batch that wrote them and of their bucket, a hash of their key;
beside the tables, ``published`` says which batch each bucket is read from since which version. A version is there once its
rows of ``published``, one file, are: what a batch wrote before that is read by nobody. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tessellar.sources.tables import cut, written

BUCKETS = 64
#: ``mark`` is what the plan's rows of a bucket add up to, ``kept`` how many rows the bucket has.
PUBLISHED = "version long, table string, bucket int, buckets int, batch string, mark string, kept long"


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _as_text(columns: Sequence[str]) -> Column:
    """The row as text that tells null from empty, and a value of one column from that of another."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _marks(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(bucket, mark): a digest of each bucket's rows in no order, added up where they are read."""
    digest = F.md5(_as_text(columns))
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)"))
    return rows.groupBy("bucket").agg(F.concat_ws("-", F.count("*"), part(1), part(16)).alias("mark"))


def _published(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(PUBLISHED).parquet(f"{path}/published")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], PUBLISHED)


def current_version(spark: SparkSession, path: str) -> int:
    """The last version that is whole; 0 where nothing is published."""
    return _published(spark, path).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def _sources(spark: SparkSession, path: str, name: str, version: int) -> DataFrame:
    """(bucket, batch, mark, kept, buckets): where a version reads each bucket of a table."""
    rows = _published(spark, path).where((F.col("table") == name) & (F.col("version") <= version))
    return rows.groupBy("bucket").agg(F.max_by(F.struct("batch", "mark", "kept", "buckets"), "version").alias("s")).select("bucket", "s.*")


def read(spark: SparkSession, path: str, name: str, schema: str, version: int | None = None) -> DataFrame:
    """A table's rows in a version, by default the last one, and ``since``, the version that gave them their values.

    Several tables are read alike if the caller takes ``current_version`` once and names it for each.
    """
    version = current_version(spark, path) if version is None else version
    return _rows(spark, path, name, schema, _sources(spark, path, name, version))


def _rows(spark: SparkSession, path: str, name: str, schema: str, sources: DataFrame) -> DataFrame:
    held, whole = sources.where("kept > 0").select("batch", "bucket"), f"{schema}, since long, batch string, bucket int"
    rows = spark.createDataFrame([], whole) if held.isEmpty() else spark.read.schema(whole).parquet(f"{path}/{name}")
    # one row for each bucket of the table, so the broadcast is as small as the store's number of buckets
    return rows.join(F.broadcast(held), ["batch", "bucket"], "left_semi").drop("batch", "bucket")


def changed_since(spark: SparkSession, path: str, name: str, schema: str, version: int) -> DataFrame:
    """The rows that are new or different since a version; buckets that nothing was written to since then aren't read."""
    now = current_version(spark, path)
    later = _published(spark, path).where((F.col("table") == name) & (F.col("version") > version)).select("bucket").distinct()
    return _rows(spark, path, name, schema, _sources(spark, path, name, now).join(later, "bucket", "left_semi")).where(F.col("since") > version)


def _changed(spark: SparkSession, path: str, name: str, plan: DataFrame, keys: Sequence[str], version: int, buckets: int, keep: bool) -> tuple[DataFrame, DataFrame]:
    """(rows to be written with their outcome, sources of the buckets as they were) of the buckets that a plan changes."""
    columns = plan.columns
    dealt = plan.withColumn("bucket", _bucket(keys, buckets))
    before = cut(_sources(spark, path, name, version))
    marks = cut(_marks(dealt, columns))
    both = marks.join(before.select("bucket", F.col("mark").alias("_mark"), "kept"), "bucket", "full_outer")
    # a bucket that the plan says nothing of is left as it is where absent rows are kept, and emptied otherwise
    gone = F.lit(False) if keep else F.col("mark").isNull() & (F.col("kept") > 0)
    stale = cut(both.where(gone | (F.col("mark").isNotNull() & ~F.col("mark").eqNullSafe(F.col("_mark")))).select("bucket", F.coalesce("mark", F.lit("0")).alias("mark")))
    wanted = sorted(r["bucket"] for r in stale.collect())  # no more than there are buckets
    new = dealt.where(F.col("bucket").isin(wanted)).withColumn("since", F.lit(None).cast("long")).withColumn("_new", F.lit(True))
    held = before.where(F.col("bucket").isin(wanted) & (F.col("kept") > 0)).select("batch", "bucket")
    if not held.isEmpty():
        stored = StructType([*plan.schema.fields, StructField("since", LongType()), StructField("batch", StringType()), StructField("bucket", IntegerType())])
        old = spark.read.schema(stored).parquet(f"{path}/{name}")
        old = old.where(F.col("bucket").isin(wanted)).join(F.broadcast(held), ["batch", "bucket"], "left_semi").withColumn("_new", F.lit(False))
        new = new.unionByName(old.select(*new.columns))
    text = F.col("_text")
    pick = lambda mine: F.max_by(F.struct(*columns, "since", "_text"), F.when(F.col("_new") == mine, text))
    rows = new.withColumn("_text", _as_text(columns)).groupBy("bucket", *[F.col(k).alias(f"_key_{k}") for k in keys]).agg(pick(True).alias("n"), pick(False).alias("o"))
    outcome = F.when(F.col("n").isNull(), "kept" if keep else "removed").when(F.col("o").isNull(), "inserted").when(F.col("n._text") == F.col("o._text"), "unchanged").otherwise("updated")
    since = F.when(outcome.isin("kept", "unchanged"), F.col("o.since")).otherwise(F.lit(version + 1))
    row = F.coalesce("n", "o")
    return rows.select("bucket", outcome.alias("outcome"), since.alias("since"), row.alias("r")).select("bucket", "outcome", "since", *[F.col(f"r.{c}").alias(c) for c in columns]), stale


def publish(spark: SparkSession, path: str, plan: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], keep: Collection[str] = (), expected: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Publishes tables as the next version and returns (version, table, outcome, n): inserted, updated, unchanged, removed or kept rows.

    A table named in ``keep`` keeps rows that its plan hasn't; from others they go. Of rows with equal keys the one whose text
    as JSON is greatest counts; keys may be null. A bucket is joined and written only if its rows differ from those of the
    last plan, told by sums of digests, for which nothing is shuffled. With ``expected``, a store at another version is left
    alone with a ValueError. The number of buckets is the store's once it has one. Column names ``bucket``, ``batch`` and
    ``since`` are taken. A plan that changes nothing makes no version. A publication that fails before its end can be run
    again: what it wrote is read by nobody, and ``retire`` removes it.
    """
    version = current_version(spark, path)
    if expected is not None and expected != version:
        raise ValueError(f"the store is at version {version}, not {expected}")
    first = _published(spark, path).select("buckets").first()
    buckets, batch = first[0] if first else buckets, f"b{uuid.uuid4().hex}"
    notes, outcomes = [], []
    for name, df in plan.items():
        rows = written(df)  # marks and rows come of one and the same table, whatever made it
        changed, stale = _changed(spark, path, name, rows, keys[name], version, buckets, name in keep)
        ready = written(changed)
        left = ready.where("outcome <> 'removed'").drop("outcome").withColumn("batch", F.lit(batch))
        left.repartition("bucket").write.mode("append").partitionBy("batch", "bucket").parquet(f"{path}/{name}")
        kept = left.groupBy("bucket").agg(F.count("*").alias("kept"))
        notes.append(stale.join(kept, "bucket", "left").select(F.lit(version + 1).cast("long").alias("version"), F.lit(name).alias("table"), "bucket", F.lit(buckets).alias("buckets"), F.lit(batch).alias("batch"), "mark", F.coalesce("kept", F.lit(0)).cast("long").alias("kept")))
        untouched = _sources(spark, path, name, version).join(stale, "bucket", "left_anti").agg(F.sum("kept").alias("n")).where("n > 0").select(F.lit("untouched").alias("outcome"), "n")
        outcomes.append(ready.groupBy("outcome").agg(F.count("*").alias("n")).unionByName(untouched).withColumn("table", F.lit(name)))
    told = cut(reduce(DataFrame.unionByName, outcomes).select("table", "outcome", "n"))
    note = cut(reduce(DataFrame.unionByName, notes))
    if not note.isEmpty():
        note.coalesce(1).write.mode("append").parquet(f"{path}/published")  # at most tables x buckets rows; the version is there when this file is
        version += 1
    return told.select(F.lit(version).cast("long").alias("version"), "table", "outcome", "n")


def retire(spark: SparkSession, path: str, oldest: int) -> int:
    """Removes folders that no version from ``oldest`` on reads, unfinished ones too, and returns how many; versions before it can't be read afterwards."""
    now = current_version(spark, path)
    names = [r[0] for r in _published(spark, path).select("table").distinct().collect()]
    removed = 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        used = set()
        for version in range(max(oldest, 1), now + 1):
            used |= {(r["batch"], r["bucket"]) for r in _sources(spark, path, name, version).where("kept > 0").select("batch", "bucket").collect()}  # bounded by buckets x versions
        root = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        fs = root.getFileSystem(conf)
        for b in fs.listStatus(root) if fs.exists(root) else []:
            batch = b.getPath().getName()
            for f in fs.listStatus(b.getPath()) if batch.startswith("batch=") else []:
                bucket = f.getPath().getName()
                if bucket.startswith("bucket=") and (batch[6:], int(bucket[7:])) not in used:
                    removed += bool(fs.delete(f.getPath(), True))
    return removed
