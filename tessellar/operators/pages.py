"""Pages over a table written in order: a page reads the files that hold it.

The table is dealt by ranges of its order and sorted within them; beside it stands one row a file: its first and last key, its
number of rows and the position of its first one. A page past a key, or at a position, finds its files there; Parquet's own
statistics then leave out the row groups before the key. The order's columns are unique together and never null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_FILE = 1 << 20
GROUP_BYTES = 8 << 20


def write_sorted(rows: DataFrame, order: Sequence[str], path: str, rows_per_file: int = ROWS_PER_FILE, group_bytes: int = GROUP_BYTES) -> None:
    """Writes the rows in order below the path, with the list of files."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("parquet.block.size", group_bytes).parquet(f"{path}/rows")
    held = spark.read.schema(rows.schema).parquet(f"{path}/rows").select(F.input_file_name().alias("file"), F.struct(*order).alias("key"))
    files = held.groupBy("file").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n"))
    # one row a file: their running number is the position of each file's first row
    start = F.coalesce(F.sum("n").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files.withColumn("start", start).coalesce(1).write.mode("overwrite").parquet(f"{path}/files")


def _past(order: Sequence[str], key: Sequence) -> Column:
    """Rows after a key; the first column alone is what the reader can skip row groups by."""
    after = F.lit(False)
    same = F.lit(True)
    for c, v in zip(order, key, strict=True):
        after, same = after | (same & (F.col(c) > F.lit(v))), same & (F.col(c) == F.lit(v))
    return (F.col(order[0]) >= F.lit(key[0])) & after


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/files")


def _rows(spark: SparkSession, path: str, files: list) -> DataFrame:
    schema = spark.read.parquet(f"{path}/rows").schema
    return spark.read.schema(schema).parquet(*[f["file"] for f in files]) if files else spark.createDataFrame([], schema)


def page_at(spark: SparkSession, path: str, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows by position, each with it (from 0) and with how many follow the page."""
    files = _files(spark, path)
    total = files.agg(F.sum("n")).first()[0] or 0
    held = files.where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)).orderBy("start").collect()  # the page's files
    first = held[0]["start"] if held else 0
    rows = _rows(spark, path, held).orderBy(*order).offset(max(0, offset - first)).limit(limit)
    place = F.row_number().over(W.orderBy(*order)) - 1 + offset  # of the page's rows
    return rows.withColumn("position", place.cast("long")).withColumn("left_over", F.lit(max(0, total - offset - limit)).cast("long"))


def page_after(spark: SparkSession, path: str, order: Sequence[str], key: Sequence | None, limit: int) -> DataFrame:
    """The next rows past a key (None: from the start), each with its position and with how many follow the page."""
    if key is None:
        return page_at(spark, path, order, 0, limit)
    files = _files(spark, path)
    beyond = files.where(_past([f"last.{c}" for c in order], key)).orderBy("start").limit(1).collect()
    if not beyond:
        return page_at(spark, path, order, 0, 0)
    # of the file that holds the key, how many rows come first
    begin = beyond[0]["start"] + _rows(spark, path, beyond).where(~_past(order, key)).count()
    return page_at(spark, path, order, begin, limit).where(_past(order, key))
