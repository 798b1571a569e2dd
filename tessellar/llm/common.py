"""What the operators of this package share: the shared folder, written tables, Arrow text buffers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = 2_800_000
NARROW_ROWS = 50_000
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one is set only where that is unset and the master local."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return (named or current.get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut: its rows are written to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_narrow(df: DataFrame, most: int) -> DataFrame:
    """``cut`` for rows of a few numbers, at most so many: into no more files than they need."""
    return cut(df.coalesce(max(1, -(-most // NARROW_ROWS))))


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet under a fresh path of the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes unless the session has its own bound: a fixed count of long texts or sets is no bound.

    Every operator with Python tasks calls it first, so that what a task holds doesn't depend on what ran before in the session.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, ARROW_BYTES)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; the crc of the empty text (0) where the id is null."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; a null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    first, last = int(ends[0]), int(ends[-1])
    held = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return held, ends - first


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most so many rows, and bytes of the text column or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(total[at - 1]) if at else 0
            to = min(max(at + 1, int(np.searchsorted(total, before + most, "right"))), at + rows)
            yield batch.slice(at, to - at)
            at = to
