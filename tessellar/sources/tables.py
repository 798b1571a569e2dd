"""Reading the tables, and cutting lineage in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a checkpoint; a folder is set only where the session names none."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where that is unset and the master local."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return (named or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to a fresh path of the shared folder and read again: columns stay apart, unlike in a checkpoint."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _true_sizes(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: How many times larger rows are in memory than in files: paths and keys repeat themselves and are packed well.
PACKED = 10.0


def _true_sizes(spark: SparkSession) -> None:
    """Spark takes a file's size for that of its rows and broadcasts what the driver can't hold; what a session states itself stays."""
    key = "spark.sql.sources.fileCompressionFactor"
    if spark.conf.get(key, "1.0") == "1.0":
        spark.conf.set(key, str(PACKED))


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star's rows as nodes: ids are a letter and the key."""
    kinds = (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))
    frames = [table(spark, sf_dir, kind).select(F.concat(F.lit(f"{kind[0]}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind")) for kind, key in kinds]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _edge(rows: DataFrame, source: tuple[str, str], target: tuple[str, str], relation: str) -> DataFrame:
    name = lambda letter, key: F.concat(F.lit(f"{letter}:"), F.col(key).cast("string"))
    return rows.select(name(*source).alias("source"), name(*target).alias("target"), F.lit(relation).alias("relation"))


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_of from places and parties to places, produces from suppliers to parts (distinct pairs)."""
    return (
        _edge(table(spark, sf_dir, "nation"), ("n", "n_nationkey"), ("r", "n_regionkey"), "part_of")
        .unionByName(_edge(table(spark, sf_dir, "customer"), ("c", "c_custkey"), ("n", "c_nationkey"), "part_of"))
        .unionByName(_edge(table(spark, sf_dir, "supplier"), ("s", "s_suppkey"), ("n", "s_nationkey"), "part_of"))
        .unionByName(_edge(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct(), ("s", "l_suppkey"), ("p", "l_partkey"), "produces"))
    )
