"""Cleaning a corpus: five stages in order, each written to the shared folder and read again before the next.

All but the last return the columns of documents; n_chars is counted again where a stage changes texts. Other columns of
documents are dropped, whatever their names. Nulls: a null text has the quality score of an empty one, no lines, no shingles
and no hits; a null doc_id is never a copy of anything; a null language or source is a value of its own in mixing. An empty
text stays if the quality stage accepts it; a text that a stage empties goes (line_dedup) or stays empty (decontamination).
Texts of any length are taken whole. Rows that repeat a doc_id are one document: near_duplicates keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm import decontam, linededup, mixing, neardup, quality
from tessellar.llm.common import crc_mod, written
from tessellar.llm.queries import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) != 2)
    return quality.score_quality(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines; a document of which nothing is left goes."""
    found = linededup.dedup_lines(docs.select(*COLUMNS))
    return _documents(found.where("n_removed = 0 or n_removed < n_lines"))


def _once(docs: DataFrame) -> DataFrame:
    """One row for each doc_id that is not null; only rows of repeated ids are moved."""
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return docs
    rest = [c for c in COLUMNS if c != "doc_id"]
    order = F.struct(*[x for c in rest for x in (F.col(c).isNull(), F.col(c))])
    one = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*rest), order).alias("row")).select("doc_id", "row.*")
    return written(docs.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS)), "once")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies; of rows that repeat a doc_id the one with the least text, lang and source (nulls last)."""
    docs = _once(docs.select(*COLUMNS))
    groups = neardup.near_duplicates(docs.select("doc_id", "text"))
    # the others are what a join has to know: rows that are in no group, or lead one, meet nothing
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that hold benchmark windows."""
    return _documents(decontam.find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), clean=True))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered shares of sources, languages and topics, with their probabilities and weights."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of(F.col("text"))}
    return mixing.mix(docs.select(*COLUMNS), dims, mixing.n_tokens(F.col("text"))).where("sampled").drop("sampled")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Two stages are models or winnowing, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
