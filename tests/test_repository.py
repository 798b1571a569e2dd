"""What queries derive of the repository: as much as they ask for."""

import os

from pyspark.sql import functions as F

from tessellar.plans import repository
from tessellar.repository import star
from tessellar.sources.tables import written

SF = "/root/testdata/sf0.001"


def test_rules_resolve_imports_of_tests_alone(spark):
    repo = repository.Repository(spark, SF)
    got = {r.path for r in repo.tested.collect()}
    whole = repo.links.where("kind = 'tests'").select("target").distinct().collect()
    assert got == {r.target for r in whole} and got
    fresh = repository.Repository(spark, SF)
    repository.findings(spark, SF, fresh)
    assert not {"imports", "files"} & set(vars(fresh))


def test_parts_of_the_repository_are_those_of_all_files(spark):
    files = star.files(spark, SF).cache()
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    assert plain(star.file_paths(spark, SF)) == plain(files.select("path"))
    columns = ["path", "classification", "text"]
    assert plain(star.source_files(spark, SF).select(columns)) == plain(files.where("classification = 'code_metadata'").select(columns))
    ruled = files.withColumn("text", F.when(~F.col("path").like("src/%"), F.col("text")))
    assert plain(star.files_by_rule(spark, SF).select(columns).na.fill("")) == plain(ruled.select(columns).na.fill(""))
    files.unpersist()


def test_packed_tables_count_as_large_as_their_rows(spark):
    rows = written(spark.range(300_000).select(F.concat(F.lit("src/some/long/folder/p"), F.col("id").cast("string")).alias("path")))
    stored = sum(os.path.getsize(f.removeprefix("file://")) for f in rows.inputFiles())
    assert int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > 5 * stored
