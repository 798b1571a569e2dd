from tessellar.plans import texts


def test_contradictions_count_every_licence_of_a_document(spark, tmp_path):
    rows = [("en", "Licensed under A\nx\nLicensed under B\nLicensed under B"), ("en", "Licensed under A"), ("en", "none"), ("de", "Licensed under C"), ("en", None)]
    spark.createDataFrame(rows, "lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in texts.contradictions(spark, str(tmp_path)).collect()] == [("en", "A", "B", 2, 1)]
