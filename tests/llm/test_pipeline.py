import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from tessellar.llm import mixing
from tessellar.llm.queries import SQL_DECONTAMINATION

SF = "/root/testdata/sf0.01"


def test_stages_keep_their_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SF), "test")
        frames[name] = (before, docs)
        if name != "mixing":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    kept = ids(frames["quality"][1])
    good, bad = ({i for i, q in labels.items() if q == k} for k in (1, 0))
    assert len(good & kept) >= 0.98 * len(good) and len(bad & kept) <= 0.1 * len(bad)
    before, after = frames["near_duplicates"]
    assert ids(after) < ids(before)
    con = duckdb.connect()
    before, after = frames["decontamination"]
    for rows, clean in ((before, False), (after, True)):
        con.register("documents", rows.toPandas())
        con.execute(f"create or replace view benchmark as select * from '{SF}/benchmark.parquet'")
        hit = con.execute(f"select count(*) from ({SQL_DECONTAMINATION}) where contaminated").fetchall()[0][0]
        assert (hit == 0) == clean
    before, after = frames["mixing"]
    assert {"probability", "weight"} <= set(after.columns) and ids(after) <= ids(before)
    drawn = {r["doc_id"]: r["u"] for r in before.select("doc_id", mixing.draw(F.col("doc_id")).alias("u")).collect()}
    assert all(drawn[r["doc_id"]] < r["probability"] for r in after.collect())


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "empty")
        assert docs.count() == 0, name


def test_odd_rows(spark):
    clean = "Plain words of a text that says something about the weather, the sea and the hills of the north coast. "
    rows = [(1, clean * 3), (1, clean * 3), (2, clean * 3), (None, clean), (None, None), (3, None), (4, ""), (5, "word " * 200_000), (6, clean + "One more line.")]
    docs = spark.createDataFrame([(i, t, None if k == 8 else "en", "web", 7, "x", True) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, probability string, kept boolean")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "line_dedup", "near_duplicates", "decontamination", "mixing"):
        got = stages[name](spark, docs, SF).collect()
        if name == "near_duplicates":
            assert sorted((r["doc_id"] or 0) for r in got) == [0, 0, 1, 3, 4, 5, 6]
        elif name == "line_dedup":
            texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in got)
            assert (5, "word " * 200_000) in texts and (2, clean * 3) not in texts and [t for t in texts if t[0] == 1] == [(1, clean * 3)] * 2
        elif name == "decontamination":
            assert len(got) == len(rows) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
        else:
            assert {r["doc_id"] for r in got} <= {None, 1, 2, 3, 4, 5, 6}
