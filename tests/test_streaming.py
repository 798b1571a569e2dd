import datetime

from pyspark.sql import functions as F

from tessellar.streaming import activity


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(k, at(k * 600), f"n{k % 3}") for k in range(20)]
    for k, part in enumerate((rows[:8], rows[6:14], rows[12:])):  # parts overlap: repeated ids
        spark.createDataFrame(part, "event_id long, ts timestamp, node string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, node string").parquet(str(tmp_path / "in"))
    counted = activity.activity(activity.unique_events(stream, late="1 day"), F.col("node"))
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, node string")
    want = activity.activity(activity.unique_events(table), F.col("node"))
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, want.collect()))


def test_phases(spark):
    df = spark.sql("select * from values (timestamp'2024-01-01 00:00:00', 'a'), (timestamp'2024-01-01 00:00:09.5', 'b'), (timestamp'2024-01-01 00:00:10.1', 'c'), (timestamp'2024-01-01 00:00:08', 'd') as t(ts, n)")
    got = dict(df.select("n", activity.phase(F.col("ts"), F.lit("2024-01-01 00:00:10").cast("timestamp"))).collect())
    assert got == {"a": "afterglow", "b": "pulse", "c": "idle", "d": "decay"}


def test_phase_changes_of_a_stream_are_those_of_the_table(spark, tmp_path):
    import random

    rng = random.Random(6)
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=round(s * 1e6))
    times = sorted(rng.choice([rng.uniform(0, 120), rng.randrange(100), rng.randrange(400) / 4]) for _ in range(150))
    rows = [(k, at(t), rng.choice("abc")) for k, t in enumerate(times)] + [(900, None, "a"), (901, at(3), None)]
    rows += [(999, at(500), "clock")]  # moves the watermark, so that all timers before it have run
    kind = "event_id long, ts timestamp, node string"
    for part in (rows[:50], rows[50:100], rows[100:152], rows[152:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    found = activity.phase_changes(stream, F.col("node"))
    query = found.writeStream.format("memory").queryName("phases").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = sorted((r["node"], r["at"], r["phase"], r["n"]) for r in spark.table("phases").collect() if r["node"] != "clock")
    table = activity.phase_changes(spark.createDataFrame(rows, kind).repartition(3), F.col("node"))
    want = sorted((r["node"], r["at"], r["phase"], r["n"]) for r in table.collect() if r["node"] != "clock")
    assert got == want
    plain = []
    for node in "abc":
        own = [(t, k) for k, t, x in rows if x == node and t is not None]
        for i, (t, _) in enumerate(own):
            for phase, us in activity.BEGINNINGS:
                begins = t + datetime.timedelta(microseconds=us)
                if not us or i + 1 == len(own) or begins < own[i + 1][0]:
                    plain.append((node, begins, phase, i + 1))
    assert want == sorted(plain)


def test_a_late_event_is_counted(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    kind = "event_id long, ts timestamp, node string"
    for part in ([(1, at(10), "a")], [(2, at(8), "a"), (3, at(11), "a")], [(4, at(100), "b")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = activity.phase_changes(stream, F.col("node")).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = [(r["phase"], r["n"]) for r in sorted(spark.table("late").where("node = 'a'").collect(), key=lambda r: (r["n"], r["at"]))]
    # the late one came before the timer of the first, whose next phase is told of a node that has had two events
    assert got == [("pulse", 1), ("late", 2), ("decay", 2), ("pulse", 3), ("decay", 3), ("afterglow", 3), ("idle", 3)]
