import random

from tessellar.operators import sinks

WRITES = "seq long, name string, entry_key string, anchor string, text string, remove boolean"


def test_states_go_on_over_batches_and_stay_apart(spark):
    """Writes of several memories, one with most rows and one without an anchor, in batches of three rows: as dictionaries give them."""
    rng = random.Random(5)
    rows = [(i, rng.choice("nm"), f"k{rng.randrange(6)}", rng.choice(["hot", "hot", "hot", None, "", "b"]), rng.choice([None, "x", "y"]), rng.random() < 0.2) for i in range(400)]
    want, held = {}, {}
    for seq, name, key, anchor, text, remove in rows:
        own = held.setdefault((anchor, name), {})
        known = own.get(key)
        if remove:
            want[seq] = "invalidated" if known is not None else "noop"
            own.pop(key, None)
        elif known == text:
            want[seq] = "noop"
        elif known is None and len(own) >= 3:
            want[seq] = "rejected_cap"
        else:
            want[seq] = "updated" if known is not None else "added"
            own[key] = text
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.seq: r.outcome for r in sinks.memory_states(spark.createDataFrame(rows, WRITES).repartition(7), 3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want and set(want.values()) == {"added", "updated", "noop", "invalidated", "rejected_cap"}
    assert sinks.memory_states(spark.createDataFrame([], WRITES)).collect() == []
