"""Streams of access events: deduplicated activity of nodes, pulse phases and their changes, and windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tessellar.sources.tables import cut

#: Ages in seconds up to which an event shows, with the phase's name.
PHASES = ((0.75, "pulse"), (2.6, "decay"), (12.0, "afterglow"))


def phase(at: Column, as_of: Column) -> Column:
    """Phase of an event by its age; older ones and those of the future are idle."""
    age = as_of.cast("timestamp").cast("double") - at.cast("timestamp").cast("double")
    out = F.lit("idle")
    for bound, name in reversed(PHASES):
        out = F.when((age >= 0) & (age < bound), name).otherwise(out)
    return out


def unique_events(events: DataFrame, event_id: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events with each id once; of a stream, ids that come again within the lateness allowed."""
    if not events.isStreaming:
        return events.dropDuplicates([event_id])
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([event_id])


def activity(events: DataFrame, node: Column, at: str = "ts", width: str = "1 hour") -> DataFrame:
    """(node, start_at, n, last_at): events of each node in tumbling windows; the same for a table and a stream."""
    w = F.window(F.col(at).cast("timestamp"), width)
    return events.groupBy(node.alias("node"), w.alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("last_at")).select("node", F.col("w.start").alias("start_at"), "n", "last_at")


#: Microseconds after an event at which each phase begins, as long as no other event comes before.
BEGINNINGS = (("pulse", 0), *((after, round(bound * 1_000_000)) for (bound, _), after in zip(PHASES, [*(name for _, name in PHASES[1:]), "idle"], strict=True)))


def phase_changes(events: DataFrame, node: Column, at: str = "ts", event_id: str = "event_id", late: str = "10 seconds") -> DataFrame:
    """(node, phase, at, n): every phase that a node enters, when, and how many events it has had by then.

    An event begins a pulse; each later phase, and the idle end, begins at its age unless another event comes before. Of a
    table they are found by looking at the next event. Of a stream a state holds each node's count, last event and phase,
    and an event-time timer makes the next phase when the watermark passes it. An event of a stream that is older than
    its node's last one counts, and is a row of the phase ``late``; without such events both give the same rows. Rows with
    a null node or time are left out.
    """
    rows = events.select(node.alias("node"), F.col(at).cast("timestamp").alias("at"), F.col(event_id).alias("id")).where("node is not null and at is not null")
    if events.isStreaming:
        return _phases_of_stream(rows, late)
    # dealt by ranges of node and time, so that one busy node is many tasks; each range needs the next one's first event
    ranged = cut(rows.repartitionByRange("node", "at", "id").withColumn("_block", F.spark_partition_id()))
    blocks = ranged.groupBy("node", "_block").agg(F.count("*").alias("_n"), F.min("at").alias("_first"))
    order = W.partitionBy("node").orderBy("_block")
    blocks = blocks.select("node", "_block", F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(order).alias("_after"))
    within = W.partitionBy("node", "_block").orderBy("at", "id")
    each = ranged.withColumn("_k", F.row_number().over(within)).withColumn("_next", F.lead("at").over(within)).join(blocks, ["node", "_block"])
    begin = F.explode(F.array(*[F.struct(F.lit(name).alias("phase"), F.lit(us).alias("us")) for name, us in BEGINNINGS]))
    each = each.select("node", "at", (F.col("_before") + F.col("_k")).alias("n"), F.coalesce("_next", "_after").alias("next"), begin.alias("b"))
    begins = F.timestamp_micros(F.unix_micros("at") + F.col("b.us"))
    return each.where((F.col("b.us") == 0) | F.col("next").isNull() | (begins < F.col("next"))).select("node", F.col("b.phase").alias("phase"), begins.alias("at"), "n")


def _phases_of_stream(rows: DataFrame, late: str) -> DataFrame:
    kind = rows.schema["node"].dataType.simpleString()
    timed = rows.withWatermark("at", late).select("node", "at", F.unix_micros("at").alias("us"), "id")
    found = timed.groupBy("node").applyInPandasWithState(_advance, f"node {kind}, phase string, us long, n long", "n long, last long, stage int", "append", "EventTimeTimeout")
    return found.select("node", "phase", F.timestamp_micros("us").alias("at"), "n")


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one node's new events, or of its timer; stage is the phase that comes next."""
    n, last, stage = state.get if state.exists else (0, 0, len(BEGINNINGS))
    out: list[tuple] = []

    def pass_time(upto: int) -> None:
        nonlocal stage
        while stage < len(BEGINNINGS) and last + BEGINNINGS[stage][1] < upto:
            out.append((BEGINNINGS[stage][0], last + BEGINNINGS[stage][1], n))
            stage += 1

    if state.hasTimedOut:
        pass_time(state.getCurrentWatermarkMs() * 1000 + 1)
    else:
        for us in pd.concat(list(frames)).sort_values(["us", "id"])["us"].tolist():
            if n and us < last:
                n += 1
                out.append(("late", us, n))
                continue
            pass_time(us)
            n, last, stage = n + 1, us, 1
            out.append(("pulse", us, n))
    state.update((n, last, stage))
    if stage < len(BEGINNINGS):
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, -(-(last + BEGINNINGS[stage][1]) // 1000)))
    yield pd.DataFrame({"node": [key[0]] * len(out), "phase": [o[0] for o in out], "us": [o[1] for o in out], "n": [o[2] for o in out]})
