"""Co-change, risk and activity reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellar.functions.columns import level, rounded
from tessellar.operators.graph import pagerank
from tessellar.sources.tables import cut

#: Least scores of the levels.
RISK_LEVELS = {"high": 4.0, "elevated": 2.5, "moderate": 1.0}


def co_change_pairs(touches: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """(a, b, times, last): how often two items (a < b) were touched by one commit of rows (commit, item, at).

    Commits with fewer or more distinct items than the guard are left out, which bounds what one commit emits. Everything
    until the pair count is partitioned by commit once; a commit's items are gathered only after the guard.
    """
    own = touches.repartition("commit").groupBy("commit", "item").agg(F.max("at").alias("at"))
    fit = own.withColumn("n", F.count("*").over(W.partitionBy("commit"))).where(F.col("n").between(least, most))
    held = fit.groupBy("commit").agg(F.array_sort(F.collect_list(F.struct("item", "at"))).alias("xs"))
    partners = lambda x, i: F.transform(F.slice("xs", i + 2, F.size("xs")), lambda y: F.struct(x["item"].alias("a"), y["item"].alias("b"), x["at"].alias("at")))
    pairs = held.select(F.explode(F.flatten(F.transform("xs", partners))).alias("p")).select("p.*")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("times"), F.max("at").alias("last"))


def decayed(pairs: DataFrame, as_of: Column, half_life_days: int = 90) -> DataFrame:
    """(item, weight): of each item's pairs the sum of min(1, times / 10), halved every so many days."""
    w = F.least(F.lit(1.0), F.col("times") / 10) * F.pow(F.lit(0.5), F.datediff(as_of, "last") / half_life_days)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("item"), w.alias("w"))
    return ends.groupBy("item").agg(rounded(F.sum(F.col("w").cast("decimal(20,12)")), 3).alias("weight"))


def risk(items: DataFrame, signals: DataFrame, top: float, measured: bool = True) -> DataFrame:
    """(item, findings, untested, fan_in, co_change, audit, score, level) of the items with a factor; what has none is left out, as nothing is known of it.

    ``signals`` has a row for each item: findings, tested (null: unknown), fan_in, importance (against ``top``, the largest),
    weight of co-change, advisories (null: not audited). One point for each finding and for no test, up to two for
    importance where something depends on the item, up to one for co-change, up to one and a half for five advisories.
    """
    rows = items.select("item").join(signals, "item", "left")
    parts = {
        "findings": F.coalesce("findings", F.lit(0)).cast("long"),
        "untested": F.when(F.coalesce("tested", F.lit(False)) | F.lit(not measured), 0).otherwise(1).cast("long"),
        "fan_in": F.when(F.coalesce("fan_in", F.lit(0)) > 0, rounded(2 * F.coalesce("importance", F.lit(0.0)) / F.lit(float(top or 1)), 3)).otherwise(rounded(F.lit(0.0), 3)),
        "co_change": rounded(F.least(F.lit(1.0), F.coalesce(F.col("weight").cast("double"), F.lit(0.0))), 3),
        "audit": rounded(F.lit(1.5) * F.least(F.lit(1.0), F.coalesce("advisories", F.lit(0)) / 5), 3),
    }
    any_ = (parts["findings"] > 0) | (parts["untested"] > 0) | (F.coalesce("fan_in", F.lit(0)) > 0) | (F.coalesce("weight", F.lit(0)) > 0) | (F.coalesce("advisories", F.lit(0)) > 0)
    out = rows.where(any_).select("item", *[c.alias(n) for n, c in parts.items()])
    out = out.withColumn("score", (F.col("findings") + F.col("untested") + F.col("fan_in") + F.col("co_change") + F.col("audit")).cast("decimal(18,3)"))
    return out.withColumn("level", level(F.col("score"), RISK_LEVELS, "low"))


def workspace_risk(artifacts: DataFrame, edges: DataFrame, findings: DataFrame, pairs: DataFrame | None = None, as_of: Column | None = None, covered: DataFrame | None = None, advisories: int = 0) -> DataFrame:
    """The risk of a workspace's artifacts (id, path, classification), as ``risk`` gives it, with their path.

    Edges (source, target, relation) go by ids; those with an end that is no artifact, such as a requirement or a route, are
    left out. What imports and calls lead to an artifact is its fan-in, its importance its PageRank over these edges, started
    everywhere alike. Code is untested without an edge of tests and a path among the covered ones; other artifacts need none.
    Findings (path, target, status) and pairs (a, b, times, last) go by paths; pairs count if both paths are known. The
    advisories of an audit fall on manifests.
    """
    known = artifacts.select("id").distinct()
    inner = edges.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    inner = cut(inner.select("source", "target", "relation"))
    depends = inner.where(F.col("relation").isin("imports", "calls") & (F.col("source") != F.col("target")))
    fan_in = depends.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("fan_in"))
    ranks = pagerank(known, depends, known.limit(0)).select("id", F.col("rank").alias("importance"))
    tested = inner.where("relation = 'tests'").select(F.col("target").alias("id"), F.lit(True).alias("_tested")).distinct()
    out = artifacts.select("id", "path", "classification").join(fan_in, "id", "left").join(ranks, "id", "left").join(tested, "id", "left")
    out = out.join(finding_counts(findings).select(F.col("item").alias("path"), F.col("n").alias("findings")), "path", "left")
    if pairs is None:
        out = out.withColumn("weight", F.lit(None).cast("double"))
    else:
        paths = artifacts.select("path").distinct()
        both = pairs.join(paths.withColumnRenamed("path", "a"), "a", "left_semi").join(paths.withColumnRenamed("path", "b"), "b", "left_semi")
        out = out.join(decayed(both, as_of).withColumnRenamed("item", "path"), "path", "left")
    measured = F.lit(False) if covered is None else F.coalesce("_covered", F.lit(False))
    if covered is not None:
        out = out.join(covered.select("path", F.lit(True).alias("_covered")).distinct(), "path", "left")
    fine = (F.col("classification") != "code_metadata") | F.coalesce("_tested", F.lit(False)) | measured
    manifest = F.col("path").rlike(r"(?:^|/)(?:package\.json|pyproject\.toml)$")
    signals = out.select(F.col("id").alias("item"), "findings", fine.alias("tested"), "fan_in", "importance", "weight", F.when(manifest, F.lit(advisories)).alias("advisories"))
    return risk(artifacts.select(F.col("id").alias("item")), signals, 1.0).join(artifacts.select(F.col("id").alias("item"), "path"), "item")


def risk_factors(scored: DataFrame) -> DataFrame:
    """(item, kind, weight): a row for each factor that counts."""
    kinds = {"findings": "open-finding", "untested": "untested", "fan_in": "fan-in", "co_change": "co-changed", "audit": "dependency-audit"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("decimal(18,3)").alias("weight")) for c, k in kinds.items()]))
    return scored.select("item", each.alias("f")).select("item", "f.*").where("weight > 0")


def unmeasured(spark: SparkSession, coverage: bool, audit: bool) -> DataFrame:
    """(signal, reason) of signals that no report gives: unknown, not zero."""
    reasons = {"coverage": "no coverage report has been read, so what runs untested files is unknown", "dependency-audit": "no dependency audit has been read, so advisories are unknown"}
    return spark.createDataFrame([(s, reasons[s]) for s, known in (("coverage", coverage), ("dependency-audit", audit)) if not known], "signal string, reason string")


def page(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, most_rows: int, most_bytes: int) -> DataFrame:
    """The first rows of each key in order, as far as both budgets go, with row and bytes_so_far.

    Rows beyond the row budget are pruned by a window limit before and after the shuffle, so the running sum of sizes sees
    no more than the budget's rows of a key, however many it has.
    """
    by = W.partitionBy(*keys).orderBy(*order)
    first = rows.withColumn("row", F.row_number().over(by)).where(F.col("row") <= most_rows)
    summed = first.withColumn("bytes_so_far", F.sum(size).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return summed.where(F.col("bytes_so_far") <= most_bytes)


def running_sum(rows: DataFrame, keys: Sequence[str], order: str, value: Column, blocks: int | None = None) -> DataFrame:
    """Adds running: the sum of values up to and with the row, in an order that is unique within a key.

    Rows are dealt by ranges of key and order, so no key is one task, however its order values lie: each range has sums of
    its keys, their running sums are small, then sums within each range. As many ranges as the session has shuffle
    partitions, unless a number is given.
    """
    valued = rows.withColumn("_value", value)
    dealt = valued.repartitionByRange(*keys, order) if blocks is None else valued.repartitionByRange(blocks, *keys, order)
    ranged = cut(dealt.withColumn("_block", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.withColumn("_start", F.coalesce(before, F.lit(0))).drop("_sum")
    within = F.sum("_value").over(W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    same = [*keys, "_block"]
    return ranged.withColumn("_within", within).join(starts, same).withColumn("running", F.col("_start") + F.col("_within")).drop("_block", "_value", "_within", "_start")


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds at (from 0, in the order) and n (of the key) to each row: dealt by ranges, so that no key is one task."""
    ranged = cut(rows.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_block").agg(F.count("*").alias("_m"))
    by = W.partitionBy(*keys)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_m").over(by.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_m").over(by))
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), "_before", "n")
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    each = ranged.withColumn("_in", F.row_number().over(W.partitionBy(*keys, "_block").orderBy(*order)))
    return each.join(counts, same).select(*rows.columns, (F.col("_before") + F.col("_in") - 1).alias("at"), "n")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest order values, by a partial aggregate instead of a window."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row").getField(c).alias(c) for c in columns])


def sessions(events: DataFrame, user: str, at: str, gap: str) -> DataFrame:
    """(user, start, end, n): runs of events with no pause of the gap or more."""
    s = F.session_window(F.col(at).cast("timestamp"), gap)
    return events.groupBy(F.col(user), s.alias("s")).agg(F.count("*").alias("n"), F.max(at).alias("last_at")).select(user, F.col("s.start").alias("start_at"), "last_at", "n")


def reconcile(before: DataFrame, now: DataFrame, key: str, status: str) -> DataFrame:
    """(key, state, status): what a new derivation does to known findings: new ones open, absent ones resolve, dismissed ones stay so."""
    a, b = before.select(key, F.col(status).alias("old")), now.select(key, F.lit(True).alias("found"))
    joined = a.join(b, key, "full_outer")
    state = F.when(F.col("old") == "dismissed", "dismissed").when(F.col("found").isNull(), "resolved").when(F.col("old").isNull(), "opened").otherwise("kept")
    return joined.select(key, state.alias("state"))


def validity(rows: DataFrame, keys: Sequence[str], at: str, order: str) -> DataFrame:
    """Adds valid_to: when the next row of the key came, null for the row in force."""
    return rows.withColumn("valid_to", F.lead(at).over(W.partitionBy(*keys).orderBy(at, order)))


def finding_counts(findings: DataFrame) -> DataFrame:
    """(item, n): open findings (status, path, target) at either end; one at both ends of an item counts twice."""
    ends = F.explode(F.array_compact(F.array("path", "target")))
    return findings.where("status = 'open'").select(ends.alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def risk_top(scored: DataFrame, n: int = 3) -> DataFrame:
    """The riskiest items, equal scores by item."""
    return scored.orderBy(F.desc("score"), "item").limit(n)
