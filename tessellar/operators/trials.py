"""Statistics of benchmark trials: intervals by resampling, grades, arms, pairs, gates, precision, operational checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.functions.words import grading_text, half_up
from tessellar.operators.reports import numbered
from tessellar.sources.tables import written

#: Resamples, their share inside the interval, seeds' hash and generator, and bounds of the gate.
RESAMPLES, LEVEL = 2000, 0.95
FNV_START, FNV_PRIME, STEP = 0x811C9DC5, 0x01000193, 0x6D2B79F5
NOT_WORSE, BETTER = -5.0, 5.0


def seed_of(key: str) -> int:
    """A 32-bit hash of a key's UTF-16 units."""
    h = FNV_START
    raw = np.frombuffer(key.encode("utf-16-le"), np.uint16)
    for unit in raw.tolist():
        h = ((h ^ unit) * FNV_PRIME) & 0xFFFFFFFF
    return h


def draws(seed: int, n: int) -> np.ndarray:
    """The first n numbers from 0 to 1 of the seed's generator: its state moves by a constant, so all come at once."""
    with np.errstate(over="ignore"):
        s = (np.uint32(seed) + np.arange(1, n + 1, dtype=np.uint64).astype(np.uint32) * np.uint32(STEP)).astype(np.uint32)
        v = (s ^ (s >> np.uint32(15))) * (s | np.uint32(1))
        v = v ^ (v + (v ^ (v >> np.uint32(7))) * (v | np.uint32(61)))
        return (v ^ (v >> np.uint32(14))).astype(np.float64) / 4294967296.0


def _seed(key: Column) -> Column:
    """``seed_of`` as a column."""
    units = F.hex(F.encode(key, "UTF-16BE"))
    each = F.transform(F.sequence(F.lit(0), F.floor(F.length(units) / 4).cast("int") - 1), lambda i: F.conv(F.substring(units, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    fold = lambda h, u: F.pmod(h.bitwiseXOR(u) * FNV_PRIME, F.lit(1 << 32))
    return F.when(F.length(units) > 0, F.aggregate(each, F.lit(FNV_START).cast("long"), fold)).otherwise(F.lit(FNV_START).cast("long"))


def _times(a: Column, b: Column) -> Column:
    """The product of two numbers below 2^32, modulo 2^32: in halves, so that none is larger than a long."""
    high, low = F.shiftrightunsigned(a, 16), a.bitwiseAND(F.lit(0xFFFF))
    return (low * b + F.shiftleft((high * b).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def intervals(units: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """(key, lower, upper) of units (key, name, at, n, value, weight): the percentile interval of the resampled mean of the values, or, where weights are given, of one minus the ratio of the two sums, in percent.

    ``at`` numbers the n units of a key from 0, ``name`` seeds its draws. Every unit makes one draw of each resample, told by
    its place alone; how often a resample takes a unit is counted, joined with the unit and summed. No key is gathered but
    for its resamples' results, two thousand numbers. Results that aren't finite are left out; without any, nulls.
    """
    drawn = units.withColumn("seed", _seed(F.col("name"))).select("key", "n", "seed", "at", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    # the draws are made of plain columns, or each step would be spelled out in the next one's text many times
    state = drawn.select("key", "n", "r", (F.col("seed") + F.pmod(F.col("r").cast("long") * F.col("n") + F.col("at") + 1, F.lit(1 << 32)) * STEP).bitwiseAND(F.lit(0xFFFFFFFF)).alias("s"))
    first = state.select("key", "n", "r", _times(F.col("s").bitwiseXOR(F.shiftrightunsigned("s", 15)), F.col("s").bitwiseOR(F.lit(1))).alias("v"))
    second = first.select("key", "n", "r", F.col("v").bitwiseXOR((F.col("v") + _times(F.col("v").bitwiseXOR(F.shiftrightunsigned("v", 7)), F.col("v").bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(0xFFFFFFFF))).alias("v"))
    picks = second.select("key", "r", F.floor(F.col("v").bitwiseXOR(F.shiftrightunsigned("v", 14)) / F.lit(float(1 << 32)) * F.col("n")).alias("at"))
    taken = picks.groupBy("key", "r", "at").agg(F.count("*").alias("times"))
    own = units.select("key", "at", "value", "weight")
    met = taken.join(own, taken["key"].eqNullSafe(own["key"]) & (taken["at"] == own["at"])).select(taken["key"], "r", "times", "value", "weight")
    sums = met.groupBy("key", "r").agg(F.sum(F.col("times") * F.col("value")).alias("value"), F.sum(F.col("times") * F.col("weight")).alias("weight"), F.sum("times").alias("times"), F.count("weight").alias("weighted"))
    result = F.when(F.col("weighted") == 0, F.col("value") / F.col("times")).when(F.col("weight") != 0, (1 - F.col("value") / F.col("weight")) * 100)
    ranked = sums.select("key", result.alias("e")).where("e is not null and not isnan(e)")
    whole = ranked.groupBy("key").agg(F.array_sort(F.collect_list("e")).alias("es"))  # a number for each resample
    size, tail = F.size("es"), (1 - LEVEL) / 2
    low, high = F.greatest(F.lit(0), F.floor(tail * size)), F.least(size - 1, F.ceil((1 - tail) * size) - 1)
    return whole.select("key", F.round(F.get("es", low.cast("int")), 6).alias("lower"), F.round(F.get("es", high.cast("int")), 6).alias("upper"))


def bootstrap(rows: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """(key, n, mean, lower, upper): the interval of each key's mean, seeded by the key, its units taken in order."""
    units = numbered(rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]), ["key"], [f"_o{i}" for i in range(len(order))])
    units = written(units.select("key", F.coalesce(F.col("key").cast("string"), F.lit("")).alias("name"), "at", "n", "value", F.lit(None).cast("double").alias("weight")))
    means = units.groupBy("key").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    found = intervals(units).withColumnRenamed("key", "_k")
    return means.join(found, means["key"].eqNullSafe(found["_k"]), "left").select(F.col("key").alias(key), "n", "mean", "lower", "upper")


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def f1_grades(expected: DataFrame, actual: DataFrame, task: str = "task", finding: str = "finding") -> DataFrame:
    """(task, matched, expected, unexpected, score, passed): the harmonic mean of precision and recall of each task's distinct findings, compared in normal form."""
    shape = lambda df, flag: df.select(task, grading_text(F.col(finding)).alias("f")).distinct().withColumn(flag, F.lit(1))
    both = shape(expected, "e").join(shape(actual, "a"), [task, "f"], "full_outer")
    one = both.groupBy(task).agg(F.count(F.when(F.col("e").isNotNull(), F.col("a"))).alias("matched"), F.count("e").alias("expected"), F.count(F.when(F.col("e").isNull(), F.col("a"))).alias("unexpected"))
    one = one.where("expected > 0")
    score = F.when(F.col("matched") == 0, 0.0).otherwise(2 * F.col("matched") / (F.col("expected") + F.col("matched") + F.col("unexpected")))
    return one.select(task, "matched", "expected", "unexpected", score.alias("score"), ((F.col("matched") == F.col("expected")) & (F.col("unexpected") == 0)).alias("passed"))


def fact_grades(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """(task, matched, facts, score): facts (task, fact, aliases) of which the task's answer (task, answer) holds one alias, in normal form."""
    rows = facts.join(answers.select("task", grading_text(F.col("answer")).alias("text")), "task", "left")
    hit = F.exists("aliases", lambda a: F.contains(F.coalesce("text", F.lit("")), grading_text(a)))
    return rows.groupBy("task").agg(F.count_if(hit).alias("matched"), F.count("*").alias("facts")).withColumn("score", F.col("matched") / F.col("facts"))


def fix_touches(commits: DataFrame, pattern: str) -> DataFrame:
    """(path, touches): commits (sha, subject, paths) whose subject fits, counted once for each path."""
    return commits.where(F.col("subject").rlike(pattern)).select(F.explode(F.array_distinct("paths")).alias("path")).groupBy("path").agg(F.count("*").alias("touches"))


def precision_at(ranked: DataFrame, relevant: DataFrame, order: Sequence[Column], ks: Sequence[int]) -> DataFrame:
    """(k, hits, precision): of the first k ranked items (path) those that are relevant; of fewer than k, over those there are."""
    from pyspark.sql import Window as W

    first = ranked.orderBy(*order).limit(max(ks)).withColumn("_k", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
    met = first.join(relevant.select("path", F.lit(1).alias("hit")).distinct(), "path", "left")
    cuts = ranked.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    rows = met.join(F.broadcast(cuts), F.col("_k") <= F.col("k"))
    return rows.groupBy("k").agg(F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("precision"))


def arms(trials: DataFrame) -> DataFrame:
    """(model, arm, trials, failed, passed, mean_score, pass_rate, tokens, calls) of trials (task, model, arm, trial, score, passed, failed, tokens, calls), for each model and, with a null model, all of them. A failed trial counts with score 0."""
    score = F.coalesce("score", F.lit(0.0))
    own = trials.withColumn("score", score).cube("model", "arm").agg(F.grouping("arm").alias("ga"), F.grouping("model").alias("gm"), F.count("*").alias("trials"), F.count_if("failed").alias("failed"), F.count_if("passed").alias("passed"), half_up(F.avg("score"), 6).alias("mean_score"), half_up(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"), F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"))
    return own.where("ga = 0").select("model", "arm", "trials", "failed", "passed", "mean_score", "pass_rate", "tokens", "calls")


def paired(trials: DataFrame, baseline: str, treatment: str) -> DataFrame:
    """(task, model, trial, baseline_score, treatment_score, baseline_tokens, treatment_tokens) of units that both arms have."""
    side = lambda arm, name: trials.where(F.col("arm") == arm).select("task", "model", "trial", F.coalesce("score", F.lit(0.0)).alias(f"{name}_score"), F.col("tokens").alias(f"{name}_tokens"))
    return side(baseline, "baseline").join(side(treatment, "treatment"), ["task", "model", "trial"])


def gate(pairs: DataFrame) -> DataFrame:
    """(model, units, delta, lower, upper, token_reduction, token_lower, token_upper, not_worse, better): whether the treatment is no worse, or better, by the bounds of its intervals in points."""
    rows = numbered(pairs.select("task", "model", "trial", (F.col("treatment_score") - F.col("baseline_score")).alias("d"), F.col("treatment_tokens").cast("double").alias("used"), F.col("baseline_tokens").cast("double").alias("base")), ["model"], ["task", "trial"])
    rows = written(rows)
    named = lambda kind: F.concat(F.lit(f"{kind}\0"), F.coalesce("model", F.lit("")))
    deltas = intervals(rows.select(F.col("model").alias("key"), named("accuracy-delta").alias("name"), "at", "n", (F.col("d") * 100).alias("value"), F.lit(None).cast("double").alias("weight")))
    saved = intervals(rows.select(F.col("model").alias("key"), named("token-reduction").alias("name"), "at", "n", F.col("used").alias("value"), F.col("base").alias("weight")))
    own = rows.groupBy("model").agg(F.count("*").alias("units"), F.round(F.avg("d") * 100, 6).alias("delta"), F.when(F.sum("base") != 0, F.round((1 - F.sum("used") / F.nullif(F.sum("base"), F.lit(0.0))) * 100, 6)).alias("token_reduction"))
    out = own.join(deltas.withColumnRenamed("key", "_d"), F.col("model").eqNullSafe(F.col("_d")), "left").drop("_d")
    out = out.join(saved.select(F.col("key").alias("_s"), F.col("lower").alias("token_lower"), F.col("upper").alias("token_upper")), F.col("model").eqNullSafe(F.col("_s")), "left")
    holds = lambda bound: F.coalesce(F.col("lower") >= bound, F.lit(False))
    return out.select("model", "units", "delta", "lower", "upper", "token_reduction", "token_lower", "token_upper", holds(NOT_WORSE).alias("not_worse"), holds(BETTER).alias("better"))


def adoption(trials: DataFrame, tool: str) -> Column:
    """An aggregate: the share of trials (tools: array) that used a tool, null without trials."""
    return F.count_if(F.array_contains("tools", tool)) / F.nullif(F.count("*"), F.lit(0))


def tokens_a_call(trials: DataFrame) -> DataFrame:
    """(arm, tokens_per_call, cache_share): tokens of all calls over their number, and the share of input read from a cache; null without calls."""
    return trials.groupBy("arm").agg((F.sum("input") / F.nullif(F.sum("calls"), F.lit(0))).alias("tokens_per_call"), (F.sum("cached") / F.nullif(F.sum("input"), F.lit(0))).alias("cache_share"))


def todo_duplication(runs: DataFrame) -> DataFrame:
    """(title, n, runs) of titles (run, counts: map of title to number) that come more than once over all runs."""
    return runs.select("run", F.explode("counts").alias("title", "c")).groupBy("title").agg(F.sum("c").alias("n"), F.count_distinct("run").alias("runs")).where("n > 1")


def judged(arms_: DataFrame, baseline: str, treatment: str, margin: float) -> DataFrame:
    """(model, verdict): better, worse or even, as the treatment's mean score differs from the baseline's by more than the margin."""
    side = lambda arm, name: arms_.where(F.col("arm") == arm).select("model", F.col("mean_score").alias(name))
    both = side(baseline, "b").alias("x").join(side(treatment, "t").alias("y"), F.col("x.model").eqNullSafe(F.col("y.model")))
    d = F.col("t") - F.col("b")
    return both.select("x.model", F.when(d > margin, "better").when(d < -margin, "worse").otherwise("even").alias("verdict"))


def levels(snapshot: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(check, value, level) of a one-row snapshot: critical from the upper bound on, warning from the lower one, ok below, unknown for a null; and a row overall with the worst."""
    rank = {"ok": 0, "unknown": 1, "warning": 2, "critical": 3}
    each = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("value"), F.when(F.col(c).isNull(), "unknown").when(F.col(c) >= hi, "critical").when(F.col(c) >= lo, "warning").otherwise("ok").alias("level")) for c, (lo, hi) in bounds.items()])
    rows = snapshot.select(F.explode(each).alias("x")).select("x.*")
    order = F.element_at(F.create_map(*[F.lit(x) for k, v in rank.items() for x in (k, v)]), F.col("level"))
    worst = rows.agg(F.lit("overall").alias("check"), F.lit(None).cast("double").alias("value"), F.max_by("level", order).alias("level"))
    return rows.unionByName(worst)
