"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents are counted into cells (one value of each dimension), so everything that iterates works on the cell table.
Each round multiplies the cells' tokens by target share over present share, one dimension after the other, until every
margin holds. A cell's ratio of raked to own tokens, times the scale that spends the token budget, is the inclusion
probability of its documents, at most 1; the weight of a sampled document is what keeps the raked margins exact.

Only DataFrame functions are used. Shares of a dimension are sums with partial aggregates joined back to the cells; to
the driver come counts, sums and one deviation a round.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.llm.common import cut

ROUNDS = 30
TOLERANCE = 1e-9
FEW_CELLS = 20_000
ROUNDS_A_JOB = 5
#: What the sampling draw is salted with.
SALT = "mix"


def draw(doc_id: Column, salt: str = SALT) -> Column:
    """A number from 0 to 1 (exclusive) that the id fixes; a null id draws as the empty text."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def n_tokens(text: Column) -> Column:
    """Words parted by white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A stand-in for a topic model, coarse, by form only: licence lines, e-mail addresses, tables, all others."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains("Licensed under"), "licence")
        .when(t.rlike(r"[0-9]@[a-z0-9]+\."), "contact")
        .when(t.contains(" | "), "table")
        .otherwise("prose")
    )


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share): a dimension's tokens raised to the power. Values without tokens have none."""
    own = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    return own.select("value", F.pow("t", F.lit(power)).alias("share"))


def _held(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _with_sums(rows: DataFrame, name: str, few: bool) -> DataFrame:
    """Adds _sum, the raked tokens of all cells with the row's value: by a window in the one partition of a small table, else by partial sums joined back."""
    if few:
        return rows.withColumn("_sum", F.sum("raked").over(Window.partitionBy(name)))
    sums = rows.groupBy(F.col(name).alias("_v")).agg(F.sum("raked").alias("_sum"))
    return rows.join(sums, rows[name].eqNullSafe(F.col("_v"))).drop("_v")


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds raked (tokens after fitting, their sum kept) to cells of unique dimension values with a column tokens.

    Values that a dimension's targets leave out, or with share null, zero or less, get nothing, as does a cell without
    tokens. Repeated target rows of a value add up. Shares are taken over the values that have tokens, in proportion; if
    targets and cells share no value, all is 0.
    """
    few = cells.count() <= FEW_CELLS
    now = cells.withColumn("raked", F.col("tokens").cast("double"))
    for k, (name, goal) in enumerate(targets.items()):
        present = cells.where("tokens > 0").select(F.col(name).alias("_p")).distinct()
        goal = goal.where("share > 0").groupBy("value").agg(F.sum("share").alias("share"))
        goal = goal.join(_held(present, few), F.col("value").eqNullSafe(F.col("_p")), "left_semi")
        whole_share = goal.agg(F.sum("share")).first()[0] or 1.0
        goal = goal.select(F.col("value").alias("_v"), (F.col("share") / F.lit(whole_share)).alias(f"_share{k}"))
        now = now.join(_held(goal, few), now[name].eqNullSafe(F.col("_v")), "left").drop("_v")
    now = cut(now.coalesce(1) if few else now)
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    done, moved = 0, float("inf")
    while done < rounds and moved > tolerance * max(whole, 1.0):
        for _ in range(min(ROUNDS_A_JOB, rounds - done)):  # tested after the same rounds whatever the size
            done += 1
            now = now.withColumn("_before", F.col("raked"))
            for k, name in enumerate(targets):
                share = F.col(f"_share{k}") * F.lit(whole) / F.col("_sum")
                now = _with_sums(now, name, few).withColumn("raked", F.when(F.col("_sum") > 0, F.coalesce(F.col("raked") * share, F.lit(0.0))).otherwise(0.0)).drop("_sum")
                now = now if few else cut(now)
        now = cut(now.coalesce(1)) if few else now
        moved = now.agg(F.max(F.abs(F.col("raked") - F.col("_before")))).first()[0] or 0.0
    if moved > tolerance * max(whole, 1.0):
        warnings.warn(f"after {done} rounds cells still move by {moved:.3g} of {whole:.3g} tokens: the margins don't hold", stacklevel=2)
    return now.select(*cells.columns, "raked")


def scale_for(cells: DataFrame, rate: float) -> float:
    """The factor at which min(1, factor * raked / tokens) of all tokens make this share of those that can be had.

    Newton's method on a concave line of pieces: it climbs to the root in as many steps as pieces it meets.
    """
    own = cells.where("tokens > 0 and raked > 0")
    whole, raked = own.agg(F.sum("tokens"), F.sum("raked")).first()
    if not whole:
        return 0.0
    scale = rate * whole / raked
    for _ in range(100):
        full = F.col("raked") * F.lit(scale) >= F.col("tokens")
        spent, left = own.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(~full, F.col("raked")))).first()
        if not left:
            break
        after = (rate * whole - spent) / left
        if after <= scale * (1 + 1e-12):
            break
        scale = after
    return scale


def mix(docs: DataFrame, dimensions: Mapping[str, Column], tokens: Column, doc_id: str = "doc_id", targets: Mapping[str, DataFrame] | None = None, power: float = 0.7, rate: float = 0.8, rounds: int = ROUNDS) -> DataFrame:
    """Adds the dimensions, n_tokens, probability, weight and sampled to every row.

    ``targets`` has (value, share) for each dimension; one without targets is tempered with ``power``. Rows with equal ids
    draw alike. A row whose cell gets nothing has probability 0 and null weight. A row without tokens costs nothing; it is
    sampled like its cell, with probability 1 where the whole cell has no tokens. A null dimension value is a value of
    its own. Columns of the added names that the input has are replaced. If the margins don't hold after all rounds (targets
    that contradict each other, or empty cells), a warning says how far cells still move.
    """
    if clash := {"n_tokens", "probability", "weight", "sampled"} & set(dimensions):
        raise ValueError(f"a dimension can't have the name of a column that is added: {sorted(clash)}")
    names = list(dimensions)
    added = [*names, "n_tokens", "probability", "weight", "sampled"]
    keep = [c for c in docs.columns if c not in added or c == doc_id]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row")
    inner = {n: f"_d{i}" for i, n in enumerate(names)}
    parts = [*[c.cast("string").alias(inner[n]) for n, c in dimensions.items()], tokens.cast("long").alias("n_tokens")]
    counted = docs.select(*parts).groupBy(*inner.values()).agg(F.sum("n_tokens").alias("tokens"))
    cells = cut(counted)
    goals = {d: targets[n] if targets and n in targets else tempered(cells, d, power) for n, d in inner.items()}
    raked = rake(cells, goals, rounds)
    scale = scale_for(raked, rate)
    ratio = F.col("raked") / F.col("tokens") * F.lit(scale)
    p = F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), ratio))
    w = F.when(F.col("tokens") == 0, F.lit(1.0)).when(p > 0, ratio / p)
    few = raked.count() <= FEW_CELLS
    rates = raked.select(*[F.col(d).alias(f"_{d}") for d in inner.values()], p.alias("probability"), w.alias("weight"))
    rows = docs.select(row, *parts)
    same = F.lit(True)
    for d in inner.values():
        same = same & F.col(d).eqNullSafe(F.col(f"_{d}"))
    joined = rows.join(_held(rates, few), same, "left")
    chosen = draw(F.col("_row").getField(doc_id)) < F.col("probability")
    shown = {**{n: F.col(d) for n, d in inner.items()}, "n_tokens": F.col("n_tokens"), "probability": F.col("probability"), "weight": F.col("weight"), "sampled": chosen}
    return joined.select(*[F.col("_row").getField(c).alias(c) for c in keep], *[c.alias(n) for n, c in shown.items() if n != doc_id])
