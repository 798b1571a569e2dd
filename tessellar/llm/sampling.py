"""Bounded samples of training rows for the classifiers of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sampled(rows: DataFrame, key: Column, most: int, *groups: str) -> DataFrame:
    """About ``most`` rows, shared evenly among the values of the group columns, chosen by a hash of the key.

    Groups with fewer rows than their share are taken whole; of more than ``most`` groups those with most rows are taken,
    equal ones in their order. One pass counts (with partial sums), one filters. Never more than twice ``most`` rows: where
    repeated keys bring more, those with the least hashes and then values, so a task that runs again finds the same.
    """
    place = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    placed = rows.withColumn("_place", place)
    if groups:
        few = rows.groupBy(*groups).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), *groups).limit(most)
        share = F.greatest(F.lit(1), F.floor(F.lit(most) / F.count("*").over(Window.partitionBy(F.lit(0)))))
        limits = few.select(*[F.col(f"`{g}`").alias(f"_{g}") for g in groups], (share / F.col("_n")).alias("_limit"))
        same = F.lit(True)
        for g in groups:
            same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"`_{g}`"))
        chosen = placed.join(F.broadcast(limits), same).where("_place < _limit")  # at most ``most`` rows of limits
    else:
        chosen = placed.where(F.col("_place") < most / max(1, rows.count()))
    return chosen.orderBy("_place", *rows.columns).limit(2 * most).select(*rows.columns)
