"""Connected components of a table of links, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import cut


#: Links that are taken in one task: 16 bytes each, no shuffle. More are dealt out; the rounds are the same.
FEW_LINKS = 100_000


def _star(edges: DataFrame, larger: bool, few: bool) -> DataFrame:
    """Large star: every neighbour above a node is linked to the node's least neighbour. Small star: every one below."""
    one = lambda df: df.coalesce(1) if few else df
    if larger:
        ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        around = edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = around.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = one(joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the least node that it reaches. Loops, repeated links and null ends add nothing.

    Nodes without links are absent. Each round is written to the shared folder; only two counts come to the driver.
    """
    now = cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    seen, n = None, now.count()
    while True:
        few = n <= FEW_LINKS
        now = now.coalesce(1) if few else now
        now = cut(_star(_star(now, True, few), False, few))
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen, n = state, state[0]
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
