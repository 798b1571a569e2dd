"""Line dedup by winnowing: repeated runs of lines go where they come again.

A gram is the shortest run of lines from a line on that has 25 words. Of the grams that start within 25 words of each
line, the one with the least hash is a fingerprint, so every repeated run of whole lines with 50 words shares one, and
every shared one stands for 25 equal words at least. Each fingerprint is joined with its first occurrence only (a star,
no pairs among copies); there the match is extended both ways, line by line, and the later run is deleted. Where a match
ends before the text does, a later place may have more of the run: fingerprints with equal matches and an equal next line
are matched further among themselves, by hashes of 2^j lines for j from the largest down, each group with its first.

Where a document holds one gram at places that overlap or touch, all of it but the first gram is a repeat; only the ends of
such a chain are fingerprints. Two documents are brought together once, whatever they share; their lines are compared
once for each shift between shared fingerprints.

All of it is DataFrame functions. Grouping is by fingerprint with partial aggregates; joins are on keys that Spark can
split where they are skewed; what is gathered for one document is never more than its own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellar.llm.common import written

GRAM_WORDS = 25
#: Keys are of one size, so their broadcast is bounded by rows; runs by rows and spans.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 16 << 20
ROW_BYTES, SPAN_BYTES = 96, 16


def _key(doc_id: Column, text: Column) -> Column:
    """What orders documents: the id (nulls last), then a hash of the text. Rows equal in both are one document."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.xxhash64(text).alias("h"))


def fingerprints(profile: DataFrame, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(k, pos, gram, size): the winnowed grams of rows (k, lines: array of (h, w)) and the lines that each has."""
    lines = profile.select("k", F.posexplode("lines").alias("pos", "line")).select("k", "pos", "line.h", F.greatest("line.w", F.lit(1)).alias("w"))
    by_doc = W.partitionBy("k").orderBy("pos")
    at = lines.withColumn("at", F.sum("w").over(by_doc.rowsBetween(W.unboundedPreceding, -1)))
    at = at.withColumn("at", F.coalesce("at", F.lit(0)).cast("long"))
    ahead = W.partitionBy("k").orderBy("at").rangeBetween(0, gram_words - 1)
    grams = at.withColumn("words", F.sum("w").over(ahead)).withColumn("hs", F.collect_list("h").over(ahead))
    whole = F.when(F.col("words") >= gram_words, F.struct(F.xxhash64("hs").alias("gram"), "pos", F.size("hs").alias("size")))
    return grams.withColumn("whole", whole).withColumn("least", F.min("whole").over(ahead)).where("least is not null").select("k", "least.pos", "least.gram", "least.size").distinct()


def _chains(marks: DataFrame) -> DataFrame:
    """(k, gram, size, low, high): occurrences of one gram in one document that overlap or touch are one chain, from its first to its last."""
    before = F.lag("pos").over(W.partitionBy("k", "gram").orderBy("pos"))
    fresh = marks.withColumn("fresh", (before.isNull() | (F.col("pos") > before + F.col("size"))).cast("int"))
    chain = F.sum("fresh").over(W.partitionBy("k", "gram").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return fresh.withColumn("chain", chain).groupBy("k", "gram", "chain").agg(F.first("size").alias("size"), F.min("pos").alias("low"), F.max("pos").alias("high")).drop("chain")


def _span(start: Column, stop: Column, shift: Column, size: Column) -> Column:
    """Lines to delete of a run whose copy lies ``shift`` lines before in the same document (null: in another one).

    Where the two overlap, the text repeats with that period: the first period stays, and as many lines as a gram has.
    """
    first = F.when(shift < stop - start, F.greatest(start, start - shift + size)).otherwise(start)
    return F.struct(first.cast("int").alias("start"), stop.cast("int").alias("stop"))


def _further(found: DataFrame, arrays: DataFrame) -> DataFrame | None:
    """(k, span): what earlier occurrences other than the first have in common with each match beyond its ends; None where nothing grows.

    A group holds places with equal lines from the fingerprint up to n. In each round those that agree in 2^j lines more
    form a group of their own; the first of each stays behind too, as what the rest of the old group may match in part.
    ``live`` is false where a place has nothing earlier in its group. So a place has one live row, and a group one other.
    ``shift`` tells how far before the earlier place is, null if in another document.
    """
    at = F.struct("k", "pos")
    shift = F.when(F.col("first.k") == F.col("k"), F.col("pos") - F.col("first.pos"))
    ends = F.array(*[F.struct(F.lit(side).alias("side"), F.col(n).alias("n"), F.col(h).alias("h")) for side, n, h in ((1, "n_ahead", "after"), (-1, "n_behind", "before"))])
    rows = found.select("k", "pos", "gram", "size", F.explode(ends).alias("e")).where("e.h is not null")
    rows = written(rows.select("k", "pos", "size", "e.side", (F.col("e.n") + 1).cast("int").alias("n"), F.xxhash64("gram", "e.side", "e.n", "e.h").alias("g")), "ends")
    first = rows.groupBy("g").agg(F.min(at).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    rows = written(rows.join(first, "g").select("k", "pos", "size", "side", "n", "g", (at != F.col("first")).alias("live"), shift.alias("shift")), "ends")
    keys = rows.select("k").distinct()
    few = keys.limit(BROADCAST_ROWS + 1).count()
    if not few:
        return None
    arrays = written(arrays.join(F.broadcast(keys) if few <= BROADCAST_ROWS else keys, "k", "left_semi"), "ends-lines")
    longest = arrays.agg(F.max(F.size("own"))).first()[0]
    carried = ("pos", "size", "side", "n", "g", "live", "shift")
    for j in reversed(range(longest.bit_length())):
        size = 1 << j
        begin = lambda m: F.when(m["side"] > 0, m["pos"] + m["n"]).otherwise(m["pos"] - m["n"] - size)  # noqa: B023, E731
        inside = lambda m: (begin(m) >= 0) & (begin(m) + size <= F.size("own"))  # noqa: B023, E731
        more = lambda m: F.struct(*[m[c].alias(c) for c in carried], F.when(inside(m), F.xxhash64(F.slice("own", begin(m) + 1, size))).alias("h"))  # noqa: B023, E731
        held = rows.groupBy("k").agg(F.collect_list(F.struct(*carried)).alias("ms")).join(arrays, "k")
        held = written(held.select("k", F.explode(F.transform("ms", more)).alias("m")).select("k", "m.*"), "ends-hashes")
        first = held.where("h is not null").groupBy("g", "h").agg(F.min(at).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
        met = held.join(first, ["g", "h"], "left")
        stays = F.struct("n", "g", "live", "shift")
        grown = lambda live, by: F.struct((F.col("n") + size).cast("int").alias("n"), F.xxhash64("g", "h").alias("g"), live.alias("live"), by.alias("shift"))  # noqa: B023, E731
        alone = F.lit(None).cast("int")
        split = F.when(F.col("first").isNull(), F.array(stays)).when(at == F.col("first"), F.array(stays, grown(F.lit(False), alone))).otherwise(F.array(grown(F.col("live"), shift)))
        rows = written(met.select("k", "pos", "size", "side", F.explode(split).alias("r")).select("k", "pos", "size", "side", "r.*"), "ends")
    start, stop = F.when(F.col("side") > 0, F.col("pos")).otherwise(F.col("pos") - F.col("n")), F.when(F.col("side") > 0, F.col("pos") + F.col("n")).otherwise(F.col("pos"))
    return rows.where("live").select("k", _span(start, stop, F.col("shift"), F.col("size")).alias("span"))


def repeated_runs(profile: DataFrame, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(k, spans): for each document with later repeated runs their line numbers, half open."""
    chains = written(_chains(fingerprints(profile, gram_words)), "fingerprints")
    own = chains.where("high > low").select("k", F.struct((F.col("low") + F.col("size")).cast("int").alias("start"), (F.col("high") + F.col("size")).cast("int").alias("stop")).alias("span"))
    marks = chains.select("k", "gram", "size", F.explode(F.array_distinct(F.array("low", "high"))).alias("pos"))
    first = marks.groupBy("gram").agg(F.min(F.struct("k", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = marks.join(first, "gram").where(F.struct("k", "pos") != F.col("first"))
    pairs = pairs.select("k", "gram", "size", "pos", F.col("first.k").alias("f"), (F.col("pos") - F.col("first.pos")).alias("shift"))
    arrays = profile.select("k", F.transform("lines", lambda x: x["h"]).alias("own"))
    # one row for each two documents, so that their lines are brought together once; fingerprints with equal shifts share one comparison
    by_shift = pairs.repartition("k").groupBy("k", "f", "shift").agg(F.collect_list(F.struct("pos", "gram", "size")).alias("ms"))
    both = by_shift.groupBy("k", "f").agg(F.collect_list(F.struct("shift", "ms")).alias("shifts"))
    both = both.join(arrays, "k").join(arrays.select(F.col("k").alias("f"), F.col("own").alias("other")), "f")

    one = both.select("k", "f", "own", "other", F.explode("shifts").alias("s")).select("k", "f", "own", "other", "s.*")
    low, high = F.greatest("shift", F.lit(0)), F.least(F.size("own"), F.size("other") + F.col("shift"))
    apart = F.filter(F.sequence(low, high - 1), lambda i: F.get("own", i) != F.get("other", i - F.col("shift")))
    one = one.select("k", "f", "own", "shift", "ms", low.alias("low"), high.alias("high"), apart.alias("apart"))

    def match(m: Column) -> Column:
        """From the line after the last difference before it to the next difference."""
        stop = F.coalesce(F.array_min(F.filter("apart", lambda i: i > m["pos"])), F.col("high"))
        start = F.coalesce(F.array_max(F.filter("apart", lambda i: i < m["pos"])) + 1, F.col("low"))
        return F.struct(*[m[c].alias(c) for c in ("pos", "gram", "size")], (stop - m["pos"]).alias("n_ahead"), (m["pos"] - start).alias("n_behind"))

    ends = F.get("own", F.col("m.pos") + F.col("m.n_ahead")).alias("after"), F.get("own", F.col("m.pos") - F.col("m.n_behind") - 1).alias("before")
    found = one.select("k", "own", F.when(F.col("f") == F.col("k"), F.col("shift")).alias("shift"), F.explode(F.transform("ms", match)).alias("m"))
    found = written(found.select("k", "shift", "m.*", *ends), "matches")
    start, stop = F.col("pos") - F.col("n_behind"), F.col("pos") + F.col("n_ahead")
    spans = found.select("k", _span(start, stop, F.col("shift"), F.col("size")).alias("span")).unionByName(own)
    further = _further(found, arrays)
    spans = spans if further is None else spans.unionByName(further)
    return spans.groupBy("k").agg(F.collect_set("span").alias("spans"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram_words: int = GRAM_WORDS) -> DataFrame:
    """The rows with later copies of repeated runs of lines deleted from their text, and n_lines and n_removed added.

    Of equal runs the one in the document with the smallest id (null ids last, then by text) and there the earliest stays.
    Of a text that repeats itself with a period, overlapping its own copy, the first period stays, and where that is
    shorter than a gram, a gram's lines from its first fingerprint on: of 40 lines of two words the first 13.
    Rows equal in id and text are one document and get the same text. A null text stays null with 0 lines; a text that
    loses all its lines becomes empty. Columns n_lines and n_removed of the input are replaced.
    """
    docs = docs.drop(*({"n_lines", "n_removed"} - {doc_id, text}))
    names = docs.columns
    i, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    line = F.split(t, "\n")
    profile = docs.where(t.isNotNull()).select(_key(i, t).alias("k"), F.transform(line, lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(r"\S+")).alias("w"))).alias("lines"))
    profile = written(profile.groupBy("k").agg(F.first("lines").alias("lines")), "profile")
    runs = written(repeated_runs(profile, gram_words), "runs")
    n_rows, n_spans = runs.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    few = n_rows * ROW_BYTES + n_spans * SPAN_BYTES <= BROADCAST_BYTES
    rows = docs.select(_key(i, t).alias("_k"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    if few:
        joined = rows.join(F.broadcast(runs), F.col("_k") == F.col("k"), "left")
    else:
        joined = rows.join(runs.hint("shuffle_hash"), F.col("_k") == F.col("k"), "left")
    t = F.col("_row").getField(text)
    lines = F.split(t, "\n")
    kept = F.filter(lines, lambda x, n: ~F.exists("spans", lambda s: (n >= s["start"]) & (n < s["stop"])))
    whole = F.col("spans").isNull()
    n_lines = F.when(t.isNull(), 0).otherwise(F.size(lines))
    joined = joined.select("_row", "spans", F.when(~whole, kept).alias("_kept"))
    return joined.select(
        *[(F.when(whole, t).otherwise(F.array_join("_kept", "\n")) if c == text else F.col("_row").getField(c)).alias(c) for c in names],
        n_lines.cast("long").alias("n_lines"),
        F.when(whole, 0).otherwise(n_lines - F.size("_kept")).cast("long").alias("n_removed"),
    )
