"""A trigram index for search: the texts that a query can't find aren't read.

Entries are numbered and written with their texts, dealt to folders by blocks of numbers. Each three characters of a text's
words make a posting: rows (gram, block, sorted places in the block), dealt to folders by a hash of the gram. A frequent gram
has a row for each block, so no row grows with the corpus, and lists are made block by block.

A query's words have grams too. Their folders are read, the lists of a block are intersected, and the entries left are judged by
the exact rule of the search: the grams only rule out. A query whose words all have fewer than three characters has no
gram, and reads all entries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions.words import query_tokens
from tessellar.operators import retrieval
from tessellar.sources.tables import cut

GRAM = 3
BUCKETS = 256
#: Numbers of a block: places in it fit two bytes.
BLOCK = 1 << 15
ENTRY = "number long, id string, path string, title string, search_key string, headings array<string>, tags array<string>, symbols array<string>, block long"
POSTING = "gram string, block long, places array<short>, bucket int"


def grams_of(chars: Column) -> Column:
    """Distinct runs of three of a text's characters, without white space or field marks; linear in the text."""
    runs = F.transform(F.sequence(F.lit(0), F.size(chars) - GRAM), lambda i: F.concat(*[F.get(chars, i + k) for k in range(GRAM)]))
    return F.array_distinct(F.filter(runs, lambda g: ~g.rlike("[\\s\\x01]")))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def write_index(entries: DataFrame, path: str, compose: bool = True, buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """Writes entries (id, path, title, search_key, headings, tags, symbols) and their postings below the path."""
    spark = entries.sparkSession
    own = [c.split()[0] for c in ENTRY.split(", ")[1:-1]]
    # a task numbers its rows from its own start on, so that blocks are runs of one task's rows
    numbered = cut(entries.select(F.monotonically_increasing_id().alias("number"), *own))
    numbered.withColumn("block", F.floor(F.col("number") / block)).repartition("block").write.partitionBy("block").mode("overwrite").parquet(f"{path}/entries")
    texts = numbered.select("number", F.filter(F.split(retrieval.fields_text(compose), ""), lambda c: c != "").alias("_chars")).where(F.size("_chars") >= GRAM)
    postings = texts.select(F.floor(F.col("number") / block).alias("block"), (F.col("number") % block).cast("short").alias("place"), F.explode(grams_of(F.col("_chars"))).alias("gram"))
    rows = postings.groupBy("gram", "block").agg(F.array_sort(F.collect_list("place")).alias("places")).withColumn("bucket", _bucket(F.col("gram"), buckets))
    rows.repartition("bucket").sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    spark.createDataFrame([(buckets, block, compose)], "buckets int, block int, compose boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def query_grams(query: str) -> list[str]:
    """Grams of a query's words."""
    return sorted({t[k : k + GRAM] for t in query_tokens(query) for k in range(len(t) - GRAM + 1)})


def candidates(spark: SparkSession, path: str, grams: Sequence[str], buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """(block, number) of the entries that hold all grams; only folders and row groups that may have them are read."""
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", _bucket(F.col("gram"), buckets).alias("bucket")).collect()  # a query's grams
    rows = spark.read.schema(POSTING).parquet(f"{path}/postings").where(F.col("bucket").isin(sorted({r["bucket"] for r in wanted})) & F.col("gram").isin([r["gram"] for r in wanted]))
    each = rows.groupBy("block").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(wanted))  # a query's grams, each a list of a block
    both = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.get("lists", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    return each.select("block", F.explode(both).alias("place")).select("block", (F.col("block") * block + F.col("place")).alias("number"))


def indexed_search(spark: SparkSession, path: str, edges: DataFrame, query: str, connected: bool = False) -> DataFrame:
    """(id, path, tier, points): the rows that ``retrieval.search`` gives for the entries of the index."""
    settings = spark.read.parquet(f"{path}/settings").first()
    entries = spark.read.schema(ENTRY).parquet(f"{path}/entries")
    grams = query_grams(query)
    some = entries
    if grams:
        found = cut(candidates(spark, path, grams, settings["buckets"], settings["block"]))
        blocks = [r["block"] for r in found.select("block").distinct().limit(10_001).collect()]
        some = entries.where(F.col("block").isin(blocks)) if len(blocks) <= 10_000 else entries
        some = some.join(found, ["block", "number"], "left_semi")
    return retrieval.answer(retrieval.direct_hits(some, query, settings["compose"]), entries, edges, connected)
