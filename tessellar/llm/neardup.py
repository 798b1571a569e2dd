"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, components.

SuperMinHash (Ertl, 2017) gives each element a random permutation of the m places; at step j the element offers the
value j + r to the place that is j-th in its permutation, and a place keeps the least offer. A text is done as soon as
all its places hold values below the next step, which for long texts is after two or three steps of m.

Texts with equal sets are one class, known by its smallest doc_id. Classes that share a band are candidates:
1. every class is verified against the least class of each of its buckets (a star, never all pairs of a bucket), and
   the verified links give preliminary components;
2. in buckets that still hold several components, the members outside the bucket's largest component are verified
   against eight of its members; what links joins the component;
3. members that are still outside are compared with all of the largest component and with the others outside, in cells
   of bounded size: a task holds one block of members and one of queries and returns only links that join components.
Links inside a component can't change it. Sizes that rule a link out are dropped before the sets are fetched, and the sets
of all candidates are written once.

A pair is found if it shares one of 32 bands of four places. Two texts alike by s share none with probability
(1 - s^4)^32 at most: 5.2e-6 at 0.75, 4.8e-8 at 0.8, below 1e-14 at 0.9 (``missed``); that is the share of borderline
pairs, without a third text that links them, which banding loses. SuperMinHash's places are
correlated; a test measures the share at lower similarities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import NARROW_ROWS, by_bytes, cut, cut_narrow, small_batches, text_buffers, written
from tessellar.llm.components import components
from tessellar.llm.words import find_words, mix, shingles, space_words

SIZE = 5
PLACES = 128
BANDS = 32
PERCENT = 75
CHUNK_BYTES = 500_000
PIVOTS = 8
PIVOT_ROUNDS = 1
CELL_ROWS = 512
CELL_SHINGLES = 250_000
#: Rows of up to 40 bytes that a broadcast may hold.
BROADCAST_ROWS = 200_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def superminhash(elements: np.ndarray, first: np.ndarray, m: int = PLACES) -> np.ndarray:
    """Signatures of texts whose element hashes lie between ``first[d]`` and ``first[d + 1]``; a place is step << 32 | r.

    A text without elements keeps the largest value everywhere.
    """
    n_texts = len(first) - 1
    out = np.full((n_texts, m), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    text, h = np.repeat(np.arange(n_texts), np.diff(first)), elements
    held = None  # permutations so far, for elements of texts that aren't done
    for j in range(m):
        if not len(h):
            break
        x = mix(h + np.uint64(int(_GOLDEN) * (j + 1) % 2**64))
        k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        offer = (x >> np.uint64(32)) | np.uint64(j << 32)
        if held is None:
            place = k
        else:
            rows = np.arange(len(h))
            place = held[rows, k].astype(np.int64)
            held[rows, k] = held[:, j]
        np.minimum.at(flat, text * m + place, offer)
        done = (out < np.uint64((j + 1) << 32)).all(axis=1)
        going = ~done[text]
        if held is None:
            text, h, k = text[going], h[going], k[going]
            held = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(h), 1))
            held[np.arange(len(h)), k] = 0
        elif not going.all():
            text, h, held = text[going], h[going], held[going]
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band, different bands' keys apart."""
    n, m = signatures.shape
    rows = m // bands
    s = signatures[:, : rows * bands].reshape(n, bands, rows)
    h = np.zeros((n, bands), np.uint64) + np.arange(bands, dtype=np.uint64) * _GOLDEN
    for k in range(rows):
        h = mix(h + s[:, :, k])
    return h.view(np.int64)


def missed(similarity: float, bands: int = BANDS, places: int = PLACES) -> float:
    """Probability that two texts of this similarity share no band of independent places."""
    return (1 - similarity ** (places // bands)) ** bands


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    words = find_words(*text_buffers(column), space_words())
    h, first = shingles(words, SIZE)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        s = np.sort(h[a:b])
        yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", CHUNK_BYTES):
        sets = list(shingle_sets(batch.column("text")))
        sizes = np.array([len(s) for s in sets], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        keys = band_keys(superminhash(np.concatenate(sets), first))
        digests = [_digest(s) if len(s) else None for s in sets]
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(digests, pa.binary()), bands], ["id", "n", "digest", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", CHUNK_BYTES):
        sets = list(shingle_sets(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "digest", "shingles"])


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are alike enough."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) * 100 < PERCENT * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each cell that are like its pivot, whose row comes before theirs; no more than the pivot's set is held."""
    cell, pivot = None, None
    for batch in batches:
        a, b = [], []
        for key, i, raw in zip(zip(batch.column("pivot").to_pylist(), batch.column("cell").to_pylist(), strict=True), batch.column("id").to_pylist(), batch.column("shingles"), strict=True):
            s = np.frombuffer(raw.as_buffer(), np.uint64)
            if key != cell:
                cell, pivot = key, s.copy()
            elif _alike(s, pivot):
                a.append(i)
                b.append(key[0])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, pivot b) of class ids, with a's size n, whose full sets are alike enough.

    A pivot's members are dealt to cells of bounded size; each set goes to its cell, a pivot's once for each of its cells.
    """
    pairs = cut(pairs)
    n_pairs = pairs.count()
    pairs = pairs.coalesce(max(1, -(-n_pairs // NARROW_ROWS)))
    sizes = pairs.groupBy("b").agg(F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum("n") / CELL_SHINGLES)).cast("int").alias("cells"))
    several = cut_narrow(sizes.where("cells > 1"), n_pairs // CELL_ROWS + 1)  # the others have one cell
    known = lambda df: df.join(_few(several, several.count()), "b", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    members = known(pairs).select(F.col("b").alias("pivot"), F.pmod(F.xxhash64(F.lit("cell"), "a"), "cells").cast("int").alias("cell"), F.lit(1).alias("place"), F.col("a").alias("id"))
    pivots = known(pairs.select("b").distinct()).select(F.col("b").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(0).alias("place"), F.col("b").alias("id"))
    rows = _with_sets(members.unionByName(pivots), sets).repartition("pivot", "cell").sortWithinPartitions("pivot", "cell", "place")
    return cut(rows.select("pivot", "cell", "id", "shingles").mapInArrow(_compare, "a long, b long"))


def _few(df: DataFrame, n: int) -> DataFrame:
    """A frame of n rows of a few numbers each, broadcast where they are few."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds the sets to narrow rows with an id; where the rows are few, the sets stay where they are read."""
    rows = cut(rows)
    return sets.join(_few(rows, rows.count()), "id")


def _alike_sizes(n1: str, n2: str):
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * PERCENT


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, id, n, label, largest) of the buckets that hold several components; largest is the component with most of its members."""
    named = buckets.select("band", "id", "n").join(labels.withColumnRenamed("node", "id"), "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("label"))
    named = cut(named)
    held = named.groupBy("band", "label").agg(F.count("*").alias("c"))
    mixed = held.groupBy("band").agg(F.max_by("label", F.struct("c", "label")).alias("largest"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    return cut(named.join(mixed, "band"))


def _pivot_pairs(mixed: DataFrame, salt: int) -> DataFrame:
    """Members outside the largest component, each with eight members of it that a hash chooses."""
    chosen = [F.min(F.when(F.col("label") == F.col("largest"), F.struct(F.xxhash64("id", F.lit(salt * PIVOTS + k)).alias("h"), F.col("id").alias("b"), F.col("n").alias("n_b")))).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = mixed.groupBy("band").agg(*chosen).select("band", F.array(*[f"p{k}" for k in range(PIVOTS)]).alias("pivots"))
    pairs = mixed.where("label <> largest").select("band", F.col("id").alias("a"), "n").join(pivots, "band").select("a", "n", F.explode("pivots").alias("p"))
    return pairs.select("a", "p.b", "n", "p.n_b").where(_alike_sizes("n", "n_b")).select("a", "b", "n").distinct()


def _cell_links(members: list[tuple], queries: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links between a cell's queries and members, rows (id, label, set), that join components not joined before."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    sizes = np.array([len(s) for *_, s in members])
    flat, owner = np.concatenate([s for *_, s in members]), np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i, label, s in queries:
        low, high = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        c = high - low
        at = np.repeat(low - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        both = np.bincount(owner[at], minlength=len(members))
        for m in np.flatnonzero(100 * both >= PERCENT * (len(s) + sizes - both)).tolist():
            x, y = root(label), root(members[m][1])
            if x != y:
                above[x] = y
                yield i, members[m][0]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each cell; the rows of a cell come one after the other."""
    held: list[tuple] = []
    cell = None

    def found() -> Iterator[pa.RecordBatch]:
        members, queries = [r[1:] for r in held if r[0]], [r[1:] for r in held if not r[0]]
        if members and queries and (links := list(_cell_links(members, queries))):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("kind", "key", "i", "j")), strict=True)
        values = zip(*(batch.column(c).to_pylist() for c in ("member", "id", "label")), batch.column("shingles"), strict=True)
        for key, (member, i, label, raw) in zip(keys, values, strict=True):
            if key != cell:
                yield from found()
                held, cell = [], key
            held.append((member, i, label, np.frombuffer(raw.as_py(), np.uint64)))
    yield from found()


def _cell_rows(mixed: DataFrame, buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(kind, key, i, j, member, id, label): members and queries of every cell, dealt to blocks.

    A component that is the largest of some bucket meets the members outside it (kind 0, once however many buckets they
    share), and the members outside meet each other bucket by bucket (kind 1).
    """
    outside = mixed.where("label <> largest")
    queries = outside.select(F.lit(0).alias("kind"), F.col("largest").alias("key"), "id", "n", "label").distinct()
    large = queries.select("key").distinct()
    own = buckets.select("id", "n").distinct().join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", "n", F.coalesce("component", "id").alias("label"))
    members = own.join(large.withColumnRenamed("key", "label"), "label", "left_semi").select(F.lit(0).alias("kind"), F.col("label").alias("key"), "id", "n", "label")
    apart = outside.select(F.lit(1).alias("kind"), F.col("band").alias("key"), "id", "n", "label")
    several = apart.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    apart = apart.join(several, "key", "left_semi")
    members, queries = cut(members.unionByName(apart)), cut(queries.unionByName(apart))
    blocks = lambda df, name: df.groupBy("kind", "key").agg(F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum("n") / CELL_SHINGLES)).cast("int").alias(name))
    sizes = cut(blocks(members, "rows").join(blocks(queries, "columns"), ["kind", "key"]))
    part = lambda n: F.pmod(F.xxhash64(F.lit("cell"), "id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    m = members.join(sizes, ["kind", "key"]).select("kind", "key", part("rows").alias("i"), every("columns").alias("j"), F.lit(True).alias("member"), "id", "label")
    q = queries.join(sizes, ["kind", "key"]).select("kind", "key", every("rows").alias("i"), part("columns").alias("j"), F.lit(False).alias("member"), "id", "label")
    return m.unionByName(q)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Words are parted by white space and A-Z is lower-cased; a text's set has its runs of five words, or all words as
    one run where there are fewer. Null, empty and wordless texts have an empty set and link with nothing. Two texts
    link if 100 times the common shingles are at least 75 times all. Rows that repeat a doc_id are one node; a row with
    a null doc_id takes no part, has a null component and is kept.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    signed = written(rows.mapInArrow(_sign, "id long, n long, digest binary, bands array<long>"), "signed")
    nodes = signed.where("id is not null and n > 0")
    classes = written(nodes.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    entries = classes.select("id", "n", F.explode("bands").alias("band"))
    least = entries.groupBy("band").agg(F.min("id").alias("pivot"), F.min_by("n", "id").alias("pivot_n"), F.count("*").alias("size")).where("size > 1").drop("size")
    buckets = written(entries.join(least, "band"), "buckets")

    wanted = cut(buckets.select("id").distinct().join(classes.select("id", "digest"), "id"))
    wanted_ = _few(wanted, wanted.count())
    known = rows.where("id is not null").join(wanted_.select("id"), "id", "left_semi")
    sets = known.mapInArrow(_sets, "id long, digest binary, shingles binary").join(wanted_, ["id", "digest"], "left_semi")
    if not nodes.groupBy("id", "digest").count().where("count > 1").isEmpty():  # repeated rows
        sets = sets.dropDuplicates(["id", "digest"])
    sets = written(sets.select("id", "shingles"), "shingles")

    star = buckets.where("id <> pivot").where(_alike_sizes("n", "pivot_n")).select(F.col("id").alias("a"), F.col("pivot").alias("b"), "n").distinct()
    labels = cut(components(_verified(star, sets)))
    for salt in range(PIVOT_ROUNDS):
        more = _verified(_pivot_pairs(_mixed(buckets, labels), salt), sets)
        labels = cut(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
    cells = _with_sets(_cell_rows(_mixed(buckets, labels), buckets, labels), sets)
    dealt = cells.repartition("kind", "key", "i", "j").sortWithinPartitions("kind", "key", "i", "j", "id")
    rest = dealt.select("kind", "key", "i", "j", "member", "id", "label", "shingles").mapInArrow(_cells, "a long, b long")

    copies = nodes.join(classes.select("digest", F.col("id").alias("class_id")), "digest").where("id <> class_id").select(F.col("id").alias("a"), F.col("class_id").alias("b")).distinct()
    final = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest).unionByName(copies))
    out = signed.select("id", "n").join(final.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
