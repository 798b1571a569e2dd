"""Benchmark decontamination with an FM-index of each shard of the training texts.

A shard is a run of rows of about a million words. Its index holds the Burrows-Wheeler transform of the shard's word
ids in a wavelet tree with rank counts, and suffix positions sampled at every 32nd word. Test windows are searched
backward, all together, one rank step per word; the occurrences of those that are found are located by walking to the
next sampled position, and their word spans are merged per text. Words that no window holds end a suffix: each counts
as a symbol of its own, lower than all others, ordered by position, so ranges and walks never cross one.

Windows are made in tasks, a block of bounded size each, and written; the driver holds one block at a time, as bytes. Up to
eight blocks pass over a text in one stage, so rows meet no shuffle; more of them take more stages, the marks written
between, and what a stage broadcast is released.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar.llm.common import by_bytes, small_batches, text_buffers, written
from tessellar.llm.words import find_words, item_words

WINDOW = 10
SHARD_BYTES = 3_000_000
SAMPLE = 32
#: Bytes of benchmark texts in a block, and blocks that pass in one stage.
BLOCK_BYTES = 4_000_000
BLOCKS_A_STAGE = 8


@dataclass
class Windows:
    """The distinct windows as places in a sequence of vocabulary ids (short items are right-aligned, 0 before them), with the items that hold them."""

    vocabulary: np.ndarray  # sorted word hashes; id k + 1 is the k-th
    sequence: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    names: list[str]
    held: np.ndarray  # items of window k: names[held[k]] for k from first[k] to first[k + 1]
    first: np.ndarray
    size: int

    def items(self, window: int) -> list[str]:
        return [self.names[i] for i in self.held[self.first[window] : self.first[window + 1]]]


def _classes(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` ids, equal for equal runs only, by doubling; those that reach beyond the end are of no use."""
    part, out, done = ids.astype(np.int64), None, 0
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            if out is None:
                out, done = part, 1 << bit
            else:
                out, done = _paired(out, part, done), done + (1 << bit)
        part = _paired(part, part, 1 << bit)
    return out


def _paired(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """A number for each pair of a and what b has so many places on."""
    after = np.zeros_like(a)
    after[: max(0, len(a) - shift)] = b[shift:]
    return np.unique(a * (int(b.max(initial=0)) + 1) + after, return_inverse=True)[1].astype(np.int64)


def make_windows(items: Sequence[str], texts: pa.Array, size: int = WINDOW) -> Windows:
    """Windows of texts without nulls and the items they belong to: runs of ``size`` words, all words of shorter items."""
    words = find_words(*text_buffers(texts), item_words())
    vocabulary, ids = np.unique(words.hashes, return_inverse=True)
    counts = words.counts.astype(np.int64)
    space = np.where(counts > 0, np.maximum(counts, size), 0)
    ends = np.cumsum(space)
    sequence = np.zeros(int(space.sum()), np.int32)
    owner = np.repeat(np.arange(len(counts)), counts)
    sequence[np.arange(len(ids)) + (ends - np.cumsum(counts))[owner]] = ids + 1
    n_starts = np.where(counts > 0, space - size + 1, 0)
    item = np.repeat(np.arange(len(counts)), n_starts)
    starts = np.arange(int(n_starts.sum())) + ((ends - space) - (np.cumsum(n_starts) - n_starts))[item]
    if not len(starts):
        return Windows(vocabulary, sequence, starts, starts, [], starts, np.zeros(1, np.int64), size)
    _, at, window = np.unique(_classes(sequence, size)[starts], return_index=True, return_inverse=True)
    names, own = np.unique(np.array([str(i) for i in items]), return_inverse=True)
    both = np.unique(window.astype(np.int64) * len(names) + own[item])
    first = np.searchsorted(both // len(names), np.arange(len(at) + 1))
    return Windows(vocabulary, sequence, starts[at], np.minimum(counts, size)[item[at]], names.tolist(), (both % len(names)).astype(np.int32), first, size)


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each block's items, which come one after the other, as one row a block."""
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        windows = make_windows(rows["item_id"].to_pylist(), rows["text"].combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(windows)], pa.binary())], ["windows"])

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if held and held[0].column("block")[0].as_py() != int(blocks[a]):
                yield block()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield block()


class WaveletTree:
    """Ranks in a sequence of ids below 2^levels, one bit vector for each level (a wavelet matrix)."""

    def __init__(self, ids: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.zeros, self.ones = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (ids >> level) & 1
            count = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(ids) - int(count[-1]))
            ids = np.concatenate([ids[bit == 0], ids[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        low = np.zeros_like(at)
        for k, (count, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((symbols >> (self.levels - 1 - k)) & 1) == 1
            a, l = count[at], count[low]
            at = np.where(one, zeros + a, at - a)
            low = np.where(one, zeros + l, low - l)
        return at - low


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling; each 0 is a symbol of its own, the earlier the lower."""
    n = len(ids)
    breaks = np.flatnonzero(ids == 0)
    rank = ids + len(breaks)
    rank[breaks] = np.arange(len(breaks))
    order = np.argsort(rank, kind="stable")
    open_, step = np.flatnonzero(ids), 1
    # rank becomes the first place of the suffix's class in the order
    sorted_ = rank[order]
    fresh = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    place = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = place
    size = np.diff(np.append(np.flatnonzero(fresh), n))
    open_ = order[np.repeat(size > 1, size)]  # in order, classes side by side
    while len(open_):
        # an open suffix has no break among its first `step` symbols, so position + step is inside (the last id is a break)
        key = rank[open_] * np.int64(n + 1) + rank[open_ + step]
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        base = rank[open_]
        new_class = np.concatenate([[True], base[1:] != base[:-1]])
        start = np.maximum.accumulate(np.where(new_class, np.arange(len(open_)), 0))
        order[base + np.arange(len(open_)) - start] = open_
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))
        rank[open_] = base + first - start
        size = np.diff(np.append(np.flatnonzero(fresh), len(open_)))
        open_ = open_[np.repeat(size > 1, size)]
        step *= 2
    return order


class FMIndex:
    """Counts and locates runs of ids in a sequence whose zeros no run may cross; the last id must be 0."""

    def __init__(self, ids: np.ndarray):
        order = suffix_order(ids)
        before = ids[order - 1]
        before[order == 0] = 0
        top = int(ids.max())
        self.before, self.tree = before, WaveletTree(before, top)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=top + 1))])
        self.n, self.top = len(ids), top
        # every 32nd position is sampled, and every one after a 0, as no walk crosses a 0
        self.sampled = (order % SAMPLE == 0) | (before == 0)
        self.at = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def _back(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.below[symbols] + self.tree.rank(symbols, rows)

    def search(self, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of the windows that occur, with the ranges of their suffixes."""
        here = np.diff(self.below) > 0
        here[0] = True
        missing = np.concatenate([[0], np.cumsum(~here[np.minimum(windows.sequence, self.top)] | (windows.sequence > self.top))])
        live = np.flatnonzero(missing[windows.starts] == missing[windows.starts + windows.size])
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for k in range(windows.size):
            moving = windows.lengths[live] > k
            symbols = windows.sequence[windows.starts[live] + windows.size - 1 - k].astype(np.int64)
            low = np.where(moving, self._back(symbols, low), low)
            high = np.where(moving, self._back(symbols, high), high)
            some = low < high
            live, low, high = live[some], low[some], high[some]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at these rows."""
        out = np.zeros(len(rows), np.int64)
        steps, which = 0, np.arange(len(rows))
        while len(which):
            done = self.sampled[rows]
            out[which[done]] = self.positions[self.at[rows[done]]] + steps
            which, rows = which[~done], rows[~done]
            rows = self._back(self.before[rows], rows)
            steps += 1
        return out


def find_hits(words, windows: Windows) -> tuple[np.ndarray, list[set[str]]]:
    """Of a shard's words: which are hit; and the items that each text holds."""
    n_texts, n = len(words.first) - 1, len(words.hashes)
    hit, items = np.zeros(n + 1, np.int64), [set() for _ in range(n_texts)]
    if not n or not len(windows.starts):
        return hit[:n] > 0, items
    v = windows.vocabulary
    at = np.minimum(np.searchsorted(v, words.hashes), len(v) - 1)
    ids = np.where(v[at] == words.hashes, at + 1, 0)
    ends_text = np.zeros(n, bool)
    ends_text[words.first[1:][words.counts > 0] - 1] = True
    # runs of unknown words become one break; a break also follows each text
    known = ids > 0
    keep = known | np.concatenate([[True], known[:-1]])
    where = np.flatnonzero(keep)
    sequence, source = ids[keep], where
    cut = np.flatnonzero(ends_text[source] & (sequence > 0)) + 1
    sequence, source = np.insert(sequence, cut, 0), np.insert(source, cut, -1)
    if sequence[-1] != 0:
        sequence, source = np.append(sequence, 0), np.append(source, -1)
    if not sequence.any():
        return hit[:n] > 0, items
    index = FMIndex(sequence)
    live, low, high = index.search(windows)
    count = high - low
    total = int(count.sum())
    if total:
        window = np.repeat(live, count)
        rows = np.repeat(low, count) + np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        start = source[index.locate(rows)]
        np.add.at(hit, start, 1)
        np.add.at(hit, start + windows.lengths[window], -1)
        text = np.searchsorted(words.first, start, "right") - 1
        for t, w in np.unique(np.stack([text, window], 1), axis=0).tolist():
            items[t].update(windows.items(w))
    return np.cumsum(hit[:n]) > 0, items


SPANS = "array<struct<start:bigint,stop:bigint>>"


def _cut(data: np.ndarray, start: int, stop: int, gone: list[tuple[int, int]]) -> str:
    """The UTF-8 text from start to stop without some ranges of bytes."""
    edges = [start, *(x for g in gone for x in g), stop]
    return b"".join(data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8")


def _pass(text: str, blocks: list, schema: T.StructType, first: bool, clean: bool):
    """Marks the hits of some blocks of windows; a later stage adds to the columns of the earlier ones. With ``clean`` the text comes back without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        windows = [pickle.loads(b.value) for b in blocks]
        for batch in by_bytes(batches, text, SHARD_BYTES):
            data, ends = text_buffers(batch.column(text))
            words = find_words(data, ends, item_words())
            hit, items = np.zeros(len(words.hashes), bool), [set() for _ in range(batch.num_rows)]
            for w in windows:
                more, found = find_hits(words, w)
                hit |= more
                for own, new in zip(items, found, strict=True):
                    own.update(new)
            if not first:
                for t, (old, had) in enumerate(zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist(), strict=True)):
                    items[t].update(had)
                    for s in old:
                        hit[words.first[t] + s["start"] : words.first[t] + s["stop"]] = True
            # runs of hit words; none crosses texts, so a text's first word begins one
            before, after = np.concatenate([[False], hit[:-1]]), np.concatenate([hit[1:], [False]])
            heads = words.first[:-1][words.counts > 0]
            before[heads], after[heads[1:] - 1] = False, False
            a, b = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for t, x, y in zip((np.searchsorted(words.first, a, "right") - 1).tolist(), a.tolist(), b.tolist(), strict=True):
                spans[t].append({"start": x - int(words.first[t]), "stop": y - int(words.first[t])})
            columns = [batch.column(f.name) for f in schema.fields if f.name not in ("_spans", "_items", "_words")]
            if clean and len(a):
                at = [f.name for f in schema.fields].index(text)
                texts = columns[at].to_pylist()
                for t in np.unique(np.searchsorted(words.first, a, "right") - 1).tolist():
                    texts[t] = _cut(data, int(ends[t]), int(ends[t + 1]), [(int(words.starts[words.first[t] + s["start"]]), int(words.ends[words.first[t] + s["stop"] - 1])) for s in spans[t]])
                columns[at] = pa.array(texts, pa.string())
            columns += [
                pa.array(words.counts, pa.int64()),
                pa.array(spans, out_schema.field("_spans").type),
                pa.array([sorted(i) for i in items], pa.list_(pa.string())).cast(out_schema.field("_items").type),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES, carry: Sequence[str] | None = None, clean: bool = False) -> DataFrame:
    """Adds n_words, n_hit, spans (merged runs of hit words, half open) and items (ids as strings, sorted) to every row.

    A null or wordless text has no words, no hits and no items. Repeated rows get the same result. Items of null text or
    id, and wordless ones, have no window; with no items nothing is hit. Input columns of the added names are replaced.
    ``carry`` names the input columns to return (all of them if None); a text that isn't carried doesn't leave the tasks.
    With ``clean`` the text comes back without its spans, as ``remove_contamination`` gives it, from the same Python workers.
    """
    added = ["n_words", "n_hit", "spans", "items"]
    carried = docs.columns if carry is None else list(carry)
    keep = [c for c in docs.columns if c == text or c in carried and c not in added]
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("text is not null and item_id is not null")
    spark, out = docs.sparkSession, docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)])
    small_batches(spark)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))).repartition("block").sortWithinPartitions("block")
    made = written(dealt.select("block", "item_id", "text").mapInArrow(_made, "windows binary"), "windows")
    column = f"_c{keep.index(text)}"
    fields = out.schema.fields
    marks = [T.StructField("_words", T.LongType()), *T._parse_datatype_string(f"_spans {SPANS}, _items array<string>").fields]
    stages = max(1, -(-made.count() // BLOCKS_A_STAGE))
    rows = made.toLocalIterator()  # a partition, of a block or a few, at a time
    for k in range(stages):
        held = [spark.sparkContext.broadcast(bytes(r["windows"])) for _, r in zip(range(BLOCKS_A_STAGE), rows, strict=False)]
        last = k == stages - 1
        schema = T.StructType([*(f for f in fields if not last or f.name != column or text in carried), *marks])
        out = out.mapInArrow(_pass(column, held, schema, k == 0, clean and last), schema)
        if not last:
            out = written(out, "marks")
            for b in held:
                b.destroy()
    hits = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep) if c in carried],
        *[c for n, c in (("n_words", F.col("_words").alias("n_words")), ("n_hit", hits.alias("n_hit")), ("spans", F.col("_spans").alias("spans")), ("items", F.col("_items").alias("items"))) if n != text],
    )


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, cuts in zip(text, spans, strict=True):
        if t is not None and len(cuts):
            data = np.frombuffer(t.encode("utf-8"), np.uint8)
            words = find_words(data, np.array([0, len(data)]), item_words())
            t = _cut(data, 0, len(data), [(int(words.starts[c["start"]]), int(words.ends[c["stop"] - 1])) for c in cuts])
        out.append(t)
    return pd.Series(out, dtype=object)


def remove_contamination(found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``find_contamination`` with the hit spans cut out of the text, from first to last hit word of each span."""
    clean = found.where(F.size("spans") == 0)
    cut = found.where(F.size("spans") > 0).withColumn(text, _without(F.col(f"`{text}`"), F.col("spans")))
    return clean.unionByName(cut)


def items_sha256(items: Column) -> Column:
    """Digest of the sorted ids, comma-joined."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
