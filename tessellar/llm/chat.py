"""Chat transcripts: a hidden Markov model finds the speakers, then the turns are written in one form.

A transcript is a sequence of lines, kept as parts (any pieces of whole lines) in order. Each line is in a state: a role,
and whether it begins a turn or goes on with it. What a line shows are its speaker marker, whether a blank line stands
before it, and its length. The model is counted from transcripts of known roles; Viterbi's best path gives the roles.

A long transcript is no single task: parts are taken in blocks of about 256. A block's effect on the scores is a max-plus
matrix; products of such matrices, 256 at a time, give the scores at every block's start and the state at its end, and
each block is then decoded by itself with those two held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import cut, small_batches, written

ROLES = ("system", "user", "assistant")
K = 2 * len(ROLES) + 1  # begin and inside of each role, then the start
START = K - 1
BLOCK = 256
NEVER = -1e18

#: Names that speaker markers use for each role.
NAMES = {"system": ("system", "sys", "instructions"), "user": ("user", "human", "q", "question", "customer"), "assistant": ("assistant", "bot", "ai", "a", "answer", "model")}
#: Forms of markers; ``{}`` is the role's k-th name, and what follows is the text.
FORMS = (("{}: ", 0, str.capitalize), ("### {}: ", 1, str.capitalize), ("[{}] ", 0, str.upper), ("<|{}|> ", 0, str.lower), ("{}: ", 2, str.upper))

_ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in NAMES[role]}
_MARKER = re.compile(r"^[ \t]*(?:#{1,4}[ ]*|\*\*|\[|<\|)?(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")(?:\|>|\]|\*\*:?|:)[ \t]*", re.IGNORECASE)
LENGTHS = (1, 4, 8, 16, 32, 64, 128)


def read_lines(text: str) -> tuple[list[tuple[int, int, int]], list[str]]:
    """Features (marker: 0 for none or role + 1, blank line before, length class) and unmarked texts of the lines that aren't blank.

    Blank lines between lines come back as line breaks in front of the text that follows them.
    """
    features, texts, blanks = [], [], 0
    for line in text.split("\n"):
        if not line.strip():
            blanks += 1
            continue
        m = _MARKER.match(line)
        body = line[m.end() :] if m else line
        features.append((_ROLE_OF[m[1].lower()] + 1 if m else 0, int(blanks > 0), int(np.searchsorted(LENGTHS, len(body.split()), "right"))))
        texts.append("\n" * (blanks if features[:-1] else 0) + body)
        blanks = 0
    return features, texts


@dataclass
class ChatModel:
    """Logarithms: emissions for each feature (state x value), moves between the 7 states (the last is the start)."""

    emissions: tuple[np.ndarray, np.ndarray, np.ndarray]
    moves: np.ndarray

    def lines(self, features: list[tuple[int, int, int]]) -> np.ndarray:
        f = np.array(features, np.int64).reshape(-1, 3)
        out = np.full((len(f), K), NEVER)
        out[:, :START] = sum(e[:, f[:, k]].T for k, e in enumerate(self.emissions))
        return out

    def matrix(self, shown: np.ndarray) -> np.ndarray:
        """Best score from every state before the lines to every state at the last; no lines: the identity."""
        m = np.where(np.eye(K, dtype=bool), 0.0, NEVER)
        for e in shown:
            m = np.maximum((m[:, :, None] + self.moves[None]).max(axis=1) + e, NEVER)
        return m

    def decode(self, shown: np.ndarray, start: np.ndarray, last: int | None) -> list[int]:
        """The best states of the lines (ties: the lowest), from scores of the states before them to a given last state."""
        score, back = start, []
        for e in shown:
            through = score[:, None] + self.moves
            back.append(through.argmax(axis=0))
            score = np.maximum(through.max(axis=0) + e, NEVER)
        state = int(score.argmax()) if last is None else last
        path = []
        for b in reversed(back):
            path.append(state)
            state = int(b[state])
        return path[::-1]


FRESH = np.where(np.arange(K) == START, 0.0, NEVER)


def _parts(rows: DataFrame, conv_id: str, part: str, text: str, *more: Column) -> DataFrame:
    """Distinct parts with their number of copies. A row without conversation or part number is a transcript of its own.

    A block has the parts of 256 numbers. Where more than 256 parts of a transcript share a number, its blocks have fewer
    numbers, and parts of one number are dealt to blocks by the hash that orders them.
    """
    c, p, t = F.col(f"`{conv_id}`"), F.col(f"`{part}`").cast("long"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    known = c.isNotNull() & p.isNotNull()
    key = F.when(known, F.concat(F.lit("c:"), c.cast("string"))).otherwise(F.concat(F.lit("row:"), F.sha2(t.cast("binary"), 256)))
    out = rows.select(key.alias("key"), c.alias("conv"), p.alias("part"), t.alias("text"), *more)
    out = written(out.groupBy(*out.columns).agg(F.count("*").alias("copies")), "parts")
    crowded = out.where("conv is not null and part is not null").groupBy("key", "part").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    finer = cut(crowded.groupBy("key").agg(F.ceil(F.max("n") / BLOCK).alias("finer")))
    place = F.floor((F.xxhash64("text") / F.lit(2.0**64) + F.lit(0.5)) * F.col("finer") * BLOCK)
    known = F.col("conv").isNotNull() & F.col("part").isNotNull()
    block = F.when(~known, 0).when(F.col("finer").isNull(), F.floor(F.col("part") / BLOCK)).otherwise(F.col("part") * F.col("finer") + F.floor(F.least(place, F.col("finer") * BLOCK - 1) / BLOCK))
    return out.join(finer, "key", "left").withColumn("block", block.cast("long")).drop("finer")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[tuple[int, int, int], int] = {}
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            features, _ = read_lines(text)
            for i, f in enumerate(features):
                state = 2 * ROLES.index(role) + (i > 0)
                for place in (*((k, state, v) for k, v in enumerate(f)), (3, state, int(i + 1 == len(features)))):
                    found[place] = found.get(place, 0) + 1
        kinds = list(found) or [(0, 0, 0)]
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in kinds], pa.int32()) for i in range(3)), pa.array([found.get(k, 0) for k in kinds], pa.int64())], ["kind", "state", "value", "n"])


def train(turns: DataFrame, conv_id: str = "conv_id", part: str = "turn", role: str = "role", text: str = "text") -> ChatModel:
    """Counts transcripts whose parts are single turns of known roles; rows of other or null roles and of null ids don't count.

    All rows are counted, by partial sums; at most a hundred counts come to the driver. Every count is one more than
    found, so without rows the model takes all to be alike, but for markers, which count for their role as 100 lines.
    """
    small_batches(turns.sparkSession)
    known = turns.where(F.col(f"`{role}`").isin(*ROLES) & F.col(f"`{conv_id}`").isNotNull() & F.col(f"`{part}`").isNotNull())
    rows = known.select(F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{part}`").cast("long").alias("part"), F.col(f"`{role}`").alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    shown = [np.ones((START, n)) for n in (len(ROLES) + 1, 2, len(LENGTHS) + 1)]
    ends = np.ones((START, 2))
    for r in range(len(ROLES)):
        shown[0][2 * r, r + 1] += 100
        shown[0][2 * r + 1, 0] += 100
    for kind, state, value, n in rows.select("role", "text").mapInArrow(_counted, "kind int, state int, value int, n long").groupBy("kind", "state", "value").agg(F.sum("n")).collect():
        (shown[kind] if kind < 3 else ends)[state, value] += n
    after = np.ones((len(ROLES), len(ROLES)))
    first = np.ones(len(ROLES))
    turn = rows.select("conv", "part", "role").distinct()
    before = turn.select("conv", (F.col("part") + 1).alias("part"), F.col("role").alias("was"))
    for was, now, n in turn.join(before, ["conv", "part"], "left").groupBy("was", "role").count().collect():
        if was is None:
            first[ROLES.index(now)] += n
        else:
            after[ROLES.index(was), ROLES.index(now)] += n
    moves = np.full((K, K), NEVER)
    end = ends / ends.sum(axis=1, keepdims=True)
    for s in range(START):
        r = s // 2
        moves[s, 2 * r + 1] = np.log(end[s, 0])
        moves[s, [0, 2, 4]] = np.log(end[s, 1] * after[r] / after[r].sum())
    moves[START, [0, 2, 4]] = np.log(first / first.sum())
    return ChatModel(tuple(np.log(c / c.sum(axis=1, keepdims=True)) for c in shown), moves)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each (key, block), which come sorted."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["key"], row["block"]) != (held[0]["key"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _matrices(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            features = [f for r in rows for f in read_lines(r["text"])[0]]
            m = broadcast.value.matrix(broadcast.value.lines(features))
            yield pa.RecordBatch.from_pylist([{"key": rows[0]["key"], "block": rows[0]["block"], "m": m.tobytes()}])

    return run


def _product(group: pd.DataFrame) -> pd.DataFrame:
    m = np.where(np.eye(K, dtype=bool), 0.0, NEVER)
    for raw in group.sort_values("block")["m"]:
        m = np.maximum((m[:, :, None] + np.frombuffer(raw).reshape(1, K, K)).max(axis=1), NEVER)
    return pd.DataFrame({"key": [group["key"].iloc[0]], "block": [group["above"].iloc[0]], "m": [m.tobytes()]})


def _handed(group: pd.DataFrame) -> pd.DataFrame:
    """Scores before, and state after, each child of a block whose own are known."""
    group = group.sort_values("block").reset_index(drop=True)
    scores, matrices = [np.frombuffer(group["scores"][0])], [np.frombuffer(raw).reshape(K, K) for raw in group["m"]]
    for m in matrices:
        scores.append(np.maximum((scores[-1][:, None] + m).max(axis=0), NEVER))
    state = int(group["last"][0])
    if state < 0:
        state = int(scores[-1].argmax())
    last = []
    for a, m in zip(reversed(scores[:-1]), reversed(matrices), strict=True):
        last.append(state)
        state = int((a + m[:, state]).argmax())
    return pd.DataFrame({"key": group["key"], "block": group["block"], "scores": [s.tobytes() for s in scores[:-1]], "last": last[::-1]})


def _boundaries(leaves: DataFrame) -> DataFrame:
    """(key, block, scores, last) of every block, from the matrices of the blocks."""
    levels = [leaves]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:
        above = levels[-1].withColumn("above", F.floor(F.col("block") / BLOCK).cast("long"))
        levels.append(written(above.groupBy("key", "above").applyInPandas(_product, "key string, block long, m binary"), "matrices"))
    known = levels.pop().select("key", "block", F.lit(FRESH.tobytes()).alias("scores"), F.lit(-1).alias("last"))
    while levels:
        above = known.withColumnRenamed("block", "above")
        children = levels.pop().withColumn("above", F.floor(F.col("block") / BLOCK).cast("long")).join(above, ["key", "above"])
        known = written(children.groupBy("key", "above").applyInPandas(_handed, "key string, block long, scores binary, last int"), "boundaries")
    return known


def render(states: list[int], texts: list[str]) -> str:
    """Lines in canonical form: a header where a turn begins, blank lines within turns only. Parts written one after the other make the transcript."""
    out = []
    for s, t in zip(states, texts, strict=True):
        out.append(f"<|{ROLES[s // 2]}|>\n{t.lstrip(chr(10))}\n" if s % 2 == 0 else f"{t}\n")
    return "".join(out)


def _decoded(broadcast, conv_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        schema = pa.schema([("conv", conv_type), ("part", pa.int64()), ("role", pa.string()), ("n_lines", pa.int64()), ("n_turns", pa.int64()), ("rendered", pa.string()), ("copies", pa.int64())])
        out: list[dict] = []
        for rows in _grouped(batches):
            read = [read_lines(r["text"]) for r in rows]
            start = FRESH if rows[0]["scores"] is None else np.frombuffer(rows[0]["scores"])
            states = model.decode(model.lines([f for features, _ in read for f in features]), start, rows[0]["last"])
            at = 0
            for r, (features, texts) in zip(rows, read, strict=True):
                own = states[at : at + len(features)]
                at += len(features)
                out.append({"conv": r["conv"], "part": r["part"], "role": ROLES[own[0] // 2] if own else None, "n_lines": len(own), "n_turns": sum(s % 2 == 0 for s in own), "rendered": render(own, texts), "copies": r["copies"]})
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def format_chats(parts: DataFrame, model: ChatModel, conv_id: str = "conv_id", part: str = "turn", text: str = "text") -> DataFrame:
    """For every row (conversation, part number, role of its first line, n_lines, n_turns begun, rendered).

    Parts follow each other by number, equal numbers by text; repeated rows are one part and get the same result each. A
    null or blank text has no lines, a null role and an empty rendering. A row without conversation or number is a
    transcript of its own. Other columns are not returned. No rows: no result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = parts.sparkSession
    small_batches(spark)
    rows = _parts(parts, conv_id, part, text)
    model_ = spark.sparkContext.broadcast(model)
    together = lambda df: df.repartition("key", "block").sortWithinPartitions("key", "block", "part", F.xxhash64("text"), "text")
    long = rows.groupBy("key").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select("key")
    long = cut(long)
    in_long = together(rows.join(long, "key", "left_semi").select("key", "block", "part", "text"))
    if long.isEmpty():
        known = spark.createDataFrame([], "key string, block long, scores binary, last int")
    else:
        leaves = written(in_long.mapInArrow(_matrices(model_), "key string, block long, m binary"), "leaves")
        known = _boundaries(leaves)
    ready = together(rows.join(known, ["key", "block"], "left"))
    kind = rows.schema["conv"].dataType
    out = ready.mapInArrow(_decoded(model_, to_arrow_type(kind)), f"conv {kind.simpleString()}, part long, role string, n_lines long, n_turns long, rendered string, copies long")
    out = out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.col("conv").alias(conv_id), F.col("part").alias(part), "role", "n_lines", "n_turns", "rendered")


def as_raw(turns: DataFrame, conv_id: str = "conv_id", part: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as parts of raw transcripts: a conversation uses one form of marker, a quarter of the later turns have none, half follow a blank line."""
    c, p = F.col(f"`{conv_id}`"), F.col(f"`{part}`")
    form = F.pmod(F.xxhash64(c), F.lit(len(FORMS)))
    marker = F.lit("")
    for k, (pattern, which, case) in enumerate(FORMS):
        for r in ROLES:
            marker = F.when((form == k) & (F.col(f"`{role}`") == r), pattern.format(case(NAMES[r][which]))).otherwise(marker)
    bare = (p > 0) & (F.pmod(F.xxhash64(F.lit("bare"), c, p), F.lit(4)) == 0)
    blank = F.when(F.pmod(F.xxhash64(F.lit("blank"), c, p), F.lit(2)) == 0, "\n").otherwise("")
    raw = F.concat(blank, F.when(bare, "").otherwise(marker), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return turns.select(c.alias(conv_id), p.alias(part), F.col(f"`{role}`").alias(role), raw.alias(text))
