import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.llm import chat
from tessellar.llm.common import crc_mod
from tessellar.llm.queries import op2_chat_formatting, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    raw = chat.as_raw(table(spark, SF, "conversations"))
    return chat.train(raw.where(crc_mod(F.col("conv_id"), 3) != 1))


def test_held_out_roles(spark):
    got = op2_chat_formatting(spark, SF).join(table(spark, SF, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"]).where(crc_mod(F.col("conv_id"), 3) == 1).toPandas()
    assert len(got) > 50 and (got.role == got.role_pred).mean() > 0.9


def test_markers_and_lines():
    features, texts = chat.read_lines("\n### Human: hi there\n\nmore\n<|assistant|> yes\nuserland: no\n\n")
    assert [f[0] for f in features] == [2, 0, 3, 0] and [f[1] for f in features] == [1, 1, 0, 0]
    assert texts == ["hi there", "\nmore", "yes", "userland: no"]
    assert chat.render([2, 3, 4, 5], texts) == "<|user|>\nhi there\n\nmore\n<|assistant|>\nyes\nuserland: no\n"


def test_best_path_is_the_best_of_all(model):
    r = np.random.default_rng(0)
    shown = model.lines([(int(r.integers(0, 4)), int(r.integers(0, 2)), int(r.integers(0, 8))) for _ in range(5)])
    best, at = -np.inf, None
    for code in np.ndindex(*([chat.START] * 5)):
        score = sum(model.moves[a, b] + e[b] for a, b, e in zip([chat.START, *code[:-1]], code, shown, strict=True))
        if score > best:
            best, at = score, list(code)
    assert model.decode(shown, chat.FRESH, None) == at


def test_blocks_give_the_path_of_the_whole(spark, model, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    r = np.random.default_rng(1)
    rows = [(7, k, ("User: " if k % 5 == 0 else "") + "word " * int(r.integers(1, 90))) for k in range(70)] + [(8, 0, "Bot: hi")]
    got = {(x.conv_id, x.turn): x for x in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, text string"), model).collect()}
    shown = model.lines([chat.read_lines(t)[0][0] for c, _, t in rows if c == 7])
    path = model.decode(shown, chat.FRESH, None)
    assert [got[7, k].role for k in range(70)] == [chat.ROLES[s // 2] for s in path]
    assert [got[7, k].n_turns for k in range(70)] == [int(s % 2 == 0) for s in path]


def test_parts_of_one_number_are_many_blocks(spark, model, monkeypatch):
    rows = [(7, 5 if k % 4 else 6, ("User: " if k % 5 == 0 else "") + f"word{k} " * (k % 60 + 1)) for k in range(90)] + [(8, 0, "Bot: hi"), (8, 1, "User: ho")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    whole = sorted((x.conv_id, x.turn, x.role, x.rendered) for x in chat.format_chats(df, model).collect())
    monkeypatch.setattr(chat, "BLOCK", 4)
    sizes = [r["count"] for r in chat._parts(df, "conv_id", "turn", "text").groupBy("key", "block").count().collect()]
    assert max(sizes) <= 16 and len(sizes) > 20
    assert sorted((x.conv_id, x.turn, x.role, x.rendered) for x in chat.format_chats(df, model).collect()) == whole


def test_odd_rows(spark, model):
    rows = [(1, 0, "User: a", "x", 1), (1, 0, "User: a", "x", 1), (1, 0, "User: b", "x", 1), (None, 3, "A: c", "x", 1), (2, None, None, "x", 1), (3, 1, "", "x", 1), (4, -600, "User: " + "w " * 100_000, "x", 1), (4, 900, "A: end", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string, n_lines int")
    got = chat.format_chats(df, model).collect()
    assert len(got) == 8 and sum(x.rendered == "<|user|>\na\n" for x in got) == 2
    assert sorted((x.conv_id or 0, x.role or "", x.n_lines) for x in got) == [(0, "assistant", 1), (1, "user", 1), (1, "user", 1), (1, "user", 1), (2, "", 0), (3, "", 0), (4, "assistant", 1), (4, "user", 1)]
    assert chat.format_chats(df.limit(0), chat.train(df.limit(0))).collect() == []
