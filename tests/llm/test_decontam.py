import re

import numpy as np
import pyarrow as pa
import pytest

from tessellar.llm import decontam
from tessellar.llm.common import text_buffers
from tessellar.llm.decontam import FMIndex, find_contamination, find_hits, make_windows, remove_contamination, suffix_order
from tessellar.llm.words import find_words, item_words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    lower = (text or "").encode()
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in lower)
    return WORD.findall(lower)


def brute(docs, items, size=10):
    out = []
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(len(w) - size + 1, min(1, len(w)))):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    for text in docs:
        w, hit, found = split(text), set(), set()
        for key, ids in windows.items():
            for i in range(len(w) - len(key) + 1):
                if tuple(w[i : i + len(key)]) == key:
                    hit.update(range(i, i + len(key)))
                    found |= ids
        out.append((len(w), len(hit), sorted(found)))
    return out


def hits(docs, items, size=10):
    words = find_words(*text_buffers(pa.array(docs, pa.string())), item_words())
    hit, found = find_hits(words, make_windows([i for i, _ in items], pa.array([t for _, t in items], pa.string()), size))
    return [(b - a, int(hit[a:b].sum()), sorted(f)) for a, b, f in zip(words.first[:-1].tolist(), words.first[1:].tolist(), found, strict=True)]


@pytest.mark.parametrize("seed", range(12))
def test_hits_equal_brute_force(seed):
    r = np.random.default_rng(seed)
    word = lambda: "abcdefgÉ"[r.integers(8)] * int(r.integers(1, 3))
    items = [(str(i), " ".join(word() for _ in range(r.integers(0, 9)))) for i in range(6)]
    docs = [" ".join(word() if r.random() < 0.9 else "zz" for _ in range(r.integers(0, 60))) for _ in range(30)]
    docs += [None, "", "  ", docs[0], docs[0] + " " + items[1][1] + ", " + items[2][1].upper()]
    assert hits(docs, items, 3) == brute(docs, items, 3)


def test_suffix_order_and_ranks():
    r = np.random.default_rng(1)
    ids = np.append(r.integers(0, 4, 500), 0)
    breaks = np.cumsum(ids == 0) - 1
    key = lambda i: [int(ids[j]) + 1000 if ids[j] else int(breaks[j]) for j in range(i, len(ids))]
    assert suffix_order(ids).tolist() == sorted(range(len(ids)), key=key)
    index = FMIndex(ids)
    at, symbols = r.integers(0, len(ids) + 1, 50), r.integers(0, 4, 50)
    assert index.tree.rank(symbols, at).tolist() == [int((index.before[:a] == s).sum()) for s, a in zip(symbols, at, strict=True)]


@pytest.mark.parametrize("blocks", [1, 8])
def test_operator_over_rows(spark, monkeypatch, blocks):
    monkeypatch.setattr(decontam, "BLOCKS_A_STAGE", blocks)
    passage = " ".join(f"word{i}" for i in range(14))
    docs = [(1, f"Intro. {passage}, end", 7), (1, f"Intro. {passage}, end", 7), (2, None, 8), (None, "clean", 9), (3, passage.upper() * 1, 1), (4, passage + " " + passage, 2), (5, "short item", 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, items int")
    items = [("a", passage), ("b", "short item"), ("c", None), ("d", "?!")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block_bytes in (10_000_000, 40):  # in one block and in several
        found = find_contamination(df, bench, block_bytes=block_bytes)
        assert found.columns == ["doc_id", "text", "n_words", "n_hit", "spans", "items"]
        got = sorted(((r.doc_id or 0), r.n_words, r.n_hit, r.items) for r in found.collect())
        want = brute([d[1] for d in docs], [i for i in items if i[1]])
        assert got == sorted((d[0] or 0, *w) for d, w in zip(docs, want, strict=True))
        clean = {r.doc_id: r.text for r in remove_contamination(found).collect()}
        assert clean == {1: "Intro. , end", 2: None, None: "clean", 3: "", 4: "", 5: ""}
        assert {r.doc_id: r.text for r in find_contamination(df, bench, block_bytes=block_bytes, clean=True).collect()} == clean
    slim = find_contamination(df, bench, carry=["doc_id"])
    assert slim.columns == ["doc_id", "n_words", "n_hit", "spans", "items"] and slim.count() == 7
    empty = find_contamination(df.limit(0), bench.limit(0))
    assert empty.collect() == []
    assert find_contamination(df, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
