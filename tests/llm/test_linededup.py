import re

import numpy as np
import pytest

from tessellar.llm.linededup import GRAM_WORDS, dedup_lines


def words(line):
    return len(re.findall(r"\S+", line))


def check(rows, result):
    """What must hold whatever the hash order: the first place of each line stays, only repeats of 25 words go, repeats of 50 words all go."""
    docs = sorted({(i is None, i or 0, t) for i, t in rows if t is not None})
    out = {(i is None, i or 0): t for i, t, *_ in result}
    seen, gone = set(), {}
    for none, i, t in docs:
        lines, left = t.split("\n"), out[none, i].split("\n") if out[none, i] != "" else []
        at, kept = 0, []
        for line in lines:  # the result is a subsequence
            if at < len(left) and left[at] == line:
                kept.append(True)
                at += 1
            else:
                kept.append(False)
                assert line in seen or lines.index(line) < len(kept) - 1, "a first occurrence has gone"
        assert at == len(left) or t == ""
        gone[none, i] = kept
        seen.update(lines)
    return gone


@pytest.mark.parametrize("seed", range(2))
def test_repeats_go_and_first_occurrences_stay(spark, seed):
    r = np.random.default_rng(seed)
    line = lambda n: " ".join(f"w{int(k)}" for k in r.integers(0, 10_000, n))
    passages = [line(60), "\n".join(line(20) for _ in range(4)), "\n".join(line(7) for _ in range(9)), line(51)]
    rows = []
    for i in range(40):
        own = [line(int(r.integers(3, 40))) for _ in range(4)]
        own.insert(int(r.integers(0, 5)), passages[i % 4])
        if i % 3 == 0:
            own.insert(2, "short line that many have")
        rows.append((i, "\n".join(own)))
    got = [(x.doc_id, x.text, x.n_lines, x.n_removed) for x in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    check(rows, got)
    texts = {x[0]: x[1] for x in got}
    for k, p in enumerate(passages):
        holders = [i for i, t in texts.items() if p in t]
        assert holders == [k], "only the first document keeps a passage of 50 words"
    for i, t in rows:  # nothing else goes: own lines and the short line stay
        assert len(texts[i].split("\n")) == len(t.split("\n")) - (len(passages[i % 4].split("\n")) if i > 3 else 0)
    for i, t, n_lines, n_removed in got:
        assert n_lines - n_removed == len(t.split("\n"))


def test_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(GRAM_WORDS))
    rows = [(1, long), (1, long), (2, None), (None, long), (3, ""), (4, long + "\n" + long), (5, "a\n\n\nb"), (6, ("y\n" * 60_000) + long), (7, long[:-4])]
    df = spark.createDataFrame([(*x, "extra", 9) for x in rows], "doc_id long, text string, h string, n_lines int")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "h", "n_lines", "n_removed"]
    got = sorted(((x.doc_id or 0), (x.text or "")[:6], x.n_lines, x.n_removed) for x in out.collect())
    assert [g for g in got if g[0] in (1, 2, 3, 5, 7)] == [(1, long[:6], 1, 0), (1, long[:6], 1, 0), (2, "", 0, 0), (3, "", 1, 0), (5, "a\n\n\nb", 4, 0), (7, long[:6], 1, 0)]
    assert [g for g in got if g[0] in (0, 4)] == [(0, "", 1, 1), (4, "", 2, 2)]
    six = next(g for g in got if g[0] == 6)
    assert six[1] == "y\ny\ny\n" and six[2] == 60_001 and six[3] >= 1
    assert dedup_lines(df.limit(0)).collect() == []


def test_a_run_goes_whole_where_an_earlier_document_has_its_middle(spark):
    line = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows, want = [], {}
    for c in range(20):
        x, f, y = line(f"x{c}_", 20), line(f"f{c}_", 30), line(f"y{c}_", 20)
        own = [line(f"o{c}_{k}_", 9) for k in range(6)]
        rows += [(3 * c, "\n".join([own[0], f, own[1]] if c % 2 else [f])), (3 * c + 1, "\n".join([own[2], x, f, y, own[3]])), (3 * c + 2, "\n".join([own[4], x, f, y, own[5]]))]
        want |= {3 * c: rows[-3][1], 3 * c + 1: "\n".join([own[2], x, y, own[3]]), 3 * c + 2: "\n".join([own[4], own[5]])}
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_every_repeat_of_50_words_goes_by_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    lines = [" ".join(f"w{k}_{i}" for i in range(int(r.integers(3, 30)))) for k in range(60)]
    docs = [[f"own {d}"] for d in range(30)]
    for d, own in enumerate(docs):
        for _ in range(int(r.integers(1, 4))):
            a = int(r.integers(0, 50))
            own += lines[a : a + int(r.integers(2, 10))] + [f"own {d} {len(own)}"]
    got = [(x.doc_id, x.text) for x in dedup_lines(spark.createDataFrame([(d, "\n".join(own)) for d, own in enumerate(docs)], "doc_id long, text string")).collect()]
    gone = {k[1]: v for k, v in check([(d, "\n".join(own)) for d, own in enumerate(docs)], got).items()}
    for d, own in enumerate(docs):
        must, may = set(), set()
        for e, other in enumerate(docs[: d + 1]):
            for i in range(len(own)):
                for j in range(i if e == d else len(other)):
                    n = 0
                    while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                        n += 1
                    held = sum(words(x) for x in own[i : i + n])
                    must |= set(range(i, i + n)) if held >= 50 else set()
                    may |= set(range(i, i + n)) if held >= GRAM_WORDS else set()
        assert must <= {i for i, kept in enumerate(gone[d]) if not kept} <= may


@pytest.mark.parametrize(("period", "n_words", "times"), [(1, 2, 40), (1, 30, 9), (2, 3, 50), (3, 20, 7), (40, 6, 5)])
def test_of_a_periodic_text_the_first_period_or_a_gram_stays(spark, period, n_words, times):
    once = [" ".join(f"p{k}_{i}" for i in range(n_words)) for k in range(period)]
    head, tail = " ".join(f"h{i}" for i in range(9)), " ".join(f"t{i}" for i in range(9))
    rows = [(1, "\n".join([head, *once * times, tail])), (2, "\n".join(once * (times - 1)))]
    got = {r.doc_id: r.text.split("\n") for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gram = -(-GRAM_WORDS // n_words)
    kept = len(got[1]) - 2
    assert got[1] == [head, *(once * times)[:kept], tail] and got[2] == [""]
    assert max(period, gram) <= kept <= (period if period * n_words >= 2 * GRAM_WORDS else period + gram)


@pytest.mark.parametrize("seed", range(2))
def test_texts_of_few_lines_in_many_orders(spark, seed):
    r = np.random.default_rng(seed)
    lines = [" ".join(f"w{k}_{i}" for i in range(int(r.integers(2, 18)))) for k in range(4)]
    docs = []
    for d in range(10):
        own: list[str] = []
        while len(own) < 40:
            if r.random() < 0.5:
                own += [lines[int(k)] for k in r.integers(0, 4, int(r.integers(1, 4)))] * int(r.integers(1, 8))
            else:
                own.append(lines[int(r.integers(0, 4))] if r.random() < 0.7 else f"own {d} {len(own)}")
        docs.append(own)
    got = {x.doc_id: x.text.split("\n") if x.text else [] for x in dedup_lines(spark.createDataFrame([(d, "\n".join(own)) for d, own in enumerate(docs)], "doc_id long, text string")).collect()}
    assert {x for own in docs for x in own} == {x for own in got.values() for x in own}
    for d, own in enumerate(docs):  # what has a copy of 50 words that lies wholly before goes; what has none of 25 words stays
        must, may = set(), set()
        for e, other in enumerate(docs[: d + 1]):
            for i in range(len(own)):
                for j in range(i if e == d else len(other)):
                    n = 0
                    while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                        n += 1
                    may |= set(range(i, i + n)) if sum(map(words, own[i : i + n])) >= GRAM_WORDS else set()
                    n = min(n, i - j) if e == d else n
                    must |= set(range(i, i + n)) if sum(map(words, own[i : i + n])) >= 50 else set()
        assert len(must) <= len(own) - len(got[d]) <= len(may)
