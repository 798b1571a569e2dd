"""Wrappers are induced from all pages of a host, whatever parts and tasks they are dealt to."""

import random

from tessellar.llm import dom, html_text

SCHEMA = "page_id long, url string, html string"


def page(title, paragraphs, last):
    return f"<body><article><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}{last}</article></body>"


def extracted(spark, rows, tasks=5):
    return {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, SCHEMA).repartition(tasks)).collect()}


def test_template_is_what_nine_tenths_of_all_pages_have(spark, monkeypatch):
    rng, rows, want = random.Random(3), [], {}
    for host in range(10):
        odd = set(rng.sample(range(60), 5))  # eight pages of sixty have one of these five more often than not
        for k in range(60):
            said = [f"Words {rng.random()} of {k}" for _ in range(1 + k % 4)]
            last = f"A reply to {k}" if k in odd else "Share this page"
            key = 100 * host + k
            rows.append((key, f"http://h{host}.org/{k}", page(f"Title {k}", said, f"<p>{last}</p>")))
            want[key] = " ".join([f"Title {k}", *said, *([last] if k in odd else [])])
    # eight of sixty have another text: no template
    for k in range(60):
        last = f"A reply to {k}" if k % 8 == 0 else "Share this page"
        rows.append((5000 + k, f"http://less.org/{k}", page(f"Title {k}", [f"Words of {k}"], f"<p>{last}</p>")))
        want[5000 + k] = f"Title {k} Words of {k} {last}"
    assert extracted(spark, rows) == want
    monkeypatch.setattr(html_text, "PART", 4)
    monkeypatch.setattr(html_text, "FAN", 2)
    assert extracted(spark, rows[::-1], 3) == want


def test_wrapper_of_long_pages(spark):
    rows = [(k, f"http://long.org/{k}", page(f"Title {k}", [f"Words {k} {j}" for j in range(560 + k)], "<div>Share this page</div>")) for k in range(12)]
    got = extracted(spark, rows)
    assert all(got[k].endswith(f"Words {k} {559 + k}") for k in range(12))


def test_exactly_eight_contents_and_copies(spark):
    eight = [(k, f"http://eight.org/{k}", page(f"Title {k}", [f"Words of {k}"], "<p>Share this page</p>")) for k in range(8)]
    copies = [(100 + k, f"http://few.org/{k}", page(f"Title {k % 7}", [f"Words of {k % 7}"], "<p>Share this page</p>")) for k in range(70)]
    got = extracted(spark, eight + copies)
    assert all(got[k] == f"Title {k} Words of {k}" for k in range(8))
    assert all(got[100 + k] == f"Title {k % 7} Words of {k % 7} Share this page" for k in range(70))


def test_rare_nodes_leave_the_wrapper_common_ones_stay():
    wrapper = None
    for k in range(200):
        wrapper = html_text.merge(wrapper, ["root", 0, "", 0, [[f"div.post-{k}", 0, str(k), 0, []], ["p", 0, "all" if k % 10 else str(k), 0, []]]])
    kept = html_text._common(wrapper, html_text.RARE * wrapper[5])
    assert [(c[0], c[5], c[2]) for c in kept[4]] == [("p", 200, "all")]


def test_tables_made_again_in_rows_give_the_same_matching(monkeypatch):
    rng = random.Random(8)

    def tree(depth):
        return [rng.choice("ab"), 0, rng.choice(["", "x", "y"]), 0, [tree(depth - 1) for _ in range(rng.randrange(12))] if depth else []]

    for _ in range(60):
        a, b = tree(2), tree(2)
        score, pairs = dom.match(a, b)
        for small, cells in ((0, 1 << 22), (0, 0), (20, 0)):
            with monkeypatch.context() as m:
                m.setattr(dom, "SMALL", small)
                m.setattr(dom, "CELLS", cells)
                again, others = dom.match(a, b)
            assert score == again and [(id(x), id(y)) for x, y in pairs] == [(id(x), id(y)) for x, y in others]
