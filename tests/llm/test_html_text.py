import glob
import html
import re

from tessellar.llm import dom, html_text
from tessellar.llm.queries import op12_html_extraction


def texts(page):
    return html_text.page_text(page, [])


def test_blocks_and_references():
    page = "<html><head><title>T</title><style>p{}</style></head><body><article><h1>A&amp;B</h1><p>one  <b>two</b>three<br>four<p>five&nbsp;&#233;<ul><li>x<li>y</ul><pre> p\n q </pre>tail &lt;b&gt;</article></body>"
    assert texts(page) == "A&B one twothree four five é x y p q tail <b>"
    assert texts(None) == texts("") == texts("<p></p>") == ""
    assert texts("a < b and 1 <2 > c") == "a < b and 1 <2 > c"
    assert texts("no markup, but\n\n words") == "no markup, but words"


def test_outer_elements_are_left_out():
    outer = ["<nav>n</nav>", "<header>h</header>", "<footer>f</footer>", "<aside>s</aside>", '<div class="ad">a</div>', '<div id="cookie-notice">c</div>', "<form><p>f</p></form>", '<div class="sideBar">s</div>', "<script>var t='</p>';</script>", "<style>x</style>", '<div role="navigation">r</div>', "<!-- c -- > c -->", '<p hidden>h</p>', '<p style="display: none">h</p>', '<section class="reader-comments"><article><p>comment</p></article></section>', "<noscript>n</noscript>", "<select><option>o</option></select>"]
    for x in outer:
        assert texts(f"<body>{x}<article><p>in</p>{x if 'header' not in x else ''}<p>side</p></article>{x}</body>") == "in side", x
    assert texts("<body><article><header><h1>Title</h1></header><p>in</p></article></body>") == "Title in"
    # a missing end tag doesn't take the article away, nor does a form around the page
    assert texts("<body><nav><ul><li>menu<article><p>in</p></article></body>") == "in"
    assert texts("<body><form><article><p>in</p></article></form></body>") == "in"
    assert texts("<body><div class=ad>x<article><p>in</p></article>") == "in"
    assert texts("<head><title>t</title><p>body without tag</p>") == "body without tag"


def test_odd_markup_ends():
    deep = "<div>" * 5000 + "in" + "</div>" * 5000
    assert texts(deep) == "in"
    assert texts("<article>" + "<div>a" * 300 + "b") == " ".join(["a"] * 299 + ["ab"])
    assert texts("<article>in <a href='x" + "y" * 100_000) == "in"
    assert texts("<article>in <!-- " + "y" * 100_000) == "in"
    assert texts("<article>in<script>" + "<" * 100_000) == "in"
    long = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    assert texts(long) == " ".join(["word"] * 50_000)


def test_matching_is_the_greatest():
    def brute(a, b):
        if a[0] != b[0]:
            return 0
        n, m = len(a[4]), len(b[4])
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute(a[4][i], b[4][j]))
        return best[n][m] + 1 + (bool(a[2]) and a[2] == b[2])

    import random

    rng = random.Random(5)

    def tree(depth):
        return [rng.choice("abc"), 0, rng.choice(["", "x", "y"]), 0, [tree(depth - 1) for _ in range(rng.randrange(5))] if depth else []]

    for _ in range(300):
        a, b = tree(3), tree(3)
        score, pairs = dom.match(a, b)
        assert score == brute(a, b)
        assert sum(1 + (bool(x[2]) and x[2] == y[2]) for x, y in pairs) == score and all(x[0] == y[0] for x, y in pairs)
    a, b = ["r", 0, "", 0, [["p", 0, str(k), 0, []] for k in range(500)]], ["r", 0, "", 0, [["p", 0, str(7 * k), 0, []] for k in range(60)]]
    assert dom.match(a, b)[0] == brute(a, b)  # runs of leaves are folded


def plain_page(host, k, words):
    return f"<html><body><div class=x1><span>{host} home</span></div><div class=x2><p>{words}</p><p>{words[::-1]}</p><p>Follow {host} every day</p></div><div class=x3><p>All rights of {host}</p></div></body></html>"


def test_constant_nodes_are_template(spark):
    """Pages without any telling element: what all pages of a host have is template; a passage that some share, and copies, stay."""
    rows = []
    for k in range(40):
        words = "shared passage of pages" if k % 3 == 0 else f"words number {k} of this page, " * 5
        rows.append((k, f"http://a.org/{k}", plain_page("a.org", k, words)))
    rows += [(100 + k, "http://copies.org/x", plain_page("copies.org", 0, "the same words everywhere")) for k in range(30)]
    rows += [(200, None, None), (201, "no scheme", ""), (None, "http://one.org", "<div><p>alone on its host</p></div>"), (202, "http://a.org/odd", "<p>another form</p>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int").repartition(7)
    out = html_text.extract_text(pages)
    assert out.columns == ["page_id", "url", "host", "text", "n_chars"]
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for k in range(40):
        words = "shared passage of pages" if k % 3 == 0 else f"words number {k} of this page, " * 5
        assert got[k]["text"] == " ".join(f"{words} {words[::-1]}".split()), k
        assert got[k]["n_chars"] == len(got[k]["text"])
    assert "the same words everywhere" in got[100]["text"]
    assert (got[200]["text"], got[201]["text"], got[None]["text"], got[202]["text"]) == ("", "", "alone on its host", "another form")
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_template_inside_articles_needs_different_contents(spark):
    def page(k, n):
        return f"<body><article><h1>Title {k % n}</h1><p>Words of {k % n} that differ</p><p>Share this page</p></article></body>"

    rows = [(k, "http://many.org/", page(k, 30)) for k in range(30)] + [(100 + k, "http://few.org/", page(k, 3)) for k in range(30)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Title 7 Words of 7 that differ"
    assert got[107] == "Title 1 Words of 1 that differ Share this page"


def test_shuffled_wrappers_give_the_same(spark, monkeypatch):
    rows = [(k, f"http://h{k % 9}.org/", plain_page(f"h{k % 9}", k, f"words number {k} here, " * 4)) for k in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = sorted(html_text.extract_text(pages).collect())
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", 64)
    assert sorted(html_text.extract_text(pages).collect()) == one


def test_query_against_plain_rules(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for f in glob.glob(f"{sf}/pages.parquet"):
        for r in spark.read.parquet(f).collect():
            inner = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
            want[r["page_id"]] = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("</?(p|h1|br)>", " ", inner))).split())
    assert {r["page_id"]: r["text"] for r in op12_html_extraction(spark, sf).collect()} == want
