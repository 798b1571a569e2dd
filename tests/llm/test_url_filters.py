from tessellar.llm import url_filters
from tessellar.llm.queries import URL_RULES


def plain(url):
    """Host and path by the words of the contract."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


URLS = [None, "", "no scheme", "http://Example.NET/en/x", "http://a.example.net/en", "http://example.com/de/y?z", "https://x.ORG/fr/#f", "http://net/", "http://planet/", "http://fishnet", "http://spam.x/a?utm_source=1&b=2&a=1", "http://www.spam.x/a/?a=1&b=2", "http://ÄÖ.net/é", "http://x.org?fr/", "http://a://b/c", "http://" + "l" * 50_000 + "/p"]


def test_hosts_rules_and_list(spark):
    rows = [(k, u, "extra", "clash") for k, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, other string, host string")
    listed = spark.createDataFrame([("http://spam.x/a?b=2&a=1",), (None,), ("nothing",)], "url string")
    out = url_filters.judge_urls(pages, listed, URL_RULES)
    assert out.columns == ["page_id", "url", "other", "host", "path", "canonical_url", "rule", "listed", "verdict"]
    got = out.collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path = plain(r["url"])
        fit = [x for x in URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        rule = max(fit, key=lambda x: len(x.text), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.text if rule else None)
        assert r["listed"] == (r["page_id"] in (10, 11)) and r["verdict"] == (rule.verdict if rule else "block" if r["listed"] else "allow")
    assert url_filters.judge_urls(pages.limit(0), listed.limit(0)).collect() == []


def test_filter_has_no_false_negatives_and_exact_join_removes_the_rest(spark):
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h/', id) as url")
    for most in (1, 1 << 20):  # one block lets almost all through
        out = url_filters.judge_urls(pages, pages.where("page_id % 3 = 0"), max_blocks=most)
        assert {r["page_id"] for r in out.where("listed").collect()} == set(range(0, 3000, 3))
