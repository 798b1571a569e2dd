import hashlib
import os

import pytest

from tessellar.llm import warc


def want(rows):
    first = {}
    for i, html in rows:
        b = (html or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, html in rows:
        b = (html or "").encode()
        again = len(b) >= 100 and b in first and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def test_round_trip_with_records_inside_payloads(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    long = "é" * 60
    rows = [(1, long), (2, long), (3, "short"), (4, "short"), (5, None), (6, ""), (7, inner), (8, "x" + inner * 3), (9, inner * 3), (10, "y" * 400_000), (11, long + "\r\n\r\nWARC/1.1\r\n"), (-3, long), (12, "a\r\n\r\nb")]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nEvil: 1", h, "extra", "clash") for i, h in rows], "page_id long, url string, html string, other string, digest string").repartition(3)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()]
    assert sorted(got, key=str) == want(rows)


def test_no_rows(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_long_urls_and_headers_inside_payloads(spark):
    rows = [(k, "http://h/" + "u" * n, h) for k, (n, h) in enumerate([(5, "a"), (100_000, "b"), (5, "c"), (65_200, "d"), (300_000, None), (5, "WARC/1.1\r\nA: WARC/1.1\r\n" * 20_000), (5, "e")])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()]
    assert sorted(got, key=str) == want([(i, h) for i, _, h in rows])


def test_files_are_bounded_by_bytes(spark, tmp_path):
    rows = [(k, f"http://h/{k}", str(k) * n) for k, n in enumerate([10] * 200 + [30_000] * 9 + [250_000] * 2)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "a"), file_bytes=200_000)
    files = [f for f in (tmp_path / "a").iterdir() if f.suffix == ".txt"]
    assert all(f.stat().st_size <= 200_000 or f.read_bytes().count(b"WARC/1.1\r\n") == 1 for f in files) and len(files) < 100
    assert sorted(r["page_id"] for r in warc.read_warc(spark, str(tmp_path / "a")).collect()) == list(range(len(rows)))


def test_a_chain_that_ends_early_is_an_error(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, "u", "c")], "page_id long, url string, html string").coalesce(1), str(tmp_path / "a"))
    one = max((tmp_path / "a").glob("*.txt"), key=lambda f: f.stat().st_size)
    os.mkdir(tmp_path / "b")
    (tmp_path / "b" / "x.txt").write_bytes(one.read_bytes()[:-30])
    with pytest.raises(ValueError, match="x.txt"):
        warc.read_warc(spark, str(tmp_path / "b"))
