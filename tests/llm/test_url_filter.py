import re

from llm_helpers import collected, order

from spendlens.llm.q_url_filter import RULES
from spendlens.llm.url_filter import filter_urls

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
URLS = [
    None, "", "no scheme/path", "http://", "http:///x", "HTTPS://WWW.Example.NET/en/1?q#f", "http://a.example.net/de/", "http://example.com/de/x.html",
    "http://notexample.com/de/x", "http://b.org/fr/", "http://b.org/fr", "http://org/fr/1", "http://x.net", "http://x.net/", "http://x.net?a/b", "x://y://z/de/",
    "https://m.bad.example/path/", "https://bad.example:443/path/index.html", "https://bad.example/path?x=1#y", "https://bad.example/other", "http://ÀB.net/é", "a://b\nc/d\ne",
] + ["https://hot.example/x"] * 50
LISTED = ["bad.example/path", "hot.example/x", "bad.example/path", None, "not.there/at/all"]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(UPPER)
    rule = verdict = None
    for says, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            rule, verdict = h + p, says
    bare = re.sub(r"^(www|m)\.|:(80|443)$", "", host)
    canonical = bare + re.sub(r"/(index\.html?)?$", "", path) if host else None
    return host, path, rule, verdict or ("block" if canonical in LISTED[:2] else "allow")


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "b") for i, u in enumerate(urls)], "page_id long, url string, host string, BLOCK string")


def test_equals_brute_force(spark):
    listed = spark.createDataFrame([(u, "x") for u in LISTED], "url string, canonical string")
    got = collected(filter_urls(pages(spark, URLS), listed, RULES).select("page_id", "host", "path", "rule", "verdict"))
    assert order(got) == order((i, *brute(u)) for i, u in enumerate(URLS))


def test_join_removes_false_positives(spark):
    # one bit a URL and thousands of URLs: the filter lets much through, the join does not
    many = spark.range(4000).selectExpr("concat('h', id, '.example/p') AS url")
    rows = pages(spark, [f"http://h{i}.example/p" for i in range(3990, 4010)])
    got = {r[0]: r[6] for r in collected(filter_urls(rows, many, [], bits_per_url=1))}
    assert got == {i: i < 10 for i in range(20)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "url string")
    assert collected(filter_urls(pages(spark, []), none, RULES)) == []
    assert all(r[4] == brute(URLS[r[0]])[3] or r[3] is None for r in collected(filter_urls(pages(spark, URLS), none, RULES)))
