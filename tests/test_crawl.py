import pytest
from pyspark.sql import functions as F

from corvath.functions import urls
from corvath.operators import crawl


def col(spark, f, *values):
    return spark.range(1).select(f(*[F.lit(v).cast("string") for v in values]).alias("v")).first().v


@pytest.mark.parametrize("url,expected", [
    ("HTTP://Example.ORG:80/a/../b//c/?z=1&a=2&utm_source=x&ref=y#frag", "http://example.org/b/c/?a=2&z=1"),
    ("https://x.org:443", "https://x.org/"), ("https://x.org/a/./b;v=1?q=a+b&q=%C3%A9&e=", "https://x.org/a/b?e=&q=a+b&q=%C3%A9"),
    ("https://x.org/p?refresh=1&GCLID=2", "https://x.org/p"), ("http://x.org:8080/..//", "http://x.org:8080/"), (None, None),
])
def test_canonical(spark, url, expected):
    got = col(spark, urls.canonical_url, url)
    assert got == expected
    assert got is None or col(spark, urls.canonical_url, got) == got


@pytest.mark.parametrize("domain,pattern,ok", [("docs.a.org", "a.org", True), ("a.org", "www.a.org", True), ("www.a.org", "a.org", True), ("x.b.io", "*.b.io", True), ("b.io", "*.b.io", False), ("nota.org", "a.org", False), ("a.org.evil.net", "a.org", False)])
def test_allowlist(spark, domain, pattern, ok):
    assert col(spark, urls.domain_allowed, domain, pattern) is ok
    pages = spark.createDataFrame([(f"https://{domain}/x",), ("nonsense",), (None,)], "url string")
    domains = spark.createDataFrame([(pattern, True), ("off.org", False)], "domain string, enabled boolean")
    assert crawl.allowed(pages, domains).count() == int(ok)


def test_domains(spark):
    assert col(spark, urls.url_domain, "https://Docs.X.org:8443/a") == "docs.x.org"
    assert col(spark, urls.url_domain, "nonsense") is None
    assert col(spark, urls.normalize_domain, " HTTPS://A.org:80/x ") == "a.org"


def test_robots(spark):
    body = "User-agent: *\nDisallow: /admin\nCrawl-delay: 2\n\nUser-agent: bot\nDisallow: /secret\n"
    robots = spark.createDataFrame([("a.org", 200, body), ("b.org", 403, None), ("c.org", 500, "x")], "domain string, status int, body string")
    pages = spark.createDataFrame([(f"https://{u}",) for u in ("a.org/admin", "a.org/secret", "a.org/public", "b.org/", "c.org/", "d.org/")], "url string")
    got = {r.url[8:]: (r.robots_ok, r.crawl_delay) for r in crawl.robots_allowed(pages, robots, "bot").collect()}
    assert got == {"a.org/admin": (False, 2.0), "a.org/secret": (False, 2.0), "a.org/public": (True, 2.0), "b.org/": (False, None), "c.org/": (True, None), "d.org/": (True, None)}


def test_frontier(spark):
    links = spark.createDataFrame([("https://a.org/", 0, "https://a.org/1"), ("https://a.org/", 1, "https://a.org/2#x"), ("https://a.org/", 2, "https://a.org/1"), ("https://a.org/1", 0, "https://a.org/3"), ("https://a.org/3", 0, "https://a.org/")], "source string, link_no int, target string")
    seeds = spark.createDataFrame([("https://A.org",)], "url string")
    assert {(r.url[13:], r.depth) for r in crawl.frontier(links, seeds, 1).collect()} == {("/", 0), ("/1", 1), ("/2", 1)}
    got = {(r.url, r.depth) for r in crawl.frontier(links, seeds, 3).collect()}
    assert got == {("https://a.org/", 0), ("https://a.org/1", 1), ("https://a.org/2", 1), ("https://a.org/3", 2)}
    assert crawl.frontier(links, seeds, 3, 2).count() == 2


def test_simulated_crawl(spark):
    page = lambda *hrefs: "<html><body>" + "".join(f"<a href='{h}'>x</a>" for h in hrefs) + "</body></html>"
    pages = spark.createDataFrame([
        ("https://a.org/", 200, "text/html", page("/1", "/secret", "/gone", "/file", "https://evil.net/")), ("https://a.org/1", 200, "text/html", page("/2", "/missing")),
        ("https://a.org/2", 200, "text/html", page("/3")), ("https://a.org/secret", 200, "text/html", page("/4")), ("https://a.org/gone", 404, "text/html", ""), ("https://a.org/file", 200, "application/zip", ""),
    ], "url string, status int, content_type string, html string")
    seeds = spark.createDataFrame([("https://a.org",)], "url string")
    domains = spark.createDataFrame([("a.org", True)], "domain string, enabled boolean")
    robots = spark.createDataFrame([("a.org", 200, "User-agent: *\nDisallow: /secret")], "domain string, status int, body string")
    got = {r.url[13:]: (r.depth, r.status_code) for r in crawl.simulate(pages, seeds, domains, robots, "bot", 2, 20).collect()}
    assert got == {"/": (0, 200), "/1": (1, 200), "/secret": (1, 403), "/gone": (1, 404), "/2": (2, 200), "/missing": (2, 0)}
