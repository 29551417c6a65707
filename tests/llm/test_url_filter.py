"""URL filters: rules, canonical form, the Bloom filter and the exact join behind it."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from crestline.llm import url_filter
from crestline.llm.url_filter import RULES, Rule, bloom_filter, canonical, judge, op11_url_filter, with_possible

SF = "/root/testdata/sf0.001"
URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/1", "https://www.Example.com/en/2?q=1", "http://m.www.example.com/en/", "http://a.example.com/de/x",
    "http://badexample.com/en/1", "http://x.net/es/1", "http://net/fr/", "http://x.net/en/1", "http://example.com", "http://example.com?x=/en/", "ftp://x.org/a://b/c#d", "http://com/",
    "http://x.net/es", "http://spam.org/a", "https://www.spam.org/a/?utm_source=q#z", "http://u:p@spam.org:80//a", "http://spam.org/a?b=2&a=1", "http://spam.org/a?a=1&&b=2&ref=x", "http://ÄÖ.org/É\n/x",
    "http://other.org/" + "a" * 200000,
]
LISTED = ["http://spam.org/a", "http://spam.org/a?a=1&b=2", "nothing", None, "http://spam.org/a", "http://example.com/en/1"]


def plain(url, rules, listed):
    """Host, path, rule and verdict, written plainly."""

    def split(u):
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), path, rest

    def form(u):
        if u is None or "://" not in u:
            return None
        host, path, rest = split(u)
        host = host.split("@", 1)[-1] if "@" in host else host
        for port in (":80", ":443"):
            host = host.removesuffix(port)
        host = host.removesuffix(".").removeprefix("www.")
        path = re.sub("/+", "/", path)
        for end in ("/index.html/", "/index.htm/", "/index.html", "/index.htm", "/"):
            if path.endswith(end):
                path = path[: -len(end)]
                break
        query = rest.split("#", 1)[0].partition("?")[2]
        names = sorted(p for p in query.split("&") if p and not p.startswith("utm_") and p.split("=")[0] not in ("ref", "fbclid", "gclid"))
        return host + path + ("?" + "&".join(names) if names else "")

    host, path = split(url)[:2] if url is not None and "://" in url else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)))
        return host, path, best.host + best.path, best.verdict
    return host, path, None, "block" if form(url) is not None and form(url) in {form(x) for x in listed} else "allow"


@pytest.mark.parametrize("most", [url_filter.MAX_BROADCAST_BLOCKS, 0])
def test_plainly_judged(spark, most):
    """Nulls, empty and long URLs, repeated rows, clashing columns; the filter broadcast and shuffled."""
    rows = [(n, u, True, "x", "y") for n, u in enumerate(URLS)] + [(None, URLS[4], None, None, None), (3, URLS[3], None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, listed boolean, canonical string, block string")
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    rules = [*RULES, Rule("block", "x.net", "/"), Rule("allow", "net", "/es/1")]
    got = sorted((tuple(r) for r in judge(pages, rules, listed, max_broadcast_blocks=most).drop("listed").collect()), key=str)
    assert got == sorted(((r[0], *plain(r[1], rules, LISTED)) for r in rows), key=str)


def test_empty_tables(spark):
    pages, none = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string"), spark.createDataFrame([], "page_id long, url string")
    assert [tuple(r) for r in judge(pages, RULES, none.select("url")).collect()] == [(1, "a.org", "/x", None, "allow", False)]
    assert judge(none, RULES, pages.select("url")).count() == 0
    assert judge(pages, [], pages.select("url")).first().verdict == "block"


def test_bloom_filter_misses_none_and_passes_few(spark):
    urls = spark.range(40000).select(F.concat(F.lit("http://h.org/"), F.col("id")).alias("u")).select(canonical(F.col("u")).alias("canonical"))
    listed = urls.filter(F.crc32("canonical") % 2 == 0)
    blocks = listed.count() * url_filter.BITS_PER_URL // 512 + 1
    found = with_possible(urls, bloom_filter(listed, blocks), blocks, True)
    n = {(r.inside, r.possible): r["count"] for r in found.groupBy((F.crc32("canonical") % 2 == 0).alias("inside"), "possible").count().collect()}
    assert (True, False) not in n
    assert n.get((False, True), 0) < 0.01 * n[(False, False)]


def test_plan_probes_first_and_runs_no_python(spark):
    plan = op11_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "ShuffledHashJoin" in plan and plan.count("BroadcastHashJoin") == 2


def test_equals_sql_on_every_page(spark):
    sf = "/root/testdata/sf0.01"  # the smaller one lists no page
    want = duckdb.connect().execute(url_filter.OP11_SQL.replace("FROM pages", f"FROM '{sf}/pages.parquet'")).fetchall()
    got = [tuple(r) for r in op11_url_filter(spark, sf).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}
