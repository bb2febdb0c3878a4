"""Extraction and rules: one clean page on which nothing fires, and one change at a time; roll-ups, robots, crawl, reports."""

import json

import pytest
from pyspark.sql import functions as F

from sitewright.operators import crawl, graph, pacing, robots, rollups
from sitewright.operators import rules as R
from sitewright.plans.audit import audit
from sitewright.sources.tables import kept
from sitewright.sources import html as H
from sitewright.sources import lab, reports, sitemaps, web
from sitewright.streaming import feed

HEAD = (
    '<title>A perfectly ordinary title</title><meta name="description" content="A description of this page that is long enough to be of some use."><meta name="viewport" content="width=device-width">'
    '<link rel="canonical" href="https://e.com/"><link rel="icon" href="/i.ico"><meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:image" content="i">'
)
TEXT = "word " * 160
CLEAN = f'<html lang="en"><head>{HEAD}</head><body><h1>Top</h1><p>{TEXT}</p><a href="/two">The second page</a></body></html>'
HEADERS = {"content-encoding": "gzip", "strict-transport-security": "max-age=1", "content-security-policy": "default-src 'self'; frame-ancestors 'none'", "x-content-type-options": "nosniff", "referrer-policy": "no-referrer"}
PAGES = "site_id string, ord double, url string, final_url string, html string, status int, failure string, headers map<string,string>, response_ms bigint, bytes bigint, transfer_bytes bigint, is_html boolean, in_sitemap boolean, inlinks array<string>, hops array<struct<url:string,status:int,location:string>>"
SITES = "site_id string, start_url string, origin string, sitemap_found boolean, robots struct<status:int,present:boolean,disallow_all:boolean,sitemaps:array<string>,crawl_delay_ms:bigint,ignored:boolean>, probes struct<http_to_https:boolean,sibling_redirects:boolean,sibling_host:string,soft404:boolean,favicon:boolean>, external_checked boolean, limits struct<max_pages:int,max_depth:int,pages_crawled:int,uncrawled:int,assets_not_measured:int,delay_raised:boolean>, blocked_by_robots array<string>"
ASSETS = "site_id string, pos int, url string, kind string, third_party boolean, status int, bytes bigint, content_type string, content_encoding string, cache_control string, measured boolean, used_by array<string>"
HOP = ("https://e.com/h", 301, "https://e.com/x")


def page(site, **over):
    row = {"site_id": site, "ord": 0.0, "url": "https://e.com/", "final_url": None, "html": CLEAN, "status": 200, "failure": None, "headers": HEADERS, "response_ms": 100, "bytes": 5000, "transfer_bytes": 2000, "is_html": True, "in_sitemap": False, "inlinks": [], "hops": []} | over
    row["final_url"] = row["final_url"] or row["url"]
    return tuple(row.values())


def site(name, **over):
    row = {"site_id": name, "start_url": "https://e.com/", "origin": "https://e.com", "sitemap_found": True, "robots": (200, True, False, ["https://e.com/s.xml"], None, False), "probes": (True, True, "www.e.com", False, True), "external_checked": True, "limits": (50, 3, 1, 0, 0, False), "blocked_by_robots": []} | over
    return tuple(row.values())


def asset(site, **over):
    row = {"site_id": site, "pos": 0, "url": "https://e.com/a", "kind": "script", "third_party": False, "status": 200, "bytes": 900, "content_type": "text/javascript", "content_encoding": None, "cache_control": "max-age=9999", "measured": True, "used_by": ["https://e.com/"]} | over
    return tuple(row.values())


def swap(a, b):
    return CLEAN.replace(a, b)


BODY = "</body>"
#: rule -> what differs from the clean site: pages, site, assets, files, urls, external
CASES = {
    "SEO-TITLE-001": {"pages": [{"html": swap("A perfectly ordinary title", "")}]},
    "SEO-TITLE-002": {"pages": [{"html": swap("A perfectly ordinary title", "Short")}]},
    "SEO-TITLE-004": {"pages": [{"html": swap("</head>", "<title>Another one here</title></head>")}]},
    "SEO-DESC-010": {"pages": [{"html": swap('name="description"', 'name="other"')}]},
    "SEO-DESC-011": {"pages": [{"html": swap("A description of this page that is long enough to be of some use.", "Brief")}]},
    "SEO-H1-020": {"pages": [{"html": swap("h1>", "h2>")}]},
    "SEO-H1-021": {"pages": [{"html": swap(BODY, "<h1>x</h1></body>")}]},
    "SEO-CANON-030": {"pages": [{"html": swap('rel="canonical"', 'rel="other"')}]},
    "SEO-CANON-031": {"pages": [{"html": swap("</head>", '<link rel="canonical" href="/b"></head>')}]},
    "SEO-CANON-033": {"pages": [{"html": swap("https://e.com/", "https://f.com/")}]},
    "SEO-INDEX-040": {"pages": [{"html": swap("</head>", '<meta name="ROBOTS" content="NoIndex"></head>')}]},
    "SEO-INDEX-041": {"pages": [{"html": swap("</head>", '<meta name="robots" content="none"></head>'), "in_sitemap": True}]},
    "SEO-INDEX-042": {"urls": ["https://e.com/no"], "site": {"blocked_by_robots": ["https://e.com/no"]}},
    "SEO-INDEX-043": {"pages": [{"html": swap("</head>", '<meta name="robots" content="noindex"></head>')}]},
    "SEO-LANG-050": {"pages": [{"html": swap(' lang="en"', "")}]},
    "SEO-VIEW-051": {"pages": [{"html": swap('name="viewport"', 'name="x"')}]},
    "SEO-OG-060": {"pages": [{"html": swap('content="i"', 'content=" "')}]},
    "SEO-LD-070": {"pages": [{"html": swap(BODY, '<script type="application/ld+json">{"a": NaN}</script></body>')}]},
    "SEO-ROBOTS-080": {"site": {"robots": (404, False, False, ["https://e.com/s.xml"], None, False)}},
    "SEO-ROBOTS-081": {"site": {"robots": (200, True, True, ["https://e.com/s.xml"], None, False)}},
    "SEO-ROBOTS-082": {"site": {"robots": (503, False, False, ["https://e.com/s.xml"], None, False)}},
    "SEO-MAP-090": {"site": {"sitemap_found": False}},
    "SEO-MAP-091": {"site": {"robots": (200, True, False, [], None, False)}, "files": [("https://e.com/sitemap.xml", 200, True, None)]},
    "SEO-MAP-092": {"pages": [{}, {"url": "https://e.com/x", "ord": 1.0, "status": 404, "is_html": False, "html": None, "in_sitemap": True}], "files": [("https://e.com/s.xml", 200, True, None)]},
    "SEO-MAP-093": {"files": [("https://e.com/s.xml", 200, False, "not a sitemap")]},
    "SEO-MAP-094": {"pages": [{}, {"url": "https://e.com/o", "ord": 1.0, "html": CLEAN.replace("ordinary", "unusual").replace("A description", "Another text").replace('href="https://e.com/"', 'href="https://e.com/o"'), "in_sitemap": True}]},
    "SEO-THIN-100": {"pages": [{"html": swap(TEXT, "few words")}]},
    "HEALTH-LINK-001": {"pages": [{}, {"url": "https://e.com/x", "ord": 1.0, "status": 404, "is_html": False, "html": None, "inlinks": ["https://e.com/"]}]},
    "HEALTH-LINK-002": {"pages": [{}, {"url": "https://e.com/x", "final_url": "https://e.com/", "ord": 1.0, "is_html": False, "html": None, "inlinks": ["https://e.com/"], "hops": [HOP]}]},
    "HEALTH-REDIR-010": {"pages": [{}, {"url": "https://e.com/x", "ord": 1.0, "is_html": False, "html": None, "hops": [HOP, HOP]}]},
    "HEALTH-REDIR-011": {"pages": [{}, {"url": "https://e.com/x", "ord": 1.0, "status": None, "failure": "redirect-loop", "is_html": False, "html": None, "hops": [HOP]}]},
    "HEALTH-HTTPS-020": {"site": {"probes": (False, True, "www.e.com", False, True)}},
    "HEALTH-HTTPS-021": {"pages": [{"html": swap(BODY, '<img src="http://e.com/i.png" alt="" width=1 height=1></body>')}]},
    "HEALTH-HTTPS-022": {"pages": [{"html": swap(BODY, '<a href="http://e.com/x">plain link</a></body>')}]},
    "HEALTH-HOST-023": {"site": {"probes": (True, False, "www.e.com", False, True)}},
    "HEALTH-404-030": {"site": {"probes": (True, True, "www.e.com", True, True)}},
    "HEALTH-FAV-040": {"site": {"probes": (True, True, "www.e.com", False, False)}},
    "HEALTH-HDR-050": {"pages": [{"headers": {k: v for k, v in HEADERS.items() if k != "strict-transport-security"}}]},
    "HEALTH-HDR-051": {"pages": [{"headers": {k: v for k, v in HEADERS.items() if k != "content-security-policy"} | {"x-frame-options": "DENY"}}]},
    "HEALTH-HDR-052": {"pages": [{"headers": HEADERS | {"x-content-type-options": "x"}}]},
    "HEALTH-HDR-053": {"pages": [{"headers": {k: v for k, v in HEADERS.items() if k != "referrer-policy"}}]},
    "HEALTH-HDR-054": {"pages": [{"headers": HEADERS | {"content-security-policy": "default-src 'self'"}}]},
    "HEALTH-EXT-060": {"external": [("https://f.com/", 404, None)]},
    "HEALTH-FETCH-070": {"pages": [{}, {"url": "https://e.com/x", "ord": 1.0, "status": None, "failure": "timeout", "is_html": False, "html": None}]},
    "PERF-RESP-001": {"pages": [{"response_ms": 801}]},
    "PERF-HTML-010": {"pages": [{"bytes": 500_001}]},
    "PERF-COMP-020": {"pages": [{"headers": {k: v for k, v in HEADERS.items() if k != "content-encoding"}}]},
    "PERF-COMP-021": {"assets": [{"bytes": 2000}]},
    "PERF-CACHE-030": {"assets": [{"cache_control": "max-age=10"}]},
    "PERF-WEIGHT-040": {"pages": [{"transfer_bytes": 2_000_001}]},
    "PERF-WEIGHT-041": {"pages": [{"transfer_bytes": 5_000_001}]},
    "PERF-REQ-042": {"pages": [{"html": swap(BODY, "".join(f'<script src="/{k}.js"></script>' for k in range(81)) + BODY)}]},
    "PERF-IMG-050": {"assets": [{"kind": "image", "bytes": 300_001}]},
    "PERF-IMG-051": {"assets": [{"kind": "image", "bytes": 1_000_001}]},
    "PERF-IMG-052": {"pages": [{"html": swap(BODY, '<img src="/i.png" alt="x" width=1></body>')}]},
    "PERF-IMG-053": {"pages": [{"html": swap(BODY, '<img src="/i.png" alt="x" width=1 height=1>' * 4 + BODY)}]},
    "PERF-IMG-054": {"assets": [{"kind": "image", "bytes": 100_001, "content_type": "image/png; x"}]},
    "PERF-BLOCK-060": {"pages": [{"html": swap("</head>", '<script src="/x.js"></script></head>')}]},
    "PERF-BLOCK-061": {"pages": [{"html": swap("</head>", "".join(f'<link rel="stylesheet" href="/{k}.css">' for k in range(5)) + "</head>")}]},
    "A11Y-ALT-001": {"pages": [{"html": swap(BODY, "<img src=/i.png width=1 height=1></body>")}]},
    "A11Y-LABEL-010": {"pages": [{"html": swap(BODY, '<input name="q"></body>')}]},
    "A11Y-LINK-020": {"pages": [{"html": swap(BODY, '<a href="/x"> </a></body>')}]},
    "A11Y-LINK-021": {"pages": [{"html": swap(BODY, '<a href="/x">Click here!</a></body>')}]},
    "A11Y-BTN-030": {"pages": [{"html": swap(BODY, '<div role="button"></div></body>')}]},
    "A11Y-HEAD-040": {"pages": [{"html": swap(BODY, "<h3>x</h3></body>")}]},
    "A11Y-FRAME-050": {"pages": [{"html": swap(BODY, '<iframe src="/x"></iframe></body>')}]},
}
DUPLICATE = [{}, {"url": "https://e.com/b", "ord": 1.0, "html": CLEAN.replace('href="https://e.com/"', 'href="https://e.com/b"')}]
CASES["SEO-TITLE-003"] = CASES["SEO-DESC-012"] = {"pages": DUPLICATE}
CASES["SEO-CANON-032"] = {"pages": [{"html": CLEAN.replace('href="https://e.com/"', 'href="https://e.com/gone"')}, {"url": "https://e.com/gone", "ord": 1.0, "status": 410, "is_html": False, "html": None}]}


@pytest.fixture(scope="module")
def run(spark):
    """All cases in one audit: each is a site of its own."""
    pages, sites, assets, files, urls, external = [], [], [], [], [], []
    for name, case in {"clean": {}, **CASES}.items():
        pages += [page(name, **p) for p in case.get("pages", [{}])]
        sites.append(site(name, **case.get("site", {})))
        assets += [asset(name, **a) for a in case.get("assets", [{}])]
        files += [(name, k, *f) for k, f in enumerate(case.get("files", []))]
        urls += [(name, k, u) for k, u in enumerate(case.get("urls", []))]
        external += [(name, k, *e, ["https://e.com/"]) for k, e in enumerate(case.get("external", []))]
    rows = spark.createDataFrame(pages, PAGES)
    docs = H.documents(H.parsed(rows, *[c for c in rows.columns if c not in ("html", "final_url")])).withColumn("doc", F.when((F.col("status") == 200) & F.col("is_html"), F.col("doc")))
    got = audit(
        docs, spark.createDataFrame(sites, SITES), spark.createDataFrame(assets, ASSETS), spark.createDataFrame(files, "site_id string, pos int, url string, status int, ok boolean, note string"),
        spark.createDataFrame(urls, "site_id string, pos int, url string"), spark.createDataFrame(external, "site_id string, pos int, url string, status int, failure string, used_by array<string>"),
    )
    return got, got.findings.collect(), got.outcomes.collect()


def test_registry():
    ids = [r.id for r in R.registry()]
    assert len(ids) == len(set(ids)) == 69
    assert {g: len(R.registry((g,))) for g in R.GROUPS} == {"seo": 30, "health": 17, "performance": 15, "accessibility": 7}
    assert set(CASES) == set(ids)


def test_nothing_fires_on_the_clean_page(run):
    assert [f for f in run[1] if f.site_id == "clean"] == []
    assert {o.status for o in run[2] if o.site_id == "clean"} == {"pass", "not-applicable"}


@pytest.mark.parametrize("rule", sorted(CASES))
def test_each_rule_fires(run, rule):
    found = [f for f in run[1] if f.site_id == rule and f.check_id == rule]
    assert found and all(f.detail and len(f.detail) <= 200 for f in found)
    expected = R.get(rule)
    assert {(f.severity, f.group) for f in found} == {(expected.severity, expected.group)}
    assert [o.status for o in run[2] if o.site_id == rule and o.check_id == rule] == ["fail"]


def test_rollups_of_a_run(run):
    got, found, _ = run
    first = got.fix_first.where("site_id = 'SEO-DESC-012'").collect()
    assert [(r.check_id, r.affected) for r in sorted(first, key=lambda r: r.rank)] == [("SEO-DESC-012", 2), ("SEO-TITLE-003", 2)]
    total = {r.site_id: r for r in got.summary.where("group = 'Total'").collect()}
    assert all(total[s].error + total[s].warning + total[s].info == sum(f.site_id == s for f in found) for s in total)
    codes = {r.site_id: r.exit_code for r in rollups.exit_codes(got.findings, got.facts, "error").collect()}
    assert codes["clean"] == 0 and codes["SEO-TITLE-001"] == 1 and codes["SEO-TITLE-002"] == 0


def test_reports(run):
    got = run[0]
    for make in (reports.as_text, reports.as_markdown, reports.as_html, reports.as_json):
        r = make(got).where("site_id = 'SEO-TITLE-001'").first().report
        assert "SEO-TITLE-001" in r
    doc = json.loads(r)
    assert doc["schema_version"] == 1 and len(doc["checks"]) == 69 and [s["group"] for s in doc["summary"]] == [*R.GROUPS, "Total"]


def test_extraction_details():
    p = H.parsed_page("<title>x &amp; y</title><p>one<p>two<!-- c -->three<b>four</b><xmp>five</xmp><svg><title>no</title></svg><noscript>six</noscript>", "https://e.com/")
    assert p["word_count"] == 4 and [e["text"] for e in p["elements"] if e["tag"] == "title"] == ["x & y", "no"]
    assert H.parsed_page("<div>" * 400, "https://e.com/")["truncated"] and not H.parsed_page("<p>" * 400, "https://e.com/")["truncated"]
    assert H.parsed_page(None, None)["elements"] == [] and H.parsed_page("</p></b><", "x")["word_count"] in (0, 1)


def test_robots(spark):
    text = "﻿User-agent: *\nDisallow: /a\nAllow: /a/b$\nCrawl-delay: 2\r\n\r\nUser-agent: Site\nUser-agent: x\nDisallow:\nDisallow: /q*z # c\nCrawl-delay: 99\nSitemap: https://e.com/s.xml\n"
    rules = robots.parsed(spark.createDataFrame([("s", text), ("t", "Disallow: /\nUser-agent: *\nDisallow: /")], "site_id string, text string"))
    paths = spark.createDataFrame([("s", "/a"), ("s", "/qxz1"), ("s", "/b"), ("t", "/x"), ("u", "/x")], "site_id string, path string")
    decided = lambda token: {(r.site_id, r.path): r.allowed for r in robots.decisions(paths, rules, token).collect()}
    assert decided("sitewright") == {("s", "/a"): True, ("s", "/qxz1"): False, ("s", "/b"): True, ("t", "/x"): False, ("u", "/x"): True}
    assert decided("other")[("s", "/a")] is False
    assert {(r.site_id, r.delay_ms, r.clamped) for r in robots.crawl_delays(rules, "sitewright").collect()} == {("s", 30000, True)}
    assert {r.site_id: r.disallow_all for r in robots.disallow_all(rules).collect()} == {"s": False, "t": True}
    assert [r.url for r in robots.sitemaps(rules).collect()] == ["https://e.com/s.xml"]


def test_sitemaps():
    assert sitemaps.parse("<?xml?><urlset><url><loc> https://e.com/a&amp;b </loc><x:loc>no</x:loc></url><url><loc><![CDATA[https://e.com/c]]></loc></url></urlset>") == ("urlset", ["https://e.com/a&b", "https://e.com/c"])
    assert sitemaps.parse("<s:sitemapindex><s:sitemap><s:loc>u</s:loc></s:sitemap></s:sitemapindex>") == ("index", ["u"])
    assert sitemaps.parse("<html></html>") == ("invalid", []) and sitemaps.parse(None) == ("invalid", []) and sitemaps.parse("<a>" * 50000)[0] == "invalid"


def test_crawl(spark):
    def answer(url, body="", status=200, **headers):
        return (url, "GET", status, {"content-type": "text/html"} | headers, None, body)

    link = lambda *to: "<body>" + "".join(f'<a href="{t}">x</a>' for t in to)
    rows = [answer("https://e.com/", link("/a", "/b", "/no", "https://f.com/")), answer("https://e.com/a", link("/c", "/")), answer("https://e.com/b", "", 301, location="/c"), answer("https://e.com/c", link("/d")), answer("https://e.com/s", link("/t")), answer("https://e.com/l", "", 302, location="/l")]
    captured = spark.createDataFrame(rows, "url string, method string, status int, headers map<string,string>, failure string, html string")
    rules = robots.parsed(spark.createDataFrame([("s", "User-agent: *\nDisallow: /no")], "site_id string, text string"))
    extract = lambda df: H.documents(H.parsed(df, *[c for c in df.columns if c not in ("html", "final_url")]))
    sites = spark.createDataFrame([site("s")], SITES)
    maps = spark.createDataFrame([("s", 0, "https://e.com/s"), ("s", 1, "https://e.com/a"), ("s", 2, "https://e.com/l")], "site_id string, pos int, url string")
    pages, blocked, left = crawl.crawled(sites, captured, rules, maps, extract, max_depth=2)
    got = {r.url.removeprefix("https://e.com"): r for r in pages.collect()}
    assert {k: r.depth for k, r in got.items()} == {"/": 0, "/a": 1, "/b": 1, "/c": 1, "/d": 2, "/s": None, "/l": None}
    assert got["/b"].final_url == "https://e.com/c" and len(got["/b"].hops) == 1 and got["/b"].doc is None and got["/c"].hops == [] and got["/l"].failure == "redirect-loop" and got["/d"].failure == "other"
    assert [r.url for r in blocked.collect()] == ["https://e.com/no"]
    assert {r.site_id: r.n for r in left.collect()} == {}
    few, _, left = crawl.crawled(sites, captured, rules, maps, extract, max_pages=2)
    assert few.count() == 2 and {r.site_id: r.n for r in left.collect()} == {"s": 4}


def test_redirects_are_judged_hop_by_hop(spark, monkeypatch):
    monkeypatch.setattr(crawl, "MAX_HOPS", 3)
    def answer(url, body="", status=200, kind="text/html", **headers):
        return (f"https://e.com{url}", "GET", status, {"content-type": kind} | headers, None, body)

    hop = lambda url, to: answer(url, "", 302, location=to)
    names = ["a/rel", "off", "barred", "left", "bad", "chain", "two", "img"]
    rows = [answer("/", "<body>" + "".join(f'<a href="/{t}">x</a>' for t in names)), hop("/a/rel", "two?q=1#f"), answer("/a/two?q=1"), hop("/off", "//f.com/x"), hop("/barred", "/no/1"), answer("/no/1", "<body><a href=/never>x</a>"), hop("/left", "/ex/1"), hop("/bad", "mailto:x"), hop("/two", "/two2"), hop("/two2", "/two"), answer("/img", "", kind="image/png")]
    rows += [hop("/chain", "/c0"), *[hop(f"/c{k}", f"/c{k + 1}") for k in range(12)]]
    captured = spark.createDataFrame(rows, "url string, method string, status int, headers map<string,string>, failure string, html string")
    rules = robots.parsed(spark.createDataFrame([("s", "User-agent: *\nDisallow: /no")], "site_id string, text string"))
    extract = lambda df: H.documents(H.parsed(df, *[c for c in df.columns if c not in ("html", "final_url")]))
    none = spark.createDataFrame([], "site_id string, pos int, url string")
    run = lambda **more: crawl.crawled(spark.createDataFrame([site("s")], SITES), captured, rules, none, extract, exclude=("/ex/*",), **more)
    pages, blocked, _ = run()
    got = {r.url.removeprefix("https://e.com"): r for r in pages.collect()}
    assert (got["/a/rel"].final_url, got["/a/rel"].status, got["/a/two?q=1"].hops) == ("https://e.com/a/two?q=1", 200, [])
    assert (got["/off"].final_url, got["/off"].status, got["/off"].failure) == ("https://f.com/x", 302, None)
    assert (got["/barred"].final_url, got["/barred"].status, got["/barred"].failure, got["/barred"].doc) == ("https://e.com/no/1", 302, "blocked-by-robots", None)
    assert (got["/left"].status, got["/left"].failure, len(got["/left"].hops)) == (302, None, 1)
    assert (got["/bad"].failure, got["/bad"].hops) == ("other", []) and (got["/two"].failure, len(got["/two"].hops)) == ("redirect-loop", 2)
    assert (got["/chain"].failure, len(got["/chain"].hops), got["/chain"].final_url) == ("too-many-redirects", 3, "https://e.com/c2")
    assert not {"/no/1", "/ex/1", "/never"} & set(got) and [r.url for r in blocked.collect()] == ["https://e.com/no/1"]
    pages, _, left = run(max_pages=3)
    assert [r.url for r in pages.orderBy("ord").collect()] == [f"https://e.com{u}" for u in ("/", "/a/rel", "/a/two?q=1", "/off")] and left.first().n == 6


def test_pacing(spark):
    log = spark.createDataFrame([("h", 1, 0, 1500), ("h", 2, 100, 100), ("h", 3, 5000, 10), ("g", 4, 50, 1)], "host string, request long, arrive_ms long, took_ms long")
    assert {r.request: r.start_ms for r in pacing.starts(log, 1000).collect()} == {1: 0, 2: 1000, 3: 5000, 4: 50}
    assert {r.request: r.start_ms for r in pacing.bounded_starts(log, 1000, 1).collect()} == {1: 0, 2: 1500, 3: 5000, 4: 50}
    tries = spark.createDataFrame([("u", 1, 429), ("u", 2, 200), ("v", 1, 503), ("v", 2, 503), ("v", 3, 503)], "url string, n int, status int")
    assert {(r.url, r.status, r.attempts, r.throttled) for r in pacing.final_attempts(tries).collect()} == {("u", 200, 2, False), ("v", 503, 3, True)}


def test_web_and_assets(spark):
    captured = spark.createDataFrame([("https://e.com/", "GET", 1, 200, {"content-type": "text/html; charset=latin1"}, bytearray("é".encode("latin1")), None), ("https://e.com/x", "GET", 1, None, {}, None, "ENOTFOUND")], "url string, method string, n int, status int, headers map<string,string>, body binary, error string")
    got = {r.url: r for r in web.answers(captured).collect()}
    assert got["https://e.com/"].html == "é" and got["https://e.com/x"].failure == "dns"
    assert web.charset(None, b'<meta charset="shift_jis">') == "shift_jis" and web.charset("text/html; charset=bogus", b"") == "utf-8"
    page = spark.createDataFrame([("s", 0.0, "https://e.com/", "https://e.com/", "<img src=/i.png><script src=https://f.com/s.js></script><img src=/i.png><a href=https://g.com/>x</a>")], "site_id string, ord double, url string, final_url string, html string")
    docs = H.documents(H.parsed(page, "site_id", "ord", "url")).withColumn("site_origin", F.lit("https://e.com"))
    assert [(r.url, r.kind, r.third_party, r.used_by) for r in graph.assets(docs).orderBy("pos").collect()] == [("https://e.com/i.png", "image", False, ["https://e.com/"]), ("https://f.com/s.js", "script", True, ["https://e.com/"])]
    assert [r.url for r in graph.external_links(docs).collect()] == ["https://g.com/"]


def test_many_users_of_a_page_or_resource_are_counted_and_some_named(spark):
    """Seven or more pages that link to one and use one image: six are named in page order, all are counted and weighed."""
    page = lambda k: f"https://e.com/{k}"
    rows = [("s", float(9 - k), page(k), page(k), "<img src=/i.png><a href=/hub>x</a><a href=https://g.com/>y</a>") for k in range(9)] + [("s", 20.0, page("hub"), page("hub"), "<p>x")]
    docs = kept(H.documents(H.parsed(spark.createDataFrame(rows, "site_id string, ord double, url string, final_url string, html string"), "site_id", "ord", "url")).withColumns({"site_origin": F.lit("https://e.com"), "is_page": F.lit(True), "bytes": F.lit(5).cast("bigint"), "transfer_bytes": F.lit(None).cast("bigint")}), "test")
    order = [page(k) for k in range(8, 2, -1)]
    got = {r.url: (r.inlinks, r.n_inlinks) for r in graph.with_inlinks(docs).collect()}
    assert got[page("hub")] == (order, 9) and got[page(0)] == ([], 0)
    (image,), (link,) = graph.assets(docs).collect(), graph.external_links(docs).collect()
    assert (image.used_by, image.n_pages, link.used_by, link.n_pages) == (order, 9, order, 9)
    sized = graph.assets(docs).withColumns({"bytes": F.lit(100), "measured": F.lit(True)})
    assert {r.total for r in graph.page_weights(docs, sized, graph.usage(docs)).where("url like '%/_'").collect()} == {105}


def test_lab(spark):
    good = json.dumps({"lighthouseVersion": "12.1.0", "categories": {"performance": {"score": 0.915}, "seo": {"score": 2}}, "audits": {"cumulative-layout-shift": {"numericValue": 0.127}}})
    got = lab.parsed(spark.createDataFrame([("s", "a", good), ("s", "b", "{"), ("s", "c", '{"runtimeError": {"code": "NO_FCP"}}')], "site_id string, url string, json string"))
    rows = {r.url: r for r in got.collect()}
    assert (rows["a"].performance, rows["a"].seo, rows["a"].cls, rows["a"].version, rows["a"].error) == (92, None, 0.127, "12.1.0", None)
    assert rows["b"].error == "the result isn't JSON" and rows["c"].error == "NO_FCP"
    assert lab.sections(got).first().status == "ok"


def test_streaming_feed(spark, tmp_path):
    pages = spark.createDataFrame([("s", "https://e.com/", "<p>x", 200)], "site_id string, final_url string, html string, status int")
    pages.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    query = feed.appended(stream, spark.createDataFrame([site("s")], SITES), str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert "SEO-TITLE-001" in {r.check_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_facts_of_many_items(spark):
    """Controls, labels and properties beyond 5,000 are all there, and each is known by its own label."""
    n = 6000
    html = "".join(f'<input id="i{k}" name="n{k}"><meta property="og:p{k % 5500}" content="{k}">' for k in range(n)) + "".join(f'<label for="i{k}">x</label>' for k in range(1, n)) + "<div role=button> \n</div>" * n + "<button>go</button>"
    row = H.documents(H.parsed(spark.createDataFrame([(1, "https://e.com/", html)], "page_id long, final_url string, html string"), "page_id")).withColumn("properties", F.map_keys("doc.open_graph")).first()
    assert [c.describe for c in row.doc.form_controls if not c.labelled] == ["input[name=n0]"] and len(row.doc.form_controls) == n
    assert row.doc.open_graph == {f"og:p{k}": str(k) for k in range(5500)} and row.properties == [f"og:p{k}" for k in range(5500)]
    assert [b.has_name for b in row.doc.buttons] == [False] * n + [True] and not row.truncated
