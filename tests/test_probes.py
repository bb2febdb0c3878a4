"""Probes of resources under robots.txt and excluded paths; encodings, hosts and text content at their edges."""

from sitewright.functions.urls import normalised
from sitewright.operators import probes, robots
from sitewright.sources import encodings, web
from sitewright.sources.html import parsed_page

WEB = "url string, method string, status int, headers map<string,string>, failure string, bytes long"


def test_measured_assets(spark):
    e = "https://e.com"
    ok = {"content-length": "2000", "content-type": "text/css", "cache-control": " ", "expires": "0"}
    answers = [
        (f"{e}/moved.css", "HEAD", 301, {"location": "/new.css"}, None, None), (f"{e}/new.css", "HEAD", 200, ok, None, None), (f"{e}/new.css", "GET", 200, {**ok, "content-length": "700", "content-encoding": "br"}, None, 2000),
        (f"{e}/to-no.png", "HEAD", 302, {"location": "/no/x.png"}, None, None), (f"{e}/no/x.png", "HEAD", 200, ok, None, None), (f"{e}/away.png", "HEAD", 302, {"location": "https://cdn.com/y.png"}, None, None),
        ("https://cdn.com/y.png", "HEAD", 200, ok, None, None), ("https://cdn.com/back.png", "HEAD", 302, {"location": "https://e.com/new.css"}, None, None), (f"{e}/busy.png", "HEAD", 429, {}, None, None), (f"{e}/gone.png", "HEAD", 404, ok, None, None),
        (f"{e}/only.png", "GET", 200, {}, None, 55), (f"{e}/late.js", "HEAD", None, {}, "timeout", None), (f"{e}/to-draft.png", "HEAD", 307, {"location": "/draft/1"}, None, None), (f"{e}/draft/1", "HEAD", 200, ok, None, None),
    ]
    names = ["moved.css", "to-no.png", "away.png", "busy.png", "gone.png", "only.png", "late.js", "none.png", "to-draft.png"]
    rows = [("s", k, f"{e}/{n}", "stylesheet" if n.endswith("css") else "image", False, [e]) for k, n in enumerate(names)] + [("s", 90, "https://cdn.com/y.png", "image", True, [e]), ("s", 91, "https://cdn.com/back.png", "image", True, [e])]
    assets = spark.createDataFrame(rows, "site_id string, pos int, url string, kind string, third_party boolean, used_by array<string>")
    sites = spark.createDataFrame([("s", e)], "site_id string, origin string")
    rules = robots.parsed(spark.createDataFrame([("s", "User-agent: *\nDisallow: /no")], "site_id string, text string"))
    got = {r.url.split("/")[-1]: (r.status, r.bytes, r.content_encoding, r.cache_control, r.measured) for r in probes.measured(assets, spark.createDataFrame(answers, WEB), sites, rules, exclude=("/draft/**",)).collect()}
    nothing = (None, None, None, None, False)
    assert got == {
        "moved.css": (200, 700, "br", "expires", True), "to-no.png": nothing, "away.png": nothing, "busy.png": nothing, "gone.png": (404, None, None, None, False), "only.png": (200, 55, None, None, True), "late.js": nothing,
        "none.png": nothing, "to-draft.png": nothing, "y.png": (200, 2000, None, "expires", True), "back.png": nothing,
    }


def test_encodings():
    for name, (codec, labels) in encodings.ENCODINGS.items():
        assert all(encodings.encoding(f" {x.upper()}\n") == name for x in labels.split())
        assert encodings.decoded(b"", name) == "" and isinstance(encodings.decoded(bytes(range(256)), name), str)
    assert encodings.encoding("cp037") is None and encodings.encoding(None) is None
    assert encodings.decoded(b"\x81\x9d", "windows-1252") == "\x81\x9d" and encodings.decoded(b"\xd2", "windows-1253") == "�"
    assert web.charset("text/html; charset=gb2312", b"") == "gbk" and web.charset(None, b"<meta charset = 'latin5'") == "windows-1254"


def test_hosts():
    for given, found in {
        "http://straße.de": "http://xn--strae-oqa.de/", "http://0x7f.1": "http://127.0.0.1/", "http://[::0001]:80": "http://[::1]/", "http://ex%61mple.com": "http://example.com/", "http://1.2.3.4.5": None, "http://[::1%25a]": None,
        "http://xn--a": None, "http://[1:0:0:2:0:0:0:3]": "http://[1:0:0:2::3]/", "http://­": None, "http://a..b": "http://a..b/", "http://256": "http://0.0.1.0/", "http://4294967296": None, "http://ＥＸ。com": "http://ex.com/",
    }.items():
        assert normalised(given) == found, given


def test_text_content():
    titles = lambda html: [e["text"] for e in parsed_page(html, "https://e.com/")["elements"] if e["tag"] == "title"]
    assert titles("<title>a<b</title>") == ["a<b"] and titles("<title>a &lt;b&gt; <i>c</i></TITLE x>d") == ["a <b> <i>c</i>"] and titles("<title>open <p>") == ["open <p>"]
    page = parsed_page("<body><textarea><a href='/x'>1 2</textarea><xmp><a href='/y'></xmp><script>'</scriptx>'</script ><a href='/z'>z</a>", "https://e.com/")
    assert [e["url"] for e in page["elements"] if e["tag"] == "a"] == ["https://e.com/z"]
    assert parsed_page("<title>x" * 50, None)["elements"][0]["text"].startswith("x<title>x")
