"""URLs, text scalars and robots patterns, case by case."""

import pytest
from pyspark.sql import functions as F

from sitewright.functions import text as T
from sitewright.functions import urls as U


@pytest.mark.parametrize(
    ("href", "base", "expected"),
    [
        ("/a", "https://e.com/b/c", "https://e.com/a"), ("a", "https://e.com/b/c", "https://e.com/b/a"), ("../a", "https://e.com/b/c/d", "https://e.com/b/a"), ("./", "https://e.com/b/c", "https://e.com/b/"),
        ("?q=1", "https://e.com/b", "https://e.com/b?q=1"), ("#x", "https://e.com/b?q", "https://e.com/b?q"), ("//f.com/x", "https://e.com/", "https://f.com/x"), ("HTTP://E.com:80/A", None, "http://e.com/A"),
        ("https://e.com:443", None, "https://e.com/"), ("https://e.com:8443/", None, "https://e.com:8443/"), ("mailto:a@b", "https://e.com/", None), ("javascript:void(0)", "https://e.com/", None), ("  /a b ", "https://e.com/", "https://e.com/a%20b"),
        ("/é", "https://e.com/", "https://e.com/%C3%A9"), ("/%C3%A9", "https://e.com/", "https://e.com/%C3%A9"), ("http://", None, None), ("/x", None, None), ("\\a\\b", "https://e.com/c", "https://e.com/a/b"), ("https://bücher.de/", None, "https://xn--bcher-kva.de/"),
        ("http://[::1]:80/x", None, "http://[::1]/x"), ("https://u:p@e.com/", None, "https://e.com/"), ("http://e.com/a/../../b", None, "http://e.com/b"),
    ],
)
def test_normalised(href, base, expected):
    assert U.normalised(href, base) == expected


def test_start_url():
    assert U.start_url(" example.com/x ") == "https://example.com/x" and U.start_url("localhost:8080") == "https://localhost:8080/" and U.start_url("http://E.com") == "http://e.com/"
    for bad in ("", "ftp://e.com", "mailto:x@y", "https://u:p@e.com/"):
        with pytest.raises(ValueError):
            U.start_url(bad)


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_hosts(spark):
    cases = {"example.com": "www.example.com", "www.example.com": "example.com", "www.com": None, "a.b.com": None, "localhost": None, "1.2.3.4": None, "single": None, "a..com": None}
    rows = spark.createDataFrame([(k,) for k in cases], "h string").select("h", U.sibling_host(F.col("h")).alias("s")).collect()
    assert {r.h: r.s for r in rows} == cases
    assert one(spark, U.same_site(F.lit("http://www.e.com/x"), F.lit("http://e.com"))) is True
    assert one(spark, U.same_site(F.lit("http://shop.e.com/x"), F.lit("http://e.com"))) is False
    assert one(spark, U.same_origin(F.lit("http://e.com/x"), F.lit("https://e.com/x"))) is False


def test_globs(spark):
    cases = [("/a/*", "/a/b", True), ("/a/*", "/a/b/c", False), ("/a/**", "/a/b/c", True), ("/a", "/a/b", False), ("**.pdf", "/x/y.pdf", True), ("/a.b", "/aXb", False), ("/***/z", "/q/r/z", True)]
    for glob, path, expected in cases:
        assert one(spark, U.excluded(F.lit("https://e.com" + path + "?q=/zz"), [glob])) is expected
    assert one(spark, U.excluded(F.lit("not a url"), ["**"])) is False


def test_text_scalars(spark):
    assert one(spark, T.tidy(F.lit(" a​\t\nb  c\x07 "))) == "a b c"
    assert one(spark, T.clip_end(F.lit("x" * 11), 10)) == "x" * 7 + "..." and one(spark, T.clip_end(F.lit("x" * 10), 10)) == "x" * 10
    assert one(spark, T.clip_middle(F.lit("abcdefghijkl"), 10)) == "abcd...jkl"
    assert one(spark, T.clean(F.lit("\x1b[31mred\x1b[0m \x1b]0;t\x07x"))) == "red x"
    assert one(spark, T.escape_html(F.lit("<a b='c'>&\""))) == "&lt;a b=&#39;c&#39;&gt;&amp;&quot;"
    assert one(spark, T.escape_markdown(F.lit("- *x* @me a@b"))) == "\\- \\*x\\* \\@me a@b"
    assert one(spark, T.link_text(F.lit(" Read more… » "))) == "read more"
    assert one(spark, T.robots_header(F.lit("noindex, googlebot: nofollow, noarchive"))) == ["noindex"]
    assert one(spark, T.robots_header(F.lit("unavailable_after: Tue, 25 Jun 2030, nofollow"))) == ["nofollow"]
    assert [one(spark, T.is_compressed(F.lit(x))) for x in ("gzip", "identity, BR", "identity", None)] == [True, True, False, False]
    assert [one(spark, T.cache_problem(F.lit(x))) is None for x in ("max-age=3600", "max-age=60", "no-store", "immutable", "expires", "public")] == [True, False, False, True, True, False]
    assert [one(spark, T.retry_after_ms(F.lit(v), F.lit(0))) for v in (None, "7", "100000", "Thu, 01 Jan 1970 00:00:09 GMT", "junk")] == [5000, 7000, 60000, 9000, 5000]
    assert [one(spark, T.duration_text(F.lit(v))) for v in (-1, 12000, 61000)] == ["not available", "12.0 seconds", "1 minute 1 second"]
