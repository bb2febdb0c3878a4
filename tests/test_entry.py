"""Registered queries against their SQL on the smallest tables, and what is left when the operators for training data are not there."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from sitewright.plans import queries

ROOT = Path(__file__).resolve().parent.parent
SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(r[k] for k in order)) for r in data)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["page_facts", "text_rules", "markup_rules", "transport_rules", "duplicate_titles_pooled", "robots_decisions", "excluded_pages", "fix_first", "summary", "tidy_texts", "origins", "resources", "page_weights", "site_audit", "page_inlinks", "external_links", "robots_facts", "site_openings", "sitemap_files", "sitemap_urls", "web_answers", "lab_scores", "header_values"])
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, str(SF))
    want = duck.sql(queries.SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_every_audit_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL) and set(queries.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_training_data_operators(tmp_path, pipeline):
    """With corpus_pipeline.py still there, and without it."""
    for name in ("__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        if (ROOT / name).exists():
            (tmp_path / name).symlink_to(ROOT / name)
    package = tmp_path / "sitewright"
    package.mkdir()
    for p in (ROOT / "sitewright").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/tmp"})
    assert done.stdout.split() == ["True", "False"], done.stderr


@pytest.mark.parametrize("name", ["markup_rules", "transport_rules", "page_facts"])
def test_pages_of_any_depth_match_sql(spark, tmp_path, name):
    """Elements that stay open nest each paragraph deeper; what comes after 256 of them is read, and the page isn't taken to be cut."""
    pages = [(k, f"https://e.com/en/{k}", f'<html lang="en"><head><title>Page {k}</title></head><body><a href="/a">one</a><article><h1>Top</h1>{"<p><b>word<br>" * n}</article><footer>end</footer></body></html>') for k, n in ((1, 2), (126, 127), (127, 128), (252, 129), (840, 5000))]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(tmp_path)), c.sql(queries.SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["markup_rules", "transport_rules", "page_facts", "text_content"])
def test_pages_of_many_items_and_long_texts_match_sql(spark, tmp_path, name):
    """Over 5,000 items of a kind, of which the last one alone lacks its name; texts of over 2,000 characters, and of over 20,000 blanks before their first word."""
    long, late = "word &amp; " * 3000 + "end", " " * 25_000 + "late"

    def page(n, title):
        links = "".join(f'<a href="/{i}">to {i}</a>' for i in range(n))
        heads = "".join(f"<h2>part {i}</h2>" for i in range(n))
        scripts = f'<script src="/{n}.js"></script>' * n
        return f'<html lang="en"><head><title>{title}</title></head><body><h1>{title}</h1>{links}<a href="/l">{title}</a><a href="/none"></a>{heads}<h4>deep</h4>{scripts}<article>text</article><footer>end</footer></body></html>'

    pages = [(k, f"https://e.com/en/{k}", page(n, title)) for k, n, title in ((1, 2, "short"), (5, 5001, "many"), (6, 6000, long), (7, 5, late), (27, 5200, "many"))]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(tmp_path)), c.sql(queries.SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_duplicate_titles_leave_out_variants(spark, tmp_path):
    """Pages that name another of their set as canonical, or say noindex, don't count; those that name themselves, or a page of another title or site, do."""
    canonical = '<link rel="canonical" href="{}">'
    heads = {
        1: "", 2: canonical.format("https://e.com/1"), 3: canonical.format("/1"), 4: canonical.format("https://e.com/4"), 5: canonical.format("https://f.com/1"), 6: canonical.format("https://e.com/9"), 7: '<meta name="robots" content="noindex">', 8: canonical.format("https://e.com/7"),
        9: "", 10: canonical.format("https://e.com/1") + "</head><body>", 11: "</head><body>" + canonical.format("https://e.com/1"), "12#top": "", 13: canonical.format("https://e.com/12#top"),
    }
    pages = [(int(str(k).removesuffix("#top")), f"https://{'f' if k == 10 else 'e'}.com/{k}", f'<html><head><title>{"Other" if k == 9 else "Same"}</title>{head}</head><body><h1>h</h1></body></html>') for k, head in heads.items()]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name, left in (("duplicate_titles", [1, 4, 5, 6, 8, 11, 12]), ("duplicate_titles_pooled", [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13])):
        got, want = queries.QUERIES[name](spark, str(tmp_path)), c.sql(queries.SQL[name])
        found = [tuple(r) for r in got.collect()]
        assert sorted(r[1] for r in found) == left and {r[4] for r in found} == {len(left) - 1}
        assert rows(got.columns, found) == rows(want.columns, want.fetchall())
