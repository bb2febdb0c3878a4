"""Reports written in fragments hold what reports made whole hold, in the same order, for sites of any size."""

import json
from types import SimpleNamespace

import pytest

from sitewright import __main__ as cli
from sitewright.operators import rules as R
from sitewright.sources import report_files, reports, tables

N = 3000


@pytest.fixture(scope="module")
def many(spark):
    """Two sites: one with thousands of findings and pages, one with none."""
    ids = [r.id for r in R.registry()][:5]
    found = spark.range(N).selectExpr("'big' AS site_id", f"element_at(array({', '.join(map(repr, ids))}), CAST(id % 3 AS INT) + 1) AS check_id", "'error' AS severity", "'seo' AS `group`", "IF(id % 7 = 0, NULL, 'https://e.com/' || id) AS url", "'say \"' || id || '\" \U000e0041, twice' AS detail", "IF(id % 2 = 0, array('a', 'b'), NULL) AS evidence")
    outcomes = spark.createDataFrame([(s, c, "seo", "error", "fail" if s == "big" and k < 3 else "pass") for s in ("big", "none") for k, c in enumerate(ids)], "site_id string, check_id string, group string, severity string, status string")
    facts = spark.createDataFrame([(s, f"https://{s}.com/", f"https://{s}.com") for s in ("big", "none")], "site_id string, start_url string, origin string")
    summary = spark.createDataFrame([("big", "Total", N, 0, 0), ("big", "seo", N, 0, 0), ("none", "seo", 0, 0, 0), ("none", "Total", 0, 0, 0)], "site_id string, group string, error bigint, warning bigint, info bigint")
    first = spark.createDataFrame([("big", 2, ids[1], "error", 1000), ("big", 1, ids[0], "error", 1000)], "site_id string, rank int, check_id string, severity string, affected bigint")
    pages = spark.range(N).selectExpr("'big' AS site_id", "'https://e.com/' || id AS url", "CAST(id AS DOUBLE) AS ord", "200 AS status", "id AS error", "0L AS warning", "0L AS info")
    scope = spark.createDataFrame([("big", [("Notice", "x")])], "site_id string, scope array<struct<label:string,value:string>>")
    return SimpleNamespace(findings=found, outcomes=outcomes, summary=summary, fix_first=first, page_counts=pages, facts=facts, scope=scope)


def test_fragments_say_what_whole_reports_say(spark, many, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "9")  # a site's report comes from several tasks
    try:
        done = {r.site_id: r for r in report_files.write_json(many, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    whole = {r.site_id: json.loads(r.report) for r in reports.as_json(many).collect()}
    assert set(done) == {"big", "none"}
    for site, r in done.items():
        text = open(r.file, encoding="utf-8").read()
        assert r.bytes == len(text.encode()) and "\U000e0041" not in text
        made = json.loads(text)
        for check in whole[site]["checks"]:
            del check["more"]
        pages = whole[site].get("pages") or []
        assert made["checks"] == whole[site]["checks"] and made["pages"] == pages
        assert {k: made[k] for k in ("site_id", "start_url", "origin", "scope", "summary", "fix_first", "run", "failed")} == {k: whole[site][k] for k in ("site_id", "start_url", "origin", "scope", "summary", "fix_first", "run", "failed")}
    assert not [p for p in (tmp_path / "site=big").iterdir() if p.name != "report.json"]


def test_a_target_that_can_t_be_written_is_refused(many, tmp_path):
    (tmp_path / "file").write_text("x")
    with pytest.raises(ValueError, match="can't write"):
        report_files.write_json(many, str(tmp_path / "file" / "below"))


def test_exit_codes_and_formats(tmp_path, capsys):
    (tmp_path / "file").write_text("x")
    assert cli.guarded(["audit", "--pages", "p", "--sites", "s", "--out", str(tmp_path / "file" / "x.json")]) == 2
    assert "can't write" in capsys.readouterr().err
    assert [cli.format_of(x) for x in ("a.json", "a.MD", "a.txt/", "a.html", "a")] == ["json", "markdown", "text", "html", "html"]
    assert cli.guarded(["audit", "--pages", str(tmp_path / "none"), "--sites", "s", "--out", str(tmp_path / "out")]) == 70
    assert "internal error: AnalysisException" in capsys.readouterr().err


def test_tables_go_with_their_scope(spark):
    from pathlib import Path

    with tables.scope(spark):
        df = tables.kept(spark.range(5), "scoped")
        growing = tables.Growing(spark, "scoped-parts")
        for k in range(3):
            growing.add(spark.range(k, k + 2))
        (path,) = {Path(f.removeprefix("file://")).parent for f in df.inputFiles()}
        assert path.exists() and sorted(r.id for r in growing.df.collect()) == [0, 1, 1, 2, 2, 3]
    assert not path.exists() and not Path(growing.path.removeprefix("file://")).exists()
