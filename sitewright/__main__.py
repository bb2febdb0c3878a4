"""The command line: audit captured pages and write reports, or list the rules.

    python -m sitewright audit --pages PATH --sites PATH --out PATH [--format html] [--only seo,health] [--fail-on error]
    python -m sitewright crawl --web PATH --starts PATH --out PATH [--max-pages 50] [--exclude "/drafts/**"] [--fail-on error]
    python -m sitewright checks [--format markdown]

Exit codes: 0 nothing at or above --fail-on, 1 something, 2 wrong usage, 3 a site that could not be audited, 70 a fault of the program.
"""

from __future__ import annotations

import argparse
import sys

from .operators import rules as R

FORMATS = ("text", "json", "markdown", "html")


class _Unsaid(str):
    """A usual value that nobody asked for."""


def groups(value: str) -> tuple[str, ...]:
    """Groups in their own order, from a list with commas."""
    named = {g.strip() for g in value.split(",") if g.strip()}
    if not named or named - set(R.GROUPS):
        raise argparse.ArgumentTypeError(f"groups are {', '.join(R.GROUPS)}")
    return tuple(g for g in R.GROUPS if g in named)


def within(low: int, high: int):
    def integer(value: str) -> int:
        if not value.isdigit() or not low <= int(value) <= high:
            raise argparse.ArgumentTypeError(f"a whole number from {low} to {high} is wanted")
        return int(value)

    return integer


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sitewright", description="Audit captured web pages with Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("audit")
    run.add_argument("--pages", required=True, help="Parquet: site_id, ord, url, final_url, html, status, ...")
    run.add_argument("--sites", required=True, help="Parquet: site_id, start_url, origin, robots, ...")
    for more in ("assets", "sitemap-files", "sitemap-urls", "external"):
        run.add_argument(f"--{more}")
    whole = commands.add_parser("crawl")
    whole.add_argument("--web", required=True, help="Parquet of captured answers: url, method, status, headers, failure, html, bytes")
    whole.add_argument("--starts", required=True, help="Parquet: site_id, start_url")
    for name, low, high, usual in (("--max-pages", 1, 2000, 50), ("--max-depth", 0, 20, 3), ("--max-assets", 0, 5000, 300), ("--delay", 0, 60_000, 1000)):
        whole.add_argument(name, type=within(low, high), default=usual)
    whole.add_argument("--exclude", action="append", default=[], help="a glob of paths; may be given often")
    whole.add_argument("--check-external", action="store_true")
    whole.add_argument("--ignore-robots", action="store_true")
    whole.add_argument("--user-agent", default="sitewright")
    for command in (run, whole):
        command.add_argument("--out", required=True)
        command.add_argument("--format", choices=FORMATS, default=_Unsaid("html"), help="by the ending of --out where not given: .json, .md, .txt; else html")
        command.add_argument("--only", type=groups, default=R.GROUPS)
        command.add_argument("--fail-on", choices=("error", "warning", "info", "never"), default="never")
        command.add_argument("--shown", type=within(1, 5000), default=50, help="findings per rule in a report")
    listed = commands.add_parser("checks")
    listed.add_argument("--format", choices=("text", "markdown"), default="text")
    return top


def format_of(out: str) -> str:
    """The format that a name's ending asks for."""
    return {"json": "json", "md": "markdown", "markdown": "markdown", "txt": "text"}.get(out.rstrip("/").rpartition(".")[2].lower(), "html")


def reference(form: str) -> str:
    """The rules, as text or as a Markdown table."""
    cell = lambda x: x.replace("|", "\\|")
    if form == "text":
        return "\n".join(f"{r.id:18}{r.severity:9}{r.group:15}{r.title}" for r in R.registry()) + "\n"
    rows = [f"| {r.id} | {r.severity} | {r.group} | {cell(r.title)} | {cell(r.heuristic or '')} |" for r in R.registry()]
    return "\n".join(["| Rule | Severity | Group | Title | Note |", "| --- | --- | --- | --- | --- |", *rows]) + "\n"


def _audit_of(args, table):
    from pyspark.sql import functions as F

    from .plans.audit import audit
    from .sources import html

    raw = table(args.pages)
    keys = [c for c in raw.columns if c not in ("html", "final_url")]
    robots = F.try_element_at("headers", F.lit("x-robots-tag")) if "headers" in raw.columns else None
    pages = html.documents(html.parsed(raw, *keys), robots).withColumn("doc", F.when(F.col("status").between(200, 299), F.col("doc")))
    return audit(pages, table(args.sites), table(args.assets), table(args.sitemap_files), table(args.sitemap_urls), table(args.external), args.only)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "checks":
        sys.stdout.write(reference(args.format))
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .cluster import ship
    from .operators import rollups
    from .plans.audit import Options
    from .plans.runs import run as whole_run
    from .sources import report_files, reports, tables

    args.format = format_of(args.out) if isinstance(args.format, _Unsaid) else args.format
    try:
        report_files.writable(args.out)
    except ValueError as error:
        sys.stderr.write(f"{error}\n")
        return 2
    spark = ship(SparkSession.builder.appName("sitewright").getOrCreate())
    # what a run writes for itself goes when its reports are there
    with tables.scope(spark):
        table = lambda path: spark.read.parquet(path) if path else None
        unopened = 0
        if args.command == "crawl":
            options = Options(args.max_pages, args.max_depth, args.max_assets, args.delay, groups=args.only, exclude=tuple(args.exclude), external=args.check_external, ignore_robots=args.ignore_robots, user_agent=args.user_agent)
            done = whole_run(table(args.starts), table(args.web), options)
            unopened, run = done.opened.where("problem is not null").count(), done.audit
        else:
            run = _audit_of(args, table)
        if args.format == "json":
            report_files.write_json(run, args.out)
        else:
            reports.write({"text": reports.as_text, "markdown": reports.as_markdown, "html": reports.as_html}[args.format](run, args.shown), args.out)
        worst = int(rollups.exit_codes(run.findings, run.facts, args.fail_on).agg(F.max("exit_code")).first()[0] or 0)
        return 3 if unopened else worst


def guarded(argv: list[str] | None = None) -> int:
    """The exit code of `main`; 70, with the fault's kind and text on standard error, where it fails."""
    try:
        return main(argv)
    except Exception as error:  # noqa: BLE001
        sys.stderr.write(f"internal error: {type(error).__name__}: {error}\n")
        return 70


if __name__ == "__main__":
    sys.exit(guarded())
