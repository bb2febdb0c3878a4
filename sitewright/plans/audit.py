"""A whole audit: captured pages and crawl facts in, findings and roll-ups out, for many sites at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from ..operators import graph, rollups
from ..operators import rules as R
from ..operators import views as V
from ..sources.tables import kept


@dataclass(frozen=True)
class Options:
    """What a run may do and looks at."""

    max_pages: int = 50
    max_depth: int = 3
    max_assets: int = 300
    delay_ms: int = 1000
    concurrency: int = 2
    timeout_ms: int = 15_000
    groups: tuple[str, ...] = R.GROUPS
    exclude: tuple[str, ...] = ()
    external: bool = False
    ignore_robots: bool = False
    user_agent: str = "sitewright"


@dataclass(frozen=True)
class Audit:
    pages: DataFrame
    facts: DataFrame
    findings: DataFrame
    outcomes: DataFrame
    scope: DataFrame | None = None

    @property
    def summary(self) -> DataFrame:
        return rollups.summary_rows(self.findings, self.facts)

    @property
    def fix_first(self) -> DataFrame:
        return rollups.fix_first(self.findings, self.outcomes)

    @property
    def page_counts(self) -> DataFrame:
        return rollups.page_counts(self.pages, self.findings)


def audit(pages: DataFrame, sites: DataFrame, assets: DataFrame | None = None, files: DataFrame | None = None, sitemap_urls: DataFrame | None = None, external: DataFrame | None = None, groups: tuple[str, ...] = R.GROUPS, used: DataFrame | None = None) -> Audit:
    """Evaluate the rules of some groups. `pages` holds `doc` already; where it has no inlinks, they are derived.

    `used` (site_id, url, page), as of `graph.usage`, is for assets whose used_by names some of their pages only.
    """
    given = V.complete(sites, V.SITE_COLUMNS)
    orphan = lambda df, cols: V.complete(df, cols) if df is not None else V.empty(pages, cols)
    assets, files = orphan(assets, V.ASSET_COLUMNS), orphan(files, V.FILE_COLUMNS)
    sitemap_urls, external = orphan(sitemap_urls, V.SITEMAP_URL_COLUMNS), orphan(external, V.EXTERNAL_COLUMNS)
    linked = pages if "inlinks" in pages.columns else graph.with_inlinks(kept(V.complete(pages, {"ord": "double"}), "pages"))
    # extraction runs in Python, and its facts are read by many branches: once is enough
    viewed = kept(V.with_views(linked, given), "pages")
    facts = rollups.site_facts(viewed, given, assets, files, sitemap_urls)
    found = [R.packed(df, name, groups) for name, df in (("pages", viewed), ("sites", facts), ("assets", assets), ("files", files), ("external", external))]
    related = [f.where(f["group"].isin(*groups)) for f in graph.relations(viewed, given, assets, sitemap_urls, used)]
    findings = R.tidied(reduce(DataFrame.unionByName, found + related))
    findings = kept(rollups.applicable(findings, facts), "findings")
    return Audit(viewed, facts, findings, rollups.outcomes(findings, facts, groups))
