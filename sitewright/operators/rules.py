"""The registry of rules.

A rule on single rows is three expressions: when it fires, what it says, and its evidence. All rules on one frame are evaluated
in one pass, as an array of which the entries that fire are exploded; so seventy rules cost one scan, not seventy. Rules that
relate rows to each other are functions from the run's frames to findings (`relations`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import hostname, origin

GROUPS = ("seo", "health", "performance", "accessibility")
SEVERITIES = ("error", "warning", "info")
FINDING = "site_id string, check_id string, severity string, group string, url string, detail string, evidence array<string>"
EVIDENCE_ITEMS, EVIDENCE_LENGTH, DETAIL_LENGTH = 5, 300, 200
#: Link texts that say nothing about their target.
GENERIC_TEXTS = ("click here", "here", "read more", "more", "learn more", "link", "this")
SKIPPED_NOTE, NESTED_NOTE = "disallowed by robots.txt", "nested index, not followed"


@dataclass(frozen=True)
class Rule:
    id: str
    group: str
    severity: str
    title: str
    frame: str
    when: Callable[[], Column] | None = None
    detail: Callable[[], Column] | None = None
    evidence: Callable[[], Column] | None = None
    level: Callable[[], Column] | None = None
    applies: str = "n_pages > 0"
    heuristic: str | None = None
    scope: str = field(default="page")


_rules: list[Rule] = []


def rule(id: str, severity: str, title: str, frame: str, when=None, detail=None, evidence=None, level=None, applies="n_pages > 0", heuristic=None, scope="page") -> None:
    group = {"SEO": "seo", "HEALTH": "health", "PERF": "performance", "A11Y": "accessibility"}[id.split("-")[0]]
    _rules.append(Rule(id, group, severity, title, frame, when, detail, evidence, level, applies, heuristic, scope))


def registry(groups: tuple[str, ...] = GROUPS) -> list[Rule]:
    """The rules of some groups, in order."""
    return [r for r in _rules if r.group in groups]


def get(id: str) -> Rule | None:
    return next((r for r in _rules if r.id == id), None)


C, said = F.col, T.said
_blank = lambda c: F.coalesce(T.trimmed(F.col(c)), F.lit("")) == ""
_count = lambda c: F.size(F.filter(c, lambda x: F.lit(True)))
_indexable = lambda f: lambda: C("indexable") & f()
_page = lambda f: lambda: C("is_page") & f()
_h1 = lambda: F.size(F.filter("doc.headings", lambda h: h["level"] == 1))
_throttled = lambda c: F.coalesce(c.isin(429, 503), F.lit(False))
_none = lambda kind="array<string>": F.array().cast(kind)


def _failed(c: str = "failure") -> Column:
    return F.when(C(c).isNotNull(), said("The request failed (", C(c), ").")).otherwise(said("It answers with status ", F.coalesce(C("status").cast("string"), F.lit("unknown")), "."))


# search engines
rule("SEO-TITLE-001", "error", "A page has no title", "pages", _indexable(lambda: _blank("doc.title")), lambda: F.lit("The title element is missing or empty."))
rule("SEO-TITLE-002", "info", "A title is unusually short or long", "pages", _indexable(lambda: ~_blank("doc.title") & ~T.chars(C("doc.title")).between(10, 60)), lambda: said("The title has ", T.chars(C("doc.title")), " characters; 10 to 60 are common."), heuristic="10 to 60 characters is a convention, not a limit.")
rule("SEO-TITLE-003", "warning", "Pages share a title", "relation")
rule("SEO-TITLE-004", "warning", "A page has more than one title", "pages", _indexable(lambda: C("doc.title_count") > 1), lambda: said("The page holds ", C("doc.title_count"), " title elements."))
rule("SEO-DESC-010", "warning", "A page has no meta description", "pages", _indexable(lambda: _blank("doc.meta_description")), lambda: F.lit("The meta description is missing or empty."))
rule("SEO-DESC-011", "info", "A meta description is unusually short or long", "pages", _indexable(lambda: ~_blank("doc.meta_description") & ~T.chars(C("doc.meta_description")).between(50, 160)), lambda: said("The meta description has ", T.chars(C("doc.meta_description")), " characters; 50 to 160 are common."), heuristic="50 to 160 characters is a convention, not a limit.")
rule("SEO-DESC-012", "warning", "Pages share a meta description", "relation")
rule("SEO-H1-020", "warning", "A page has no top heading", "pages", _indexable(lambda: _h1() == 0), lambda: F.lit("There is no h1 heading."))
rule("SEO-H1-021", "info", "A page has several top headings", "pages", _indexable(lambda: _h1() > 1), lambda: said("There are ", _h1(), " h1 headings."))
rule("SEO-CANON-030", "warning", "A page names no canonical URL", "pages", _indexable(lambda: F.size("doc.canonicals") == 0), lambda: F.lit("There is no canonical link."))
rule("SEO-CANON-031", "error", "A page names different canonical URLs", "pages", _indexable(lambda: F.size(F.array_distinct("doc.canonicals")) > 1), lambda: said("The page names ", F.size(F.array_distinct("doc.canonicals")), " different canonical URLs."), lambda: F.array_distinct("doc.canonicals"))
rule("SEO-CANON-032", "error", "A canonical URL doesn't answer with a page", "relation")
_away = lambda: F.filter("doc.canonicals", lambda c: ~F.coalesce(origin(c) == C("site_origin"), F.lit(False)))
rule("SEO-CANON-033", "warning", "A canonical URL lies on another origin", "pages", _indexable(lambda: F.size(_away()) > 0), lambda: F.lit("The canonical URL lies on another origin."), _away)
_noindex = lambda: F.arrays_overlap("doc.meta_robots", F.array(F.lit("noindex"), F.lit("none")))
rule("SEO-INDEX-040", "info", "A page asks not to be indexed", "pages", _page(_noindex), lambda: F.lit("A robots directive says noindex."))
rule("SEO-INDEX-041", "error", "A page in the sitemap asks not to be indexed", "pages", _page(lambda: _noindex() & F.coalesce("in_sitemap", F.lit(False))), lambda: F.lit("The page says noindex, yet the sitemap lists it."))
rule("SEO-INDEX-042", "error", "The sitemap lists URLs that robots.txt disallows", "relation", applies="not coalesce(robots_ignored, false) and n_sitemap_urls > 0")
rule("SEO-INDEX-043", "error", "The start page asks not to be indexed", "relation")
rule("SEO-LANG-050", "warning", "A page names no language", "pages", _indexable(lambda: _blank("doc.lang")), lambda: F.lit("The html element has no lang attribute."))
rule("SEO-VIEW-051", "error", "A page has no viewport", "pages", _indexable(lambda: ~C("doc.has_viewport")), lambda: F.lit("There is no viewport meta element."))
_missing_graph = lambda: F.filter(F.array(*map(F.lit, ("og:title", "og:description", "og:image"))), lambda k: F.coalesce(F.try_element_at("doc.open_graph", k), F.lit("")) == "")
rule("SEO-OG-060", "info", "Open Graph properties are missing", "pages", _indexable(lambda: F.size(_missing_graph()) > 0), lambda: said("Missing: ", F.array_join(_missing_graph(), ", "), "."))
rule("SEO-LD-070", "warning", "A JSON-LD block doesn't parse", "pages", _indexable(lambda: F.exists("doc.json_ld", lambda b: ~b["ok"])), lambda: F.lit("At least one JSON-LD block isn't valid JSON."))
rule("SEO-ROBOTS-080", "warning", "robots.txt answers with a client error", "sites", lambda: C("robots.status").between(400, 499), lambda: said("robots.txt answers with status ", C("robots.status"), "."), applies="true", scope="site")
rule("SEO-ROBOTS-081", "error", "robots.txt disallows the whole site", "sites", lambda: C("robots.disallow_all"), lambda: F.lit("robots.txt disallows all URLs for all crawlers."), applies="true", scope="site")
rule("SEO-ROBOTS-082", "error", "robots.txt answers with a server error", "sites", lambda: C("robots.status") >= 500, lambda: said("robots.txt answers with status ", C("robots.status"), "."), applies="true", scope="site")
rule("SEO-MAP-090", "warning", "No sitemap was found", "sites", lambda: ~F.coalesce("sitemap_found", F.lit(False)) & (C("n_files_ok_status") == 0), lambda: F.when(F.size(F.coalesce("robots.sitemaps", _none())) > 0, said("robots.txt names a sitemap that could not be read", F.when(C("unread_note").isNotNull(), said(": ", C("unread_note"))), ".")).when(C("n_files_skipped") > 0, "robots.txt names no sitemap and disallows /sitemap.xml.").otherwise("robots.txt names no sitemap, and there is none at /sitemap.xml."), applies="true", scope="site")
rule("SEO-MAP-091", "info", "robots.txt names no sitemap", "sites", lambda: F.coalesce("sitemap_found", F.lit(False)) & (F.size(F.coalesce("robots.sitemaps", _none())) == 0), lambda: F.lit("There is a sitemap, but no Sitemap line in robots.txt."), applies="n_files_tried > 0", scope="site")
_mapped_bad = lambda: F.coalesce("in_sitemap", F.lit(False)) & C("requested") & ~_throttled(C("status")) & (~C("status").eqNullSafe(200) | (F.size(F.coalesce("hops", _none("array<struct<url:string,status:int,location:string>>"))) > 0))
rule("SEO-MAP-092", "error", "The sitemap lists URLs that aren't pages", "pages", _mapped_bad, lambda: F.when(C("status").eqNullSafe(200), said("The sitemap lists the URL, but it redirects (", F.size("hops"), T.plural(F.size("hops"), " hop", " hops"), ").")).otherwise(said("The sitemap lists the URL, but ", F.lower(F.left(_failed(), F.lit(1))), F.substring(_failed(), 2, 500))), lambda: F.when(C("status").eqNullSafe(200), F.array("final_url")), applies="n_files_tried > 0")
rule("SEO-MAP-093", "error", "A sitemap file doesn't parse", "files", lambda: ~C("ok") & (C("status") == 200) & C("note").isNotNull() & (C("note") != NESTED_NOTE), lambda: said("The sitemap file can't be read (", C("note"), ")."), applies="n_files_tried > 0", scope="site")
rule("SEO-MAP-094", "info", "Pages of the sitemap aren't linked", "relation", applies="n_pages > 0 and coalesce(uncrawled, 0) = 0")
rule("SEO-THIN-100", "info", "A page has little text", "pages", _indexable(lambda: C("doc.word_count") < 150), lambda: said("The page shows ", C("doc.word_count"), T.plural(C("doc.word_count"), " word.", " words.")), heuristic="150 words is a rule of thumb.")

# health
_linked = lambda: C("requested") & (F.size(F.coalesce("inlinks", _none())) > 0)
_hops = lambda: F.size(F.coalesce("hops", _none("array<struct<url:string,status:int,location:string>>")))
_hop_urls = lambda: F.transform("hops", lambda h: h["url"])
rule("HEALTH-LINK-001", "error", "A link on the site is broken", "pages", lambda: _linked() & (C("failure").isNotNull() | F.coalesce(C("status") >= 400, F.lit(False))), _failed, lambda: C("inlinks"), lambda: F.when(_throttled(C("status")), "info").otherwise("error"), applies="n_requested > 0")
rule("HEALTH-LINK-002", "warning", "A link on the site redirects", "pages", lambda: _linked() & (_hops() >= 1) & C("failure").isNull() & (C("status") == 200), lambda: said("Links to this URL are redirected to ", C("final_url"), "."), lambda: C("inlinks"), applies="n_requested > 0")
rule("HEALTH-REDIR-010", "warning", "A URL redirects more than once", "pages", lambda: C("requested") & (_hops() > 1), lambda: said("A chain of ", _hops(), " redirects ends at ", C("final_url"), "."), _hop_urls, applies="n_requested > 0")
rule("HEALTH-REDIR-011", "error", "Redirects never end", "pages", lambda: C("requested") & C("failure").isin("redirect-loop", "too-many-redirects"), lambda: F.when(C("failure") == "redirect-loop", "The redirects form a loop.").otherwise("There are more than 10 redirects."), _hop_urls, applies="n_requested > 0")
rule("HEALTH-HTTPS-020", "error", "The site is open to plain HTTP", "sites", lambda: C("origin").startswith("http://") | (C("probes.http_to_https") == F.lit(False)), lambda: F.when(C("origin").startswith("http://"), "The site is served over plain HTTP.").otherwise(said("http://", hostname(C("origin")), "/ answers without a redirect to HTTPS.")), applies="is_http or probe_http is not null", scope="site")
rule("HEALTH-HTTPS-021", "error", "A secure page loads over HTTP", "pages", _page(lambda: F.size("doc.mixed_content") > 0), lambda: said(F.size("doc.mixed_content"), T.plural(F.size("doc.mixed_content"), " resource loads over HTTP.", " resources load over HTTP.")), lambda: C("doc.mixed_content"))
_insecure = lambda: F.array_distinct(F.filter(F.transform("doc.links", lambda x: x["url"]), lambda u: F.coalesce(u.startswith("http://") & (hostname(u) == hostname(C("final_url"))), F.lit(False))))
rule("HEALTH-HTTPS-022", "warning", "A secure page links to its own site over HTTP", "pages", _page(lambda: C("final_url").startswith("https://") & (F.size(_insecure()) > 0)), lambda: said(F.size(_insecure()), T.plural(F.size(_insecure()), " link of the site uses http://.", " links of the site use http://.")), _insecure)
rule("HEALTH-HOST-023", "warning", "Two host names serve the site", "sites", lambda: C("probes.sibling_redirects") == F.lit(False), lambda: said(hostname(C("origin")), " and ", C("probes.sibling_host"), " both answer, and neither redirects to the other."), applies="probe_sibling is not null and sibling_host is not null", scope="site")
rule("HEALTH-404-030", "warning", "Missing pages answer with success", "sites", lambda: C("probes.soft404"), lambda: F.lit("A path that can't exist answers with status 200."), applies="probe_soft404 is not null", scope="site")
rule("HEALTH-FAV-040", "info", "The site has no icon", "sites", lambda: C("probes.favicon") == F.lit(False), lambda: F.lit("No page names an icon, and there is no /favicon.ico."), applies="probe_favicon is not null", scope="site")
#: Security headers: rule, severity, what is missing, and when a header map has it.
_header = lambda name: F.try_element_at("headers", F.lit(name))
_holds = lambda name, part: F.coalesce(F.lower(_header(name)).contains(part), F.lit(False))
HEADERS = {
    "HEALTH-HDR-050": ("warning", "Strict-Transport-Security", lambda: _header("strict-transport-security").isNotNull()),
    "HEALTH-HDR-051": ("info", "Content-Security-Policy", lambda: _header("content-security-policy").isNotNull()),
    "HEALTH-HDR-052": ("warning", "X-Content-Type-Options: nosniff", lambda: _holds("x-content-type-options", "nosniff")),
    "HEALTH-HDR-053": ("info", "Referrer-Policy", lambda: _header("referrer-policy").isNotNull()),
    "HEALTH-HDR-054": ("info", "X-Frame-Options or CSP frame-ancestors", lambda: _header("x-frame-options").isNotNull() | _holds("content-security-policy", "frame-ancestors")),
}
for _id, (_severity, _name, _) in HEADERS.items():
    rule(_id, _severity, f"The start page sends no {_name} header", "relation", applies="has_start" + (" and not is_http" if _id.endswith("050") else ""), scope="site")
_odd = lambda: (C("status") < 100) | (C("status") > 599)
rule("HEALTH-EXT-060", "warning", "A link to another site is broken", "external", lambda: C("failure").isNotNull() | F.coalesce(_odd() | (C("status") >= 400), F.lit(False)), lambda: F.when(C("failure").isNull() & (_odd() | C("status").isin(401, 403, 405, 429, 503)), said("It can't be told (status ", C("status"), "): many sites refuse automated requests.")).otherwise(_failed()), lambda: C("used_by"), lambda: F.when(C("failure").isNull() & (_odd() | C("status").isin(401, 403, 405, 429, 503)), "info").otherwise("warning"), applies="coalesce(external_checked, false)")
rule("HEALTH-FETCH-070", "warning", "A page was not read whole", "pages", lambda: C("requested") & (C("failure").eqNullSafe("timeout") | F.coalesce("truncated", F.lit(False))), lambda: F.when(C("failure").eqNullSafe("timeout"), "The page timed out before it was loaded.").otherwise("The body was cut, so only a part was audited."), applies="n_requested > 0")

# performance
rule("PERF-RESP-001", "warning", "A page is slow to respond", "pages", _page(lambda: C("response_ms") > 800), lambda: said("The first byte took ", C("response_ms"), " ms; more than 800 is slow."), heuristic="One measurement from one place.")
rule("PERF-HTML-010", "warning", "An HTML document is large", "pages", _page(lambda: C("bytes") > 500_000), lambda: said("The document has ", C("bytes"), " bytes; more than 500000 is large."))
_encoding = lambda: _header("content-encoding")
rule("PERF-COMP-020", "error", "A page is sent uncompressed", "pages", _page(lambda: (C("bytes") > 1024) & ~T.is_compressed(_encoding())), lambda: said(C("bytes"), " bytes of HTML are sent uncompressed."))
_asset = lambda f: lambda: C("measured") & C("bytes").isNotNull() & f()
_used = lambda: C("used_by")
rule("PERF-COMP-021", "warning", "A script or stylesheet is sent uncompressed", "assets", _asset(lambda: C("kind").isin("script", "stylesheet") & (C("bytes") > 1024) & ~T.is_compressed(C("content_encoding"))), lambda: said("A ", C("kind"), " of ", C("bytes"), " bytes is sent uncompressed."), _used, applies="n_assets > 0")
rule("PERF-CACHE-030", "warning", "A resource is not cached for long", "assets", _asset(lambda: ~C("third_party") & T.cache_problem(C("cache_control")).isNotNull()), lambda: T.cache_problem(C("cache_control")), _used, applies="n_assets > 0")
rule("PERF-WEIGHT-040", "warning", "A page is heavy", "relation", heuristic="More than 2 MB, of what was measured.")
rule("PERF-WEIGHT-041", "error", "A page is very heavy", "relation", heuristic="More than 5 MB, of what was measured.")
_resources = lambda: F.size(F.filter(F.array_union(F.array_union(F.transform(F.filter("doc.scripts", lambda s: ~s["inline"]), lambda s: s["url"]), F.transform("doc.stylesheets", lambda s: s["url"])), F.transform("doc.images", lambda i: i["url"])), lambda u: u.isNotNull()))
rule("PERF-REQ-042", "info", "A page refers to many resources", "pages", _page(lambda: _resources() > 80), lambda: said("The page refers to ", _resources(), " different scripts, stylesheets and images."), heuristic="80 is a rule of thumb.")
_image = lambda f: _asset(lambda: (C("kind") == "image") & f())
_bytes = lambda: said("The image has ", C("bytes"), " bytes.")
rule("PERF-IMG-050", "warning", "An image is large", "assets", _image(lambda: (C("bytes") > 300_000) & (C("bytes") <= 1_000_000)), _bytes, _used, applies="n_assets > 0")
rule("PERF-IMG-051", "error", "An image is very large", "assets", _image(lambda: C("bytes") > 1_000_000), _bytes, _used, applies="n_assets > 0")
_images = lambda f: F.filter("doc.images", f)
_urls = lambda items: F.filter(F.transform(items, lambda i: i["url"]), lambda u: u.isNotNull())
_unsized = lambda: _images(lambda i: i["url"].isNotNull() & (~i["width"] | ~i["height"]))
rule("PERF-IMG-052", "warning", "Images have no size", "pages", _page(lambda: F.size(_unsized()) > 0), lambda: said(F.size(_unsized()), T.plural(F.size(_unsized()), " image lacks", " images lack"), " a width or a height."), lambda: _urls(_unsized()))
_eager = lambda: _images(lambda i: (i["index"] >= 3) & ~i["loading"].eqNullSafe("lazy"))
rule("PERF-IMG-053", "info", "Images further down aren't loaded lazily", "pages", _page(lambda: F.size(_eager()) > 0), lambda: said(F.size(_eager()), T.plural(F.size(_eager()), " image", " images"), " after the third could be lazy."), lambda: _urls(_eager()), heuristic="The first three images are taken to be in view.")
rule("PERF-IMG-054", "info", "An image has an old format", "assets", _image(lambda: T.mime_type(C("content_type")).isin("image/jpeg", "image/png") & (C("bytes") > 100_000)), lambda: said("A ", T.mime_type(C("content_type")), " of ", C("bytes"), " bytes."), _used, applies="n_assets > 0")
_blocking = lambda: F.filter("doc.scripts", lambda s: s["in_head"] & ~s["inline"] & ~s["async"] & ~s["defer"] & ~s["module"])
rule("PERF-BLOCK-060", "warning", "Scripts in the head block the page", "pages", _page(lambda: F.size(_blocking()) > 0), lambda: said(F.size(_blocking()), T.plural(F.size(_blocking()), " script in the head blocks", " scripts in the head block"), " rendering."), lambda: _urls(_blocking()))
_sheets = lambda: F.filter("doc.stylesheets", lambda s: s["in_head"])
rule("PERF-BLOCK-061", "info", "Many stylesheets in the head", "pages", _page(lambda: F.size(_sheets()) > 4), lambda: said("The head holds ", F.size(_sheets()), " stylesheets."), lambda: _urls(_sheets()))


# accessibility: pick items of a page, count them, describe the first ones
def _items(id: str, severity: str, title: str, pick: Callable[[], Column], describe: Callable[[Column], Column], one: str, many: str, heuristic: str | None = None) -> None:
    rule(id, severity, title, "pages", _page(lambda: F.size(pick()) > 0), lambda: said(F.size(pick()), " ", T.plural(F.size(pick()), one, many)), lambda: F.transform(F.slice(pick(), 1, EVIDENCE_ITEMS), describe), heuristic=heuristic)


_items("A11Y-ALT-001", "warning", "Images have no text alternative", lambda: _images(lambda i: ~i["has_alt"] & ~i["decorative"]), lambda i: F.coalesce(i["url"], i["src"], F.lit("an image without a source")), "image has no alt attribute.", "images have no alt attribute.")
_items("A11Y-LABEL-010", "warning", "Form controls have no label", lambda: F.filter("doc.form_controls", lambda c: ~c["labelled"]), lambda c: c["describe"], "form control has no label.", "form controls have no label.")
_items("A11Y-LINK-020", "warning", "Links have no name", lambda: F.filter("doc.links", lambda x: ~x["has_accessible_name"]), lambda x: F.coalesce(x["url"], x["href"]), "link has no text or other name.", "links have no text or other name.")
_items("A11Y-LINK-021", "info", "Link texts say nothing", lambda: F.filter("doc.links", lambda x: T.link_text(x["text"]).isin(*GENERIC_TEXTS)), lambda x: said(x["text"], " (", F.coalesce(x["url"], x["href"]), ")"), "link has a generic text.", "links have a generic text.", heuristic="A short English list of texts.")
_items("A11Y-BTN-030", "warning", "Buttons have no name", lambda: F.filter("doc.buttons", lambda b: ~b["has_name"]), lambda b: b["describe"], "button has no name.", "buttons have no name.")
_skips = lambda: F.filter(F.transform("doc.headings", lambda h, i: F.struct(F.when(i > 0, F.get("doc.headings", i - 1)["level"]).alias("before"), h["level"].alias("level"))), lambda s: F.coalesce(s["level"] > s["before"] + 1, F.lit(False)))
_items("A11Y-HEAD-040", "info", "Heading levels are skipped", _skips, lambda s: said("h", s["before"], " is followed by h", s["level"]), "heading skips a level.", "headings skip a level.")
_items("A11Y-FRAME-050", "info", "Frames have no title", lambda: F.filter("doc.iframes", lambda f: ~f["has_title"]), lambda f: F.coalesce(f["src"], F.lit("a frame without a source")), "frame has no title.", "frames have no title.")


def packed(df: DataFrame, frame: str, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """Findings of all rules on one frame, in one pass over it."""
    url = F.lit(None).cast("string") if frame == "sites" else C("url")
    entries = [
        F.when(
            F.coalesce(r.when(), F.lit(False)),
            F.struct(F.lit(r.id).alias("check_id"), (r.level() if r.level else F.lit(r.severity)).alias("severity"), F.lit(r.group).alias("group"), r.detail().alias("detail"), (r.evidence() if r.evidence else F.lit(None).cast("array<string>")).alias("evidence")),
        )
        for r in registry(groups)
        if r.frame == frame and r.when
    ]
    if not entries:
        return df.sparkSession.createDataFrame([], FINDING)
    fired = df.select("site_id", url.alias("url"), F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("f"))
    return tidied(fired.select("site_id", "f.check_id", "f.severity", "f.group", "url", "f.detail", "f.evidence"))


def tidied(findings: DataFrame) -> DataFrame:
    evidence = F.transform(F.slice("evidence", 1, EVIDENCE_ITEMS), lambda e: T.clip_middle(T.tidy(e), EVIDENCE_LENGTH))
    return findings.select("site_id", "check_id", "severity", "group", "url", T.clip_end(T.tidy(C("detail")), DETAIL_LENGTH).alias("detail"), F.when(F.size("evidence") > 0, evidence).alias("evidence"))
