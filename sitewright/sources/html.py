"""HTML pages as rows of elements, and facts about each page as column expressions over these.

A tokenizer per page is the one thing that runs in Python. It keeps a stack of open elements, closes those that HTML lets be
left open, and lists elements in document order with what only the tree can tell: what encloses them, whether content has begun,
and their text. All facts are Spark expressions over that list.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import normalised, same_origin

#: Limits on work per page, of bounded parsing alone: tables of pages are read whole, all items and texts of them.
MAX_DEPTH, MAX_NODES, MAX_ITEMS, PREVIEW, SCANNED = 256, 500_000, 5000, 2000, 20_000
#: Characters of text that go into a batch of parsed pages before it is handed on.
HANDED_ON = 32_000_000
#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("noscript template iframe noembed noframes xmp script style".split())
UNCOUNTED = frozenset("script style noscript template svg".split())
BEFORE_CONTENT = frozenset("html head title meta link script style base noscript".split())
TITLED = frozenset("title h1 h2 h3 h4 h5 h6".split())
PREVIEWED = TITLED | frozenset("a button".split())
CONTROLS = frozenset("input select textarea".split())
LISTED = PREVIEWED | frozenset("html head body base meta link script img input select textarea label iframe video audio source svg".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Which open elements an opening tag closes, while one of them is innermost (from the optional-tag rules of the HTML standard).
CLOSES = {b: frozenset({"p"}) for b in BLOCKS} | {
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}),
    "option": frozenset({"option"}), "optgroup": frozenset({"option", "optgroup"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
    "thead": frozenset({"tr", "td", "th", "tbody", "tfoot"}), "tbody": frozenset({"tr", "td", "th", "thead", "tbody", "tfoot"}), "tfoot": frozenset({"tr", "td", "th", "thead", "tbody"}),
    "rt": frozenset({"rt", "rp"}), "rp": frozenset({"rt", "rp"}), "body": frozenset({"head", "title", "style", "script"}),
}
ELEMENT = "struct<tag:string,attrs:map<string,string>,url:string,parent:string,in_label:boolean,labelled:boolean,in_svg:boolean,before_body:boolean,before_content:boolean,text:string,named_image:boolean,data:string>"
PARSED = f"elements array<{ELEMENT}>, word_count int, truncated boolean, head_seen boolean, body_seen boolean"
SEEN = ("truncated", "head_seen", "body_seen")
_WORD = re.compile(r"\S+")


class _Stop(Exception):
    pass


class _Page(HTMLParser):
    #: Elements whose content is text up to their own end tag; of REPLACEABLE ones, character references count in it.
    CDATA_CONTENT_ELEMENTS = ("script", "style", "title", "textarea", "xmp")
    REPLACEABLE = ("title", "textarea")

    def __init__(self, url: str, bounded: bool = True):
        super().__init__(convert_charrefs=True)
        self.bounded = bounded
        self.page = self.base = url
        self.based = self.truncated = self.content = self.head = self.body = False
        self.rows: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []
        self.opened: dict[str, int] = {}
        self.nodes = self.opaque = self.uncounted = self.labels = self.svgs = self.in_body = self.titles = 0
        #: Text that elements' texts are cut from, its length, and how many images have had a name by now.
        self.texts: list[str] = []
        self.chars = self.named = 0
        self.words = self.body_words = 0
        self.in_word = False
        self.kept: dict[str, int] = {}

    def set_cdata_mode(self, elem: str) -> None:
        self.cdata_elem = elem.lower()
        self.interesting = re.compile(rf"</{self.cdata_elem}(?=[\s/>])", re.I)

    def parse_endtag(self, i: int) -> int:
        """The end of text content may hold blanks and attributes; other end tags are as the base class has them."""
        if self.cdata_elem is None:
            return super().parse_endtag(i)
        end, name = self.rawdata.find(">", i), self.cdata_elem
        if end < 0:
            return -1
        self.clear_cdata_mode()
        self.handle_endtag(name)
        return end + 1

    def close(self) -> None:
        """Text content that no end tag ends goes to the end of the page."""
        super().close()
        if self.cdata_elem is not None and self.rawdata:
            rest, self.rawdata = self.rawdata, ""
            self.handle_data(rest)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = CLOSES.get(tag)
        while closes and self.open and self.open[-1][0] in closes:
            self._pop()
        self.nodes += 1
        if self.bounded and (len(self.open) >= MAX_DEPTH or self.nodes > MAX_NODES):
            self.truncated = True
            raise _Stop
        self.in_word = False
        row = None
        if not self.opaque:
            row = self._row(tag, dict((k, v or "") for k, v in reversed(attrs)))
        if tag in VOID:
            return
        self.open.append((tag, row))
        self._enter(tag, 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _enter(self, tag: str, by: int) -> None:
        self.opened[tag] = self.opened.get(tag, 0) + by
        self.opaque += by * (tag in OPAQUE)
        self.uncounted += by * (tag in UNCOUNTED)
        self.titles += by * (tag == "title")
        self.labels += by * (tag == "label")
        self.svgs += by * (tag == "svg")
        if tag == "body":
            self.in_body = 1 if by > 0 and not self.body else self.in_body - (by < 0)
            self.body = True

    def _row(self, tag: str, attrs: dict) -> dict | None:
        before_content, before_body = not self.content, not self.body
        if tag not in BEFORE_CONTENT:
            self.content = True
        if tag in ("img", "svg") and (attrs.get("alt" if tag == "img" else "aria-label") or "").strip():
            self.named += 1
        if tag not in LISTED and attrs.get("role") != "button":
            return None
        kind = "script:ld" if tag == "script" and attrs.get("type", "").strip().lower() == "application/ld+json" else tag
        self.kept[kind] = self.kept.get(kind, 0) + 1
        if self.bounded and self.kept[kind] > MAX_ITEMS + 1:
            self.truncated = True
            return None
        if tag == "base" and not self.based and "href" in attrs:
            self.based, self.base = True, normalised(attrs["href"], self.page) or self.page
        self.head |= tag == "head"
        parent = self.open[-1][0] if self.open else None
        row = {"tag": tag, "attrs": attrs, "parent": parent, "in_label": self.labels > 0, "labelled": False, "in_svg": self.svgs > 0, "before_body": before_body, "before_content": before_content, "text": "", "named_image": False, "data": None, "begin": self.chars, "end": self.chars, "named": self.named}
        self.rows.append(row)
        return row

    def handle_endtag(self, tag: str) -> None:
        self.in_word = False
        if self.opened.get(tag):
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        tag, row = self.open.pop()
        if row is not None:
            row["end"], row["named_image"] = self.chars, self.named > row["named"]
        self.in_word = False
        self._enter(tag, -1)
        return tag

    def handle_data(self, data: str) -> None:
        self.nodes += 1
        if self.cdata_elem in self.REPLACEABLE:
            data = unescape(data)
        if self.open and self.open[-1][0] == "script" and self.open[-1][1] is not None:
            row = self.open[-1][1]
            row["data"] = (row["data"] or "") + data
        if not self.uncounted:
            n = len(data.split()) - (1 if self.in_word and data and not data[0].isspace() else 0)
            n = max(n, 0)
            if not self.titles:
                self.words += n
            if self.in_body > 0:
                self.body_words += n
            self.in_word = not data[-1:].isspace() if data.strip() else (self.in_word and not data)
        if not self.opaque:
            self.texts.append(data)
            self.chars += len(data)

    def found(self) -> dict:
        while self.open:
            self._pop()
        text = "".join(self.texts)
        named = {row["attrs"]["for"] for row in self.rows if row["tag"] == "label" and "for" in row["attrs"]}
        for row in self.rows:
            row["text"] = self._text(text, row)
            if row["tag"] in CONTROLS:
                row["labelled"] = bool(row["attrs"].get("id")) and row["attrs"]["id"] in named
            row["url"] = self._url(row)
            if row["tag"] == "script":
                row["data"] = _json_ld(row["data"] or "") if row["attrs"].get("type", "").strip().lower() == "application/ld+json" else None
            del row["begin"], row["end"], row["named"]
        return {"elements": self.rows, "word_count": self.body_words if self.body else self.words, "truncated": self.truncated, "head_seen": self.head, "body_seen": self.body}

    def _text(self, text: str, row: dict) -> str:
        """The whole text of titles, headings and links, the first word of buttons and anchors: of these it counts alone whether there is any."""
        tag, begin, end = row["tag"], row["begin"], row["end"]
        if tag not in PREVIEWED and row["attrs"].get("role") != "button":
            return ""
        if self.bounded:
            return " ".join(text[begin : min(end, begin + SCANNED)].split())[:PREVIEW]
        if tag in TITLED or (tag == "a" and "href" in row["attrs"]):
            return " ".join(text[begin:end].split())
        first = _WORD.search(text, begin, end)
        return first[0] if first else ""

    def _url(self, row: dict) -> str | None:
        a, tag = row["attrs"], row["tag"]
        raw = a.get("href") if tag in ("a", "link") else a.get("src")
        if tag == "img" and not (raw or "").strip():
            raw = re.match(r"\S*", (a.get("srcset") or "").strip())[0].rstrip(",")
        if raw is None or (not raw.strip() and tag != "a"):
            return None
        return normalised(raw, self.base)


def _refused(_: str) -> None:
    raise ValueError


def _json_ld(text: str) -> str:
    """The types of a JSON-LD block as a JSON list; `!` where it isn't valid JSON."""
    try:
        parsed = json.loads(text, parse_constant=_refused)
    except (ValueError, RecursionError):
        return "!"
    types = []
    for item in parsed if isinstance(parsed, list) else [parsed]:
        graph = item.get("@graph") if isinstance(item, dict) else None
        for node in [item, *(graph if isinstance(graph, list) else [])]:
            named = node.get("@type") if isinstance(node, dict) else None
            types += [t for t in (named if isinstance(named, list) else [named]) if isinstance(t, str)]
    return json.dumps(types)


def parsed_page(html: str | None, url: str | None, bounded: bool = True) -> dict:
    """The PARSED columns of a page. Bounded, parsing ends for good at MAX_DEPTH open elements or MAX_NODES nodes, and keeps MAX_ITEMS of a kind and one more, and PREVIEW characters of a text."""
    page = _Page(url or "", bounded)
    try:
        page.feed(html or "")
        page.close()
    except _Stop:
        pass
    return page.found()


_ARROW = pa.list_(pa.struct([("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("url", pa.string()), ("parent", pa.string()), ("in_label", pa.bool_()), ("labelled", pa.bool_()), ("in_svg", pa.bool_()), ("before_body", pa.bool_()), ("before_content", pa.bool_()), ("text", pa.string()), ("named_image", pa.bool_()), ("data", pa.string())]))


def _parsing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            html, url = (part.column(part.schema.get_field_index(k)).to_pylist() for k in ("html", "final_url"))
            found, begin, held = [], 0, 0
            for k, (h, u) in enumerate(zip(html, url, strict=True)):
                found.append(parsed_page(h, u, bounded=False))
                held += sum(len(e["text"]) for e in found[-1]["elements"])
                if held > HANDED_ON or k + 1 == part.num_rows:
                    yield _as_batch(part.slice(begin, len(found)), found)
                    found, begin, held = [], k + 1, 0


def _as_batch(part: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
    for f in found:
        for e in f["elements"]:
            e["attrs"] = list(e["attrs"].items())
    keys = [k for k in part.schema.names if k != "html"]
    return pa.RecordBatch.from_arrays(
        [*[part.column(part.schema.get_field_index(k)) for k in keys], pa.array([f["elements"] for f in found], _ARROW), pa.array([f["word_count"] for f in found], pa.int32()), *[pa.array([f[k] for f in found], pa.bool_()) for k in SEEN]],
        names=[*keys, "elements", "word_count", *SEEN],
    )


def parsed(pages: DataFrame, *keys: str) -> DataFrame:
    """Key columns, final_url, and the PARSED columns, of pages (keys, final_url, html)."""
    kept = [k for k in keys if k != "final_url"] + ["final_url"]
    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in kept)
    return pages.select(*kept, "html").mapInArrow(_parsing, f"{schema}, {PARSED}")


def attr(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def _has(e: Column, name: str) -> Column:
    return T.trimmed(F.coalesce(attr(e, name), F.lit(""))) != ""


def _lower(e: Column, name: str) -> Column:
    return F.nullif(F.lower(T.trimmed(F.coalesce(attr(e, name), F.lit("")))), F.lit(""))


def _tokens(e: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(attr(e, "rel"), F.lit(""))), r"\s+"), lambda t: t != "")


def _tags(elements: Column, *tags: str) -> Column:
    return F.filter(elements, lambda e: e["tag"].isin(*tags))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a page: what a lambda refers to is else computed for each item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _named(e: Column) -> Column:
    return (e["text"] != "") | _has(e, "aria-label") | _has(e, "aria-labelledby") | _has(e, "title") | e["named_image"]


def _described(e: Column, *names: str) -> Column:
    parts = []
    for name in names:
        value = _lower(e, name) if name in ("type", "role") else F.nullif(T.trimmed(F.coalesce(attr(e, name), F.lit(""))), F.lit(""))
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"[{name}="), F.left(value, F.lit(40)), F.lit("]"))).otherwise(""))
    return F.concat(e["tag"], *parts)


def documents(pages: DataFrame, robots: Column | None = None) -> DataFrame:
    """`doc`, a struct of facts, from the PARSED columns and final_url. `robots` is the X-Robots-Tag header, if there is one."""
    el = F.col("elements")
    has_head, has_body = F.col("head_seen"), F.col("body_seen")

    def in_head(e: Column) -> Column:
        return F.when(has_head | ~has_body, e["before_content"]).otherwise(e["before_body"])

    titles = F.filter(el, lambda e: (e["tag"] == "title") & F.when(has_head, (e["parent"] == "head") | (e["before_content"] & ~e["in_svg"])).otherwise(~e["in_svg"]))
    metas, links = _tags(el, "meta"), _tags(el, "link")
    named = lambda name: F.filter(metas, lambda e: _lower(e, "name") == name)
    split = lambda c: F.filter(F.transform(F.split(F.lower(c), ","), T.trimmed), lambda p: p != "")
    in_page = F.flatten(F.transform(named("robots"), lambda e: split(F.coalesce(attr(e, "content"), F.lit("")))))
    content = lambda e: T.trimmed(F.coalesce(attr(e, "content"), F.lit("")))
    graph = F.filter(metas, lambda e: F.coalesce(_lower(e, "property").startswith("og:"), F.lit(False)) & attr(e, "content").isNotNull())
    by_property = F.array_sort(F.transform(graph, lambda e, i: F.struct(_lower(e, "property").alias("key"), i.alias("at"), content(e).alias("value"))))
    first_graph = _bound(by_property, lambda g: F.filter(g, lambda x, i: (i == 0) | (x["key"] != F.get(g, i - 1)["key"])))
    ld = lambda e: F.coalesce(_lower(e, "type") == "application/ld+json", F.lit(False))
    scripts = _tags(el, "script")
    controls = F.filter(_tags(el, "input", "select", "textarea"), lambda e: ~((e["tag"] == "input") & F.coalesce(_lower(e, "type").isin("hidden", "submit", "button", "reset"), F.lit(False))))
    image_input = lambda e: (e["tag"] == "input") & F.coalesce(_lower(e, "type") == "image", F.lit(False))
    loaded = F.filter(el, lambda e: e["tag"].isin("img", "script", "link", "iframe", "video", "audio", "source") & ((e["tag"] != "link") | F.array_contains(_tokens(e), "stylesheet")) & (attr(e, "src").isNotNull() | (e["tag"] == "link")))
    no = lambda c: F.nullif(c, F.lit(""))
    decorative = lambda e: (attr(e, "alt").isNotNull() & ~_has(e, "alt")) | F.coalesce(_lower(e, "role") == "presentation", F.lit(False)) | F.coalesce(_lower(e, "aria-hidden") == "true", F.lit(False))
    doc = F.struct(
        no(F.get(titles, F.lit(0))["text"]).alias("title"),
        F.size(titles).alias("title_count"),
        no(content(F.get(named("description"), F.lit(0)))).alias("meta_description"),
        F.array_distinct(F.concat(in_page, T.robots_header(robots if robots is not None else F.lit(None).cast("string")))).alias("meta_robots"),
        F.filter(F.transform(F.filter(links, lambda e: F.array_contains(_tokens(e), "canonical") & in_head(e)), lambda e: e["url"]), lambda u: u.isNotNull()).alias("canonicals"),
        no(T.trimmed(F.coalesce(attr(F.get(_tags(el, "html"), F.lit(0)), "lang"), F.lit("")))).alias("lang"),
        F.exists(named("viewport"), lambda e: _has(e, "content")).alias("has_viewport"),
        F.transform(_tags(el, "h1", "h2", "h3", "h4", "h5", "h6"), lambda e: F.struct(F.substring(e["tag"], 2, 1).cast("int").alias("level"), e["text"].alias("text"))).alias("headings"),
        F.map_from_entries(F.transform(F.array_sort(F.transform(first_graph, lambda x: F.struct(x["at"], x["key"], x["value"]))), lambda x: F.struct(x["key"], x["value"]))).alias("open_graph"),
        F.transform(F.filter(scripts, ld), lambda e: F.struct((e["data"] != "!").alias("ok"), F.when(e["data"] != "!", F.from_json(e["data"], "array<string>")).otherwise(F.array().cast("array<string>")).alias("types"))).alias("json_ld"),
        F.transform(
            F.filter(_tags(el, "a"), lambda e: attr(e, "href").isNotNull()),
            lambda e: F.struct(attr(e, "href").alias("href"), e["url"].alias("url"), e["text"].alias("text"), same_origin(e["url"], F.col("final_url")).alias("internal"), _tokens(e).alias("rel"), _named(e).alias("has_accessible_name")),
        ).alias("links"),
        F.transform(
            _tags(el, "img"),
            lambda e, i: F.struct(attr(e, "src").alias("src"), e["url"].alias("url"), attr(e, "alt").isNotNull().alias("has_alt"), attr(e, "alt").alias("alt"), attr(e, "width").isNotNull().alias("width"), attr(e, "height").isNotNull().alias("height"), _lower(e, "loading").alias("loading"), i.alias("index"), decorative(e).alias("decorative")),
        ).alias("images"),
        F.transform(
            F.filter(scripts, lambda e: ~ld(e)),
            lambda e: F.struct(e["url"].alias("url"), in_head(e).alias("in_head"), attr(e, "async").isNotNull().alias("async"), attr(e, "defer").isNotNull().alias("defer"), F.coalesce(_lower(e, "type") == "module", F.lit(False)).alias("module"), attr(e, "src").isNull().alias("inline")),
        ).alias("scripts"),
        F.transform(F.filter(links, lambda e: F.array_contains(_tokens(e), "stylesheet") & e["url"].isNotNull()), lambda e: F.struct(e["url"].alias("url"), in_head(e).alias("in_head"), no(T.trimmed(F.coalesce(attr(e, "media"), F.lit("")))).alias("media"))).alias("stylesheets"),
        F.exists(links, lambda e: F.exists(_tokens(e), lambda t: t.contains("icon"))).alias("icon_link"),
        F.transform(
            controls,
            lambda e: F.struct(
                e["tag"].alias("tag"),
                _lower(e, "type").alias("type"),
                F.when(image_input(e), _has(e, "alt")).otherwise(e["labelled"] | e["in_label"] | _has(e, "aria-label") | _has(e, "aria-labelledby") | _has(e, "title")).alias("labelled"),
                F.when(_has(e, "name"), _described(e, "type", "name")).otherwise(_described(e, "type", "id")).alias("describe"),
            ),
        ).alias("form_controls"),
        F.transform(F.filter(el, lambda e: (e["tag"] == "button") | F.coalesce(attr(e, "role") == "button", F.lit(False))), lambda e: F.struct(_named(e).alias("has_name"), _described(e, "type", "role").alias("describe"))).alias("buttons"),
        F.transform(_tags(el, "iframe"), lambda e: F.struct(_has(e, "title").alias("has_title"), attr(e, "src").alias("src"))).alias("iframes"),
        F.col("word_count").alias("word_count"),
        F.when(F.lower("final_url").startswith("https:"), F.filter(F.transform(loaded, lambda e: e["url"]), lambda u: F.coalesce(u.startswith("http://"), F.lit(False)))).otherwise(F.array().cast("array<string>")).alias("mixed_content"),
    )
    return pages.withColumn("doc", doc).drop("elements", "word_count", "head_seen", "body_seen")
