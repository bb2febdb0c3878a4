"""URLs: a resolver for one reference, and column expressions over URLs that it has normalised."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from functools import lru_cache
from urllib.parse import quote, unquote_to_bytes

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.\-]*):")
_PATH_SAFE = "!$%&'()*+,-./:;=@[\\]^_|~"
_QUERY_SAFE = "!$%&()*+,-./:;=?@[\\]^_`{|}~"
_PORTS = {"http": "80", "https": "443"}


def _dotless(path: str) -> str:
    """The path with its dot segments resolved."""
    out: list[str] = []
    segments = path.split("/")[1:]
    for k, s in enumerate(segments):
        last, low = k == len(segments) - 1, s.lower().replace("%2e", ".")
        if low == "..":
            out = out[:-1]
        elif low != ".":
            out.append(s)
            continue
        if last:
            out.append("")
    return "/" + "/".join(out)


#: Code points that host names keep though case folding would change or drop them, those that it drops, and full stops.
_KEPT = frozenset("\u00df\u03c2\u200c\u200d")
_DROPPED = frozenset("\u00ad\u034f\u180b\u180c\u180d\u200b\u2060\u2064\ufeff") | frozenset(map(chr, range(0xFE00, 0xFE10)))
_STOPS = str.maketrans("\u3002\uff0e\uff61", "...")
_FORBIDDEN = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")


def _ascii_label(label: str) -> str | None:
    """A label of a host name as sent over the wire: Punycode where it isn't ASCII; null where no name may hold it."""
    if label.startswith("xn--"):
        try:
            plain = label[4:].encode().decode("punycode")
            if not plain or plain.isascii() or f"xn--{plain.encode('punycode').decode()}" != label:
                return None
        except (UnicodeError, ValueError):
            return None
        return label if _valid_label(plain) else None
    if label.isascii():
        return label
    return f"xn--{label.encode('punycode').decode()}" if _valid_label(label) else None


def _valid_label(label: str) -> bool:
    return label == unicodedata.normalize("NFKC", label) and not unicodedata.category(label[0]).startswith("M") and all(unicodedata.category(c) not in ("Cn", "Co", "Cs", "Cc", "Zs", "Zl", "Zp") for c in label) and "\ufffd" not in label


def _ascii_domain(name: str) -> str | None:
    """The name in lower case, compatibility forms mapped, other scripts in Punycode (the mapping that browsers use)."""
    if not name.isascii():
        kept = "".join("\u00df" if c == "\u1e9e" else c if c in _KEPT else "" if c in _DROPPED else unicodedata.normalize("NFKC", c).casefold() for c in name)
        name = unicodedata.normalize("NFKC", kept)
    labels = [_ascii_label(x) for x in name.lower().translate(_STOPS).split(".")]
    return None if None in labels else ".".join(labels)


def _number(part: str) -> int | None:
    """A part of an IPv4 address: decimal, octal after 0, hexadecimal after 0x."""
    digits, base = (part[2:], 16) if part[:2] in ("0x", "0X") else (part[1:], 8) if len(part) > 1 and part[0] == "0" else (part, 10)
    if part and digits == "":
        return 0
    return int(digits, base) if re.fullmatch({16: "[0-9a-fA-F]+", 8: "[0-7]+", 10: "[0-9]+"}[base], digits) else None


def _ipv4(host: str) -> str | None:
    """The address that a host name is if its last label is a number: one to four numbers, of which the last fills what is left."""
    parts = host.split(".")
    parts = parts[:-1] if parts[-1] == "" and len(parts) > 1 else parts
    numbers = [_number(p) for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << (8 * (3 - k)) for k, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> shift & 255) for shift in (24, 16, 8, 0))


def _ends_in_number(host: str) -> bool:
    labels = host.split(".")
    last = labels[-2] if labels[-1] == "" and len(labels) > 1 else labels[-1]
    return re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]*", last) is not None


def _ipv6(text: str) -> str | None:
    """An IPv6 address in its shortest form: the first longest run of zeros left out."""
    try:
        packed = ipaddress.IPv6Address(text).packed if "%" not in text else None
    except ValueError:
        return None
    if packed is None:
        return None
    pieces = [packed[k] << 8 | packed[k + 1] for k in range(0, 16, 2)]
    best = max(((next((m for m in range(k, 8) if pieces[m]), 8) - k, -k) for k in range(8)), default=(0, 0))
    words = [format(x, "x") for x in pieces]
    if best[0] < 2:
        return ":".join(words)
    return ":".join(words[: -best[1]]) + "::" + ":".join(words[-best[1] + best[0] :])


def _host(raw: str) -> str | None:
    """A host as the URL standard has it: percent-decoded, mapped and in Punycode, addresses in their usual form; null where it is none."""
    if raw.startswith("["):
        found = _ipv6(raw[1:-1]) if raw.endswith("]") else None
        return found and f"[{found}]"
    if "%" in raw:
        raw = unquote_to_bytes(raw).decode("utf-8", "replace")
    host = _ascii_domain(raw)
    if not host or _FORBIDDEN.search(host):
        return None
    return _ipv4(host) if _ends_in_number(host) else host


def _split(url: str) -> tuple[str, str, str, str | None] | None:
    """(scheme, host and port, path, query) of an absolute http(s) URL."""
    m = _SCHEME.match(url)
    if not m or m[1].lower() not in _PORTS:
        return None
    scheme, rest = m[1].lower(), url[m.end() :].replace("\\", "/").lstrip("/")
    authority, tail = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
    authority = authority.rpartition("@")[2]
    name, port = re.fullmatch(r"(.*?)(?::(\d*))?", authority, re.S).groups()
    host = _host(name)
    if host is None or (port and int(port) > 65535):
        return None
    port = "" if not port or str(int(port)) == _PORTS[scheme] else f":{int(port)}"
    path, mark, query = tail.partition("#")[0].partition("?")
    return scheme, host + port, path or "/", query if mark else None


@lru_cache(maxsize=50_000)
def normalised(href: str, base: str | None = None) -> str | None:
    """`href` resolved against `base`: no fragment, no default port, host in lower case, dot segments resolved; http(s) only, else None."""
    href = re.sub(r"[\t\n\r]", "", href.strip())
    m = _SCHEME.match(href)
    if m and not (m[1].lower() in _PORTS and base and base.startswith(m[1].lower() + ":") and not re.match(r"[/\\]", href[m.end() :])):
        parts = _split(href)
    else:
        href = href[m.end() :] if m else href
        at = _split(base) if base else None
        if at is None:
            return None
        scheme, authority, path, query = at
        plain, mark, search = href.partition("#")[0].partition("?")
        plain = plain.replace("\\", "/")
        if plain.startswith("//"):
            parts = _split(f"{scheme}:{plain}{mark}{search}")
        elif plain.startswith("/"):
            parts = scheme, authority, plain, search if mark else None
        elif plain:
            parts = scheme, authority, path.rpartition("/")[0] + "/" + plain, search if mark else None
        else:
            parts = scheme, authority, path, search if mark else query
    if parts is None:
        return None
    scheme, authority, path, query = parts
    out = f"{scheme}://{authority}{_dotless(quote(path, safe=_PATH_SAFE))}"
    return out if query is None else f"{out}?{quote(query, safe=_QUERY_SAFE)}"


def start_url(text: str) -> str:
    """A start URL as typed: a bare host means https; credentials and other schemes are refused."""
    text = text.strip()
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", text) or re.match(r"^(mailto|javascript|data|file|ftp):", text, re.I):
        url = text
    else:
        url = f"https://{text}"
    found = normalised(url)
    if not text or found is None:
        raise ValueError(f"not an http or https URL: {text!r}")
    if "@" in re.match(r"[^:]+:/*([^/?#]*)", url)[1]:
        raise ValueError("a start URL can't hold a user name or password")
    return found


def origin(url: Column) -> Column:
    """Scheme, host and port; null where the URL isn't an absolute http(s) one."""
    return F.nullif(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1), F.lit(""))


def same_origin(a: Column, b: Column) -> Column:
    return F.coalesce(origin(a) == origin(b), F.lit(False))


def hostname(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^https?://(\[[^\]]*\]|[^/?#:]+)", 1), F.lit(""))


def bare_hostname(url: Column) -> Column:
    """The host name without the dot that may end it."""
    return F.regexp_replace(hostname(url), r"\.$", "")


def path_with_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def sibling_host(host: Column) -> Column:
    """www.example.com for example.com and the other way round; null for addresses, single labels and other subdomains."""
    h = F.lower(F.trim(host))
    labels = F.split(h, r"\.")
    n = F.size(labels)
    bad = (h == "") | (h == "localhost") | h.contains(":") | h.startswith("[") | h.rlike(r"^\d+(?:\.\d+){3}$") | F.array_contains(labels, "") | (n < 2)
    return F.when(bad, F.lit(None)).when(F.element_at(labels, 1) == "www", F.when(n >= 3, F.substring(h, 5, 1 << 20))).when(n == 2, F.concat(F.lit("www."), h))


def same_site(url: Column, site_origin: Column) -> Column:
    """Same host or its www or apex sibling, on the same or a default port."""
    port = lambda u: F.regexp_extract(u, r"^https?://[^/?#]*?(:\d+)(?:[/?#]|$)", 1)
    a, b = bare_hostname(url), bare_hostname(site_origin)
    return F.coalesce(((a == b) | (sibling_host(a) == b)) & ((port(url) == port(site_origin)) | (port(url) == "")), F.lit(False))


def glob_regex(glob: str) -> str:
    """A whole-path glob as an anchored regular expression: `*` stops at a slash, `**` doesn't."""
    parts = re.split(r"(\*+)", glob)
    return "^" + "".join((".*" if len(p) > 1 else "[^/]*") if p.startswith("*") else re.escape(p) for p in parts) + "$"


def excluded(url: Column, globs: list[str]) -> Column:
    """Whether the URL's path matches one of the globs."""
    out = F.lit(False)
    for g in globs:
        out = out | path(url).rlike("(?s)" + glob_regex(g))
    return F.coalesce((path(url) != "") & out, F.lit(False))


def robots_like(pattern: Column) -> Column:
    """A robots.txt path pattern as a LIKE pattern: a prefix, `*` any run of characters, a last `$` ends it."""
    anchored = F.endswith(pattern, F.lit("$"))
    body = F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    literal = F.regexp_replace(body, r"([\\%_])", r"\\$1")
    return F.concat(F.replace(literal, F.lit("*"), F.lit("%")), F.when(anchored, "").otherwise("%"))
