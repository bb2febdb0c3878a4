"""Text scalars as column expressions: cleaning, clipping and escaping of what findings and reports say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that collapses, and characters that are dropped, in findings.
SPACES = "[\\x20\\x09\\x0A\\x0D\\xA0]"
UNSAFE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\u200B-\\u200F\\u202A-\\u202E\\u2066-\\u2069]"
#: The same for reports, with terminal escape sequences.
REPORT_SPACES = "[\\s\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
REPORT_UNSAFE = "[\\x00-\\x08\\x0E-\\x1F\\x7F-\\x84\\x86-\\x9F\\u00AD\\u061C\\u180E\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u206F\\uFEFF\\uFFF9-\\uFFFB]|[\\x{E0000}-\\x{E007F}]"
ESCAPES = "\\x1B\\[[0-?]*[ -/]*[@-~]|\\x1B[PX^_\\]][^\\x07\\x1B\\x9C]*(?:\\x07|\\x1B\\\\|\\x9C)|\\x1B[@-Z\\\\-_]|\\x9B[0-?]*[ -/]*[@-~]"
TRIMMED = "^[\\s\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+|[\\s\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+$"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, TRIMMED, "")


def chars(text: Column) -> Column:
    return F.length(trimmed(text))


def tidy(text: Column) -> Column:
    """Controls and invisible characters dropped, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SPACES + "+", " "), UNSAFE, ""), " +", " "))


def clip_end(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def clip_middle(text: Column, most: int) -> Column:
    head = (most - 3 + 1) // 2
    tail = most - 3 - head
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(head)), F.lit("..."), F.right(text, F.lit(tail)))).otherwise(text)


def clean(text: Column, most: int = 200) -> Column:
    """For reports: escape sequences, controls and invisible characters go, then as `tidy`, then cut at its end."""
    plain = F.regexp_replace(text, ESCAPES, "")
    return clip_end(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, REPORT_SPACES + "+", " "), REPORT_UNSAFE, ""), " +", " ")), most)


def clean_url(text: Column, most: int = 300) -> Column:
    plain = F.regexp_replace(text, ESCAPES, "")
    return clip_middle(F.trim(F.regexp_replace(F.regexp_replace(plain, REPORT_SPACES + "+", " "), REPORT_UNSAFE, "")), most)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def escape_markdown_inline(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"([\\`*_{}\[\]<>()#|~!&])", r"\\$1"), r"(?<![A-Za-z0-9])@", r"\\@")


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(escape_markdown_inline(text), r"^(\s*)([-+])", r"$1\\$2"), r"^(\s*\d+)([.)])", r"$1\\$2")


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def said(*parts: Column | str) -> Column:
    """Text and columns joined; a null column says nothing."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def link_text(text: Column) -> Column:
    """Lower-cased, without the punctuation, symbols and blanks that end it."""
    return F.regexp_replace(F.lower(trimmed(text)), r"[\p{P}\p{S}\s\xA0]+$", "")


def fixed(x: Column, places: int) -> Column:
    """A number of at least 0 with so many decimal places: rounded by its exact binary value, and up where it lies just in between."""
    between = F.pmod(x * 2 ** (places + 1), F.lit(2.0)) == 1
    return F.when(between, F.format_string(f"%.{places}f", x)).otherwise(F.call_function("format_number", x, F.lit("0." + "0" * places)))


def seconds(ms: Column) -> Column:
    """Seconds with one decimal place, rounded from tenths of a second."""
    return F.format_string("%.1f s", F.floor(ms / 100 + 0.5) / 10)


def megabytes(n: Column) -> Column:
    return fixed(n / 1e6, 1)


def mime_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))


def is_html_type(content_type: Column) -> Column:
    return mime_type(content_type).isin("text/html", "application/xhtml+xml")


def is_compressed(encoding: Column) -> Column:
    tokens = F.transform(F.split(F.lower(F.coalesce(encoding, F.lit(""))), ","), lambda p: F.trim(p))
    return F.arrays_overlap(tokens, F.array(*map(F.lit, ("gzip", "br", "deflate", "zstd"))))


def cache_problem(value: Column) -> Column:
    """Why a Cache-Control value falls short; null where it is fine. `expires` stands for an Expires header alone."""
    parts = F.transform(F.split(F.lower(value), ","), lambda p: F.trim(p))
    ages = F.filter(F.transform(parts, lambda p: F.regexp_extract(p, r'^max-age\s*=\s*"?(\d+)"?$', 1)), lambda a: a != "")
    age = F.get(ages, F.lit(0)).cast("double")
    return (
        F.when(value.isNull(), "There is neither a Cache-Control nor an Expires header.")
        .when(value == "expires", F.lit(None))
        .when(F.array_contains(parts, "no-store"), "Cache-Control forbids storing.")
        .when(age < 3600, said("It may be kept for ", age.cast("long"), " seconds, less than an hour (3600)."))
        .when(age.isNotNull() | F.array_contains(parts, "immutable"), F.lit(None))
        .otherwise("Cache-Control names no max-age and there is no Expires header.")
    )


def robots_header(value: Column) -> Column:
    """Directives of an X-Robots-Tag value that hold for every crawler.

    `bot: x` and the plain directives after it are that bot's; the parts of an `unavailable_after` date are skipped up to
    the next part that looks like a directive; other parts with a colon are dropped.
    """
    parts = F.filter(F.transform(F.split(F.lower(F.coalesce(value, F.lit(""))), ","), lambda p: trimmed(p)), lambda p: p != "")
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("scoped"), F.lit(False).alias("dated"))

    def step(s: Column, p: Column) -> Column:
        name = F.split_part(p, F.lit(":"), F.lit(1))
        colon = p.contains(":")
        date = colon & (name == "unavailable_after")
        bot = colon & ~date & ~name.rlike(r"\s")
        skipped = ~colon & s["dated"] & ~p.rlike("^[a-z_-]+$")
        plain = ~colon & ~skipped
        return F.struct(
            F.when(plain & ~s["scoped"], F.concat(s["out"], F.array(p))).otherwise(s["out"]).alias("out"),
            (s["scoped"] | bot).alias("scoped"),
            F.when(date, True).when(bot | plain, False).otherwise(s["dated"]).alias("dated"),
        )

    return F.aggregate(parts, state, step, lambda s: s["out"])


def retry_after_ms(value: Column, now: Column) -> Column:
    """Milliseconds to wait: 5000 with no value, seconds, or the time up to a date; within 0 and 60000."""
    date = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract(value, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))) * 1000
    ms = F.when(value.rlike(r"^\s*\d+\s*$"), F.trim(value).cast("double") * 1000).otherwise(date - now)
    return F.least(F.lit(60000), F.greatest(F.lit(0), F.coalesce(ms, F.lit(5000)))).cast("long")


def duration_text(ms: Column) -> Column:
    """How long something took: tenths of a second below a minute, else minutes and seconds."""
    tenths, total = F.floor(ms / 100 + 0.5), F.floor(ms / 1000 + 0.5)
    minutes, rest = F.floor(total / 60), total % 60
    long = said(minutes, plural(minutes, " minute", " minutes"), F.when(rest > 0, said(" ", rest, plural(rest, " second", " seconds"))))
    return F.when(ms.isNull() | (ms < 0), "not available").when(tenths < 600, F.format_string("%.1f seconds", tenths / 10)).otherwise(long)
