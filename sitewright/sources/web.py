"""Captured answers of the web as a source: (url, method, n, status, headers, body, error) -> decoded, classified and retried.

Everything is a column expression but decoding, which is an Arrow batch function: Spark's own decode knows few character sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_html_type, mime_type
from ..operators.pacing import final_attempts
from . import encodings

MAX_BODY = 5_000_000
#: Error codes of fetching, by what they mean for a page.
FAILURES = {
    "timeout": ("ETIMEDOUT", "UND_ERR_CONNECT_TIMEOUT", "UND_ERR_HEADERS_TIMEOUT", "UND_ERR_BODY_TIMEOUT", "TimeoutError", "AbortError"),
    "dns": ("ENOTFOUND", "EAI_AGAIN", "EAI_FAIL", "ENODATA"),
    "connection": ("ECONNREFUSED", "ECONNRESET", "EPIPE", "EHOSTUNREACH", "ENETUNREACH", "UND_ERR_SOCKET"),
}
TLS_RE = "^(CERT_|ERR_TLS|ERR_SSL|DEPTH_ZERO|SELF_SIGNED|UNABLE_TO_|EPROTO)"


def headers(pairs: Column) -> Column:
    """Header pairs (name, value) as a map of lower-cased names; values of a repeated name are joined."""
    lowered = F.transform(pairs, lambda p: F.struct(F.lower(p["name"]).alias("name"), p["value"].alias("value")))
    names = F.array_distinct(F.transform(lowered, lambda p: p["name"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.array_join(F.transform(F.filter(lowered, lambda p: p["name"] == n), lambda p: p["value"]), ", "))))


def is_textual(content_type: Column) -> Column:
    kind = mime_type(content_type)
    return kind.startswith("text/") | kind.contains("html") | kind.endswith("/xml") | kind.endswith("+xml") | kind.endswith("/json") | kind.endswith("+json")


def failure(code: Column) -> Column:
    """What an error code means; null stays null."""
    out = F.when(code.isNull(), F.lit(None).cast("string"))
    for name, codes in FAILURES.items():
        out = out.when(code.isin(*codes), name)
    return out.when(code.rlike(TLS_RE), "tls").otherwise("other")


def content_length(of: Column) -> Column:
    raw = F.try_element_at(of, F.lit("content-length"))
    return F.when(raw.rlike(r"^\d{1,15}$"), raw.cast("bigint"))


def looks_like_html(content_type: Column, text: Column) -> Column:
    return is_html_type(content_type) | F.lower(F.ltrim(F.left(F.coalesce(text, F.lit("")), F.lit(64)))).rlike("^<(!doctype html|html)")


def charset(content_type: str | None, body: bytes) -> str:
    """The encoding that a header or a meta element in the first 2048 bytes names, if it is one of the web's; else UTF-8."""
    named = re.search(r";\s*charset\s*=\s*[\"']?([^\s\"';]+)", content_type or "", re.I)
    label = named[1] if named else None
    if label is None:
        for tag in re.findall(rb"<meta[^>]*", body[:2048], re.I):
            if inner := re.search(rb"charset\s*=[\s\"']*([A-Za-z0-9_:.\-]+)", tag, re.I):
                label = inner[1].decode("ascii")
                break
    return encodings.encoding(label) or "utf-8"


def _decoding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index
        bodies, kinds = batch.column(at("body")).to_pylist(), batch.column(at("content_type")).to_pylist()
        text = [None if b is None else encodings.decoded(b, charset(k, b)) for b, k in zip(bodies, kinds, strict=True)]
        keep = [k for k in batch.schema.names if k not in ("body", "content_type")]
        yield pa.RecordBatch.from_arrays([*[batch.column(at(k)) for k in keep], pa.array(text, pa.string())], names=[*keep, "html"])


def answers(captured: DataFrame, retries: int = 2, most: int = MAX_BODY) -> DataFrame:
    """One answer per url and method: the attempt that counts, its failure, and its text, cut at `most` bytes.

    captured has url, method, n (of the attempt), status, headers (a map), body (binary) and error (a code).
    """
    chosen = final_attempts(captured.withColumn("url", F.concat_ws(" ", "method", "url")), retries).select(F.split_part("url", F.lit(" "), F.lit(1)).alias("method"), F.expr("substring(url, instr(url, ' ') + 1)").alias("url"), F.col("attempts").alias("n"))
    rows = captured.join(chosen, ["url", "method", "n"])
    kind = F.try_element_at("headers", F.lit("content-type"))
    body = F.when(is_textual(F.coalesce(kind, F.lit(""))), F.expr(f"substring(body, 1, {most})"))
    flat = rows.select("url", "method", "status", "headers", failure(F.col("error")).alias("failure"), F.octet_length("body").cast("bigint").alias("bytes"), (F.octet_length("body") > most).alias("truncated"), kind.alias("content_type"), body.alias("body"))
    return flat.mapInArrow(_decoding, "url string, method string, status int, headers map<string,string>, failure string, bytes long, truncated boolean, html string")
