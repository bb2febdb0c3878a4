"""Registered queries of parsing: text content of elements, and hosts of URLs, and their SQL. What is put in is told by page_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.crawl import resolving
from ..sources import html as H
from ..sources import web
from . import overlay as O

#: What stands at the begin of each page's title, or before it: markup that is text there, ends that are none, and references.
BEGIN = {
    0: "<title>a<b ", 1: '<title>x &lt;i&gt; &amp; <a href="/t"> ', 2: "<title>A</titlex> </ title> ", 3: '<textarea><a href="/in">&amp;</textarea ><title>', 4: '<xmp><a href="/x"><title>no</title></xmp><title>',
    5: "<TITLE\n>up ", 6: '<script>"</scripty>"; <a href="/s"></script x="y"><title>', 7: "<title>&notit; &#x41;&#66; <!-- kept --> ",
}
SAID = {0: "a<b ", 1: 'x <i> & <a href="/t"> ', 2: "A</titlex> </ title> ", 5: "up ", 7: "¬it; AB <!-- kept --> "}
_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"
OPENED = "CASE page_id % 9 " + " ".join(f"WHEN {k} THEN {_QUOTED(v)}" for k, v in BEGIN.items()) + " ELSE '<title>' END"
#: Every fifth title ends with blanks in its end tag; every eleventh never ends.
CLOSED = "CASE WHEN page_id % 11 = 10 THEN '' WHEN page_id % 5 = 4 THEN '</Title \n x>' ELSE '</title>' END"


def text_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, form fields and links of pages in which the content of title, textarea, xmp and script looks like markup."""
    html = f"replace(replace(html, '</title>', {CLOSED}), '<title>', {OPENED})"
    rows = O.raw(spark, sf_dir).select("page_id", F.lit("https://e.com/").alias("final_url"), F.expr(f"{html} AS html"))
    d = F.col("doc")
    title = F.left(d["title"], F.lit(2000))
    return H.documents(H.parsed(rows, "page_id")).select(
        "page_id", F.md5(title.cast("binary")).alias("title"), F.length(title).cast("bigint").alias("title_chars"), F.size(d["links"]).cast("bigint").alias("n_links"), F.size(d["form_controls"]).cast("bigint").alias("n_fields"), F.size(d["scripts"]).cast("bigint").alias("n_scripts"),
    )


#: Forms of hosts by number: (as written, as resolved), in SQL that Spark and DuckDB share. n is a number below 2**32, a to d its bytes.
HOSTS = [
    ("CAST(n AS STRING)", "address"), ("'0x' || lower(hex(n))", "address"), ("'0X' || upper(hex(n)) || '.'", "address"), ("a || '.' || (n % 16777216)", "address"), ("a || '.0x' || hex(b) || '.' || (n % 65536)", "address"),
    ("a || '.' || b || '.' || c || '.' || d || '.1'", "NULL"), ("(a + 256) || '.1'", "NULL"), ("'a.' || n", "NULL"), ("'09.' || a", "NULL"), ("'x' || n || '.0x1g'", "'x' || n || '.0x1g'"),
    ("'[::' || upper(hex(16 + a)) || ']'", "'[::' || lower(hex(16 + a)) || ']'"), ("'[1:0:0:0:0:0:' || lower(hex(1 + b)) || ':000' || (d % 10) || ']'", "'[1::' || lower(hex(1 + b)) || ':' || (d % 10) || ']'"),
    ("'[::ffff:' || a || '.' || b || '.' || c || '.' || d || ']'", "'[::ffff:' || lower(hex(a * 256 + b)) || ':' || lower(hex(c * 256 + d)) || ']'"), ("'[::1%25e' || a || ']'", "NULL"), ("'[1::2::' || a || ']'", "NULL"),
    ("'Stra' || chr(223) || 'e.DE'", "'xn--strae-oqa.de'"), ("'fa' || chr(223) || '.' || n || 'x'", "'xn--fa-hia.' || n || 'x'"), ("'B' || chr(252) || 'cher.example'", "'xn--bcher-kva.example'"), ("'ex%61mple' || n || '.com'", "'example' || n || '.com'"), ("'a' || n || '%2Eb%2e'", "'a' || n || '.b.'"),
    ("'a%00' || n", "NULL"), ("'a' || n || '。JP'", "'a' || n || '.jp'"), ("'\uff21' || n || '.com'", "'a' || n || '.com'"), ("'a' || chr(173) || 'b' || n", "'ab' || n"), ("'a b' || n", "NULL"), ("'a' || n || '^'", "NULL"), ("'u:p@h' || n", "'h' || n"),
    ("'h' || n || ':0080'", "'h' || n"), ("'h' || n || ':65536'", "NULL"), ("'xn--' || n || '-'", "NULL"), ("'www.Ex' || n || '.com.'", "'www.ex' || n || '.com.'"),
]
NUMBERS = "SELECT *, CAST(floor(n / 16777216) AS BIGINT) AS a, CAST(floor(n / 65536) AS BIGINT) % 256 AS b, CAST(floor(n / 256) AS BIGINT) % 256 AS c, n % 256 AS d FROM (SELECT page_id, (page_id * 2654435761 + 12345) % 4294967296 AS n FROM pages)"


def host_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as numbers, in octal or hexadecimal, IPv6, names in other scripts, percent-encoded, with ports, and hosts that are none."""
    rows = spark.sql(NUMBERS.replace("FROM pages", "FROM {pages}"), pages=O.raw(spark, sf_dir))
    forms = F.array(*[F.struct(F.lit(k).cast("bigint").alias("form"), F.concat(F.lit("http://"), F.expr(f"CAST({w} AS STRING)"), F.lit("/p")).alias("_to"), F.lit("https://base.example/").alias("final_url")) for k, (w, _) in enumerate(HOSTS)])
    asked = rows.select("page_id", F.explode(forms).alias("x")).select("page_id", "x.*")
    return asked.mapInArrow(resolving, asked.schema).select("page_id", "form", F.col("_to").alias("url"))


#: (label, bytes, text): what servers send under labels of the web, among them some that mean more than they say, and some that are none.
ENCODED = [
    ("gb2312", "C4E3BAC3", "你好"), ("GB2312", "8140", "丂"), ("gb18030", "8139EF30", "㐁"), ("big5", "A741A66E", "你好"), ("ks_c_5601-1987", "BEC8B3E7", "안녕"), ("euc-kr", "8141", "갂"), ("shift_jis", "8740", "①"), ("sjis", "82A0", "あ"),
    ("euc-jp", "A4A2", "あ"), ("iso-2022-jp", "1B244224221B2842", "あ"), ("iso-8859-9", "80FD", "€ı"), ("latin1", "80E9", "€é"), ("us-ascii", "93", "“"), ("iso-8859-2", "B1", "ą"), ("iso-8859-15", "A4", "€"), ("koi8-r", "F0D2C9D7C5D4", "Привет"), ("ibm866", "8FE0", "Пр"),
    ("windows-1251", "CFF0", "Пр"), ("tis-620", "A1", "ก"), ("macintosh", "8E", "é"), ("x-user-defined", "41FF", "A\uf7ff"), ("utf-16", "6100E900", "aé"), ("UTF-16BE", "00610416", "aЖ"), ("windows-1253", "AA41", "\ufffdA"), ("hz-gb-2312", "7E7BC3A9", "~{é"),
    ("utf-7", "2B41", "+A"), ("bogus", "C3A9", "é"), ("utf-8", "C3A9C3", "é\ufffd"),
]


def web_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of each page under the labels of the web, named by a header or, on every other page, by a meta element."""
    k = "CAST(page_id % 5 + 1 AS INT)"
    forms = F.array(*[F.struct(F.lit(i).alias("form"), F.lit(label).alias("label"), F.lit(data).alias("data")) for i, (label, data, _) in enumerate(ENCODED)])
    rows = O.raw(spark, sf_dir).select("page_id", F.explode(forms).alias("x")).select("page_id", "x.*")
    meta = F.expr("page_id % 2 = 1 AND lower(label) NOT LIKE 'utf-16%'")
    named = F.when(meta, F.lit("text/html")).otherwise(F.concat(F.lit('text/html; Charset="'), F.col("label"), F.lit('"')))
    # the mark that divides the head from the text is ASCII in all encodings but those of 16 bits, which have no head
    head = F.when(meta, F.concat(F.lit("<meta http-equiv=x content='text/html; charset="), F.col("label"), F.lit("'>|"))).otherwise(F.lit(""))
    captured = rows.select(F.expr("'https://e.com/' || form || '/' || page_id AS url"), F.lit("GET").alias("method"), F.lit(1).alias("n"), F.lit(200).alias("status"), F.create_map(F.lit("content-type"), named).alias("headers"), F.concat(head.cast("binary"), F.unhex(F.expr(f"repeat(data, {k})"))).alias("body"), F.lit(None).cast("string").alias("error"))
    got = web.answers(captured)
    text = F.regexp_replace("html", "^<meta [^|]*\\|", "")
    return got.select(F.regexp_extract("url", r"/(\d+)$", 1).cast("bigint").alias("page_id"), F.regexp_extract("url", r"/(\d+)/\d+$", 1).cast("bigint").alias("form"), text.alias("text"))


QUERIES = {f.__name__: f for f in (text_content, host_forms, web_encodings)}
_TITLE = "CASE page_id % 9 " + " ".join(f"WHEN {k} THEN {_QUOTED(v)}" for k, v in SAID.items()) + " ELSE '' END"
_DECODED = "regexp_extract(html, '<title>(.*?)</title>', 1)"
_REST = "rest"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("middot", "·"), ("copy", "©"), ("amp", "&")):
    _DECODED, _REST = (f"replace({x}, '&{_name};', '{_char}')" for x in (_DECODED, _REST))
SQL = {
    # a title that never ends takes all that comes: that page has no other element after it, and its length tells how much was read
    "text_content": f"""WITH t AS (SELECT page_id, html, {_TITLE} AS begin, {_DECODED} AS own, page_id % 11 = 10 AS endless FROM pages),
r AS (SELECT *, CASE WHEN endless THEN regexp_extract(html, '(?s)</title>(.*)$', 1) ELSE '' END AS rest FROM t),
u AS (SELECT *, trim(regexp_replace(begin || own || {_REST}, '[ \\t\\n\\f\\r\\v]+', ' ', 'g')) AS title FROM r)
SELECT page_id, md5(left(title, 2000)) AS title, CAST(length(left(title, 2000)) AS BIGINT) AS title_chars, CASE WHEN endless THEN CAST(0 AS BIGINT) ELSE CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) END AS n_links,
       CAST(CASE WHEN page_id % 9 = 3 THEN 1 ELSE 0 END AS BIGINT) AS n_fields, CASE WHEN page_id % 9 = 6 THEN 1 ELSE 0 END + CASE WHEN endless THEN CAST(0 AS BIGINT) ELSE CAST(len(regexp_extract_all(html, '<script')) AS BIGINT) END AS n_scripts FROM u""",
    "web_encodings": "\nUNION ALL ".join(f"SELECT page_id, CAST({i} AS BIGINT) AS form, repeat({_QUOTED(text)}, CAST(page_id % 5 + 1 AS BIGINT)) AS text FROM pages" for i, (_, _, text) in enumerate(ENCODED)),
    "host_forms": f"WITH n AS ({NUMBERS}), m AS (SELECT *, a || '.' || b || '.' || c || '.' || d AS address FROM n)\n" + "\nUNION ALL ".join(f"SELECT page_id, CAST({k} AS BIGINT) AS form, 'http://' || {r} || '/p' AS url FROM m" for k, (_, r) in enumerate(HOSTS)),
}
