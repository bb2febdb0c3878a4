"""Web archives packaged as ZIP files: written by tasks, located by their directories and read back by ranges.

`write_archives` lets each task write ZIP files whose members are stored, not compressed: one WARC file of records, each a
gzip member of its own, and one index of (id, offset, length) lines. `read_archives` opens each ZIP file, finds the end of its
central directory (the ZIP64 one where the plain one is full), lists its members, reads the indexes, and then reads each record
by its range of bytes, so that nothing is extracted and no archive is held in memory.

Of records with equal payloads the one with the smallest page_id is the response, and the others are revisits of it: payloads
are grouped by their SHA-1 and length in a table that holds no html. Files go to the folder that the cluster shares, under a
name that no other attempt of a task uses; a lost attempt leaves files that nothing lists.

Defined cases: a null html is an empty payload, a null url an empty target; rows that repeat a page_id are records of their own,
of which with equal payloads one is the response; a null page_id sorts before all others, and what it is the response of refers
to no number; an empty table gives no archive; columns other than page_id, url and html are
not looked at. A page is packed and read by one task, however long it is.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, shared_dir, write_out
from .textnp import column

#: Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL32, FULL16, EXTRA64 = 0xFFFFFFFF, 0xFFFF, 0x0001
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdx"
DATE = "1970-01-01T00:00:00Z"
ROLL_BYTES = 256 << 20


class ZipWriter:
    """Stored members, one after another, on a stream that can't seek. With `zip64`, every size and offset is written in 64 bits."""

    def __init__(self, out, zip64: bool = True):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def open(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, self.at, 0])
        # sizes and CRC follow in the central directory; bit 3 says so to other readers
        extra = struct.pack("<HHQQ", EXTRA64, 16, 0, 0) if self.zip64 else b""
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45 if self.zip64 else 20, 0x0808, 0, 0, 0x21, 0, *([FULL32] * 2 if self.zip64 else [0, 0]), len(raw), len(extra)) + raw + extra)
        self.members[-1][2] = self.at

    def write(self, data: bytes) -> int:
        """Append to the member that is open; where in it this began."""
        member = self.members[-1]
        offset = self.at - member[2]
        member[3] = zlib.crc32(data, member[3])
        self._put(data)
        return offset

    def end_member(self) -> None:
        member = self.members[-1]
        size = self.at - member[2]
        member.append(size)
        self._put(struct.pack("<II" + ("QQ" if self.zip64 else "II"), 0x08074B50, member[3], size, size))

    def close(self) -> None:
        first = self.at
        for raw, header, _, crc, size in self.members:
            wide = self.zip64
            extra = struct.pack("<HHQQQ", EXTRA64, 24, size, size, header) if wide else b""
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45 if wide else 20, 45 if wide else 20, 0x0808, 0, 0, 0x21, crc, *([FULL32] * 2 if wide else [size, size]), len(raw), len(extra), 0, 0, 0, 0, FULL32 if wide else header) + raw + extra)
        n, size = len(self.members), self.at - first
        if self.zip64:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, first))
            self._put(struct.pack("<IIQI", LOCATOR64, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, *([FULL16] * 2 if self.zip64 else [n, n]), *([FULL32] * 2 if self.zip64 else [size, first]), 0))


def members(file, length: int) -> dict[str, tuple[int, int]]:
    """name -> (first byte, size) of the stored members of a ZIP file, from its directories. `file` is read by ranges."""
    tail_at = max(0, length - 65_557)
    tail = file.read_at(length - tail_at, tail_at)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    n, size, first = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == n or FULL32 in (size, first):
        signature, _, end64, _ = struct.unpack("<IIQI", file.read_at(20, tail_at + at - 20))
        if signature != LOCATOR64:
            raise ValueError("no locator of the ZIP64 directory")
        record = file.read_at(56, end64)
        if struct.unpack_from("<I", record)[0] != END64:
            raise ValueError("no ZIP64 directory")
        n, size, first = struct.unpack_from("<QQQ", record, 32)
    directory, found, at = file.read_at(size, first), {}, 0
    for _ in range(n):
        signature, method = struct.unpack_from("<I6xH", directory, at)
        packed, plain, len_name, len_extra, len_comment, header = struct.unpack_from("<IIHHH8xI", directory, at + 20)
        if signature != CENTRAL:
            raise ValueError("the central directory is broken")
        name = directory[at + 46 : at + 46 + len_name].decode()
        extra, e = directory[at + 46 + len_name : at + 46 + len_name + len_extra], 0
        while e + 4 <= len(extra):
            kind, size_e = struct.unpack_from("<HH", extra, e)
            if kind == EXTRA64:
                wide = list(struct.unpack_from(f"<{size_e // 8}Q", extra, e + 4))
                plain = wide.pop(0) if plain == FULL32 else plain
                packed = wide.pop(0) if packed == FULL32 else packed
                header = wide.pop(0) if header == FULL32 else header
            e += 4 + size_e
        if method == 0:
            local = file.read_at(30, header)
            n_name, n_extra = struct.unpack_from("<HH", local, 26)
            found[name] = (header + 30 + n_name + n_extra, packed)
        at += 46 + len_name + len_extra + len_comment
    return found


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes | None, size: int, sha: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed: a response with its payload, or a revisit without."""
    page = "" if page_id is None else str(page_id)
    named = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", DATE), ("WARC-Target-URI", " ".join(url.split()))]
    if payload is None:
        named += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head + (payload or b"")
    named += [("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The fields of one record. A revisit's payload_bytes come from its HTTP header, a response's from the payload itself."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    claimed = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).partition(":")[2])
    page = fields["warc-record-id"][len("<urn:page:") : -1]
    kind, sha = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    refers = fields["warc-refers-to"][len("<urn:page:") : -1] if kind == "revisit" else None
    if kind == "response" and (len(payload), digest(payload)) != (claimed, sha):
        raise ValueError(f"record {page}: the payload isn't the one that its header names")
    return {"page_id": int(page) if page else None, "url": fields["warc-target-uri"], "record_type": kind, "payload": payload if kind == "response" else None, "payload_bytes": claimed, "payload_digest": sha, "refers_to": int(refers) if refers else None}


_REC = "path string, n long"


def _writer(target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, paths, counts = None, [], []
        for batch in batches:
            cols = {k: column(batch, k) for k in ("page_id", "url", "html", "_response", "_n", "_sha", "_first")}
            html = cols.pop("html").cast(pa.large_binary()).to_pylist()
            rest = [cols[k].to_pylist() for k in ("page_id", "url", "_response", "_n", "_sha", "_first")]
            for payload, page, url, response, size, sha, first in zip(html, *rest, strict=True):
                if out is None:
                    fs, path = pafs.FileSystem.from_uri(target)
                    fs.create_dir(path, recursive=True)
                    paths.append(f"{target}/{uuid.uuid4().hex}.wacz")
                    counts.append(0)
                    stream = fs.open_output_stream(pafs.FileSystem.from_uri(paths[-1])[1], buffer_size=1 << 20)
                    out, index = ZipWriter(stream), []
                    out.open(WARC_MEMBER)
                base32 = base64.b32encode(bytes.fromhex(sha)).decode()
                packed = gzip.compress(record(page, url or "", (payload or b"") if response else None, size, base32, first), 3, mtime=0)
                index.append(b"%d %d\n" % (out.write(packed), len(packed)))
                counts[-1] += 1
                if out.at >= ROLL_BYTES:
                    _finish(out, index)
                    out = None
        if out is not None:
            _finish(out, index)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "n"])

    return run


def _finish(out: ZipWriter, index: list[bytes]) -> None:
    out.end_member()
    out.open(INDEX_MEMBER)
    out.write(b"".join(index))
    out.end_member()
    out.close()
    out.out.close()


def write_archives(pages: DataFrame, target: str | None = None, least: int = 0) -> DataFrame:
    """Write all pages as WARC records into ZIP archives below `target`; (path, n) of each archive."""
    target = target or f"{shared_dir(pages.sparkSession)}/sitewright/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("_sha"), F.octet_length(payload).alias("_n"))
    small = Written(rows.select("page_id", "_sha", "_n"), "warc-digests").df
    order = F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id").alias("id"))
    first = small.where(F.col("_n") >= least).groupBy("_sha", "_n").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    shared = first.select("_sha", "_n", F.col("f.id").alias("_first"))
    # only payloads that are there twice take part; rows go without their html
    revisits = small.join(shared, ["_sha", "_n"]).where(~F.col("page_id").eqNullSafe(F.col("_first"))).select(F.col("page_id").alias("_page"), F.col("_sha").alias("_s"), "_first").distinct()
    marked = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_sha") == F.col("_s")), "left")
    sent = marked.select("page_id", "url", F.when(F.col("_s").isNull(), F.col("html")).alias("html"), F.col("_s").isNull().alias("_response"), "_n", "_sha", "_first")
    return write_out(_one_response(sent, small).mapInArrow(_writer(target), _REC), "warc-archives")


def _one_response(sent: DataFrame, small: DataFrame) -> DataFrame:
    """Of rows with equal page_ids and payloads, one stays a response and the others revisit it. No other row is shuffled for it."""
    again = small.groupBy(F.col("page_id").alias("_page"), F.col("_sha").alias("_s")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    if again.isEmpty():
        return sent
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_sha") == F.col("_s"))
    # their numbers hold once they are written
    many = Written(sent.join(again, same, "left_semi").where("_response").withColumn("_row", F.monotonically_increasing_id()), "warc-repeats").df
    first = many.groupBy(F.col("page_id").alias("_page"), F.col("_sha").alias("_s")).agg(F.min("_row").alias("_least"))
    is_first = F.col("_row") == F.col("_least")
    split = many.join(first, same).select("page_id", "url", F.when(is_first, F.col("html")).alias("html"), is_first.alias("_response"), "_n", "_sha", F.when(~is_first, F.col("page_id")).alias("_first"))
    return sent.join(again, same, "left_anti").unionByName(sent.join(again, same, "left_semi").where("not _response")).unionByName(split)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
_DDL = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
PIECE = 2000


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path -> pieces of its index: (path, first byte of the WARC member, offsets, lengths)."""
    for batch in batches:
        rows = []
        for path in column(batch, "path").to_pylist():
            fs, local = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(local) as file:
                found = members(file, file.size())
                first = found[WARC_MEMBER][0]
                lines = [x.split() for x in file.read_at(found[INDEX_MEMBER][1], found[INDEX_MEMBER][0]).splitlines()]
            for k in range(0, len(lines), PIECE):
                rows.append({"path": path, "ranges": [{"at": first + int(a), "n": int(n)} for a, n in lines[k : k + PIECE]]})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("ranges", pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())])))]))


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, ranges in zip(column(batch, "path").to_pylist(), column(batch, "ranges").to_pylist(), strict=True):
                fs, local = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_file(local) as file:
                    for r in ranges:
                        row = parsed(gzip.decompress(file.read_at(r["n"], r["at"])))
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"")
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_OUT)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_OUT)

    return run


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of archives (column path): page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to.

    Each archive's directories are read once; its index is then dealt out in pieces, so that many tasks share a large archive.
    Each response's payload is held against its digest.
    """
    n = archives.sparkSession.sparkContext.defaultParallelism
    pieces = archives.select("path").repartition(n).mapInArrow(_indexed, "path string, ranges array<struct<at:long,n:long>>")
    return pieces.repartition(2 * n).mapInArrow(_reader(with_payload), _DDL)


def round_trip(pages: DataFrame) -> DataFrame:
    archives = write_archives(pages)
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of the SHA-1: each 5 hexadecimal digits are 4 letters.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, html,
         array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(sha1(html), CAST((k // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest
  FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM r
"""
