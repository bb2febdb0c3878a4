"""Suffix-array deduplication: remove every byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

A full suffix array has an entry per byte of the corpus. This one sorts two much smaller sets of suffixes, and stays exact:

1. Anchors. Each 50-byte window has an anchor: the place of the least hash of its 16-byte grams, the leftmost of equal ones. Equal
   windows have equal grams at their anchors, so they meet when anchors are grouped by gram. Neighbouring windows mostly share
   their anchor; such a run of windows is one entry, with a fingerprint of all bytes that the run covers. Entries with equal
   grams and equal fingerprints are copies of each other, and all but those of the smallest doc_id are covered whole. About one
   place in 18 is an anchor.
2. Suffixes. What is left undecided are windows in runs whose gram, and the bytes on one side of it, also stand in other bytes, as
   where a repeated passage begins and ends. Such runs are range-partitioned by the leading 8 bytes of their anchor's suffix, at
   splitters that Spark samples, a frequent leading token over several buckets. Each bucket sorts all its 50-byte suffixes by
   multikey quicksort, 8 bytes at a time and only where ties are left; equal neighbours are compared in the bucket, and those at
   its boundaries with what other buckets hold of them.

Copies in one batch are settled there, so a passage of very many documents reaches step 1's exchange once a batch.

Defined cases: a null text has no bytes; texts under 50 bytes keep all theirs; strings repeated in one document only stay; equal
doc_ids are one document for this purpose, and repeated rows get equal results each; a null doc_id is smaller than all others;
an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import Written, free_name, parallelism
from .textnp import _BYTE, _U, _power_tables, as_int64, column, mixed, text_chunks

WINDOW = 50
GRAM = 16
SPAN = WINDOW - GRAM + 1
#: Bytes before the gram or bytes after it: of the 34 bytes of a window besides its gram, one side has as many.
BESIDE = (WINDOW - GRAM) // 2
BLOCK = 1 << 23
NULL_ID = -(2**63)
#: Entries that a task decides, entries of a bucket of them, and undecided runs that a task sorts: what a task holds in memory.
ENTRIES_A_TASK, ENTRIES_A_BUCKET, RUNS_A_BUCKET = 400_000, 100_000, 25_000


def _leading(buf: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes at each of the first n places as a little-endian number; bytes past the end count as zero."""
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[: min(len(buf), n + 8)] = buf[: n + 8]
    return np.ndarray((n,), dtype="<u8", buffer=padded.data, strides=(1,)).copy()


def _anchored(buf: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of valid windows of a block with one anchor: first and last window, hashes of the gram, of all, of the bytes beside the gram, place of the anchor."""
    n = len(buf) - GRAM + 1
    words = _leading(buf, n + 8)
    grams = mixed(words[:n] * _U(0x9E3779B97F4A7C15) ^ mixed(words[8 : n + 8]))
    least = (grams & ~_U(0xFFFFFF)) | np.arange(n, dtype=_U)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    anchor = (least[valid] & _U(0xFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(anchor)])) - 1
    gram = grams[anchor[first]]
    i0, i1 = valid[first], valid[last]
    power, inverse = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum(_BYTE[buf] * power[:-1], out=sums[1:])
    print_ = mixed((sums[i1 + WINDOW] - sums[i0]) * inverse[i0] + (i1 - i0).astype(_U))
    at = anchor[first]
    before, after = np.maximum(at - BESIDE, 0), np.minimum(at + GRAM + BESIDE, len(buf))
    left = mixed((sums[at] - sums[before]) * inverse[before])
    right = mixed((sums[after] - sums[at + GRAM]) * inverse[at + GRAM])
    return i0, i1, gram, print_, left, right, at - i0


def runs(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, hashes of the gram, of all, of the bytes beside the gram, place of the anchor in the run)."""
    buf = np.frombuffer(b"".join(t or b"" for t in texts), dtype=np.uint8)
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    out = []
    for at in range(0, max(0, len(buf) - WINDOW + 1), BLOCK):
        part = buf[at : at + BLOCK + WINDOW - 1]
        places = np.arange(at, at + len(part) - WINDOW + 1)
        valid = np.flatnonzero(places + WINDOW <= ends[np.searchsorted(ends, places, "right")])
        if len(valid):
            i0, i1, *hashes = _anchored(part, valid)
            out.append((i0 + at, i1 + at, *hashes))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, *[none.view(_U)] * 4, none
    i0, i1, *hashes = (np.concatenate(x) for x in zip(*out, strict=True))
    text = np.searchsorted(ends, i0, "right")
    begin = (ends - sizes)[text]
    return text, i0 - begin, i1 - begin, *hashes


_FIELDS = (("gram", "<u8"), ("finger", "<u8"), ("doc", "<i8"), ("tag", "<u8"), ("left", "<u2"), ("right", "<u2"), ("first", "<u4"), ("length", "u1"), ("at", "u1"), ("same", "u1"))


def _packed(e: dict[str, np.ndarray]) -> bytes:
    """Entries as bytes: each field in planes of equal significance, doc_ids as steps, so that compression finds the zeros."""
    planes = []
    for name, kind in _FIELDS:
        values = np.diff(e[name], prepend=0) if name == "doc" else e[name]
        planes.append(np.ascontiguousarray(values, dtype=kind).view(np.uint8).reshape(len(values), -1)[:, : 6 if name == "gram" else None].T.tobytes())
    return b"".join(planes)


_WIDTH = sum(6 if name == "gram" else np.dtype(kind).itemsize for name, kind in _FIELDS)


def _unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts = {name: [] for name, _ in _FIELDS}
    for blob in blobs:
        n, at = len(blob) // _WIDTH, 0
        for name, kind in _FIELDS:
            width = 6 if name == "gram" else np.dtype(kind).itemsize
            raw = np.zeros((n, np.dtype(kind).itemsize), dtype=np.uint8)
            raw[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
            at += n * width
            values = raw.reshape(-1).view(kind)
            parts[name].append(np.cumsum(values) if name == "doc" else values)
    return {name: np.concatenate(p) if p else np.zeros(0, dtype=kind) for (name, kind), p in zip(_FIELDS, parts.values(), strict=True)}


def _grouped(e: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by (gram, fingerprint, doc): the order, the smallest doc of each entry's copies, where grams begin."""
    order = np.lexsort((e["doc"], e["finger"], e["gram"]))
    gram, finger, doc = e["gram"][order], e["finger"][order], e["doc"][order]
    new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
    new = new_gram | np.concatenate(([True], finger[1:] != finger[:-1]))
    smallest = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order, smallest, new_gram


def _mapped(n_buckets: int):
    """Texts -> (bucket, entries); a batch's own copies are settled, and their entries marked as covered."""

    def flush(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        e = {name: np.concatenate([h[name] for h in held]) for name, _ in _FIELDS}
        if not len(e["doc"]):
            return
        order, smallest, _ = _grouped(e)
        e["same"][order] = e["doc"][order] > smallest
        # what is settled only passes through: any bucket will do, so that a frequent passage doesn't meet in one
        bucket = (np.where(e["same"] == 1, mixed(e["doc"].view(_U) ^ e["finger"]), e["gram"]) % _U(n_buckets)).astype(np.int64)
        by = np.argsort(bucket.astype(np.uint16) if n_buckets <= 65536 else bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        blobs = [_packed({k: v[by[cuts[b] : cuts[b + 1]]] for k, v in e.items()}) for b in used]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, texts in text_chunks(batches):
            docs = column(batch, "_id").to_numpy(zero_copy_only=False)
            tags = column(batch, "_tag").to_numpy(zero_copy_only=False).astype(np.int64)
            text, i0, i1, gram, finger, left, right, at = runs(texts)
            held.append({"gram": gram & _U(0xFFFFFFFFFFFF), "finger": finger, "doc": docs[text].astype(np.int64), "tag": tags[text].view(_U), "left": left.astype(np.uint16), "right": right.astype(np.uint16), "first": i0.astype(np.uint32), "length": (i1 - i0).astype(np.uint8), "at": at.astype(np.uint8), "same": np.zeros(len(i0), dtype=np.uint8)})
            size += len(i0)
            if size >= 400_000:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


_SPANS = "_id long, _tag long, covered boolean, first long, last long, at int"


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries -> runs that are covered (bytes first to last), and runs whose windows are to be compared (windows first to last)."""
    e = _unpacked([b for batch in batches for b in column(batch, "entries").to_pylist()])
    if not len(e["doc"]):
        return
    order, smallest, new_gram = _grouped(e)
    doc = e["doc"][order]
    covered = (doc > smallest) | (e["same"][order] == 1)
    begin = np.flatnonzero(new_gram)
    differs = np.minimum.reduceat(smallest, begin) != np.maximum.reduceat(smallest, begin)
    maybe = np.flatnonzero(~covered & differs[np.cumsum(new_gram) - 1])
    open_ = np.zeros(len(doc), dtype=bool)
    for side in ("left", "right"):
        # a window that two of them share takes in the bytes on one side of the gram
        both = e["gram"][order[maybe]] << _U(16) | e[side][order[maybe]].astype(_U)
        by = np.argsort(both, kind="stable")
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(by)), dtype=bool), both[by][1:] != both[by][:-1])))
        if len(by):
            some = np.minimum.reduceat(doc[maybe[by]], first) != np.maximum.reduceat(doc[maybe[by]], first)
            open_[maybe[by]] |= np.repeat(some, np.diff(np.append(first, len(by))))
    take = np.flatnonzero(covered | open_)
    rows = order[take]
    first = e["first"][rows].astype(np.int64)
    last = first + e["length"][rows] + np.where(covered[take], WINDOW, 1)
    # neighbours in a text first: equal values are then next to each other in the written table
    by = np.lexsort((first, e["doc"][rows]))
    out = [e["doc"][rows][by], e["tag"][rows][by].astype(np.int64), covered[take][by], first[by], last[by], e["at"][rows][by].astype(np.int32)]
    names = ["_id", "_tag", "covered", "first", "last", "at"]
    for at in range(0, len(rows), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in out], names=names)


_SUFFIX = "_id long, _tag long, first long, lead long, bytes binary"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The undecided runs of texts: their first window, the first 8 bytes of the anchor's suffix as a number, and their bytes."""
    for batch, texts in text_chunks(batches):
        ids, tags, spans = (column(batch, k).to_pylist() for k in ("_id", "_tag", "spans"))
        rows = [(doc, tag, s["first"], int.from_bytes(text[s["first"] + s["at"] : s["first"] + s["at"] + 8], "big") - (1 << 63), text[s["first"] : s["last"] + WINDOW - 1]) for doc, tag, text, own in zip(ids, tags, texts, spans, strict=True) for s in own]
        if rows:
            doc, tag, first, lead, raw = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (doc, tag, first, lead)], pa.array(raw, pa.binary())], names=["_id", "_tag", "first", "lead", "bytes"])


def multikey_sorted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of 8-byte words: by the first word, then ties among themselves by the next, and so on.

    Returns the order, and for each place in it the number of the class of equal rows.
    """
    order = np.argsort(words[:, 0], kind="stable")
    key = words[order, 0]
    cls = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64)))) if len(order) else np.zeros(0, dtype=np.int64)
    for k in range(1, words.shape[1]):
        tied = np.flatnonzero(np.concatenate(([False], cls[1:] == cls[:-1])) | np.concatenate((cls[1:] == cls[:-1], [False])))
        if not len(tied):
            break
        own = order[tied]
        by = np.lexsort((words[own, k], cls[tied]))
        order[tied] = own[by]
        value = words[order, k]
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (cls[1:] == cls[:-1]) & (value[1:] == value[:-1])
        alone = np.ones(len(order), dtype=bool)
        alone[tied] = False
        same[alone] = False
        cls = np.cumsum(~same) - 1
    return order, cls


_FOUND = "_id long, _tag long, place long, suffix binary"


def _sorted_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's suffixes -> those that a smaller doc_id of the bucket has too (suffix null), and those at its boundaries."""
    parts = list(batches)
    if not sum(p.num_rows for p in parts):
        return
    ids, tags, first, leads = (np.concatenate([column(p, k).to_numpy(zero_copy_only=False) for p in parts]) for k in ("_id", "_tag", "first", "lead"))
    raw = [x for p in parts for x in column(p, "bytes").to_pylist()]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    buf = np.frombuffer(b"".join(raw), np.uint8)
    # all windows of all runs: the run, and the window's place in it
    count = size - WINDOW + 1
    run = np.repeat(np.arange(len(raw)), count)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(size) - size)[run] + inner
    eight = np.ndarray((len(buf) - 7,), dtype=">u8", buffer=buf.data, strides=(1,))
    words = np.column_stack([eight[at + k].astype(_U) for k in (*range(0, WINDOW - 8, 8), WINDOW - 8)])
    doc, tag, place = ids[run], tags[run], first[run] + inner
    order, cls = multikey_sorted(words)
    least = np.minimum.reduceat(doc[order], np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1]))))
    repeated = doc[order] > least[cls]
    # leading tokens that the splitters may have left in other buckets too
    edge = ((leads == leads.min()) | (leads == leads.max()))[run][order]
    take = np.flatnonzero(repeated | edge)
    rows, settled = order[take], repeated[take]
    for k in range(0, len(rows), 50_000):
        s = slice(k, k + 50_000)
        suffix = [None if done else buf[i : i + WINDOW].tobytes() for done, i in zip(settled[s], at[rows[s]], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x[rows[s]]) for x in (doc, tag, place)] + [pa.array(suffix, pa.binary())], names=["_id", "_tag", "place", "suffix"])


def _key() -> tuple[Column, Column]:
    """doc_id with a value for null, and a hash of the text, to tell apart rows that share a doc_id: 64 bits where it is null, else 32."""
    tag = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), tag


def _keyed(documents: DataFrame, *more: str) -> DataFrame:
    id_, tag = _key()
    return documents.select(id_.alias("_id"), tag.alias("_tag"), "text", *more)


def covered_spans(documents: DataFrame) -> DataFrame:
    """(_id, _tag, first, last): runs of bytes to remove, last excluded; they may overlap."""
    docs = _keyed(documents.where(F.octet_length("text") >= WINDOW))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(parallelism(docs.sparkSession), size // (18 * ENTRIES_A_TASK))
    n_buckets = max(1, min(60_000, max(4 * parts, size // (18 * ENTRIES_A_BUCKET))))
    entries = docs.mapInArrow(_mapped(n_buckets), "bucket long, entries binary").repartition(parts, "bucket")
    decided = Written(entries.mapInArrow(_decided, _SPANS), "suffix-runs").df
    undecided = decided.where(~F.col("covered")).groupBy("_id", "_tag").agg(F.collect_list(F.struct("first", "last", "at")).alias("spans"))
    suffixes = Written(docs.join(undecided, ["_id", "_tag"]).dropDuplicates(["_id", "_tag"]).mapInArrow(_suffixes, _SUFFIX), "suffix-undecided")
    n = suffixes.df.count()
    ranged = suffixes.df.repartitionByRange(max(parallelism(docs.sparkSession), n // RUNS_A_BUCKET), "lead", "_id")
    found = Written(ranged.mapInArrow(_sorted_bucket, _FOUND), "suffix-repeats")
    suffixes.drop()
    edges = found.df.where(F.col("suffix").isNotNull())
    least = edges.groupBy("suffix").agg(F.min("_id").alias("_least"))
    across = edges.join(least, "suffix").where(F.col("_id") > F.col("_least"))
    places = found.df.where(F.col("suffix").isNull()).select("_id", "_tag", "place").unionByName(across.select("_id", "_tag", "place"))
    windows = places.select("_id", "_tag", F.col("place").alias("first"), (F.col("place") + WINDOW).alias("last"))
    return decided.where("covered").select("_id", "_tag", "first", "last").unionByName(windows)


def _spans_by_text(spans: DataFrame) -> DataFrame:
    return spans.groupBy("_id", "_tag").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def united(spans: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans."""
    if not spans:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    first = np.array([s["first"] for s in spans])
    last = np.array([s["last"] for s in spans])
    order = np.argsort(first)
    first, last = first[order], np.maximum.accumulate(last[order])
    fresh = np.concatenate(([True], first[1:] > last[:-1]))
    return first[fresh], last[np.append(np.flatnonzero(fresh)[1:] - 1, len(last) - 1)]


def _kept(text: bytes, first: np.ndarray, last: np.ndarray) -> bytes:
    return b"".join(text[a:b] for a, b in zip(np.append(0, last), np.append(first, len(text)), strict=True))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches):
        out = []
        for text, spans in zip(texts, column(batch, "spans").to_pylist(), strict=True):
            first, last = united(spans)
            out.append((len(text or b""), int((last - first).sum()), len(first), hashlib.sha256(_kept(text or b"", first, last)).hexdigest()))
        n_bytes, removed, n_spans, sha = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    spans = _spans_by_text(covered_spans(documents))
    joined = _keyed(documents, "doc_id").join(spans, ["_id", "_tag"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(_digested, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents with all their columns, repeated bytes cut out of their texts, n_chars made to fit where there is one.

    A character of which a byte is cut goes as a whole, so texts stay valid. Texts that lose all are empty, not dropped.
    """
    schema = documents.schema
    spans_name, id_name, tag_name = (free_name(documents, n) for n in ("_spans", "_id", "_tag"))
    spans = _spans_by_text(covered_spans(documents)).select(F.col("_id").alias(id_name), F.col("_tag").alias(tag_name), F.col("spans").alias(spans_name))
    id_, tag = _key()
    cut = documents.join(spans, (id_ == F.col(id_name)) & (tag == F.col(tag_name)), "left").select(*[F.col(f"`{c}`") for c in schema.names], spans_name)
    cut = cut.mapInArrow(_cut_texts(spans_name), StructType([*schema.fields, StructField(spans_name, ArrayType(StructType([StructField("first", LongType()), StructField("last", LongType())])))]))
    out = cut.select(*schema.names)
    if "n_chars" in schema.names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(schema["n_chars"].dataType)))
    return out


def _cut_texts(spans_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            out = [_cut(text, spans) for text, spans in zip(texts, column(batch, spans_name).to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return run


def _cut(text: bytes | None, spans: list[dict] | None) -> str | None:
    """A text without some bytes, and without characters of which they are a part."""
    if text is None or not spans:
        return None if text is None else text.decode()
    first, last = united(spans)
    begins = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    first = begins[np.searchsorted(begins, first, "right") - 1]
    ends = np.append(begins, len(text))
    last = ends[np.searchsorted(ends, last, "left")]
    return _kept(text, *united([{"first": int(a), "last": int(b)} for a, b in zip(first, last, strict=True)])).decode()
