"""Benchmark decontamination: a prefix-filtered set join between documents and item-sized windows of benchmark texts.

A window is ten consecutive words of an item (all words of a shorter item). Its shingles, runs of three words, are ordered by
how often the whole corpus holds them. Containment asks for every shingle of the window, so the necessary prefix is one
shingle, the rarest: documents are joined with windows on it alone. Its place in the window and the window's length then fix
where the window would have to lie in the document, which must have room for it, and every word there is compared.

The benchmark side is broadcast in blocks of at most `block` windows, each block with a pass of its own over the documents,
so it may be of any size; blocks follow each other, and one at a time is in memory. Hashes of words propose, their bytes decide.

Defined cases: a null or blank text has no words and no hits; a null or blank item has no window; items with equal texts are
both named; a null item_id is left out; repeated rows get equal results each; an empty benchmark contaminates nothing; columns
other than doc_id and text are not looked at, but for `decontaminated`, which keeps them. A text is held by one task, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, write_out
from .textnp import ALPHANUMERIC, Words, as_int64, column, distinct_sorted, grams, text_chunks, words_of

WINDOW = 10
SHINGLE = 3
BLOCK = 100_000


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, words, spelled): the word hashes of each window of each item, and its words, joined by line ends."""
    for batch, texts in text_chunks(batches):
        found = words_of(texts, ALPHANUMERIC)
        hashes, ids = as_int64(found.hashes()), column(batch, "item_id").to_pylist()
        items, runs, spelled = [], [], []
        for k, item in enumerate(ids):
            own = hashes[found.bounds[k] : found.bounds[k + 1]]
            for i in range(max(1, len(own) - WINDOW + 1) if len(own) else 0):
                items.append(item)
                runs.append(own[i : i + WINDOW].tolist())
                words = range(found.bounds[k] + i, found.bounds[k] + i + len(runs[-1]))
                spelled.append(b"\n".join(found.buf[found.starts[w] : found.ends[w]].tobytes() for w in words))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(runs, pa.list_(pa.int64())), pa.array(spelled, pa.binary())], names=["item_id", "words", "spelled"])


def _shingles(words: np.ndarray) -> np.ndarray:
    """The shingle hashes of one window, by place."""
    return as_int64(grams(words.view(np.uint64), min(SHINGLE, len(words))))


def _counted(shared):
    """How often each of the given shingles stands in the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = shared.value
        totals = {n: np.zeros(len(known), dtype=np.int64) for n, known in by_size.items()}
        for _, texts in text_chunks(batches):
            found = words_of(texts, ALPHANUMERIC)
            hashes = found.hashes()
            for n, known in by_size.items():
                at, hit = _lookup(known, as_int64(grams(hashes, n)))
                totals[n] += np.bincount(at[hit], minlength=len(known))
        for n, known in by_size.items():
            some = totals[n] > 0
            yield pa.RecordBatch.from_arrays([pa.array(known[some]), pa.array(totals[n][some])], names=["shingle", "n"])

    return run


def _lookup(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    # most values are in no window: a bitmap of their low bits drops nearly all of them before the search
    bits = 20
    seen = np.zeros(1 << bits, dtype=bool)
    seen[known & ((1 << bits) - 1)] = True
    maybe = np.flatnonzero(seen[values & ((1 << bits) - 1)])
    at, hit = np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    found = np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)
    at[maybe] = found
    hit[maybe] = known[found] == values[maybe]
    return at, hit


class _Index:
    """Windows of one block by their rarest shingle."""

    def __init__(self, items: list[str], windows: list[np.ndarray], spelled: list[bytes], counts: dict[int, int]):
        self.bytes = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        begins = np.cumsum([0, *map(len, spelled)])
        self.word_at, self.word_size = np.zeros((len(windows), WINDOW), dtype=np.int64), np.zeros((len(windows), WINDOW), dtype=np.int64)
        for k, raw in enumerate(spelled):
            size = np.array([len(w) for w in raw.split(b"\n")], dtype=np.int64)
            self.word_size[k, : len(size)] = size
            self.word_at[k, : len(size)] = begins[k] + np.cumsum(size + 1) - size - 1
        self.items = np.array(items, dtype=object)
        self.length = np.array([len(w) for w in windows], dtype=np.int64)
        self.words = np.zeros((len(windows), WINDOW), dtype=np.int64)
        prefix, self.place = np.empty(len(windows), dtype=np.int64), np.empty(len(windows), dtype=np.int64)
        for k, w in enumerate(windows):
            self.words[k, : len(w)] = w
            own = _shingles(w)
            place = min(range(len(own)), key=lambda i: (counts.get(int(own[i]), 0), int(own[i])))
            prefix[k], self.place[k] = own[place], place
        self.by_size = {}
        for n in sorted({min(SHINGLE, int(x)) for x in self.length}):
            rows = np.flatnonzero(np.minimum(self.length, SHINGLE) == n)
            rows = rows[np.argsort(prefix[rows], kind="stable")]
            keys = distinct_sorted(prefix[rows])
            first = np.searchsorted(prefix[rows], keys)
            self.by_size[n] = (keys, rows, first, np.diff(np.append(first, len(rows))))

    def spelled_alike(self, found: Words, start: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Which of the occurrences have the window's words byte by byte."""
        out = np.ones(len(start), dtype=bool)
        for a in range(0, len(start), 50_000):
            b = min(len(start), a + 50_000)
            used = np.arange(WINDOW) < self.length[window[a:b], None]
            word = (start[a:b, None] + np.arange(WINDOW))[used]
            match = np.repeat(np.arange(a, b), self.length[window[a:b]])
            size, begin = self.word_size[window[a:b]][used], self.word_at[window[a:b]][used]
            even = found.ends[word] - found.starts[word] == size
            out[match[~even]] = False
            size, begin, word, match = size[even], begin[even], word[even], match[even]
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            unlike = found.buf[np.repeat(found.starts[word], size) + step] != self.bytes[np.repeat(begin, size) + step]
            out[np.repeat(match, size)[unlike]] = False
        return out

    def matches(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence within a text."""
        hashes, bounds = found.hashes(), found.bounds
        at_all, window_all = [], []
        doc_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        signed = as_int64(hashes)
        for n, (keys, rows, first, count) in self.by_size.items():
            at, hit = _lookup(keys, as_int64(grams(hashes, n)))
            places = np.flatnonzero(hit)
            if not len(places):
                continue
            times = count[at[places]]
            place = np.repeat(places, times)
            run = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
            window = rows[np.repeat(first[at[places]], times) + run]
            start = place - self.place[window]
            # positional and length bounds: the whole window lies in the text where its prefix stands
            doc = doc_of[place]
            fits = (start >= bounds[doc]) & (start + self.length[window] <= bounds[doc + 1])
            start, window = start[fits], window[fits]
            for k in range(WINDOW):
                short = self.length[window] <= k
                same = short | (signed[np.minimum(start + k, len(signed) - 1)] == self.words[window, k])
                start, window = start[same], window[same]
            same = self.spelled_alike(found, start, window)
            start, window = start[same], window[same]
            at_all.append(start)
            window_all.append(window)
        if not at_all:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(at_all), np.concatenate(window_all)


_SCHEMA = "doc_id long, _key long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("_key", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _matched(shared, all_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch, texts in text_chunks(batches):
            found = words_of(texts, ALPHANUMERIC)
            start, window = index.matches(found)
            doc = np.searchsorted(found.bounds, start, "right") - 1
            order = np.lexsort((start, doc))
            start, window, doc = start[order], window[order], doc[order]
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            spans, items = [], []
            for k in range(len(texts)):
                a, b = cuts[k], cuts[k + 1]
                spans.append(_merged(start[a:b] - found.bounds[k], index.length[window[a:b]]) if a < b else [])
                items.append(sorted(set(index.items[window[a:b]])) if a < b else [])
            out = pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), column(batch, "_key"), pa.array(np.diff(found.bounds)), pa.array(spans, _ARROW.field("spans").type), pa.array(items, _ARROW.field("items").type)], schema=_ARROW)
            yield out if all_rows else out.filter(pa.array(np.diff(cuts) > 0))

    return run


def _merged(starts: np.ndarray, lengths: np.ndarray) -> list[dict]:
    """Runs of covered words, from sorted starts."""
    ends = np.maximum.accumulate(starts + lengths)
    fresh = np.concatenate(([True], starts[1:] > ends[:-1]))
    first = starts[fresh]
    last = ends[np.append(np.flatnonzero(fresh)[1:] - 1, len(ends) - 1)]
    return [{"first": int(a), "last": int(b)} for a, b in zip(first, last, strict=True)]


def _indexes(docs: DataFrame, benchmark: DataFrame, block: int):
    """(number of blocks, broadcast): windows of the benchmark by their rarest shingle, at most about `block` windows each; at least one.

    Where there are more, whoever takes them writes what a block finds and destroys it before the next: one at a time is in memory.
    """
    sc = docs.sparkSession.sparkContext
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    windows = write_out(items.mapInArrow(_windows, "item_id string, words array<long>, spelled binary").distinct(), "decontaminate-windows")
    n_blocks = max(1, -(-windows.count() // block))
    # windows with their items, so that one which very many items have is dealt out too
    parts = windows.withColumn("_block", F.pmod(F.xxhash64("item_id", "words"), F.lit(n_blocks)))
    for k in range(n_blocks):
        # one block at a time comes to the driver and goes to the executors
        rows = parts.where(F.col("_block") == k).select("item_id", "words", "spelled").toArrow()
        own = [w.values.to_numpy() for w in rows["words"]]
        by_size: dict[int, list[np.ndarray]] = {}
        for w in own:
            by_size.setdefault(min(SHINGLE, len(w)), []).append(_shingles(w))
        known = sc.broadcast({n: distinct_sorted(np.concatenate(s)) for n, s in by_size.items()})
        counted = docs.select("text").mapInArrow(_counted(known), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")) if own else None
        counts = dict(zip(*(c.to_pylist() for c in counted.toArrow().columns), strict=True)) if own else {}
        known.destroy()
        yield n_blocks, sc.broadcast(_Index(rows["item_id"].to_pylist(), own, rows["spelled"].to_pylist(), counts))


def contamination(documents: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, _key (hash of its text), n_words, spans (covered word runs, last excluded), items (ids as text)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_key"), "text")
    found = None
    for n_blocks, index in _indexes(docs, benchmark, block):
        hits = docs.mapInArrow(_matched(index, found is None), _SCHEMA)
        if n_blocks == 1:
            return hits
        hits = write_out(hits, "decontaminate-hits")
        found = hits if found is None else found.unionByName(hits)
        index.destroy()
    merged = found
    more = merged.where(F.size("items") > 0).groupBy("doc_id", "_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # a null doc_id is an id like others here too, as it is with one block
    found_by = lambda other: F.col("d.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col("d._key") == F.col(f"{other}._key"))
    counted = merged.groupBy("doc_id", "_key").agg(F.max("n_words").alias("n_words"))
    joined = docs.select("doc_id", "_key").alias("d").join(counted.alias("c"), found_by("c"), "left").join(more.alias("m"), found_by("m"), "left")
    spans = F.aggregate(F.array_sort("spans"), F.array().cast("array<struct<first:bigint,last:bigint>>"), lambda s, x: F.when((F.size(s) > 0) & (x["first"] <= F.element_at(s, -1)["last"]), F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(F.element_at(s, -1)["first"].alias("first"), F.greatest(F.element_at(s, -1)["last"], x["last"]).alias("last"))))).otherwise(F.concat(s, F.array(x))))
    none = F.array()
    return joined.select("d.doc_id", "d._key", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce(spans, none.cast("array<struct<first:bigint,last:bigint>>")).alias("spans"), F.coalesce("items", none.cast("array<string>")).alias("items"))


def digests(found: DataFrame) -> DataFrame:
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark. With one block of it, no row is shuffled."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_key"), "text")
    found = None
    for n_blocks, index in _indexes(documents, benchmark, block):
        if n_blocks == 1:
            return documents.mapInArrow(_clean(index), documents.schema)
        hits = write_out(docs.mapInArrow(_matched(index, False), _SCHEMA).select("doc_id", "_key").distinct(), "decontaminate-hits")
        found = hits if found is None else found.unionByName(hits)
        index.destroy()
    id_, key = free_name(documents, "_id"), free_name(documents, "_hit")
    gone = found.select(F.col("doc_id").alias(id_), F.col("_key").alias(key)).distinct()
    return documents.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left_anti")


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            found = words_of(texts, ALPHANUMERIC)
            start, _ = shared.value.matches(found)
            clean = np.ones(len(texts), dtype=bool)
            clean[np.searchsorted(found.bounds, start, "right") - 1] = False
            yield batch.filter(pa.array(clean))

    return run


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower_ascii, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
win AS (
  SELECT item_id, least(10, len(words)) AS n, words[i:i + least(10, len(words)) - 1] AS w
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT doc_id, i, n, words[i:i + n - 1] AS w
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n)),
hits AS (SELECT doc_id, i, runs.n, item_id FROM runs JOIN win ON runs.n = win.n AND runs.w = win.w),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
