"""Periodic run detection: stretches of words that repeat a cycle three times or more, by tiles of each scale.

Periods are taken by octaves [Q, 2Q). For an octave a document is laid out in overlapping tiles, one around each multiple c of Q
(of 8 for the periods below 16): a run of three cycles holds such a c with at least Q words on its right that stand q words
further on too. A tile is solved on its own: the names of its blocks of Q words give the periods q at c, and the Z-values of its
boundary (how far the words at c and at c + q agree, to the right and to the left, as far as the tile goes) give one fragment of
the run. Block names are made by doubling, so all tiles of a batch of documents are solved at once, in a few passes per octave.
Periods that a part of them explains are no fragment (q is no smallest period then). Fragments are shuffled by document and
period and stitched where they touch; what is long enough is a run. Texts travel only where a document has a fragment, and only
there are they looked at again: each run is compared word by word, as bytes, and a document of which one does not hold is solved
anew with exact names in place of 64-bit ones.

Defined cases: a null text, or one without words, has no words, no runs, and the digest of nothing; repeated rows get a row
each; a null doc_id stays null; ties among runs go to the smallest start, then period; an empty table gives no rows; columns
other than doc_id and text are not looked at, but for `collapsed`, which keeps them. A text is held by one task, with some 60
bytes of working space per byte, however long it is; the work on n words grows with n log n.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Written, free_name, words
from .textnp import _B, _U, column, mixed, text_chunks, words_of

#: A run has at least this many words, and this many cycles.
LEAST, CYCLES = 24, 3
#: Periods below twice this are looked for at once, at boundaries this far apart.
LOWEST = 8
_FRAGMENT = [("q", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]


class Names:
    """Names of all blocks of 1, 2, 4, ... words: equal where the words are equal. `exact` names are ranks, the others 64-bit hashes."""

    def __init__(self, words: np.ndarray, exact: bool = False):
        self.levels, self.exact = [words], exact

    def __getitem__(self, level: int) -> np.ndarray:
        while len(self.levels) <= level:
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            a, b = (last[:-half], last[half:]) if len(last) > half else (last[:0], last[:0])
            self.levels.append(np.unique((a << _U(32)) | b, return_inverse=True)[1].astype(_U) if self.exact else mixed(a * _U(_B) + mixed(b)))
        return self.levels[level]

    def same(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the blocks at a and at b are equal; blocks that leave the words at either end aren't."""
        names = self[level]
        inside = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < len(names))
        out = np.zeros(len(a), dtype=bool)
        out[inside] = names[a[inside]] == names[b[inside]]
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether `size` words at a and at b are equal."""
        out = np.zeros(len(a), dtype=bool)
        level = np.frexp(size.astype(float))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            tail = size[at] - (1 << int(k))
            out[at] = self.same(int(k), a[at], b[at]) & self.same(int(k), a[at] + tail, b[at] + tail)
        return out


def _matches(names: Names, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(c, q): boundaries and the octave's periods at which the block of Q words at c stands again."""
    own, q = names[level], 1 << level
    if q == LOWEST:
        found = [(np.flatnonzero(own[: len(own) - k : q] == own[k::q][: len(own[: len(own) - k : q])]) * q, k) for k in range(1, 2 * q) if k < len(own)]
        return np.concatenate([c for c, _ in found] or [np.zeros(0, np.int64)]), np.concatenate([np.full(len(c), k) for c, k in found] or [np.zeros(0, np.int64)])
    whole = max(0, len(own) - q) // q
    row, at = np.nonzero(own[q : q + whole * q].reshape(whole, q) == own[: whole * q : q][:, None])
    last = np.flatnonzero(own[q + whole * q :] == own[whole * q]) if len(own) > q + whole * q else np.zeros(0, np.int64)
    return np.concatenate((row, np.full(len(last), whole))) * q, np.concatenate((at, last)) + q


def _prime_parts(q: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(places, r): which of the periods are multiples of the prime r."""
    out, left, r = [], np.unique(q), 2
    rest = left.copy()
    while len(rest) and r * r <= int(rest.max()):
        if (rest % r == 0).any():
            out.append(r)
            while (rest % r == 0).any():
                rest = np.where(rest % r == 0, rest // r, rest)
        r += 1
    out.extend(int(x) for x in np.unique(rest) if x > 1)
    return [(np.flatnonzero(q % r == 0), r) for r in dict.fromkeys(out)]


def fragments(names: Names, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, lo, hi) of all tiles of all octaves: the words lo to hi, hi excluded, are each equal to the word q further on."""
    out = [(np.zeros(0, np.int64),) * 3]
    level = LOWEST.bit_length() - 1
    while (1 if 1 << level == LOWEST else 1 << level) <= longest // CYCLES:
        tile = 1 << level
        c, q = _matches(names, level)
        keep = np.ones(len(c), dtype=bool)
        for at, r in _prime_parts(q):
            at = at[keep[at]]
            p = q[at] // r
            keep[at] = ~names.equal(c[at], c[at] + p, tile + q[at] - p)
        c, q = c[keep], q[keep]
        right, left = np.full(len(c), tile), np.zeros(len(c), np.int64)
        for k in range(level, -1, -1):
            right += names.same(k, c + right, c + q + right) * (1 << k)
            left += names.same(k, c - left - (1 << k), c + q - left - (1 << k)) * (1 << k)
        ends_inside = (right < 3 * tile - 1) & (left < 2 * tile - 1)
        short = ends_inside & (right + left + q < np.maximum(LEAST, CYCLES * q))
        out.append((q[~short], (c - left)[~short], (c + right)[~short]))
        level += 1
    q, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True))
    return q, lo, hi


def _batch_fragments(texts: list[bytes | None], exact: bool = False) -> tuple[np.ndarray, ...]:
    """(text, q, lo, hi) by text, and each text's number of words. Between texts stands a word that stands nowhere else."""
    found = words_of(texts, lower=False)
    n = np.diff(found.bounds)
    own = np.repeat(np.arange(len(texts)), n)
    joined = np.empty(len(own) + len(texts), dtype=_U)
    breaks = found.bounds[1:] + np.arange(len(texts))
    joined[np.arange(len(own)) + own] = found.ids() + len(texts) if exact else found.hashes()
    joined[breaks] = np.arange(len(texts)) if exact else mixed(np.arange(len(texts)).astype(_U) ^ _U(0x94D049BB133111EB))
    q, lo, hi = fragments(Names(joined, exact), int(n.max(initial=0)))
    begin = found.bounds[:-1] + np.arange(len(texts))
    text = np.searchsorted(begin, lo, "right") - 1
    by = np.argsort(text, kind="stable")
    return text[by], q[by], (lo - begin[text])[by], (hi - begin[text])[by], n


_SOLVED = "key long, doc_id long, n long, words_sha256 string, fragments array<struct<q:long,lo:long,hi:long>>, text string"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> their tiles' fragments; the text goes on only where there are any."""
    for batch, texts in text_chunks(batches):
        text, q, lo, hi, n = _batch_fragments(texts)
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        held = np.diff(bounds) > 0
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (q, lo, hi)], names=[k for k, _ in _FRAGMENT]))
        shas = [None if h else _sha(b" ".join((t or b"").split())) for t, h in zip(texts, held, strict=True)]
        kept_texts = pa.array([t.decode() if h else None for t, h in zip(texts, held, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([column(batch, "key"), column(batch, "doc_id"), pa.array(n), pa.array(shas, pa.string()), lists, kept_texts], names=["key", "doc_id", "n", "words_sha256", "fragments", "text"])


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def stitched(found: DataFrame) -> DataFrame:
    """(key, q, lo, hi) fragments -> (key, start, length, period): where fragments of a document and period touch, they are one."""
    own = Window.partitionBy("key", "q").orderBy("lo", "hi")
    reach = F.max("hi").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    joined = opened.groupBy("key", "q", "part").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo") + F.col("q")).alias("length"))
    return joined.where(F.col("length") >= F.greatest(F.lit(LEAST), CYCLES * F.col("q"))).select("key", "start", "length", F.col("q").alias("period"))


def _true_run(w: list[bytes], start: int, length: int, q: int) -> bool:
    end = start + length
    return w[start : end - q] == w[start + q : end] and (start == 0 or w[start - 1] != w[start - 1 + q]) and (end == len(w) or w[end - q] != w[end])


def _exact_runs(text: bytes) -> list[tuple[int, int, int]]:
    """The runs of one text by exact names, stitched here."""
    _, q, lo, hi, _ = _batch_fragments([text], exact=True)
    merged: list[list[int]] = []
    for p, a, b in sorted(zip(q.tolist(), lo.tolist(), hi.tolist(), strict=True)):
        if merged and merged[-1][0] == p and a <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([p, a, b])
    return sorted((a, b - a + p, p) for p, a, b in merged if b - a + p >= max(LEAST, CYCLES * p))


def checked(text: bytes, runs: list[tuple[int, int, int]]) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """The words and the runs (start, length, period) by start and period, once each run is seen to hold."""
    w, runs = text.split(), sorted(runs)
    return w, runs if all(_true_run(w, *run) for run in runs) else _exact_runs(text)


def kept_words(w: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: of each run, the first cycle stays."""
    gone = bytearray(len(w))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [x for x, g in zip(w, gone, strict=True) if not g]


class Runs:
    """The runs of a table of documents: `solved` has a row per document, `runs` those of each key."""

    def __init__(self, documents: DataFrame):
        own = documents.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.solved = Written(own.mapInArrow(_solved, _SOLVED), "periodic-tiles").df
        self.runs = stitched(self.solved.select("key", F.explode("fragments").alias("x")).select("key", "x.*"))

    def with_runs(self) -> DataFrame:
        """key, doc_id, text, runs of the documents that have a fragment."""
        lists = self.runs.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
        return self.solved.where("text is not null").select("key", "doc_id", "text").join(lists, "key", "left")


def runs(documents: DataFrame) -> DataFrame:
    """doc_id, start, length, period of every run of every document."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            for doc_id, t, own in zip(column(batch, "doc_id").to_pylist(), texts, column(batch, "runs").to_pylist(), strict=True):
                found = checked(t, [(r["start"], r["length"], r["period"]) for r in own or []])[1]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), *(pa.array([r[k] for r in found], pa.int64()) for k in range(3))], names=["doc_id", "start", "length", "period"])

    return Runs(documents).with_runs().mapInArrow(listed, "doc_id long, start long, length long, period long")


_DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches):
        rows = []
        for doc_id, t, own in zip(column(batch, "doc_id").to_pylist(), texts, column(batch, "runs").to_pylist(), strict=True):
            w, found = checked(t, [(r["start"], r["length"], r["period"]) for r in own or []])
            best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
            listed = "".join(f"{a},{b},{c}\n" for a, b, c in found).encode()
            rows.append((doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, _sha(listed), _sha(b" ".join(kept_words(w, found)))))
        types = [pa.int64()] * 6 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _DIGESTS.split(", ")])


def digests(documents: DataFrame) -> DataFrame:
    """Per document the number of its runs, the one of most cycles, and digests of all runs and of the words they leave."""
    found = Runs(documents)
    none = F.lit(None).cast("long")
    without = found.solved.where("text is null").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), *(none.alias(x) for x in ("start", "length", "period", "exponent_milli")), F.lit(_sha(b"")).alias("runs_sha256"), F.col("words_sha256").alias("collapsed_sha256")
    )
    return found.with_runs().mapInArrow(_digested, _DIGESTS).unionByName(without)


def collapsed(documents: DataFrame) -> DataFrame:
    """The documents with all their columns; of each run in a text only the first cycle stays, its words joined by single blanks.

    Texts without a run stay as they are, and so does n_chars, which else is made to fit where there is one.
    """
    names, schema = [f"`{c}`" for c in documents.columns], documents.schema
    row, text, own = (free_name(documents, x) for x in ("_row", "_text", "_runs"))
    held = Written(documents.withColumn(row, F.monotonically_increasing_id()), "periodic-documents").df
    found = Runs(held.select(F.col(row).alias("doc_id"), "text")).with_runs().where("runs is not null").select("doc_id", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            out = [b" ".join(kept_words(*checked(t, [(r["start"], r["length"], r["period"]) for r in o]))).decode() for t, o in zip(texts, column(batch, "runs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out, pa.string())], names=[own, text])

    joined = held.join(found.mapInArrow(cut, StructType().add(own, "long").add(text, "string")), F.col(row) == F.col(own), "left")
    out = joined.select(*names[: schema.names.index("text")], F.coalesce(text, "text").alias("text"), *names[schema.names.index("text") + 1 :], text)
    if "n_chars" in schema.names:
        out = out.withColumn("n_chars", F.when(F.col(text).isNotNull(), F.length("text").cast(schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*names)


def with_planted(documents: DataFrame) -> DataFrame:
    """The documents with doc_id and text; where a tenth of crc32(doc_id) says so, the text's words from one on repeat a cycle.

    A null doc_id has no such number: its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = words(F.col("text"))
    n, g = F.size(w), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycles = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.concat(F.slice(w, F.lit(1), a), F.slice(cycles, F.lit(1), n - a))
    return documents.select("doc_id", F.when((h % 10 == 0) & (n > 0), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))
