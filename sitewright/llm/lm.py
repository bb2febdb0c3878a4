"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Token counts are gathered from all training documents. The most frequent tokens are dealt by rank into classes; all
others form one more class, in which a token's share is its smoothed count. A token's probability is that of its class times
that of the token in its class, each a softmax over hashed features of what goes before: the last word, the one before it
(a skip), and both. The words before are hashed to rows first, so a context is a pair of rows.

Weights start at zero over unigram constants and are trained by distributed gradient updates on all training documents. Their
contexts are gathered once, as counts of (context, token). In each round every task walks through its contexts and adds up, for
each weight, the mass that the model expects there; the gradient is the observed mass less the expected. It is scaled by their
logarithmic mean, which bounds the curvature (as in iterative scaling), over STEPS. In the first round all weights are zero, and
the expected mass follows from counts of features alone. Sums go through the shuffle in slices of the tables. Scoring runs on
batches of tokens, as sparse rows of the weight tables.

The model grows with the counts: its vocabulary are the tokens seen at least a tenth of the root of all tokens
(VOCABULARY at least), in as many classes as members of each; its tables have rows for the root (ROWS at least, MOST_ROWS at
most: two tables of 65,536 rows of at most 513 numbers are what is broadcast).

Words are known by 64-bit hashes. Tokens that rank below FREQUENT are too many to broadcast: their counts are joined in a
shuffle.

Defined cases: a null or blank text is one end token; with no training documents N and V are 0 and every token is unseen; equal
counts rank by hash; rows with equal doc_ids are scored each; an empty table gives no rows; only doc_id and text are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, id_crc, parallelism
from .textnp import _U, as_int64, column, mixed, text_chunks, words_of

#: What the least model has; larger ones follow from the counts.
CLASSES, MEMBERS = 64, 64
VOCABULARY = CLASSES * MEMBERS
ROWS, MOST_ROWS = 1 << 13, 1 << 16
FREQUENT = 1 << 18
ROUNDS = 2
#: By what a round's scaled gradient is divided, and mass that is added to observed and expected.
STEPS, SMOOTH = 2.0, 4.0
#: Contexts in a step through the tables, entries that a task deals out at once and gathers, and entries of a task of a round.
BATCH, HELD, A_TASK = 4096, 4_000_000, 2_000_000
#: Rows of a table that are added up together.
SLICE = 64
END, BEGIN = _U(0x1F3D5B79A2C4E6F8), np.array(0x2A4C6E8193B5D7F9, dtype=_U)
_SALTS = (_U(0x8CB92BA72F3D8DD7), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5))


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, its end included, and where each text's begin."""
    found = words_of(texts)
    hashes = found.hashes()
    bounds = found.bounds + np.arange(len(found.bounds))
    out = np.full(len(hashes) + len(texts), END, dtype=_U)
    inside = np.ones(len(out), dtype=bool)
    inside[bounds[1:] - 1] = False
    out[inside] = hashes
    return out, bounds


def contexts(stream: np.ndarray, bounds: np.ndarray, bits: int) -> np.ndarray:
    """What stands before each token: the row of the last word in the low bits, that of the word before it above."""
    mask = _U((1 << bits) - 1)
    row, begin = mixed(stream ^ _SALTS[0]) & mask, (mixed(BEGIN[None] ^ _SALTS[0]) & mask)[0]
    last, skip = np.empty_like(row), np.empty_like(row)
    last[1:], skip[2:] = row[:-1], row[:-2]
    last[bounds[:-1]] = begin
    skip[bounds[:-1]] = begin
    second = bounds[:-1] + 1
    skip[second[second < bounds[1:]]] = begin
    return skip << _U(bits) | last


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        token, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return token, np.bincount(inverse, np.concatenate([h[1] for h in held]), minlength=len(token)).astype(np.int64)

    for _, texts in text_chunks(batches):
        held.append(np.unique(tokens(texts)[0], return_counts=True))
        if sum(len(h[0]) for h in held) > 2_000_000:
            held = [merged()]
            if len(held[0][0]) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(as_int64(held[0][0])), pa.array(held[0][1])], names=["token", "n"])
                held = []
    if held:
        token, n = merged()
        for at in range(0, len(token), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(as_int64(token[at : at + 100_000])), pa.array(n[at : at + 100_000])], names=["token", "n"])


class Model:
    """What scoring needs: frequent tokens and their counts, the vocabulary's classes, and weights."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.argsort(frequent)
        self.token, self.count = frequent[order], counts[order]
        self.total, self.distinct = total, distinct
        root = math.isqrt(total)
        often = int((self.count >= max(1, root // 10)).sum())
        # as many classes as members of each
        self.side = max(CLASSES, math.isqrt(max(0, often - 1)) + 1)
        self.bits = min(MOST_ROWS, max(ROWS, 1 << max(0, root.bit_length() - 1))).bit_length() - 1
        self.rows = 1 << self.bits
        rank = np.lexsort((self.token, -self.count))[: self.side**2]
        self.place = np.full(len(self.token), -1, dtype=np.int32)
        self.place[rank] = np.arange(len(rank))
        known = self.count[rank]
        self.rare_total = int(total - known.sum())
        self.rare_distinct = int(distinct - len(rank))
        n = np.zeros(self.side**2)
        n[: len(rank)] = known
        by_class = n.reshape(self.side, self.side)
        self.class_bias = np.log(np.append(by_class.sum(axis=1), self.rare_total) + 0.5).astype(np.float32)
        filled = (np.arange(self.side**2) < len(rank)).reshape(self.side, self.side)
        self.class_bias[:-1][~filled.any(axis=1)] = -1e4
        self.member_bias = np.where(filled, np.log(by_class + 0.5), -1e4).astype(np.float32)
        self.weights = [np.zeros((self.rows, self.side + 1), dtype=np.float32), np.zeros((self.rows, self.side), dtype=np.float32)]

    def find(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, place in the vocabulary) of tokens; -1 where a token isn't frequent, or not of the vocabulary."""
        if not len(self.token):
            return np.full(len(stream), -1), np.full(len(stream), -1)
        distinct, inverse = np.unique(stream, return_inverse=True)
        at = np.minimum(np.searchsorted(self.token, as_int64(distinct)), len(self.token) - 1)
        hit = self.token[at] == as_int64(distinct)
        return np.where(hit, self.count[at], -1)[inverse], np.where(hit, self.place[at], -1)[inverse]


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _rows(model: Model, context: np.ndarray) -> np.ndarray:
    """The rows of a context's three features: last word, word before the last, both."""
    low = _U(model.rows - 1)
    hashed = np.column_stack((mixed((context & low) ^ _SALTS[1]), mixed((context >> _U(model.bits)) ^ _SALTS[2]), mixed(context ^ _SALTS[3])))
    return (hashed & low).astype(np.int64)


def _class_rows(model: Model, context: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The rows of the three features within a class."""
    own = _rows(model, context).astype(_U) | (np.arange(3, dtype=_U) << _U(60))
    return (mixed(own + ((cls.astype(_U) + _U(1)) << _U(32))[:, None]) & _U(model.rows - 1)).astype(np.int64)


def _logits(w: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = w[rows[:, 0]]
    out += w[rows[:, 1]]
    out += w[rows[:, 2]]
    out += bias
    return out


def packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys, as steps, and their counts: in planes of equal significance, as many as there are bytes that count."""
    steps = np.diff(keys, prepend=keys[:1])
    head, planes = [len(keys), int(keys[0]) if len(keys) else 0], []
    for values in (steps, n.astype(_U)):
        width = (int(values.max(initial=0)).bit_length() + 7) // 8
        head.append(width)
        planes.append(values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return np.array(head, dtype=_U).tobytes() + b"".join(planes)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, first, *widths = np.frombuffer(blob, _U, 4).tolist()
    at, out = 32, []
    for width in widths:
        raw = np.zeros((size, 8), dtype=np.uint8)
        raw[:, :width] = np.frombuffer(blob, np.uint8, size * width, at).reshape(width, size).T
        at += size * width
        out.append(raw.reshape(-1).view(_U))
    return np.cumsum(out[0]) + _U(first), out[1].astype(np.int64)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1])))
    return keys[begins], np.add.reduceat(n, begins) if len(begins) else n


def _place_bits(model: Model) -> int:
    return (model.side**2).bit_length()


def keys_of(model: Model, texts: list[bytes | None]) -> np.ndarray:
    """The context of each token of texts and, in the low bits, its place in the vocabulary; 0 there is a rare token."""
    stream, bounds = tokens(texts)
    return contexts(stream, bounds, model.bits) << _U(_place_bits(model)) | (model.find(stream)[1] + 1).astype(_U)


def _dealt(shared, n_buckets: int):
    """Texts -> (bucket, entries): counts of (context, token), all of one context in one bucket."""

    def flush(held: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = (mixed(keys >> _U(bits)) % _U(n_buckets)).astype(np.int64)
        by = np.argsort(bucket.astype(np.uint16) if n_buckets <= 65536 else bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        blobs = [packed(keys[by[cuts[b] : cuts[b + 1]]], n[by[cuts[b] : cuts[b + 1]]]) for b in used]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = shared.value, [], 0
        for _, texts in text_chunks(batches):
            held.append(keys_of(model, texts))
            size += len(held[-1])
            if size >= HELD:
                yield from flush(held, _place_bits(model))
                held, size = [], 0
        if held:
            yield from flush(held, _place_bits(model))

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of a bucket, those of equal keys added up, in rows of at most a million."""
    parts = [unpacked(b) for batch in batches for b in column(batch, "entries").to_pylist()]
    if parts:
        keys, n = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        for at in range(0, len(keys), 1_000_000):
            s = slice(at, at + 1_000_000)
            yield pa.RecordBatch.from_arrays([pa.array([len(keys[s])]), pa.array([packed(keys[s], n[s])], pa.binary())], names=["size", "entries"])


def _groups(model: Model, keys: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    """Of sorted entries, for each weight table: (context, class, mass of each pair of these; of entries: which pair, output, mass, place)."""
    context, place = keys >> _U(_place_bits(model)), (keys & _U((1 << _place_bits(model)) - 1)).astype(np.int64) - 1
    cls = np.where(place >= 0, place // model.side, model.side)
    take = np.arange(len(keys))
    for common in (False, True):
        if common:
            take = np.flatnonzero(place >= 0)
            context, cls, place, n = context[take], cls[take], place[take], n[take]
        new = np.ones(len(context), dtype=bool)
        new[1:] = (context[1:] != context[:-1]) | (common & (cls[1:] != cls[:-1]))
        begins = np.flatnonzero(new)
        if len(begins):
            yield common, context[begins], cls[begins], np.add.reduceat(n, begins), np.cumsum(new) - 1, place % model.side if common else cls, n, take


def log10_probabilities(model: Model, context: np.ndarray, place: np.ndarray) -> np.ndarray:
    """log10 P of the class of each token, and of the token in it if it is of the vocabulary. Repeated contexts are looked at once."""
    keys, inverse = np.unique(context << _U(_place_bits(model)) | (place + 1).astype(_U), return_inverse=True)
    out = np.zeros(len(keys))
    for common, ctx, cls, _, of, output, _, take in _groups(model, keys, np.ones(len(keys))):
        cuts = np.searchsorted(of, np.arange(0, len(ctx) + BATCH, BATCH))
        for at, lo, hi in zip(range(0, len(ctx), BATCH), cuts[:-1], cuts[1:], strict=False):
            s = slice(at, at + BATCH)
            rows = _class_rows(model, ctx[s], cls[s]) if common else _rows(model, ctx[s])
            x = _logits(model.weights[common], rows, model.member_bias[cls[s]] if common else model.class_bias)
            x -= x.max(axis=1, keepdims=True)
            own = of[lo:hi] - at
            picked = x[own, output[lo:hi]]
            np.exp(x, out=x)
            out[take[lo:hi]] += picked - np.log(x.sum(axis=1))[own]
    return out[inverse] / np.log(10)


def observed(model: Model, entries: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The mass of each weight, and of each (row of the second table, class): what the first round needs."""
    out = [np.zeros(w.shape, dtype=np.float32) for w in (*model.weights, model.weights[1])]
    for keys, n in entries:
        for common, context, cls, mass, of, output, times, _ in _groups(model, keys, n):
            rows = _class_rows(model, context, cls) if common else _rows(model, context)
            width = model.side + (not common)
            for k in range(3):
                out[common] += np.bincount(rows[of, k] * width + output, times, minlength=model.rows * width).reshape(model.rows, width)
                if common:
                    out[2] += np.bincount(rows[:, k] * width + cls, mass, minlength=model.rows * width).reshape(model.rows, width)
    return out


def _add(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add values to each of their rows of a table."""
    flat = rows.ravel()
    order = np.argsort(flat.astype(np.uint16) if len(total) <= 65536 else flat, kind="stable")
    flat, of = flat[order], order // rows.shape[1]
    begins = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    times = np.diff(np.append(begins, len(flat)))
    # rows met a few times are added up time by time, the others row by row
    sums = values[of[begins]]
    few = np.flatnonzero((times > 1) & (times <= 16))
    for k in range(1, 16):
        few = few[times[few] > k]
        sums[few] += values[of[begins[few] + k]]
    for k in np.flatnonzero(times > 16).tolist():
        sums[k] = values[of[begins[k] : begins[k] + times[k]]].sum(axis=0)
    total[flat[begins]] += sums


def expected(model: Model, entries: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The mass that the model expects at each weight."""
    out = [np.zeros(w.shape, dtype=np.float32) for w in model.weights]
    for keys, n in entries:
        for common, context, cls, mass, *_ in _groups(model, keys, n):
            for at in range(0, len(context), BATCH):
                s = slice(at, at + BATCH)
                rows = _class_rows(model, context[s], cls[s]) if common else _rows(model, context[s])
                p = _softmax(_logits(model.weights[common], rows, model.member_bias[cls[s]] if common else model.class_bias))
                p *= mass[s, None]
                _add(out[common], rows, p)
    return out


def expected_at_zero(model: Model, seen: list[np.ndarray]) -> list[np.ndarray]:
    """The same with no weights yet: each feature's mass, shared out by the constants."""
    shares = _softmax(model.member_bias.copy())
    return [seen[0].sum(axis=1, keepdims=True) * _softmax(model.class_bias[None].copy()), seen[2] @ shares]


def updated(model: Model, seen: list[np.ndarray], mass: list[np.ndarray]) -> None:
    """A gradient step: (observed - expected) over their logarithmic mean is the logarithm of their ratio."""
    for w, o, e in zip(model.weights, seen, mass, strict=False):
        w += np.log((o + SMOOTH) / (e + SMOOTH)) / STEPS


_SUMS = "part long, at long, mass binary"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for blob in column(batch, "entries").to_pylist():
            yield unpacked(blob)


def _walked(shared, walk):
    """Entries -> what `walk` adds up for a model, in slices of tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, total in enumerate(walk(shared.value, _entries(batches))):
            met = [at for at in range(0, len(total), SLICE) if total[at : at + SLICE].any()]
            for i in range(0, len(met), 64):
                some = met[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array([total[at : at + SLICE].tobytes() for at in some], pa.binary())], names=["part", "at", "mass"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal slices of many tasks, added up."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for part, at, mass in zip(*(column(batch, k).to_pylist() for k in ("part", "at", "mass")), strict=True):
            own = np.frombuffer(mass, np.float32).astype(np.float64)
            sums[part, at] = sums[part, at] + own if (part, at) in sums else own
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], names=["part", "at", "mass"])


def _sums(contexts_: DataFrame, size: int, model: Model, walk, shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    """What `walk` adds up over all contexts: tables of the shapes of weights, whatever the corpus has."""
    spark = contexts_.sparkSession
    shared = spark.sparkContext.broadcast(model)
    tasks = max(1, min(parallelism(spark), size // A_TASK))
    slices = contexts_.select("entries").coalesce(tasks).mapInArrow(_walked(shared, walk), _SUMS)
    out = [np.zeros(shape, dtype=np.float32) for shape in shapes]
    added = slices.repartition(parallelism(spark), "part", "at").mapInArrow(_added, _SUMS)
    for part, at, mass in added.toPandas().itertuples(index=False, name=None):
        own = out[part][at : at + SLICE]
        own += np.frombuffer(mass, np.float32).reshape(own.shape)
    shared.unpersist()
    return out


def train(documents: DataFrame, counts: DataFrame) -> Model:
    """Fit a model on documents (text), of which counts (token, n) are all the tokens."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # the least count that at most FREQUENT tokens reach, from how many tokens have each count
    held = counts.groupBy("n").count().orderBy(F.desc("n")).limit(FREQUENT).toArrow()
    fits = held["n"].to_numpy()[np.cumsum(held["count"].to_numpy()) <= FREQUENT]
    least = int(fits.min()) if len(fits) else 1 << 62
    frequent = counts.where(F.col("n") >= least).select("token", "n").toArrow()
    model = Model(frequent["token"].to_numpy(), frequent["n"].to_numpy(), int(total), int(distinct))
    if not total:
        return model
    spark = documents.sparkSession
    parts = max(parallelism(spark), int(total) // HELD)
    shared = spark.sparkContext.broadcast(model)
    dealt = documents.select("text").mapInArrow(_dealt(shared, parts), "bucket long, entries binary").repartition(parts, "bucket")
    held = Written(dealt.mapInArrow(_gathered, "size long, entries binary"), "lm-contexts")
    size = held.df.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shapes = [w.shape for w in model.weights]
    seen = _sums(held.df, size, model, observed, [*shapes, shapes[1]])
    updated(model, seen, expected_at_zero(model, seen))
    for _ in range(ROUNDS - 1):
        updated(model, seen, _sums(held.df, size, model, expected, shapes))
    held.drop()
    return model


_SCORED = "_row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<long>, times array<long>"


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        all_, rare_all = np.log10(model.total + model.distinct + 1), np.log10(model.rare_total + model.rare_distinct + 1)
        for batch, texts in text_chunks(batches, limit=1 << 22):
            stream, bounds = tokens(texts)
            n = len(texts)
            text = np.repeat(np.arange(n), np.diff(bounds))
            count, place = model.find(stream)
            known, rare = count >= 0, place < 0
            unigram = np.log10(np.maximum(count, 0) + 1.0)
            base = np.bincount(text, np.where(known, unigram, 0.0), minlength=n) - np.diff(bounds) * all_
            p = log10_probabilities(model, contexts(stream, bounds, model.bits), place)
            p += np.where(rare, np.where(known, unigram, 0.0) - rare_all, 0.0)
            tail = np.flatnonzero(~known)
            order = tail[np.lexsort((stream[tail], text[tail]))]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (text[order][1:] != text[order][:-1]) | (stream[order][1:] != stream[order][:-1])
            begins = np.flatnonzero(new)
            times = np.diff(np.append(begins, len(order)))
            cuts = pa.array(np.searchsorted(text[order][begins], np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "_row"), column(batch, "doc_id"), column(batch, "held_out"), pa.array(np.diff(bounds)), pa.array(np.bincount(text[known], minlength=n)), pa.array(base), pa.array(np.bincount(text, p, minlength=n)), pa.ListArray.from_arrays(cuts, pa.array(as_int64(stream[order][begins]))), pa.ListArray.from_arrays(cuts, pa.array(times))],
                names=["_row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail", "times"],
            )

    return run


def scored(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 P) of every document.

    Documents whose crc32(doc_id) leaves 2 when divided by 7 are held out of counts and training.
    """
    sc = documents.sparkSession.sparkContext
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.pmod(id_crc(F.col("doc_id")), F.lit(7)) == 2).alias("held_out"))
    seen = rows.where(~F.col("held_out")).select("text")
    counts = Written(seen.mapInArrow(_counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "lm-counts").df
    model = train(seen, counts)
    shared = sc.broadcast(model)
    # the row number is written with the scores: from here on it is fixed
    part = Written(rows.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(_scored(shared), _SCORED), "lm-scores").df
    rest = part.select("_row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("_row", F.col("t.tail").alias("token"), F.col("t.times").alias("times"))
    found = rest.join(counts, "token")
    more = found.groupBy("_row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("unigram"))
    unigram = F.coalesce("unigram", F.lit(0.0))
    return part.drop("tail", "times").join(more, "_row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + unigram).alias("base_score"),
        (F.col("score") + unigram).alias("score"),
    )
