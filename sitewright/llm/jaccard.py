"""N-gram Jaccard join: documents whose sets of 5-word shingles are at least 0.75 similar, by parity sketches.

A parity sketch toggles one bit per shingle of a set, so two sketches differ in at most as many bits as the sets' symmetric
difference has elements. At similarity 3/4 that is at most a seventh of the sum of both sizes. Sizes are cut into bands; in
each size band, the sketch is cut into more words than bits can differ and than can be blank, so that by the pigeonhole
principle similar sets share a word that is not blank. Sketches are as sparse as sets: of a word, a 64-bit hash of its odd bits
is kept. A set that could share blank words only (rare, and known by counting) is joined by these too. Large sets need fewer
words than that: as differing bits meet in words, so many words that similar sets share SHARED on average leave a chance of
about 1e-15 that they share none, below that of the hashes' collisions; and fewer words are longer, and met by chance less.

Equal sets have one 64-bit digest, and are one node from there on (two of N different sets collide with a chance of N*N / 2**65).
Of all words, those that more than one set has are kept; in each, the set with most company stands for the group. Sets that
share words are candidates. Each is held against those that stand for its words: dense sketches, folded to a common length, drop
most by Hamming distance, and what is left is verified on the texts, shingle by shingle as bytes. Verified links are united to classes; then, only where the
sets that met one set aren't all of one class yet, their pairs of different classes are held against each other likewise, in
blocks. So each link that is not implied by others is looked at, and tight groups cost a link per member, not per pair.

Defined cases: without words or text a set is empty and linked with nothing; with fewer than five words the whole sequence is
the one shingle; rows that share a doc_id are one document in links; repeated rows get a row each; a null doc_id is a document
with the smallest id; an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, free_name, parallelism
from .components import components, united
from .suffixes import NULL_ID, _keyed
from .textnp import _U, column, distinct_sorted, grams, mixed, text_chunks, words_of

N, PERCENT = 5, 75
RATIO = 1.6
BLOCK, SHINGLES = 1500, 3_000_000
#: Words that similar sets of a size share on average, at least: none shared has then a chance of about 1e-15 per pair.
SHARED = 35


@lru_cache(maxsize=None)
def starts() -> tuple[int, ...]:
    """Where the bands of sizes begin."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, math.floor(out[-1] * RATIO)))
    return tuple(out)


@lru_cache(maxsize=None)
def n_words(band: int, certain_only: bool = False) -> tuple[int, int]:
    """Words of the sketches of a size band, and the most bits that can differ; the smaller set of a pair is of the band's sizes.

    Either so many that a word is shared for certain, or so many that SHARED are on average, whichever is less; for the second
    the bits that can differ are given as -1: there is nothing to make sure of. `certain_only`: always the first.
    """
    least, most = starts()[band], starts()[band + 1] - 1
    differ = (most + 4 * most // 3) // 7
    certain = differ + 1
    while certain <= 4 * differ + 8:
        blank = certain * (1 - 1 / certain) ** least
        load = least / certain
        spread = math.sqrt(max(0.0, certain * math.exp(-load) * (1 - (1 + load) * math.exp(-load))))
        if certain - differ - blank - 2.5 * spread >= 1:
            break
        certain += 1 + certain // 64
    if certain_only:
        return certain, differ
    likely = 8
    while likely < certain and likely * math.exp(-differ / likely) * (1 - math.exp(-(least - differ / 2) / likely)) < SHARED:
        likely += 1 + likely // 64
    return (certain, differ) if certain <= likely else (likely, -1)


def _exact_grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for every run of n consecutive words, equal where all words are, and only there."""
    out = ids[: max(0, len(ids) - n + 1)].astype(_U)
    for k in range(1, n):
        out = np.unique((out << _U(32)) | ids[k : k + len(out)].astype(_U), return_inverse=True)[1].astype(_U)
    return out


def shingle_sets(texts: list[bytes | None], n: int = N, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles of each text, one text after another and sorted, and where each text's begin.

    Shingles are 64-bit hashes, the same in all texts; `exact` ones are numbers that hold among these texts only, and tell
    shingles apart by their bytes.
    """
    found = words_of(texts)
    hashes = found.ids() if exact else found.hashes()
    count = np.diff(found.bounds)
    long_ = count >= n
    text = np.repeat(np.arange(len(texts)), np.where(long_, count - n + 1, 0))
    run = np.arange(len(text)) - np.repeat(np.cumsum(np.where(long_, count - n + 1, 0)) - np.where(long_, count - n + 1, 0), np.where(long_, count - n + 1, 0))
    values = (_exact_grams(hashes, n) if exact else grams(hashes, n))[found.bounds[text] + run] if len(text) else np.zeros(0, dtype=_U)
    whole: dict[tuple, int] = {}
    few = np.flatnonzero((count > 0) & ~long_)
    for k in few:
        own = hashes[found.bounds[k] : found.bounds[k + 1]]
        own = np.array([2**62 + whole.setdefault(tuple(own.tolist()), len(whole))], dtype=_U) if exact else grams(own, int(count[k])) + _U(count[k])
        text, values = np.append(text, k), np.append(values, own)
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
    return values[keep], np.searchsorted(text[keep], np.arange(len(texts) + 1))


def _xor_runs(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduceat(values, begins) if len(begins) else np.zeros(0, dtype=_U)


def sketch_bits(n: int) -> int:
    return max(64, 1 << (max(1, n) * 2 - 1).bit_length())


def dense_sketch(values: np.ndarray) -> bytes:
    """The sketch with at least twice as many bits as the set has elements; half of it, folded, is the next smaller one."""
    bits = sketch_bits(len(values))
    odd = np.bincount((mixed(values ^ _U(0x5851F42D4C957F2D)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def set_digest(values: np.ndarray) -> int:
    """What a set is known by, wherever it stands: 64 bits of all its shingles."""
    return int((mixed(np.bitwise_xor.reduce(mixed(values ^ _U(1)), initial=_U(0))[None]) + mixed(np.add.reduce(mixed(values ^ _U(2)), keepdims=True)))[0].view(np.int64))


_SETS = "_id long, _tag long, n long, node long, sketch binary"


def dense_sketches(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [dense_sketch(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _described(n: int, sketches):
    """Texts -> their sets' sizes, digests and sketches. An empty set is equal to none of another doc_id: its node is of the doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            values, bounds = shingle_sets(texts, n)
            node = np.array([set_digest(values[bounds[k] : bounds[k + 1]]) for k in range(len(texts))], dtype=np.int64)
            ids = column(batch, "_id").to_numpy(zero_copy_only=False).astype(np.int64)
            node = np.where(np.diff(bounds) > 0, node, mixed(ids.view(_U) ^ _U(0x5BF0363574A1C29D)).view(np.int64))
            yield pa.RecordBatch.from_arrays([column(batch, "_id"), column(batch, "_tag"), pa.array(np.diff(bounds)), pa.array(node), pa.array(sketches(values, bounds), pa.binary())], names=["_id", "_tag", "n", "node", "sketch"])

    return run


def word_keys(values: np.ndarray, bounds: np.ndarray, certain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) for each word of each set's sketches: its own size band's, and the next lower one's if a set there can match."""
    size = np.diff(bounds)
    limits = np.array(starts())
    own = np.searchsorted(limits, size, "right") - 1
    sets, keys = [], []
    for lower in (0, 1):
        band = own - lower
        used = (size > 0) & (band >= 0)
        if lower:
            used &= size <= 4 * (limits[np.maximum(own, 0)] - 1) // 3
        if not used.any():
            continue
        words = np.zeros(len(size), dtype=np.int64)
        differ = np.zeros(len(size), dtype=np.int64)
        for b in np.unique(band[used]):
            words[used & (band == b)], differ[used & (band == b)] = n_words(int(b), certain)
        base = np.cumsum(words) - words
        of = np.repeat(np.arange(len(size)), np.where(used, size, 0))
        mine = values[np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in np.flatnonzero(used)])]
        hashed = mixed(mine ^ _U(0xA24BAED4963EE407))
        word = base[of] + ((hashed >> _U(32)) * words[of].astype(_U) >> _U(32)).astype(np.int64)
        order = np.argsort(word, kind="stable")
        sorted_ = word[order]
        begins = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        filled = sorted_[begins]
        digest = _xor_runs(mixed(mine[order]), begins)
        holder = of[order][begins]
        # words whose toggles cancel out are blank too; nothing is lost by treating them as words with a value
        blank = words - np.bincount(holder, minlength=len(size))
        weak = used & (differ >= 0) & (words - differ <= blank)
        salt = (band[holder].astype(_U) << _U(40)) + (filled - base[holder]).astype(_U)
        sets.append(holder)
        keys.append(mixed(digest + mixed(salt)))
        for k in np.flatnonzero(weak):
            empty = np.setdiff1d(np.arange(words[k]), filled[holder == k] - base[k])
            sets.append(np.full(len(empty), k))
            keys.append(mixed(mixed((_U(int(band[k])) << _U(40)) + empty.astype(_U)) ^ _U(0xFF51AFD7ED558CCD)))
    if not sets:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
    return np.concatenate(sets), np.concatenate(keys)


#: Bytes of a word's key beside its bucket, and of a set's digest.
KEY, NODE = 6, 8


def _keyed_words(n_buckets: int, n: int, keys_of):
    """Texts -> (bucket, keys and digests), by `keys_of` the sets of n-word shingles. Equal sets have equal digests, so of those in a batch one is enough."""

    def flush(nodes: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        node, key = np.concatenate(nodes), np.concatenate(keys)
        bucket = (key % _U(n_buckets)).astype(np.int64)
        by = np.argsort(bucket.astype(np.uint16) if n_buckets <= 65536 else bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        blobs = []
        for b in used:
            rows = by[cuts[b] : cuts[b + 1]]
            blobs.append(key[rows].view(np.uint8).reshape(-1, 8)[:, 8 - KEY :].tobytes() + node[rows].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(blobs, pa.binary())], names=["bucket", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, keys, size, seen = [], [], 0, set()
        for _, texts in text_chunks(batches):
            values, bounds = shingle_sets(texts, n)
            digest = np.array([set_digest(values[bounds[k] : bounds[k + 1]]) for k in range(len(texts))], dtype=np.int64)
            fresh = np.zeros(len(texts), dtype=bool)
            for k, d in enumerate(digest.tolist()):
                fresh[k] = d not in seen
                seen.add(d)
            count = np.diff(bounds)
            sets, key = keys_of(values[np.repeat(fresh, count)], np.concatenate(([0], np.cumsum(np.where(fresh, count, 0)))))
            nodes.append(digest[sets])
            keys.append(key)
            size += len(key)
            if size >= 1_500_000:
                yield from flush(nodes, keys)
                nodes, keys, size, seen = [], [], 0, set()
        if size:
            yield from flush(nodes, keys)

    return run


_SHARED = "key long, node long, size long"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's words -> (word, set, sets with this word) for the words that more than one set has."""
    keys, nodes, buckets = [], [], []
    for batch in batches:
        for bucket, blob in zip(column(batch, "bucket").to_pylist(), column(batch, "words").to_pylist(), strict=True):
            n = len(blob) // (KEY + NODE)
            raw = np.zeros((n, 8), dtype=np.uint8)
            raw[:, 8 - KEY :] = np.frombuffer(blob, np.uint8, KEY * n).reshape(n, KEY)
            keys.append(raw.reshape(-1).view(_U) | _U(bucket))
            nodes.append(np.frombuffer(blob, np.int64, n, KEY * n))
    if not keys:
        return
    key, node = np.concatenate(keys), np.concatenate(nodes)
    # a word that only one row has is in no pair: most are
    order = np.argsort(key, kind="stable")
    key = key[order]
    twice = np.zeros(len(key), dtype=bool)
    twice[1:] = key[1:] == key[:-1]
    twice[:-1] |= twice[1:]
    key, node = key[twice], node[order[twice]]
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new_key = np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1]))
    first = new_key | np.concatenate((np.ones(min(1, len(key)), dtype=bool), node[1:] != node[:-1]))
    group = (np.cumsum(new_key) - 1)[first]
    key, node, size = key[first], node[first], np.bincount(group)[group]
    take = np.flatnonzero(size > 1)
    for at in range(0, len(take), 100_000):
        s = take[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), pa.array(node[s]), pa.array(size[s])], names=["key", "node", "size"])


def may_match(n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes leave it open that sets are so similar."""
    return 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)


def near_by_sketch(n1: np.ndarray, n2: np.ndarray, s1: list[bytes], s2: list[bytes]) -> np.ndarray:
    """Which pairs of sets, of sizes that may match, the Hamming distance of their sketches doesn't rule out."""
    keep = may_match(n1, n2, PERCENT)
    for k in np.flatnonzero(keep):
        x, y = np.frombuffer(s1[k], np.uint64), np.frombuffer(s2[k], np.uint64)
        size = min(len(x), len(y))
        keep[k] = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) * 7 <= n1[k] + n2[k]
    return keep


def _near(near):
    """Pairs with both sketches -> pairs whose sizes and sketches don't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n1, n2 = (column(batch, k).to_numpy() for k in ("n1", "n2"))
                keep = near(n1, n2, column(batch, "s1").to_pylist(), column(batch, "s2").to_pylist())
                yield batch.select(["a", "b", "shared"]).filter(pa.array(keep))

    return run


def rows_by_sketch(n: np.ndarray, sketches: list[bytes]):
    """(x, right) -> those of the sets `right` of a block that sizes and sketches don't rule out beside set x."""
    size = min(map(len, sketches)) // 8
    sketch = np.stack([folded(np.frombuffer(s, np.uint64), size) for s in sketches])

    def near(x: int, right: np.ndarray) -> np.ndarray:
        right = right[may_match(n[right], n[x], PERCENT)]
        far = np.bitwise_count(sketch[right] ^ sketch[x]).sum(axis=1, dtype=np.int64)
        return right[far * 7 <= n[right] + n[x]]

    return near


def _hashed_sets(n: int):
    """(node, text) -> (node, set): 32 bits of each shingle, sorted, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            values, bounds = shingle_sets(texts, n)
            short = (values >> _U(32)).astype(np.uint32)
            sets = [distinct_sorted(short[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array(sets, pa.binary())], names=["node", "set"])

    return run


def _across(rows_near, percent: int):
    """Blocks of the sets that met one set, sorted by block -> for each set and each other class there, the pair that is most similar, if it may be a link.

    What sizes and sketches don't rule out is counted on the sets: of the 32-bit hashes that both have, and as many more as may
    have fallen together within a set, so the count is never less than the shingles in common.
    """

    def block(rows: list[list]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        id_, side, cls, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
        near = rows_near(n, [r[4] for r in rows])
        sets = [np.frombuffer(r[5], np.uint32) for r in rows]
        size = np.array([len(x) for x in sets], dtype=np.int64)
        within = not (side == 1).any()
        a, b = [], []
        for x in np.flatnonzero(side == 0):
            right = near(x, np.flatnonzero((cls != cls[x]) & ((id_ > id_[x]) if within else (side == 1))))
            if not len(right):
                continue
            values = np.concatenate([sets[k] for k in right])
            held = sets[x][np.minimum(np.searchsorted(sets[x], values), size[x] - 1)] == values
            both = np.add.reduceat(held.astype(np.int64), np.cumsum(size[right]) - size[right]) + np.minimum(n[x] - size[x], n[right] - size[right])
            similar = lambda both: 100 * both >= percent * (n[x] + n[right] - both)
            # hashes of both sets that happen to be equal: where the best pair leaves room for some, it is a link
            chance = 2 + (n[x] * n[right] >> 30)
            sure, may = similar(both - chance), similar(both)
            order = np.lexsort((-both / (n[x] + n[right] - both), ~sure, cls[right]))
            order = order[may[order]]
            first = np.diff(cls[right][order], prepend=-1 - abs(cls[right][order][:1])) != 0
            settled = np.isin(cls[right][order], cls[right][order][first & sure[order]])
            chosen = right[order[first | ~settled]]
            a.append(np.full(len(chosen), id_[x]))
            b.append(id_[chosen])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            cols = [column(batch, k).to_pylist() for k in ("rep", "i", "j", "id", "side", "class", "n", "sketch", "set")]
            for rep, i, j, *row in zip(*cols, strict=True):
                if (rep, i, j) != name:
                    yield from block(held)
                    held, name = [], (rep, i, j)
                held.append(row)
        yield from block(held)

    return run


def _verified(n: int, percent: int):
    """Rows sorted by (a, salt, side): the text of a, then those to be held against it -> links.

    Shingles are compared by their bytes here, so that no two hashes that happen to be equal make a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch, texts in text_chunks(batches):
            before = len(held)
            values, bounds = shingle_sets(held + texts, n, exact=True)
            sets = [values[bounds[k] : bounds[k + 1]] for k in range(before)]
            a, salt, side, b = (column(batch, k).to_pylist() for k in ("a", "salt", "side", "b"))
            out_a, out_b = [], []
            for k in range(len(texts)):
                own = values[bounds[before + k] : bounds[before + k + 1]]
                if (a[k], salt[k]) != name:
                    name, sets, held = (a[k], salt[k]), [], []
                if side[k] == 0:
                    sets.append(own)
                    held.append(texts[k])
                elif any(_similar(own, x, percent) for x in sets):
                    out_a.append(a[k])
                    out_b.append(b[k])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y):
        return False
    x, y = (x, y) if len(x) < len(y) else (y, x)
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


class Join:
    """The join of a table of documents with itself, step by step. Equal sets are one node, known by its digest.

    What a set is described by, the keys that similar sets share, and how descriptions rule pairs out can be others' (`minhash`).
    """

    n, percent = N, PERCENT
    sketches = staticmethod(dense_sketches)
    keys = staticmethod(word_keys)
    near, rows_near = staticmethod(near_by_sketch), staticmethod(rows_by_sketch)

    def __init__(self, documents: DataFrame, certain: bool = False):
        """`certain`: as many sketch words at every size as make sure that similar sets share one; more disk for large sets."""
        if certain:
            self.keys = partial(word_keys, certain=True)
        self.docs = _keyed(documents.select("doc_id", "text"))
        self.spark = documents.sparkSession
        self.sets = Written(self.docs.mapInArrow(_described(self.n, self.sketches), _SETS), "jaccard-sets").df
        rows = self.sets.groupBy("node").agg(F.min(F.struct("_id", "_tag")).alias("row"), F.max("_id").alias("last"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        #: Each distinct set: its smallest and largest _id, and the row whose text stands for it.
        self.nodes = Written(rows.select("node", "n", "sketch", "row._id", "row._tag", "last"), "jaccard-nodes").df

    def n_keys(self) -> int:
        """About how many keys all sets have, at most."""
        return self.nodes.agg(F.sum("n")).first()[0] or 0

    def shared(self) -> Written:
        """(key, node, size): the sketch words that more than one set has."""
        parts = max(parallelism(self.spark), self.n_keys() // 1_500_000)
        n_buckets = max(1, min(60_000, 4 * parts))
        words = self.docs.select("text").mapInArrow(_keyed_words(n_buckets, self.n, self.keys), "bucket long, words binary")
        return Written(words.repartition(parts, "bucket").mapInArrow(_shared, _SHARED), "jaccard-words")

    def met(self) -> Written:
        """(rep, node, shared): sets, and the one of each of their words that stands for its group: the set with most company in all its words.

        The original of a group of near copies has most words in common with others, so most words of the group agree on it.
        """
        words = self.shared()
        company = words.df.groupBy("node").agg(F.sum("size").alias("company"))
        reps = words.df.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("rep"))
        pairs = words.df.join(reps, "key").where("node != rep").groupBy("rep", "node").agg(F.count(F.lit(1)).alias("shared"))
        out = Written(pairs, "jaccard-met")
        words.drop()
        return out

    def sized(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, shared) that sizes and sketches leave."""
        a = self.nodes.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("sketch").alias("s1"))
        b = self.nodes.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("s2"))
        return pairs.join(a, "a").join(b, "b").mapInArrow(_near(self.near), "a long, b long, shared long")

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of the given nodes, each once."""
        needed = self.nodes.join(nodes.distinct(), "node", "left_semi").select("node", "_id", "_tag")
        return self.docs.join(needed, ["_id", "_tag"]).dropDuplicates(["node"]).select("node", "text")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose texts are similar. A set that many are held against is dealt out over salts."""
        held = Written(pairs.select("a", "b").distinct(), "jaccard-pairs")
        salts = held.df.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 2000).cast("int").alias("salts"))
        left = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("a").alias("b"))
        right = held.df.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"), "b")
        rows = left.unionByName(right)
        texts = self.texts(rows.select(F.col("b").alias("node"))).withColumnRenamed("node", "b")
        dealt = rows.join(texts, "b").repartition(parallelism(self.spark), "a", "salt").sortWithinPartitions("a", "salt", "side")
        out = Written(dealt.mapInArrow(_verified(self.n, self.percent), "a long, b long"), "jaccard-links")
        held.drop()
        return out.df

    def same_id(self) -> DataFrame:
        """(a, b): sets of rows that share a doc_id."""
        rows = self.sets.groupBy("_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").select("_id", "a")
        return self.sets.join(rows, "_id").where("node != a").select("a", F.col("node").alias("b"))

    def labels(self) -> DataFrame:
        """(node, component) of every set with a link; the component is named by one of its nodes."""
        seen = self.met()
        near = Written(self.sized(seen.df.select(F.col("rep").alias("a"), F.col("node").alias("b"), "shared")), "jaccard-near")
        # first, for each set the one that shares most words with it; then whatever is not of the same class by then
        best = near.df.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
        labels = components(self.verify(best).unionByName(self.same_id()))
        labels = united(labels, self.verify(self.unlike(near.df, labels)))
        near.drop()
        labels = united(labels, self.verify(self.rest(seen.df, labels)))
        seen.drop()
        return labels

    def classes(self) -> DataFrame:
        """(node, component) of every set whose class has more than one doc_id; the component is its smallest _id."""
        labels = self.labels().select("node", F.col("component").alias("class"))
        named = self.nodes.join(labels, "node", "left").select("node", F.coalesce("class", "node").alias("class"), "_id", "last")
        least = named.groupBy("class").agg(F.min("_id").alias("component"), F.max("last").alias("last")).where("component != last").select("class", "component")
        return Written(named.join(least, "class").select("node", "component"), "jaccard-classes").df

    def unlike(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs that aren't of one class yet."""
        a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        both = pairs.join(a, "a", "left").join(b, "b", "left")
        return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)

    def rest(self, seen: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs of different classes among the sets that met one set, in blocks of about BLOCK sets, or SHINGLES shingles of them, by as many."""
        members = seen.select("rep", F.col("node").alias("id")).unionByName(seen.select("rep", F.col("rep").alias("id")).distinct())
        named = members.join(labels, F.col("id") == F.col("node"), "left").select("rep", "id", F.coalesce("component", "id").alias("class"))
        sized = named.join(self.nodes.select(F.col("node").alias("id"), "n", "sketch"), "id")
        blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / SHINGLES)).cast("int")
        open_ = sized.groupBy("rep").agg(F.count(F.lit(1)).alias("size"), F.min("class").alias("lo"), F.max("class").alias("hi"), blocks.alias("blocks")).where("lo != hi and size > 2").select("rep", "blocks")
        full = Written(sized.join(open_, "rep"), "jaccard-open")
        sets = Written(self.texts(full.df.select(F.col("id").alias("node"))).mapInArrow(_hashed_sets(self.n), "node long, set binary"), "jaccard-open-sets")
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        with_sets = full.df.join(sets.df.withColumnRenamed("node", "id"), "id")
        dealt = with_sets.select("rep", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), own.alias("own"), "id", "class", "n", "sketch", "set")
        dealt = dealt.select("rep", F.least("x", "own").alias("i"), F.greatest("x", "own").alias("j"), "id", F.when(F.col("own") > F.col("x"), 1).otherwise(0).alias("side"), "class", "n", "sketch", "set")
        return dealt.repartition(parallelism(self.spark), "rep", "i", "j").sortWithinPartitions("rep", "i", "j").mapInArrow(_across(self.rows_near, self.percent), "a long, b long")


def similar(documents: DataFrame, certain: bool = False, by: type[Join] = Join) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: the smallest doc_id that it reaches by links, itself included."""
    join = by(documents, certain)
    out = join.sets.join(join.classes(), "node", "left")
    id_ = lambda c: F.when(c != NULL_ID, c)
    return out.select(id_(F.col("_id")).alias("doc_id"), F.col("n").alias("n_shingles"), id_(F.coalesce("component", "_id")).alias("component_id"))


def one_of_each(documents: DataFrame, by: type[Join] = Join) -> DataFrame:
    """The documents, with all their columns, without those that a document with a smaller doc_id stands for.

    Of rows that share a doc_id all stay, or none.
    """
    join = by(documents)
    gone = free_name(documents, "_gone")
    ids = join.sets.join(join.classes(), "node").where("_id != component").select(F.col("_id").alias(gone)).distinct()
    return documents.join(ids, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)) == F.col(gone), "left_anti")


#: Shared shingles and a closure over links; for tables in which each doc_id stands once.
SQL = r"""WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM t),
x AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.g)"""
