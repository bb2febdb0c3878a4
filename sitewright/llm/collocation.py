"""Phrase collocation mining: phrases of 2 to 4 words that stand together more often than their parts would, per language.

Counting is level by level. Words are counted first; texts then become sequences of the numbers of frequent words, broken where a
piece ends or a rare word stands, as no candidate reaches across (Apriori: each part of a frequent phrase is frequent). A scan of
the sequences gathers the pairs of frequent neighbours that may be candidates. From there on each level's candidates are dealt
out over tries of at most TRIE phrases; a trie is a double array over the digits of word numbers, built in a task and broadcast.
All positions of a sequence walk it at once, digit by digit; the states that accept are counted by bincount, and the sums of all
tasks are added up by shards of candidates. The same walk shows where a candidate of the level goes on: phrases one word longer
whose both parts are candidates are gathered with their sums, and those that reach the least count are the next level's.

Words are told apart by 64-bit hashes of language and word while they are counted; a hash that two words share is found (the least
and the greatest word of each hash are compared) and other hashes are taken. Scores are decimals of 38 digits, floored exactly.
The number of scans grows with the number of candidates, one more for each TRIE of them, over sequences of four bytes a word.

Defined cases: a null text is empty; a null lang is `und`, as are rows that say so; repeated rows count each; no words, no rows;
ties in score and count go by the phrase's UTF-8 bytes; an empty table gives no rows; columns other than text and lang are not
looked at. A text is held by one task, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, parallelism
from .textnp import _U, byte_table, column, mixed, text_chunks, words_of

LONGEST, LEAST, TOP = 4, 30, 2000
#: Candidates in one trie: a proven bound of what is broadcast at once (some 50 MB at most), as are words in one dictionary (24 MB).
TRIE, DICTIONARY = 250_000, 2_000_000
BREAKS = byte_table({*b".,;:!?", *range(0x0A, 0x0E)})
WORDS = ~(BREAKS | byte_table({0x20, 0x09}))
#: Keys that a task gathers before it sums them up and sends them on.
GATHERED = 4_000_000


def _language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _tokens(batches: Iterator[pa.RecordBatch], seed: int):
    """(words, languages, language per word, key per word) of some texts at a time. The key is of the language and the word, and not 0."""
    for batch, texts in text_chunks(batches):
        found = words_of(texts, WORDS)
        langs = column(batch, "lang").to_pylist()
        number = {x: k for k, x in enumerate(dict.fromkeys(langs))}
        own = np.repeat(np.array([number[x] for x in langs], dtype=np.int64), np.diff(found.bounds))
        salts = np.array([_language_hash(x) for x in number], dtype=_U)
        yield found, list(number), own, np.maximum(mixed(found.hashes(seed) ^ salts[own]), _U(1))


def _counted(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, langs, own, keys in _tokens(batches, seed):
            key, first, n = np.unique(keys, return_index=True, return_counts=True)
            raw = found.buf.tobytes()
            words = [raw[a:b] for a, b in zip(found.starts[first].tolist(), found.ends[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array([langs[k] for k in own[first]], pa.string()), pa.array(words, pa.binary()), pa.array(n)], names=["key", "lang", "word", "n"])

    return run


def _sequence(found, keys: np.ndarray) -> np.ndarray:
    """The keys of a text's words one after another, with a 0 wherever a piece or a text ends between two of them."""
    ended = np.concatenate(([0], np.cumsum(BREAKS[found.buf], dtype=np.int64)))
    apart = np.zeros(len(keys), dtype=np.int64)
    apart[1:] = ended[found.starts[1:]] != ended[found.ends[:-1]]
    at = np.arange(len(keys)) + np.cumsum(apart)
    out = np.zeros(int(at[-1]) + 1 if len(at) else 0, dtype=_U)
    out[at] = keys
    return out


def _numbered(keys: np.ndarray, known: np.ndarray, first: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    return np.where(known[at] == keys, first + at, -1).astype(np.int32) if len(known) else np.full(len(keys), -1, np.int32)


def _packed(numbers: np.ndarray) -> bytes:
    """Only words with a numbered neighbour, and one -1 at each break."""
    held = numbers >= 0
    beside = np.zeros(len(held), dtype=bool)
    beside[1:] = held[:-1]
    beside[:-1] |= held[1:]
    held &= beside
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    return np.where(held, numbers, -1)[held | np.concatenate((begins[1:], [False]))].tobytes()


def _encoded(seed: int, known, first: int):
    """Texts -> sequences of word numbers, with the one dictionary there is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, _, _, keys in _tokens(batches, seed):
            yield pa.RecordBatch.from_arrays([pa.array([_packed(_numbered(_sequence(found, keys), known.value, first))], pa.binary())], names=["ids"])

    return run


def _hashed(seed: int):
    """Texts -> sequences of keys, for dictionaries that are looked at one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, _, _, keys in _tokens(batches, seed):
            keys = _sequence(found, keys)
            yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([np.full(len(keys), -1, np.int32).tobytes()], pa.binary())], names=["keys", "ids"])

    return run


def _looked_up(known, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, ids in zip(column(batch, "keys").to_pylist(), column(batch, "ids").to_pylist(), strict=True):
                out = np.maximum(np.frombuffer(ids, np.int32), _numbered(np.frombuffer(keys, _U), known.value, first))
                yield pa.RecordBatch.from_arrays([pa.array([keys], pa.binary()), pa.array([out.tobytes()], pa.binary())], names=["keys", "ids"])

    return run


def _all_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_packed(np.frombuffer(x, np.int32)) for x in column(batch, "ids").to_pylist()], pa.binary())], names=["ids"])


class _Gatherer:
    """(a, b) pairs of 32-bit numbers, summed up in a task and sent on by bucket as 8-byte keys and 4-byte sums."""

    def __init__(self, n_buckets: int):
        self.n_buckets, self.held, self.size = n_buckets, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((a.astype(np.int64) << 32) | b.astype(np.int64))
        self.size += len(a)
        if self.size >= GATHERED:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(self.held or [np.zeros(0, np.int64)]), return_counts=True)
        self.held, self.size = [], 0
        bucket = (mixed(keys.view(_U)) % _U(self.n_buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(self.n_buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        blobs = [keys[by[cuts[k] : cuts[k + 1]]].tobytes() + n[by[cuts[k] : cuts[k + 1]]].astype(np.uint32).tobytes() for k in used]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(blobs, pa.binary())], names=["bucket", "sums"])


def _frequent(least: int):
    """A bucket's sums -> (a, b) of those that reach the least count. Rows come sorted by bucket."""

    def summed(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        sizes = [len(x) // 12 for x in blobs]
        keys = np.concatenate([np.frombuffer(x, np.int64, n) for x, n in zip(blobs, sizes, strict=True)])
        sums = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(blobs, sizes, strict=True)]).astype(np.int64)
        by = np.argsort(keys, kind="stable")
        begins = np.flatnonzero(np.diff(keys[by], prepend=keys[by[0]] - 1))
        often = keys[by[begins]][np.add.reduceat(sums[by], begins) >= least]
        yield pa.RecordBatch.from_arrays([pa.array((often >> 32).astype(np.int32)), pa.array((often & 0xFFFFFFFF).astype(np.int32))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            for bucket, blob in zip(column(batch, "bucket").to_pylist(), column(batch, "sums").to_pylist(), strict=True):
                if bucket != name and held:
                    yield from summed(held)
                    held = []
                name = bucket
                held.append(blob)
        if held:
            yield from summed(held)

    return run


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in column(batch, "ids").to_pylist():
            yield np.frombuffer(x, np.int32)


def _pairs(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Gatherer(n_buckets)
        for s in _sequences(batches):
            both = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
            yield from gathered.add(s[both], s[both + 1])
        yield from gathered.flush()

    return run


class Trie:
    """A double array over phrases of k word numbers, each number as so many digits of eight bits.

    The child of the node in slot s by digit d is in slot base[s] + d if check there is s. Phrase j ends in a slot whose `ends` is j.
    """

    def __init__(self, phrases: np.ndarray):
        """`phrases`: a row of word numbers each, sorted and distinct."""
        self.k = phrases.shape[1]
        self.size = len(phrases)
        self.alphabet, codes = np.unique(phrases, return_inverse=True)
        self.digits = max(1, ((len(self.alphabet) - 1).bit_length() + 7) // 8)
        codes = codes.reshape(phrases.shape)
        digits = np.stack([(codes >> (8 * (self.digits - 1 - d))) & 255 for d in range(self.digits)], axis=2).reshape(self.size, -1)
        parents, by_digit, children = [], [], []
        node, count = np.zeros(self.size, dtype=np.int64), 1
        for d in range(digits.shape[1]):
            edge = node * 256 + digits[:, d]
            first = np.diff(edge, prepend=-1) != 0
            parents.append(node[first])
            by_digit.append(digits[first, d])
            node = count + np.cumsum(first) - 1
            children.append(node[first])
            count += int(first.sum())
        parent, digit, child = (np.concatenate(x) for x in (parents, by_digit, children))
        base = self._bases(parent, digit, count)
        slot = np.zeros(count, dtype=np.int64)
        slot[child] = base[parent] + digit
        length = int(max(slot.max(), base.max()) + 257)
        self.base, self.check, self.ends = np.zeros(length, np.int32), np.full(length, -1, np.int32), np.full(length, -1, np.int32)
        self.base[slot] = base
        self.check[slot[child]] = slot[parent]
        self.ends[slot[node]] = np.arange(self.size)

    @staticmethod
    def _bases(parent: np.ndarray, digit: np.ndarray, count: int) -> np.ndarray:
        """A base for each node, so that no two children share a slot; slot 0 is the root's. Nodes with most children come first, single children fill the gaps."""
        by = np.argsort(parent, kind="stable")
        digit = digit[by]
        bounds = np.searchsorted(parent[by], np.arange(count + 1))
        fan = np.diff(bounds)
        base, used, at = np.zeros(count, dtype=np.int64), np.zeros(2 * len(digit) + 4096, dtype=bool), 1
        ahead = np.arange(64)[:, None]
        for node in np.argsort(-fan, kind="stable")[: int((fan > 1).sum())]:
            own = digit[bounds[node] : bounds[node + 1]]
            while True:
                if at + 512 > len(used):
                    used = np.concatenate((used, np.zeros(len(used), dtype=bool)))
                free = ~used[at + ahead + own].any(axis=1)
                if free.any():
                    break
                at += 64
            base[node] = at + int(free.argmax())
            used[base[node] + own] = True
        single = np.flatnonzero(fan == 1)
        used = np.concatenate((used, np.zeros(len(single) + 256, dtype=bool)))
        gaps = np.flatnonzero(~used[256:])[: len(single)] + 256
        base[single] = gaps - digit[bounds[single]]
        return base

    def walk(self, numbers: np.ndarray) -> np.ndarray:
        """For each position the phrase that begins there, or -1: all positions take each step at once."""
        out = np.full(len(numbers), -1, dtype=np.int64)
        code = np.minimum(np.searchsorted(self.alphabet, numbers), len(self.alphabet) - 1)
        known = self.alphabet[code] == numbers
        at = np.flatnonzero(known[: len(numbers) - self.k + 1]) if len(numbers) >= self.k else np.zeros(0, np.int64)
        state = np.zeros(len(at), dtype=np.int64)
        for word in range(self.k):
            held = known[at + word]
            at, state = at[held], state[held]
            own = code[at + word]
            for d in range(self.digits - 1, -1, -1):
                to = self.base[state] + ((own >> (8 * d)) & 255)
                held = self.check[to] == state
                at, state, own = at[held], to[held], own[held]
        out[at] = self.ends[state]
        return out


#: Candidates whose counts travel as one shard.
SHARD = 4096


def _walked(trie, n_buckets: int, whole: bool, last: bool):
    """Sequences -> shards of the phrases' counts, and (phrase, next word) for the next level.

    `whole`: the trie holds all phrases of its level, so that the second part of a longer phrase can be looked up in it as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, gathered = trie.value, _Gatherer(n_buckets)
        counts = np.zeros(own.size, dtype=np.int64)
        for s in _sequences(batches):
            found = own.walk(s)
            counts += np.bincount(found[found >= 0], minlength=own.size)
            if not last:
                at = np.flatnonzero(found[: -own.k] >= 0) if len(found) > own.k else np.zeros(0, np.int64)
                at = at[(s[at + own.k] >= 0) & ((found[at + 1] >= 0) if whole else True)]
                for part in gathered.add(found[at], s[at + own.k]):
                    yield part
        if not last:
            yield from gathered.flush()
        starts = [k for k in range(0, own.size, SHARD) if counts[k : k + SHARD].any()]
        yield pa.RecordBatch.from_arrays([pa.array([-1 - k // SHARD for k in starts], pa.int64()), pa.array([counts[k : k + SHARD].tobytes() for k in starts], pa.binary())], names=["bucket", "sums"])

    return run


def _summed_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of counts, sorted by shard -> (number, n)."""

    def done(shard: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)) + (-1 - shard) * SHARD), pa.array(total)], names=["number", "n"])

    name, total = None, None
    for batch in batches:
        for shard, blob in zip(column(batch, "bucket").to_pylist(), column(batch, "sums").to_pylist(), strict=True):
            if shard != name and total is not None:
                yield done(name, total)
                total = None
            own = np.frombuffer(blob, np.int64)
            name, total = shard, own.copy() if total is None else total + own
    if total is not None:
        yield done(name, total)


_TRIE = "trie long, alphabet binary, base binary, check binary, ends binary, size long, words binary"


def _built(k: int):
    """Phrases sorted by trie -> each trie's double array, and its phrases in their order."""

    def one(trie: int, rows: list) -> pa.RecordBatch:
        phrases = np.unique(np.array(rows, dtype=np.int32).reshape(-1, k), axis=0)
        own = Trie(phrases)
        return pa.RecordBatch.from_arrays([pa.array([trie]), *(pa.array([getattr(own, x).tobytes()], pa.binary()) for x in ("alphabet", "base", "check", "ends")), pa.array([own.size]), pa.array([phrases.tobytes()], pa.binary())], names=[x.split()[0] for x in _TRIE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            for trie, words in zip(column(batch, "trie").to_pylist(), column(batch, "words").to_pylist(), strict=True):
                if trie != name and held:
                    yield one(name, held)
                    held = []
                name = trie
                held.append(words)
        if held:
            yield one(name, held)

    return run


def _opened(row, k: int) -> Trie:
    out = Trie.__new__(Trie)
    out.k, out.size = k, row["size"]
    out.alphabet, out.base, out.check, out.ends = (np.frombuffer(row[x], np.int32) for x in ("alphabet", "base", "check", "ends"))
    out.digits = max(1, ((len(out.alphabet) - 1).bit_length() + 7) // 8)
    return out


def _listed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trie, blob in zip(column(batch, "trie").to_pylist(), column(batch, "words").to_pylist(), strict=True):
                flat = np.frombuffer(blob, np.int32)
                for at in range(0, len(flat) // k, 50_000):
                    own = flat[at * k : (at + 50_000) * k]
                    n = len(own) // k
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, trie)), pa.array(np.arange(at, at + n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(own))], names=["trie", "number", "words"])

    return run


class Phrases:
    """Counts of all frequent phrases of a table of documents, per language."""

    def __init__(self, documents: DataFrame, least: int = LEAST, longest: int = LONGEST):
        self.least, self.longest, self.spark = least, longest, documents.sparkSession
        self.docs = documents.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
        self.parts = parallelism(self.spark)
        self.n_buckets = 8 * self.parts
        for seed in range(100):
            # each key's least and greatest word: where they differ, two words share the key
            counts = self.docs.mapInArrow(_counted(seed), "key long, lang string, word binary, n long").groupBy("key")
            own = F.struct("lang", "word")
            words = Written(counts.agg(F.sum("n").alias("n"), F.min(own).alias("own"), F.max(own).alias("other")), "collocation-words")
            if words.df.where("own != other").isEmpty():
                break
            words.drop()
        self.seed, self.words = seed, words.df.select("key", "own.*", "n")
        self.totals = self.words.groupBy("lang").agg(F.sum("n").alias("n"))

    def numbered(self) -> tuple[DataFrame, int]:
        """(id, lang, word, n) of the frequent words: dictionaries of at most DICTIONARY words, by ranges of keys; and how many there are."""
        often = self.words.where(F.col("n") >= self.least)
        count = often.count()
        blocks = 1
        while count / blocks > DICTIONARY / 2:  # keys are spread evenly: a block of twice the mean has no chance
            blocks *= 2
        block = F.shiftrightunsigned("key", 64 - (blocks.bit_length() - 1)).cast("int") if blocks > 1 else F.lit(0)
        # by unsigned key, as the tasks look them up
        rank = F.row_number().over(Window.partitionBy("block").orderBy(F.col("key") < 0, "key")) - 1
        held = Written(often.withColumn("block", block).withColumn("rank", rank), "collocation-dictionary").df
        first = {r["block"]: r["size"] for r in held.groupBy("block").agg(F.count(F.lit(1)).alias("size")).collect()}
        self.first, so_far = {}, 0
        for b in range(blocks):
            self.first[b] = so_far
            so_far += first.get(b, 0)
        starts = F.create_map(*[x for b, n in self.first.items() for x in (F.lit(b), F.lit(n))])
        self.dictionary = held
        return held.select((F.col("rank") + starts[F.col("block")]).cast("int").alias("id"), "lang", "word", "n"), count

    def sequences(self) -> DataFrame:
        """The texts as sequences of word numbers."""
        context, out = self.spark.sparkContext, None
        for b, first in self.first.items():
            keys = self.dictionary.where(F.col("block") == b).select("key").toArrow().column("key").to_numpy().view(_U)
            known = context.broadcast(np.sort(keys))
            if len(self.first) == 1:
                out = Written(self.docs.mapInArrow(_encoded(self.seed, known, first), "ids binary"), "collocation-sequences")
            else:
                before = out or Written(self.docs.mapInArrow(_hashed(self.seed), "keys binary, ids binary"), "collocation-keys")
                out = Written(before.df.mapInArrow(_looked_up(known, first), "keys binary, ids binary"), "collocation-keys")
                before.drop()
            known.destroy()
        if len(self.first) == 1:
            return out.df
        packed = Written(out.df.mapInArrow(_all_packed, "ids binary"), "collocation-sequences")
        out.drop()
        return packed.df

    def frequent(self, gathered: DataFrame) -> DataFrame:
        dealt = gathered.repartition(self.parts, "bucket").sortWithinPartitions("bucket")
        return dealt.mapInArrow(_frequent(self.least), "a int, b int")

    def level(self, k: int, candidates: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(words, n) of a level's candidates by their tries, and the (words) that may be the next level's."""
        count = candidates.count()
        if not count:
            return candidates.select("words", F.lit(0).cast("long").alias("n")), None
        n_tries = -(-count // TRIE)
        dealt = candidates.withColumn("trie", F.pmod(F.xxhash64("words"), F.lit(n_tries))).repartition(n_tries, "trie").sortWithinPartitions("trie")
        tries = Written(dealt.select("trie", "words").mapInArrow(_built(k), _TRIE), "collocation-tries").df
        listed = Written(tries.select("trie", "words").mapInArrow(_listed(k), "trie long, number long, words array<int>"), "collocation-phrases").df
        counted, longer = [], []
        for trie in range(n_tries):
            rows = tries.where(F.col("trie") == trie).select("alphabet", "base", "check", "ends", "size").toArrow().to_pylist()
            if not rows:
                continue
            shared = self.spark.sparkContext.broadcast(_opened(rows[0], k))
            found = Written(sequences.mapInArrow(_walked(shared, self.n_buckets, n_tries == 1, k == self.longest), "bucket long, sums binary"), "collocation-walked")
            shards = found.df.where("bucket < 0").repartition(self.parts, "bucket").sortWithinPartitions("bucket")
            counted.append(Written(shards.mapInArrow(_summed_shards, "number long, n long").withColumn("trie", F.lit(trie).cast("long")), "collocation-counts").df)
            if k < self.longest:
                longer.append(Written(self.frequent(found.df.where("bucket >= 0")).withColumn("trie", F.lit(trie).cast("long")), "collocation-longer").df)
            found.drop()
            shared.destroy()
        counts = _union(counted)
        out = listed.join(counts, ["trie", "number"]).select("words", "n")
        if k == self.longest:
            return out, None
        more = _union(longer).withColumnRenamed("a", "number").join(listed, ["trie", "number"])
        return out, more.select(F.concat("words", F.array("b")).alias("words"))

    def counts(self) -> DataFrame:
        """lang, words (array of word numbers), n of every phrase of 1 to `longest` words that stands `least` times."""
        words, count = self.numbered()
        self.numbers = Written(words, "collocation-numbers").df
        levels = [self.numbers.select(F.array("id").alias("words"), "n")]
        if count and self.longest > 1:
            sequences = self.sequences()
            pairs = sequences.mapInArrow(_pairs(self.n_buckets), "bucket long, sums binary")
            candidates = self.frequent(pairs).select(F.array("a", "b").alias("words"))
            for k in range(2, self.longest + 1):
                own, candidates = self.level(k, Written(candidates, "collocation-candidates").df, sequences)
                levels.append(own.where(F.col("n") >= self.least))
                if candidates is None:
                    break
        return Written(_union(levels), "collocation-frequent").df


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _wide(x):
    return x.cast("decimal(38,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """(words, n) of frequent phrases -> words, a, l, r, score of those of two words and more, by their lowest-scoring cut, that no longer one holds for the most part."""
    own = phrases.where(F.size("words") > 1).withColumnRenamed("n", "a")
    cut = own.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.withColumn("first", F.slice("words", F.lit(1), F.col("k"))).withColumn("rest", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")))
    l, r = phrases.select(F.col("words").alias("first"), F.col("n").alias("l")), phrases.select(F.col("words").alias("rest"), F.col("n").alias("r"))  # noqa: E741
    both = cut.join(l, "first").join(r, "rest")
    # `div` of decimals is exact: the products may pass 64 bits
    score = F.expr("(cast(2000000 as decimal(38,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    least = both.withColumn("score", score).groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # where a longer phrase holds this one, so does one that is a word longer, and as often at least
    size = F.size("words")
    inside = own.where(size > 2).select(F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"), F.col("a").alias("longer"))
    longest = inside.groupBy("words").agg(F.max("longer").alias("longer"))
    free = least.join(longest, "words", "left").where(F.col("longer").isNull() | (_wide(F.col("longer")) * 100 < _wide(F.col("a")) * 80))
    return free.select("words", "a", "cut.l", "cut.r", "cut.score")


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    found = Phrases(documents, least)
    kept = Written(scored(found.counts()), "collocation-scored").df.withColumn("row", F.monotonically_increasing_id())
    kept = Written(kept, "collocation-rows").df
    words = kept.select("row", F.posexplode("words").alias("at", "id")).join(found.numbers.select("id", "lang", "word"), "id")
    spoken = words.groupBy("row").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("own"))
    spoken = spoken.select("row", "lang", F.array_join(F.transform("own", lambda x: x["word"].cast("string")), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = kept.join(spoken, "row").withColumn("rank", rank).where(F.col("rank") <= top)
    return first.join(found.totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
c AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g),
n AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang),
a AS (SELECT * FROM c WHERE f >= 30),
u AS (SELECT lang, k, g, f, unnest(range(1, k)) AS j FROM a WHERE k > 1),
q AS (SELECT lang, g, f, j, g[1:j] AS h, g[j + 1:k] AS t FROM u),
s AS (SELECT q.lang, q.g, q.f AS a, l.f AS l, r.f AS r, j, CAST(2000000 AS HUGEINT) * q.f // (l.f + r.f) AS score
  FROM q JOIN a l ON l.lang = q.lang AND l.g = q.h JOIN a r ON r.lang = q.lang AND r.g = q.t),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
y AS (SELECT lang, f, g, k, unnest(range(2, k)) AS size FROM a WHERE k > 2),
v AS (SELECT lang, f, unnest(list_transform(range(1, k - size + 2), lambda i: g[i:i + size - 1])) AS g FROM y),
o AS (SELECT lang, g, max(f) AS f FROM v GROUP BY lang, g),
z AS (SELECT m.lang, array_to_string(m.g, ' ') AS phrase, a, l, r, score FROM m LEFT JOIN o USING (lang, g) WHERE o.f IS NULL OR 100 * o.f < 80 * a)
SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM z JOIN n ON n.lang = z.lang QUALIFY rank <= 2000"""
