"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum, over all ways
to cut it into pieces, of the product of their probabilities; a forward pass computes it, for all languages and for many words
at once. A text's score is the sum over its words, and a word is scored once per task. Piece probabilities are learned by
expectation-maximisation, from the word counts of a sample of labelled documents.

Words are runs of letters of the lower-cased text; every byte that no piece covers counts as a piece of a small fixed probability.

The sample has about `a_language` documents per language (all, if there are fewer); this bounds what is learned from, not what is
scored. Every language with a document is learned. Models are broadcast for LANGUAGES languages at a time, and the best of a
text's earlier ones travels along with it, so memory doesn't grow with their number.

The vocabulary is a sentencepiece model, read on the driver from `vocabulary`, a parameter.

Defined cases: a null text, or one without a letter, is `und` with score 0, and so is everything when no language can be learned;
a null lang or text teaches nothing; words of any length are scored whole (over LONGEST bytes, in windows that hand on the forward
probabilities that pieces across their border need; learning alone cuts such words); equal scores go to the language that sorts
first; repeated rows get equal results each; an empty table gives no rows; columns other than doc_id, text
and lang are not looked at.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, id_crc, write_out
from .textnp import _BYTE, _U, _power_tables, as_int64, byte_table, column, mixed, text_chunks, words_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LETTERS = byte_table({*range(0x61, 0x7B), *range(0x80, 0x100)})
LONGEST = 40
LANGUAGES, A_LANGUAGE, ROUNDS = 128, 3000, 3
#: Numbers in memory at a time: of forward probabilities, and of words' scores.
CELLS = 8_000_000
BYTE_P = 1e-7
UNDETERMINED = "und"


def pieces(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces in UTF-8, a word's begin as a blank; those that no lower-cased word can hold are left out."""
    import sentencepiece

    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}: name a sentencepiece model that the driver can read")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(k).replace("▁", " ") for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
    return sorted(p.encode() for p in found if p and p == p.lower() and all(c.isalpha() for c in p[p[0] == " " :]))


class Pieces:
    """Pieces by hash."""

    def __init__(self, raw: list[bytes]):
        hashes = np.array([_hash(np.frombuffer(p, np.uint8)[None, :], 0, len(p))[0] for p in raw], dtype=_U)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.seen = np.zeros(1 << 18, dtype=bool)
        self.seen[hashes & _U((1 << 18) - 1)] = True
        self.size = len(raw)
        self.lengths = sorted({len(p) for p in raw}, reverse=True)
        self.longest = max(self.lengths, default=0)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashes that are pieces, the pieces)."""
        maybe = np.flatnonzero(self.seen[hashes & _U((1 << 18) - 1)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), self.size - 1)
        hit = self.hashes[at] == hashes[maybe]
        return maybe[hit], self.order[at[hit]]


def _prefix_sums(rows: np.ndarray) -> np.ndarray:
    power, _ = _power_tables(256)
    sums = np.zeros((rows.shape[0], rows.shape[1] + 1), dtype=_U)
    np.cumsum(_BYTE[rows] * power[: rows.shape[1]], axis=1, out=sums[:, 1:])
    return sums


def _hash(rows: np.ndarray, a: int, b: int, sums: np.ndarray | None = None) -> np.ndarray:
    sums = _prefix_sums(rows) if sums is None else sums
    return mixed((sums[:, b] - sums[:, a]) * _power_tables(256)[1][a] + _U(b - a))


def _lattice(vocabulary: Pieces, rows: np.ndarray, before: int = 0) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, words, pieces) of all pieces in words of one length that end after the first `before` bytes, by end."""
    sums, out = _prefix_sums(rows), []
    for b in range(before + 1, rows.shape[1] + 1):
        for a in (b - n for n in vocabulary.lengths if n <= b):
            words, found = vocabulary.find(_hash(rows, a, b, sums))
            if len(words):
                out.append((a, b, words, found))
    return out


def _forward(lattice, n: int, length: int, p: np.ndarray) -> np.ndarray:
    """alpha[end, word, language]: the probability of a word's first bytes, over all segmentations."""
    alpha = np.zeros((length + 1, n, p.shape[1]))
    alpha[0] = 1.0
    done = 0
    for a, b, words, found in lattice:
        while done < b:
            done += 1
            alpha[done] = alpha[done - 1] * BYTE_P
        alpha[b, words] += alpha[a, words] * p[found]
    while done < length:
        done += 1
        alpha[done] = alpha[done - 1] * BYTE_P
    return alpha


def _by_length(words: list[bytes], n_languages: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes) of words of one length, with the blank that begins a word; at most 20,000, and CELLS probabilities, at a time."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    for n in np.unique(lengths):
        where = np.flatnonzero(lengths == n)
        step = max(1, min(20_000, CELLS // ((int(n) + 2) * max(1, n_languages))))
        for at in range(0, len(where), step):
            own = where[at : at + step]
            rows = np.frombuffer(b"".join(b" " + words[k] for k in own), np.uint8).reshape(len(own), -1)
            yield own, rows


def log_likelihoods(vocabulary: Pieces, words: list[bytes], p: np.ndarray) -> np.ndarray:
    """log P(word | language)."""
    out = np.empty((len(words), p.shape[1]))
    short = np.array([k for k, w in enumerate(words) if len(w) <= LONGEST], dtype=np.int64)
    for own, rows in _by_length([words[k] for k in short], p.shape[1]):
        out[short[own]] = np.log(np.maximum(_forward(_lattice(vocabulary, rows), len(own), rows.shape[1], p)[-1], 1e-300))
    for k, w in enumerate(words):
        if len(w) > LONGEST:
            out[k] = _long(vocabulary, w, p)
    return out


def _long(vocabulary: Pieces, word: bytes, p: np.ndarray) -> np.ndarray:
    """log P of one word of any length: forward in windows, each with the bytes before it that a piece may begin in.

    The forward probabilities of these bytes are handed on, over the last of them, whose logarithm is kept.
    """
    before, raw = vocabulary.longest, b" " + word
    n = -(-len(raw) // LONGEST)
    padded = np.zeros(before + n * LONGEST, dtype=np.uint8)
    padded[before : before + len(raw)] = np.frombuffer(raw, np.uint8)
    alpha = np.zeros((before + LONGEST + 1, p.shape[1]))
    alpha[before] = 1.0
    log_scale = np.zeros(p.shape[1])
    for first in range(0, n, 2000):
        windows = np.stack([padded[k * LONGEST : (k + 1) * LONGEST + before] for k in range(first, min(n, first + 2000))])
        found = _lattice(vocabulary, windows, before)
        none = np.zeros(0, dtype=np.int64)
        window, piece = (np.concatenate([none, *[f[k] for f in found]]).astype(np.int64) for k in (2, 3))
        begin, end = (np.concatenate([none, *[np.full(len(f[2]), f[k]) for f in found]]).astype(np.int64) for k in (0, 1))
        order = np.lexsort((begin, end, window))
        begin, piece = begin[order], piece[order]
        cuts = np.searchsorted((window * (before + LONGEST + 1) + end)[order], np.arange(len(windows) * (before + LONGEST + 1) + 1)).tolist()
        for k in range(len(windows)):
            at = k * (before + LONGEST + 1)
            for b in range(before + 1, before + 1 + min(LONGEST, len(raw) - (first + k) * LONGEST)):
                alpha[b] = alpha[b - 1] * BYTE_P
                i, j = cuts[at + b], cuts[at + b + 1]
                if i < j:
                    alpha[b] += (alpha[begin[i:j]] * p[piece[i:j]]).sum(axis=0)
            if first + k == n - 1:
                return np.log(np.maximum(alpha[b], 1e-300)) + log_scale
            alpha[: before + 1] = alpha[LONGEST:]
            # none is below BYTE_P of the one before it, so dividing by the last leaves room both ways
            last = np.maximum(alpha[before], 1e-300)
            alpha[: before + 1] /= last
            log_scale += np.log(last)
    raise AssertionError("a word has a last window")


def learned(vocabulary: Pieces, words: list[bytes], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities by expectation-maximisation on counted words."""
    p = np.full((vocabulary.size, 1), 1.0 / max(1, vocabulary.size))
    lattices = [(own, rows.shape[1], _lattice(vocabulary, rows)) for own, rows in _by_length(words)]
    for _ in range(rounds):
        expected = np.zeros(vocabulary.size)
        for own, length, lattice in lattices:
            alpha = _forward(lattice, len(own), length, p)[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[length] = 1.0
            at = length
            for a, b, words_, found in reversed(lattice):
                while at > b:
                    at -= 1
                    beta[at] += beta[at + 1] * BYTE_P
                expected += np.bincount(found, counts[own][words_] * alpha[a, words_] * p[found, 0] * beta[b, words_] / np.maximum(alpha[length, words_], 1e-300), minlength=vocabulary.size)
                beta[a, words_] += p[found, 0] * beta[b, words_]
        p = ((expected + 0.01) / (expected.sum() + 0.01 * vocabulary.size))[:, None]
    return p[:, 0]


def _lowered(texts: list[bytes | None]) -> list[bytes | None]:
    return [None if t is None else t.decode().lower().encode() for t in texts]


def _distinct(texts: list[bytes | None], cut: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, their hashes, for each word of the texts its distinct one, its text); with `cut`, long words in parts."""
    found = words_of(texts, LETTERS)
    starts, ends = found.starts, found.ends
    if cut and len(starts) and (ends - starts).max() > LONGEST:
        parts = -(-(ends - starts) // LONGEST)
        run = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts_ = np.repeat(starts, parts) + run * LONGEST
        ends = np.minimum(starts_ + LONGEST, np.repeat(ends, parts))
        text = np.repeat(np.repeat(np.arange(len(texts)), np.diff(found.bounds)), parts)
        found.starts, found.ends = starts_, ends
    else:
        text = np.repeat(np.arange(len(texts)), np.diff(found.bounds))
    hashes, first, inverse = np.unique(found.hashes(), return_index=True, return_inverse=True)
    raw = found.buf.tobytes()
    return [raw[found.starts[k] : found.ends[k]] for k in first], hashes, inverse, text


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, word, n)."""
    for batch, texts in text_chunks(batches):
        langs = np.array(column(batch, "lang").to_pylist(), dtype=object)
        words, _, inverse, text = _distinct(_lowered(texts), cut=True)
        for lang in set(langs):
            n = np.bincount(inverse[langs[text] == lang], minlength=len(words))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([words[k] for k in some], pa.binary()), pa.array(n[some])], names=["lang", "word", "n"])


def sample(documents: DataFrame, known: DataFrame, a_language: int = A_LANGUAGE) -> DataFrame:
    """(lang, text) to learn from: about `a_language` documents of each language, by a hash; `known` has lang and _n, its documents."""
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_000)) * F.col("_n") < 1_000_000 * a_language
    return rows.join(known, "lang").where(drawn).select("lang", "text")


class Model:
    """Languages, their piece probabilities and their shares of documents."""

    def __init__(self, raw: list[bytes], languages: list[str], p: np.ndarray, prior: np.ndarray):
        self.raw, self.languages, self.p, self.prior = raw, languages, p, prior


def train(documents: DataFrame, vocabulary: str = VOCABULARY, a_language: int = A_LANGUAGE, languages: int = LANGUAGES) -> Iterator[Model]:
    """Learn from the documents' text and lang: models of `languages` languages each, in order of their names."""
    raw = pieces(vocabulary)
    shared = documents.sparkSession.sparkContext.broadcast(raw)

    def learn(key, rows: pd.DataFrame) -> pd.DataFrame:
        words = [bytes(w) for w in rows["word"]]
        p = learned(Pieces(shared.value), words, rows["n"].to_numpy(dtype=float))
        return pd.DataFrame({"lang": [key[0]], "p": [p]})

    known = Written(documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "languages")
    names = known.df.toPandas().sort_values("lang")
    counts = sample(documents, F.broadcast(known.df) if len(names) <= 100_000 else known.df, a_language).mapInArrow(_counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # a group is the words of one language's part of the sample
    found = Written(counts.groupBy("lang").applyInPandas(learn, "lang string, p array<double>"), "language-pieces")
    known.drop()
    share = dict(names.itertuples(index=False, name=None))
    for at in range(0, len(names), languages):
        block = names["lang"].tolist()[at : at + languages]
        own = found.df.where(F.col("lang").isin(*block)).toPandas().sort_values("lang")
        if len(own):
            yield Model(raw, own["lang"].tolist(), np.column_stack(list(own["p"])), np.log(np.array([share[x] for x in own["lang"]], dtype=float)))
    found.drop()


def _has_letter(text: bytes | None) -> bool:
    return bool(text) and (any(0x61 <= b <= 0x7A for b in text[:200]) or any(c.isalpha() for c in text.decode()))


#: What a text carries from one block of languages to the next: its best language, that one's score, and the sum of all scores.
_CARRIED = "doc_id long, held_out boolean, best string, top double, mass double"


def _scored(shared, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n = len(model.languages)
        vocabulary, known, scores = Pieces(model.raw), {}, np.zeros((0, n))
        for batch, texts in text_chunks(batches):
            lowered = _lowered(texts)
            total = np.tile(model.prior, (len(texts), 1))
            words, hashes, inverse, text = _distinct(lowered)
            if len(known) > min(500_000, CELLS // n):
                known, scores = {}, np.zeros((0, n))
            keys = as_int64(hashes).tolist()
            new = [k for k, h in enumerate(keys) if h not in known]
            if new:
                known.update((keys[k], len(scores) + i) for i, k in enumerate(new))
                scores = np.concatenate((scores, log_likelihoods(vocabulary, [words[k] for k in new], model.p)))
            rows = np.fromiter((known[h] for h in keys), np.int64, len(keys))[inverse]
            for k in range(n):
                total[:, k] += np.bincount(text, scores[rows, k], minlength=len(texts))
            at = np.argmax(total, axis=1)
            top = total[np.arange(len(texts)), at]
            best = [model.languages[k] if _has_letter(t) else UNDETERMINED for k, t in zip(at, lowered, strict=True)]
            mass = np.log(np.exp(total - top[:, None]).sum(axis=1)) + top
            old, old_top = column(batch, "best").to_pylist(), column(batch, "top").to_numpy(zero_copy_only=False)
            stays = old_top >= top
            best = [a if s else b for a, b, s in zip(old, best, stays, strict=True)]
            mass = np.logaddexp(column(batch, "mass").to_numpy(zero_copy_only=False), mass)
            out = [column(batch, "doc_id"), column(batch, "held_out"), pa.array(best, pa.string()), pa.array(np.where(stays, old_top, top)), pa.array(mass)]
            names = ["doc_id", "held_out", "best", "top", "mass"]
            yield pa.RecordBatch.from_arrays(out + [column(batch, "text")] * with_text, names=names + ["text"] * with_text)

    return run


def predict(documents: DataFrame, models: Iterable[Model]) -> DataFrame:
    """doc_id, held_out, lang_pred and score (its probability among the known languages) of every document (doc_id, text, held_out)."""
    none = F.lit(float("-inf"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out", F.lit(UNDETERMINED).alias("best"), none.alias("top"), none.alias("mass"))
    models = iter(models)
    model = next(models, None)
    while model:
        after = next(models, None)
        scores = rows.mapInArrow(_scored(documents.sparkSession.sparkContext.broadcast(model), after is not None), _CARRIED + (", text string" if after else ""))
        rows = write_out(scores, "language-scores") if after else scores
        model = after
    known = F.col("best") != UNDETERMINED
    return rows.select("doc_id", "held_out", F.col("best").alias("lang_pred"), F.when(known, F.least(F.lit(1.0), F.exp(F.col("top") - F.col("mass")))).otherwise(0.0).alias("score"))


def identified(documents: DataFrame, vocabulary: str = VOCABULARY, a_language: int = A_LANGUAGE, languages: int = LANGUAGES) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) isn't divisible by 5, and predict all."""
    rows = documents.select("doc_id", "text", "lang", (F.pmod(id_crc(F.col("doc_id")), F.lit(5)) == 0).alias("held_out"))
    return predict(rows, train(rows.where(~F.col("held_out")), vocabulary, a_language, languages))
