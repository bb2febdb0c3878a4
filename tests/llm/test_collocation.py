"""Collocations against counts taken phrase by phrase, on odd rows, over several tries and dictionaries, and tries against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.llm import collocation

from .helpers import SCHEMA, documents, lowered


def brute(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", lowered(text)):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, b in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * b >= 80 * counts[p[i : i + k]]}
        ranked = []
        for p, a in found.items():
            if p not in gone:
                score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, b" ".join(p), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def rows():
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "ñandú", "a-b", "\x01", "x" * 300]
    out = [(None, "en"), ("", "en"), (" \t\n", None), ("...!?", "de"), ("one", None)]
    for k in range(400):
        words = [r.choice(vocabulary) for _ in range(r.randrange(1, 60))]
        for _ in range(3):
            at = r.randrange(len(words))
            words[at:at] = r.choice(["New York City hall", "of the", "in spite of the", "a\x01 b", "UND so weiter"]).split(" ")
        out.append(("".join(w + r.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "."]) for w in words), r.choice(["en", "de", None, "und", "x y"])))
    out += [("the " * 200, "en"), ("the " * 200, "en"), ("a b " * 5000 + "end", "long")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    wide = spark.createDataFrame([(t, x, "mine", 1) for t, x in rows()], "text string, lang string, word string, n int")
    return wide.withColumn("key", F.lit(0)).withColumn("words", F.lit("w")).repartition(5)


def got(df, **more):
    return sorted(map(tuple, collocation.collocations(df, **more).collect()))


def test_matches_counts_phrase_by_phrase(docs):
    want = brute(rows())
    assert got(docs) == want
    assert {len(r[2].split(" ")) for r in want} >= {2, 3, 4}


def test_first_of_each_language_and_ties(docs):
    assert got(docs, least=5, top=7) == brute(rows(), 5, 7)


def test_many_tries_and_dictionaries_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(collocation, "TRIE", 17)
    monkeypatch.setattr(collocation, "DICTIONARY", 20)
    assert got(docs, least=12) == brute(rows(), 12)


def test_odd_rows_and_empty_tables(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    assert got(df, least=3) == brute([(r[1], r[2]) for r in documents()], 3)
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None, None, None, 0), (2, "a b", "en", None, 3)], SCHEMA)) == []


def test_exact_beyond_64_bits(spark):
    """Counts as a very large corpus has them: the products of scores don't fit in 64 bits."""
    a, l, r = 10**14 + 7, 10**14 + 11, 3 * 10**14 + 13  # noqa: E741
    phrases = spark.createDataFrame([([1], l), ([2], r), ([1, 2], a)], "words array<int>, n long")
    row = collocation.scored(phrases).first()
    assert (row.a, row.l, row.r, row.score) == (a, l, r, 2000000 * a // (l + r))


@pytest.mark.parametrize("kinds", [3, 300, 70_000])
def test_tries_find_what_they_hold(kinds):
    r = np.random.default_rng(kinds)
    for k in (2, 3, 4):
        text = r.zipf(1.3, 20_000).astype(np.int64) % kinds
        windows = np.stack([text[i : len(text) - k + 1 + i] for i in range(k)], axis=1)
        phrases = np.unique(windows[r.random(len(windows)) < 0.3], axis=0).astype(np.int32)
        trie = collocation.Trie(phrases)
        number = {tuple(p): j for j, p in enumerate(phrases.tolist())}
        with_breaks = np.where(r.random(len(text)) < 0.05, -1, text).astype(np.int32)
        want = [number.get(tuple(with_breaks[i : i + k].tolist()), -1) for i in range(len(text))]
        assert trie.walk(with_breaks).tolist() == want
        assert len(trie.walk(with_breaks[: k - 1])) == k - 1


def test_packed_keeps_neighbours_only():
    x = np.array([5, -1, 6, 7, -1, -1, 8, -1, 9, 9, 9], dtype=np.int32)
    runs = [s for s in " ".join(map(str, np.frombuffer(collocation._packed(x), np.int32))).replace("-1", "|").split("|") if s.strip()]
    assert [s.split() for s in runs] == [["6", "7"], ["9", "9", "9"]]
