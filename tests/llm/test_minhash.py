"""MinHash near-duplicates against brute force, at the threshold, in groups, and the sequential test against its own definition."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.llm import jaccard, minhash
from sitewright.llm.textnp import words_of

from .helpers import SCHEMA, documents, prose, words


def shingles(text, n=2):
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def classes(rows):
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingles(text))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def expected(rows):
    root = classes(rows)
    return sorted((i, len(shingles(t)), root[i], root[i] == i) for i, t in rows)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())


def test_matches_brute_force_on_the_odd_table(spark):
    wide = spark.createDataFrame(documents(), SCHEMA).withColumn("node", F.lit(1)).withColumn("_id", F.lit("x")).repartition(3)
    rows = [(r[0], r[1]) for r in documents()]
    assert got(wide) == expected(rows)
    out = minhash.one_of_each(wide)
    root = classes(rows)
    assert out.columns == wide.columns and sorted({r.doc_id for r in out.collect()}) == sorted(i for i in root if root[i] == i)


def edited(text, share, r):
    w = text.split(" ")
    for k in r.sample(range(len(w)), max(1, int(share * len(w)))):
        w[k] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def test_pairs_around_the_threshold_and_groups(spark):
    r = random.Random(4)
    rows = []
    for k in range(150):  # pairs whose similarity lies around 0.8
        text = prose(1000 + k, r.randrange(3, 400), 3000)
        rows += [(2 * k, text), (2 * k + 1, edited(text, r.choice([0.02, 0.04, 0.05, 0.06, 0.08]), r))]
    base = prose(5, 200, 5000)  # a group around one text, and a chain
    rows += [(1000 + k, edited(base, r.choice([0.03, 0.05, 0.09]), r)) for k in range(120)]
    chain = [f"c{k}" for k in range(300)]
    rows += [(2000 + k, " ".join(chain[8 * k : 8 * k + 90])) for k in range(20)]
    shared = " ".join(f"s{k}" for k in range(60))  # a passage that many have
    rows += [(3000 + k, shared + " " + prose(3000 + k, 40, 5000)) for k in range(150)]
    r.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == expected(rows)


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, None), (5, "A"), (6, "a"), (7, "")], "doc_id long, text string")
    rows = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert rows == sorted([(None, 3, None, True), (4, 3, None, False), (None, 0, None, True), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)], key=repr)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_least_agreements_are_the_posterior_bound():
    for n in (32, 64, 96, 128):
        m = minhash.least_agreements(n)
        # a Beta(m + 1, n - m + 1) posterior above t, by numbers
        x = np.linspace(0, 1, 400_001)
        for agreed, kept in ((m, True), (m - 1, False)):
            density = x**agreed * (1 - x) ** (n - agreed) * (n + 1) * math.comb(n, agreed)
            assert (np.trapezoid(density[x >= 0.8], x[x >= 0.8]) >= minhash.MISS) is np.bool_(kept)


def test_signatures_agree_as_often_as_sets_are_similar():
    r = np.random.default_rng(2)
    shares = []
    for _ in range(150):
        both, more = r.integers(0, 2**63, 80, dtype=np.uint64), r.integers(0, 2**63, 20, dtype=np.uint64)
        values = np.concatenate((both, more[:10], both, more[10:]))
        m = minhash.minima(values, np.array([0, 90, 90, 180]))
        assert (m[1] == 2**32 - 1).all()
        shares.append((m[0] == m[2]).mean())
    assert abs(np.mean(shares) - 0.8) < 0.01 and 0.015 < np.std(shares) < 0.028


def thue_morse(k=10):
    text = "a"
    for _ in range(k):
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


def test_regular_words_don_t_collide(spark):
    a, b = thue_morse()
    found = words_of([a.encode(), b.encode(), f"{b} {a}".encode()])
    assert len(set(found.hashes().tolist())) == 2 and found.ids().tolist() in ([0, 1, 1, 0], [1, 0, 0, 1])
    df = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}")], "doc_id long, text string")
    assert [r[2] for r in got(df)] == [1, 2, 3, 4]
    assert sorted((r.doc_id, r.component_id) for r in jaccard.similar(df).collect()) == [(k, k) for k in (1, 2, 3, 4)]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_exact_sets_are_the_same_as_hashed_ones(n):
    texts = [(t or "").encode() for _, t, *_ in documents()]
    hashed, bounds = jaccard.shingle_sets(texts, n)
    exact, same = jaccard.shingle_sets(texts, n, exact=True)
    assert bounds.tolist() == same.tolist()
    pairs = {tuple(sorted((i, j))) for i in range(0, len(texts), 3) for j in range(0, len(texts), 4)}
    both = lambda v, i, j: len(np.intersect1d(v[bounds[i] : bounds[i + 1]], v[bounds[j] : bounds[j + 1]]))
    assert all(both(hashed, i, j) == both(exact, i, j) for i, j in pairs)


def test_certain_words_at_every_size():
    assert all(jaccard.n_words(b, True)[0] >= jaccard.n_words(b)[0] and jaccard.n_words(b, True)[1] >= 0 for b in range(20))
