"""The Jaccard join, suffix deduplication and their pipeline forms against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.llm import components, jaccard, suffixes

from .helpers import SCHEMA, documents, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


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
            if i < j and any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sets, {i: find(i) for i in sets}


def test_similar_matches_brute_force(docs):
    rows = [(r[0], r[1]) for r in documents()]
    sets, root = classes(rows)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(docs).collect())
    assert got == sorted((i, len(shingles(t)), root[i]) for i, t in rows)


def test_one_of_each_keeps_first_and_columns(spark, docs):
    wide = docs.withColumn("_node", F.lit("mine")).withColumn("node", F.lit(1))
    out = jaccard.one_of_each(wide)
    _, root = classes([(r[0], r[1]) for r in documents()])
    assert out.columns == wide.columns
    assert sorted({r.doc_id for r in out.collect()}) == sorted({i for i in root if root[i] == i})


def test_a_chain_of_links_is_one_class(spark):
    w = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(12):  # each step changes some words more: neighbours are similar, ends aren't
        w[k * 12 : k * 12 + 3] = [f"y{k}a", f"y{k}b", f"y{k}c"]
        texts.append((k, " ".join(w), None, None, 0))
    _, root = classes([(t[0], t[1]) for t in texts])
    got = {r.doc_id: r.component_id for r in jaccard.similar(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert got == root and len(set(root.values())) == 1


def test_pigeonhole_holds_for_all_sizes():
    r = np.random.Generator(np.random.PCG64(3))
    for size in (1, 2, 3, 4, 5, 7, 9, 12, 20, 33, 60, 100, 250, 700):
        for _ in range(20):
            a = r.integers(1, 2**63, size, dtype=np.uint64)
            drop = r.integers(0, size // 4 + 1)
            b = np.concatenate((a[drop:], r.integers(1, 2**63, r.integers(0, size // 4 + 1), dtype=np.uint64)))
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 4 * both < 3 * either:
                continue
            a, b = np.sort(a), np.sort(b)
            sets, keys = jaccard.word_keys(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
            assert set(keys[sets == 0].tolist()) & set(keys[sets == 1].tolist())
            x, y = (np.frombuffer(jaccard.dense_sketch(s), np.uint64) for s in (a, b))
            n = min(len(x), len(y))
            assert np.bitwise_count(jaccard.folded(x, n) ^ jaccard.folded(y, n)).sum() <= len(a) + len(b) - 2 * both


def test_blocks_hold_sets_of_a_word_against_each_other(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    _, root = classes([(r[0], r[1]) for r in documents()])
    assert {r.doc_id: r.component_id for r in jaccard.similar(docs).collect()} == root


def test_rows_in_any_order_with_copies_and_shared_ids(spark):
    """Near and exact copies with ids dealt at random, some texts under the id of another, in one partition and in many."""
    for seed in range(2):
        r = random.Random(seed)
        texts = []
        for k in range(25):
            n = r.choice([6, 9, 14, 20, 40, 90])
            base = [f"t{k}w{j}" for j in range(n)]
            texts.append(" ".join(base))
            for _ in range(r.randrange(9)):
                w = list(base)
                for _ in range(r.randrange(max(1, n // 12) + 1)):
                    w[r.randrange(n)] = f"x{r.randrange(6)}"
                texts.append(" ".join(w + ["tail"] * r.randrange(2)))
        texts += [r.choice(texts) for _ in range(40)]
        ids = r.sample(range(1000), len(texts))
        for _ in range(5):
            ids[r.randrange(len(ids))] = ids[r.randrange(len(ids))]
        rows = list(zip(ids, texts, strict=True)) + [(ids[0], None), (ids[1], " ")]
        r.shuffle(rows)
        _, root = classes(rows)
        docs = spark.createDataFrame([(*row, None, None, 0) for row in rows], SCHEMA)
        for shape in (docs.coalesce(1), docs.repartition(5)):
            got = {(x.doc_id, x.component_id) for x in jaccard.similar(shape).collect()}
            assert got == set(root.items()), seed


@pytest.mark.parametrize("size", [30, 120, 300, 900, 3000])
def test_sets_at_the_threshold_share_words(size):
    """No pair at a similarity of just over 0.75 without a common word, over the bands that keep SHARED words and the others."""
    r = np.random.Generator(np.random.PCG64(size))
    for _ in range(40):
        n = int(size * r.uniform(1, 1.5))
        a = r.integers(1, 2**63, n, dtype=np.uint64)
        b = np.concatenate((a[n // 7 :], r.integers(1, 2**63, n // 7, dtype=np.uint64)))
        sets, keys = jaccard.word_keys(np.concatenate((np.sort(a), np.sort(b))), np.array([0, n, 2 * n]))
        assert len(set(keys[sets == 0].tolist()) & set(keys[sets == 1].tolist())) >= min(8, n // 12)


def test_components_of_links(spark):
    links = spark.createDataFrame([(5, 3), (3, 9), (2, 1), (9, 7), (4, 4)], "a long, b long")
    got = {(r.node, r.component) for r in components.components(links).collect()}
    assert got == {(5, 3), (9, 3), (7, 3), (2, 1)}
    more = components.united(components.components(links), spark.createDataFrame([(7, 2), (20, 21)], "a long, b long"))
    assert {(r.node, r.component) for r in more.collect()} == {(2, 1), (3, 1), (5, 1), (7, 1), (9, 1), (21, 20)}


def cut(rows):
    """Brute force: which bytes go, of (doc_id, text) rows."""
    first = {}
    for i, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_suffixes_match_brute_force(docs):
    got = sorted(tuple(r) for r in suffixes.digests(docs).collect())
    assert got == sorted(cut([(r[0], r[1]) for r in documents()]))


def test_deduplicated_texts_stay_valid(docs):
    wide = docs.withColumn("_id", F.lit(1)).withColumn("spans", F.lit("x"))
    out = suffixes.deduplicated(wide)
    assert out.columns == wide.columns
    kept = {r.doc_id: r for r in out.collect()}
    expected = {i: n - removed for i, n, removed, _, _ in cut([(r[0], r[1]) for r in documents()])}
    for i, r in kept.items():
        assert len((r.text or "").encode()) <= expected[i] and r.n_chars == len(r.text or "")
    assert kept[0].text == documents()[0][1] and kept[50].text is None and kept[20].text == ""


def test_multikey_sort_orders_rows_and_names_equal_ones():
    r = np.random.Generator(np.random.PCG64(5))
    rows = r.integers(0, 3, (500, 4)).astype(np.uint64)
    order, cls = suffixes.multikey_sorted(rows)
    got = [tuple(x) for x in rows[order].tolist()]
    assert got == sorted(got)
    assert cls.tolist() == [sorted(set(got)).index(x) for x in got]


def test_a_hot_suffix_across_buckets(spark):
    """Many documents with one passage between other words, dealt over many buckets."""
    passage = "the very same passage of some sixty bytes or more stands here, "
    rows = [(k, f"{k * 7919} {k}a{k} " * 3 + passage + f" {k * 31} b{k}" * 2, None, None, 0) for k in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = sorted(tuple(r) for r in suffixes.digests(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted(cut([(r[0], r[1]) for r in rows]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert jaccard.similar(none).count() == 0
    assert suffixes.digests(none).count() == 0
    assert suffixes.deduplicated(none).count() == 0


def test_null_id_is_a_document(spark):
    rows = [(None, "a b c d e f g h " * 8, None, None, 0), (1, "a b c d e f g h " * 8, None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {(r.doc_id, r.component_id) for r in jaccard.similar(docs).collect()} == {(None, None), (1, None)}
    assert {r.doc_id: r.n_removed for r in suffixes.digests(docs).collect()} == {None: 0, 1: 128}
