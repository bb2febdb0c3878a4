"""Periodic runs against brute force over all periods, on odd rows, and on planted cycles of every scale."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.llm import periodic

from .helpers import SCHEMA, documents

DOC = "doc_id long, text string"


def split(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def brute(w):
    """(start, length, period) of every run: for each period, the stretches in which words that far apart are equal."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q) and not any(q % p == 0 and all(w[k] == w[k + p] for k in range(i, i + q + q - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


def expected(doc_id, w):
    found = brute(w)
    gone = {k for a, n, q in found for k in range(a + q, a + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def odd_texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 3)))
    out = [None, "", " \n\t ", "one", "a " * 23, "a " * 24, "a b " * 11 + "a", "a b " * 12, "ab " * 500, "a " * 30 + "b " + "a " * 60]
    for q in (1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 24, 31, 32, 33, 63, 64, 65, 100, 127, 128, 200):
        cycle = [word() for _ in range(q - 1)] + [f"u{q}"]
        for extra in (-1, 0, 1, q // 2, q - 1, 3 * q):
            n = max(24, 3 * q) + extra
            ahead = [f"x{k}" for k in range(r.randrange(0, 40))]
            out.append(" ".join([*ahead, *(cycle[k % q] for k in range(n)), *(f"y{k}" for k in range(r.randrange(0, 5)))]))
    for _ in range(60):  # few words: runs that overlap and nest
        n, kinds = r.randrange(20, 220), r.randrange(1, 4)
        w = [r.choice("abc"[:kinds]) for _ in range(n)]
        for _ in range(3):
            q, at = r.randrange(1, 30), r.randrange(n)
            for k in range(at + q, min(n, at + q * r.randrange(2, 9))):
                w[k] = w[k - q]
        out.append(" ".join(w))
    for parts in ((1, 4), (2, 6, 3), (5, 10, 6), (8, 16), (3, 48)):  # cycles of cycles
        w = ["a", "b", "c"]
        for times in parts:
            w = w * times + [f"z{len(w)}"]
        out.append(" ".join(w * 4))
    thue = "a"
    for _ in range(10):
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    out += [" ".join([thue] * 12 + [other] * 12), "É è\x0bÉ\x0cè " * 20, "A a " * 8 + "a A " * 8]
    return out


def test_digests_match_brute_force(spark):
    rows = list(enumerate(odd_texts()))
    got = sorted(map(tuple, periodic.digests(spark.createDataFrame(rows, DOC).repartition(4)).collect()))
    assert got == sorted(expected(i, split(t)) for i, t in rows)
    assert sum(r[1] for r in got) > 100


def test_planted_query_on_the_odd_table(spark):
    rows = [*((r[0], r[1]) for r in documents()), *((k, "w " + " ".join(f"t{(k * j) % 97}" for j in range(k))) for k in range(100, 190)), (None, "a b c " * 40)]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA).withColumn("key", F.lit("x")).withColumn("q", F.lit(1)).withColumn("runs", F.lit(2))
    got = sorted(map(tuple, periodic.digests(periodic.with_planted(df)).collect()), key=repr)
    assert got == sorted((expected(i, planted(i, split(t))) for i, t in rows), key=repr)
    assert any(r[1] for r in got if zlib.crc32(str(r[0]).encode()) % 10 == 0)


def test_empty_table(spark):
    none = spark.createDataFrame([], DOC)
    assert periodic.digests(periodic.with_planted(none)).collect() == []
    assert periodic.runs(none).collect() == [] and periodic.collapsed(none).collect() == []


def test_runs_and_collapsed_keep_columns_and_rows(spark):
    rows = [(1, "x y " * 20 + "end", 3), (1, "x y " * 20 + "end", 3), (2, "no  run", 7), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").withColumn("_row", F.lit("mine")).withColumn("runs", F.lit("too"))
    out = periodic.collapsed(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "x y end", 7, "mine", "too")] * 2 + [(2, "no  run", 7, "mine", "too"), (None, None, None, "mine", "too")], key=repr)
    assert sorted(map(tuple, periodic.runs(df).collect())) == [(1, 0, 40, 2)] * 2


def test_a_very_long_text(spark):
    r = random.Random(3)
    w = [f"w{r.randrange(10**6)}" for _ in range(200_000)]
    for start, q, n in ((1000, 30_000, 100_000), (150_000, 7, 20_000)):
        for k in range(start + q, start + n):
            w[k] = w[k - q]
    w[101_000] = "stop"
    got = [tuple(x) for x in periodic.runs(spark.createDataFrame([(1, " ".join(w))], DOC)).collect()]
    assert sorted(got) == [(1, 1000, 100_000, 30_000), (1, 150_000, 20_000, 7)]


def test_wrong_names_are_found_out():
    """Should two blocks have one 64-bit name, the words tell, and the text is solved by exact names."""
    text = ("a b c " * 10 + "q r s t").encode()
    assert periodic.checked(text, [(0, 33, 3)])[1] == periodic.checked(text, [(0, 30, 3)])[1] == [(0, 30, 3)]
    for t in odd_texts():
        assert periodic._exact_runs((t or "").encode()) == brute(split(t))


def test_names_of_blocks():
    names = periodic.Names(np.array([1, 2, 1, 2, 1, 2, 3], dtype=np.uint64))
    at = np.array([0, 0, 0, 1])
    assert names.equal(at, np.array([2, 2, 1, 3]), np.array([4, 5, 1, 3])).tolist() == [True, False, False, True]


@pytest.mark.parametrize("q", [1, 2, 12, 30, 49])
def test_prime_parts(q):
    parts = {r for at, r in periodic._prime_parts(np.array([q])) if len(at)}
    assert parts == {r for r in range(2, q + 1) if q % r == 0 and all(r % k for k in range(2, r))}
