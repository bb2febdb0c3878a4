"""Texts of over a megabyte, and keys that are null, in operators whose other cases are tested beside them."""

import hashlib
import random

from pyspark.sql import functions as F

from sitewright.llm import chat, decontaminate, minhash, quality, suffixes, warc

from .helpers import words

R = random.Random(12)
LONG = " ".join(f"w{R.randrange(50_000)}" for _ in range(220_000))
DOC = "doc_id long, text string"


def test_null_conversations_and_long_turns(spark):
    rows = [(None, 1, "user", "a"), (None, 2, "assistant", LONG), (7, 1, "user", None), (7, 2, "assistant", "</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit("mine"))
    got = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    assert set(got) == {None, 7} and got[None].n_turns == 2 and got[None].loss_chars == len(LONG)
    assert got[None].loss_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and got[7].loss_chars == 4


def test_long_texts_in_sets_windows_and_suffixes(spark):
    w = LONG.split()
    other = " ".join(["other"] * 50 + w[: len(w) - 100] + ["new"] * 50)
    df = spark.createDataFrame([(1, LONG), (2, other), (3, " ".join(w[5000:5040])), (4, None)], DOC)
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    bench = spark.createDataFrame([("a", " ".join(w[5010:5030]))], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.digests(decontaminate.contamination(df, bench)).collect()} == {1: 20, 2: 20, 3: 20, 4: 0}
    got = {r.doc_id: r for r in suffixes.digests(df).collect()}
    raw = LONG.encode()
    assert got[1].n_removed == 0 and got[3].n_removed == got[3].n_bytes and got[2].n_bytes == len(other.encode()) and got[2].n_removed >= len(" ".join(w[: len(w) - 100]))
    assert got[1].kept_sha256 == hashlib.sha256(raw).hexdigest()


def test_long_texts_in_rules_and_archives(spark):
    df = spark.createDataFrame([(1, LONG)], DOC)
    row = quality.ledger(df).first()
    assert row.n_words == len(words(LONG))
    pages = spark.createDataFrame([(1, "https://e.com/", LONG, "mine"), (2, "https://e.com/2", LONG, "mine")], "page_id long, url string, html string, payload_digest string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert (got[1].record_type, got[2].record_type, got[2].refers_to, got[1].payload_bytes) == ("response", "revisit", 1, len(LONG))
