"""The operators on single documents and pages, on cases that they define, against plain Python."""

import base64
import hashlib
import io
import math
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitewright.llm import chat, decontaminate, language, lm, mixing, quality, textnp, toxicity, warc

from .helpers import SCHEMA, documents, lowered, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).withColumns({"size": F.lit("clash"), "n_words": F.lit(-1), "tail": F.lit(2)}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows():
    return [(r[0], r[1]) for r in documents()]


# words


def test_words_and_hashes_do_not_depend_on_place():
    texts = [b"Aa bb\tcc", None, b"", b" bb ", "é aa".encode()]
    found = textnp.words_of(texts)
    h = found.hashes()
    assert np.diff(found.bounds).tolist() == [3, 0, 0, 1, 2]
    assert h[0] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 4


# chat formatting


def test_chat_round_trip_and_mask(spark):
    nasty = ["<|end|>", "\\<|turn|>\\", "[INST] x [/INST]</s>", "a\\", "<|loss|>evil<|end|>", "", None, "<<SYS>>"]
    turns = [(1, k, ["user", "assistant"][k % 2], t) for k, t in enumerate(nasty)] + [(2, 0, None, "x"), (3, 0, "a\n<|body|>", "y"), (3, 0, "a\n<|body|>", "y")]
    whole = chat.formatted(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in whole.select("conv_id", "n_turns", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted")).alias("l"), chat.loss_spans(F.col("formatted")).alias("s"), "formatted").collect()}
    assert [(x.role, x.text) for x in got[1].t] == [(r, t or "") for _, _, r, t in turns[:8]]
    assert got[1].l == [t or "" for t in nasty[1::2]]
    plain = [got[1].formatted[s.start : s.start + s.length] for s in got[1].s]
    assert [re.sub(r"(?s)\\(.)", r"\1", p) for p in plain] == got[1].l
    assert [(x.role, x.text) for x in got[2].t] == [("", "x")] and got[3].n_turns == 2 and got[3].t[0].role == "a\n<|body|>"


def test_chat_parts_become_placeholders(spark):
    parts = [("text", "see <|image:9|>", None, None, None, None, None), ("image", None, "a.png", 400, 200, None, None), ("audio", None, "b.wav", None, None, 2.5, None), ("odd", "x", None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 3)]
    r = chat.formatted(spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()
    assert "see <\\|image:9|><|image:1|><|audio:2|><|document:3|>" in r.formatted
    assert [(a.place, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 2 * 1 * 196), (2, "audio", "b.wav", 63), (3, "document", "c.pdf", 1536)]
    assert r.attachment_tokens == 392 + 63 + 1536


# quality


def measures(text):
    w = [x.decode() for x in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, docs, none):
    extra = [(100, "a b c d e f g " * 3, None, None, 0), (101, "x\n \ny\nx\nx # $", None, None, 0)]
    both = docs.select(*SCHEMA_COLUMNS).unionByName(spark.createDataFrame(extra, SCHEMA))
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.ledger(both).collect())
    assert got == sorted((i, *measures(t)) for i, t in rows() + [(e[0], e[1]) for e in extra])
    assert quality.ledger(none).count() == 0
    clash = quality.ledger(docs.withColumn("_words", F.lit(5)), keep=("doc_id", "n_words", "_words"))
    assert clash.columns[:3] == ["doc_id", "n_words_", "_words"] and {(r.n_words_, r._words) for r in clash.collect()} == {(-1, 5)}


SCHEMA_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_ablation_counts_bits(docs):
    table = quality.ledger(docs)
    bits = [r.failures for r in table.collect()]
    names = quality.names()
    policy = quality.POLICIES["v1"]
    for r in quality.ablation(table, "v1").collect():
        bit = 1 << names.index(r.rule)
        assert (r.failing, r.only) == (sum(bool(b & bit) for b in bits), sum((b & policy.mask(names)) == bit for b in bits))


# mixing


def test_mix_meets_targets(docs, none):
    got = mixing.mix(docs).collect()
    total = sum(r.size for r in got)
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert math.isclose(sum(t for t, _ in targets.values()), 1.5 * total) and all(t <= 2 * s + 1e-9 for t, s in targets.values())
    for source, (target, _) in targets.items():
        own = [r for r in got if r.source == source]
        assert all(r.taken in (r.size, 2 * r.size, 0) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
    assert mixing.mix(none).count() == 0


# decontamination


def exact(docs, items):
    word = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = []
    for item, text in items:
        w = re.findall(word, lowered(text))
        windows += [(str(item), w[k : k + 10]) for k in range(max(1, len(w) - 9))] if w else []
    out = []
    for i, text in docs:
        w, hit, named = re.findall(word, lowered(text)), set(), set()
        for item, x in windows:
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit |= set(range(p, p + len(x)))
                    named.add(item)
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [100_000, 7])
def test_contamination_matches_brute_force(spark, docs, block):
    base = dict(rows())
    items = [(1, base[3][40:260]), (2, base[4][10:150].upper()), (3, "one"), (4, None), (5, " ,. "), (10, "two three four"), (11, "two three four"), (12, "not there at all"), (None, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.digests(decontaminate.contamination(docs, benchmark, block)).collect())
    expected = exact(rows(), [x for x in items if x[0] is not None])
    assert got == expected
    kept = decontaminate.decontaminated(docs, benchmark, block)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(e[0] for e in expected if not e[5])


def test_null_ids_are_counted_with_many_blocks(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h i j k", None, None, 0), (None, "none of it", None, None, 0), (None, None, None, None, 0), (3, "c d e f g h i j k l", None, None, 0)], SCHEMA)
    benchmark = spark.createDataFrame([(1, "b c d e f g h i j k l m n"), (2, "a b c d e f g h i j")], "item_id long, text string")
    one, many = (sorted((tuple(r) for r in decontaminate.digests(decontaminate.contamination(docs, benchmark, block)).collect()), key=str) for block in (100_000, 1))
    assert one == many and sum(r[-1] for r in one) == 2


def test_contamination_of_empty_tables(spark, docs, none):
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, no_items).count() == 0
    assert {r.contaminated for r in decontaminate.digests(decontaminate.contamination(docs, no_items)).collect()} == {False}


# web archives


def test_warc_round_trip(spark, tmp_path):
    pages = [(5, "http://a/", "same"), (2, "http://b/", "same"), (9, None, None), (3, "http://c/\r\nx: y", "é" * 5000), (4, "http://d/", ""), (7, "http://e/", "same")]
    archives = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), f"file://{tmp_path}")
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    for page, _, html in pages:
        raw = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert got[page].payload is None or bytes(got[page].payload) == raw
    assert {p: (r.record_type, r.refers_to) for p, r in got.items()} == {2: ("response", None), 5: ("revisit", 2), 7: ("revisit", 2), 3: ("response", None), 4: ("response", None), 9: ("revisit", 4)}
    for path in tmp_path.glob("*.wacz"):  # other readers take them too
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and set(z.namelist()) == {warc.WARC_MEMBER, warc.INDEX_MEMBER}
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_and_null_pages_have_one_response(spark):
    pages = [(1, "a", "abc"), (1, "a", "abc"), (2, "b", "abc"), (3, "c", "x"), (None, "d", "y"), (None, "e", "y"), (7, "f", "y"), (3, "c", "z"), (8, None, None), (8, None, "")]
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect())
    assert got == Counter([(1, 3, "response", None), (1, 3, "revisit", 1), (2, 3, "revisit", 1), (3, 1, "response", None), (3, 1, "response", None), (None, 1, "response", None), (None, 1, "revisit", None), (7, 1, "revisit", None), (8, 0, "response", None), (8, 0, "revisit", 8)])


def test_warc_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = warc.round_trip(spark.read.parquet(f"{sf}/pages.parquet"))
    want = duckdb.sql(warc.SQL.replace("FROM pages", f"FROM '{sf}/pages.parquet'")).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("zip64", [True, False])
def test_zip_directories(zip64):
    import pyarrow as pa

    out = io.BytesIO()
    w = warc.ZipWriter(out, zip64)
    for name, data in (("a", b"first"), ("b/c", b"")):
        w.open(name)
        w.write(data)
        w.end_member()
    w.close()
    raw = out.getvalue()
    file = pa.PythonFile(io.BytesIO(raw))
    found = warc.members(pa.BufferReader(raw), len(raw))
    assert {k: raw[a : a + n] for k, (a, n) in found.items()} == {"a": b"first", "b/c": b""} and file


def test_zip_of_another_writer():
    import pyarrow as pa

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x", b"stored")
        z.writestr(zipfile.ZipInfo("y"), b"packed" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    raw = out.getvalue()
    found = warc.members(pa.BufferReader(raw), len(raw))
    assert set(found) == {"x"} and raw[found["x"][0] :][: found["x"][1]] == b"stored"


# language


def test_forward_sums_all_segmentations():
    raw = [b" a", b"a", b"b", b" ab", b"ab", b"bb"]
    vocabulary = language.Pieces(raw)
    p = np.random.Generator(np.random.PCG64(1)).random((len(raw), 2)) / 10

    def total(rest, k):
        if not rest:
            return 1.0
        out = language.BYTE_P * total(rest[1:], k)
        for n in range(1, len(rest) + 1):
            if rest[:n] in raw:
                out += p[raw.index(rest[:n]), k] * total(rest[n:], k)
        return out

    words_ = [b"a", b"ab", b"abb", b"bab", b"zz", b"aabbab"]
    got = language.log_likelihoods(vocabulary, words_, p)
    for w, row in zip(words_, got, strict=True):
        for k in range(2):
            assert math.isclose(row[k], math.log(total(b" " + w, k)), rel_tol=1e-9)


def test_words_of_any_length_are_scored_whole():
    """Against a forward pass of logarithms; pieces lie across the borders of windows."""
    raw = [b" a", b"a", b"ab", b"abcab", "ü".encode(), "üaü".encode(), b"c" * 22]
    vocabulary = language.Pieces(raw)
    rng = np.random.Generator(np.random.PCG64(2))
    p = rng.random((len(raw), 3)) / 10
    words_ = ["".join(rng.choice(["a", "b", "c", "ü", "abcab", "c" * 22], n)).encode() for n in (12, 40, 41, 42, 90, 500, 3000)] + [b"z" * 39, b"z" * 40, b"z" * 41, b"z" * 5000, b"a" * 81]
    for w, row in zip(words_, language.log_likelihoods(vocabulary, words_, p), strict=True):
        text = b" " + w
        logs = [np.zeros(3)]
        for b in range(1, len(text) + 1):
            ways = [logs[b - 1] + math.log(language.BYTE_P)] + [logs[b - len(x)] + np.log(p[k]) for k, x in enumerate(raw) if text[:b].endswith(x)]
            logs.append(np.logaddexp.reduce(ways))
        assert np.allclose(row, logs[-1], rtol=1e-9), len(w)


def test_blocks_of_languages_change_nothing(spark):
    words_ = {"aa": "the and of with", "bb": "der die und nicht", "cc": "le la les des est", "dd": "el los las por que"}
    rows = [(k, " ".join([words_[x], words_[x], "das que the"][: 1 + k % 3]), x, None, 0) for k, x in enumerate(sorted(words_) * 20)]
    docs = spark.createDataFrame(rows + [(None, None, None, None, 0), (7000, "", "aa", None, 0), (7001, "und", "ee", None, 0)], SCHEMA)
    whole, parts = ({(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in language.identified(docs, languages=n).collect()} for n in (128, 1))
    assert whole == parts and {x[2] for x in whole} >= set(words_) | {"und"}
    assert sum(x[2] == rows[x[0]][2] for x in whole if x[0] is not None and x[0] < len(rows)) > 75


def test_learning_raises_the_likelihood():
    vocabulary = language.Pieces([b" th", b"e", b"er", b" t", b"h", b"r"])
    words_, n = [b"the", b"there", b"her"], np.array([5.0, 2.0, 1.0])
    scores = [float((language.log_likelihoods(vocabulary, words_, language.learned(vocabulary, words_, n, k)[:, None])[:, 0] * n).sum()) for k in (1, 2, 4)]
    assert scores[0] < scores[1] < scores[2]


def test_languages_and_undetermined(spark, none):
    en, de = "the and of with this that from have ", "der die und nicht ein auch mit sich "
    table = [(k, (en if k % 2 else de) * 3, "en" if k % 2 else "de", None, 0) for k in range(60)] + [(100, None, "en", None, 0), (101, "123 !!", "en", None, 0), (102, "THE AND OF " + "the" * 50, None, None, 0), (102, "THE AND OF " + "the" * 50, None, None, 0)]
    got = {r.doc_id: r for r in language.identified(spark.createDataFrame(table, SCHEMA)).collect()}
    assert all(got[k].lang_pred == ("en" if k % 2 else "de") for k in range(60))
    assert (got[100].lang_pred, got[100].score, got[101].lang_pred, got[102].lang_pred) == ("und", 0.0, "und", "en")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    assert language.identified(none).count() == 0


# toxicity


def test_chain_learns_and_keeps_columns(spark, none):
    clean = [(k, f"a quiet day in town number {k} with some rain", None, None, 0) for k in range(120)]
    bad = [(k, f"a quiet day you horrid{'ly' * (k % 2)} thing number {k}", None, None, 0) for k in range(200, 260)]
    docs = spark.createDataFrame(clean + bad + [(900, None, None, None, 0), (901, "", None, None, 0), (902, "horrid thing", None, None, 0)], SCHEMA)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(120)] + [(k, 1, 1) for k in range(200, 260)] + [(None, 1, 1), (901, None, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    assert all(got[k].toxic for k in range(200, 260)) and not any(got[k].toxic for k in range(120)) and got[902].toxic
    assert (got[900].p_toxic, got[900].toxic, got[901].toxic) == (0.0, False, False)
    wide = docs.withColumn("toxic", F.lit("clash"))
    kept = toxicity.not_toxic(wide, chain)
    assert kept.columns == wide.columns and {r.doc_id for r in kept.collect()} == set(range(120)) | {900, 901}
    assert toxicity.score(none, chain).count() == 0


def test_texts_under_one_id_are_chosen_alike_in_any_order(spark):
    rows = [(k, f"a {'horrid thing' if k % 3 == 0 else 'quiet day'} in town number {k}", None, None, 0) for k in range(90)]
    rows += [(k, f"an odd {'quiet' if k % 3 == 0 else 'horrid'} text {k}", None, None, 0) for k in range(0, 90, 2)]
    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(90)], "doc_id long, quality int, toxic int")
    one, two = (toxicity.train(spark.createDataFrame(x, SCHEMA).coalesce(1), labels) for x in (rows, rows[::-1]))
    assert one.threshold == pytest.approx(two.threshold)
    for a, b in zip(one.models, two.models, strict=True):
        assert a.index.tolist() == b.index.tolist() and np.allclose(a.weight, b.weight, atol=1e-6)


def test_chain_matches_brute_force(spark):
    """Each fold left out in turn, its probabilities handed on to the next model, the threshold by trying all cuts; document by document."""
    r = random.Random(4)
    common = [f"w{c}{d}" for c in "abcdefgh" for d in "mnop"]
    texts, marks = {}, {}
    for k in range(150):
        bad, toxic = r.random() < 0.4, r.random() < 0.3
        texts[k] = " ".join(r.choices(common, k=14) + ["junk"] * (bad and r.random() < 0.8) + ["horrid"] * (toxic and r.random() < 0.8) + ["odd"] * (r.random() < 0.2))
        marks[k] = (int(bad), int(toxic))
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in texts.items()], SCHEMA)
    chain = toxicity.train(docs, spark.createDataFrame([(k, 1 - b, t) for k, (b, t) in marks.items()], "doc_id long, quality int, toxic int"))
    fold = {x.doc_id: x.f for x in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    own = {k: sorted(toxicity.features([t.encode()])[1].tolist()) for k, t in texts.items()}
    earlier = {k: [] for k in texts}
    log_odds = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))

    def fitted(ids, rank):
        pairs = np.array([(n, f) for n, k in enumerate(ids) for f in own[k]])
        return toxicity.fit(pairs[:, 0], pairs[:, 1], np.array([[log_odds(p) for p in earlier[k]] for k in ids]).reshape(len(ids), rank), np.array([marks[k][rank] for k in ids], dtype=float))

    def probability(model, features, before):
        weights = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
        return 1 / (1 + math.exp(-model.constant - sum(weights.get(f, 0) for f in features) - sum(c * log_odds(p) for c, p in zip(model.chain.tolist(), before, strict=True))))

    models = []
    for rank in range(2):
        models.append(fitted(sorted(texts), rank))
        without = [fitted([k for k in sorted(texts) if fold[k] != f], rank) for f in range(toxicity.FOLDS)]
        found = {k: probability(without[fold[k]], own[k], earlier[k]) for k in texts}
        earlier = {k: [*earlier[k], found[k]] for k in texts}
    ranked = sorted(((earlier[k][-1], marks[k][1]) for k in texts), reverse=True)
    quality = [2 * sum(y for _, y in ranked[: n + 1]) / (n + 1 + sum(y for _, y in ranked)) for n in range(len(ranked))]
    best = quality.index(max(quality))
    assert chain.threshold == pytest.approx(min(max((ranked[best][0] + ranked[best + 1][0]) / 2, 0.2), 0.8), abs=1e-6)
    for x in toxicity.score(docs, chain).collect():
        low = probability(models[0], own[x.doc_id], [])
        high = probability(models[1], own[x.doc_id], [low])
        assert (x.p_low_quality, x.p_toxic) == pytest.approx((low, high), abs=1e-6) and x.toxic == (x.p_toxic >= chain.threshold)


def test_fit_is_near_the_best_penalised_loss():
    """The loss of plain small steps, very many of them, over dense columns; labels noisy enough for weights to stay small."""
    r = np.random.Generator(np.random.PCG64(3))
    x = (r.random((80, 12)) < 0.4).astype(float)
    before = r.normal(size=(80, 1))
    y = (x[:, 0] + 0.7 * before[:, 0] + r.normal(size=80) * 1.5 > 0.6).astype(float)
    doc, feature = np.nonzero(x)
    got = toxicity.fit(doc, feature, before, y)
    weights = np.zeros(12)
    weights[got.index] = got.weight

    def loss(w, c, b):
        z = x @ w + before @ c + b
        return float(np.mean(np.logaddexp(0, z) - y * z) + toxicity.PENALTY * np.abs(w).sum())

    w, c, b = np.zeros(12), np.zeros(1), 0.0
    for _ in range(30_000):
        e = (1 / (1 + np.exp(-(x @ w + before @ c + b))) - y) / 80
        w, c, b = w - 0.5 * (x.T @ e), c - 0.5 * (before.T @ e), b - 0.5 * e.sum()
        w = np.sign(w) * np.maximum(np.abs(w) - 0.5 * toxicity.PENALTY, 0)
    assert loss(weights, got.chain, got.constant) <= loss(w, c, b) * 1.02 + 1e-4


def test_chain_without_labels(spark, docs):
    chain = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not any(r.toxic for r in toxicity.score(docs, chain).collect())


# language model


@pytest.mark.parametrize("frequent", [1 << 18, 20])
def test_base_scores_match_counts(docs, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    stream = {k: words(t) + [None] for k, (_, t) in enumerate(rows())}
    held = {k: zlib.crc32(str(i).encode()) % 7 == 2 for k, (i, _) in enumerate(rows())}
    c = Counter(w for k, s in stream.items() if not held[k] for w in s)
    total, distinct = sum(c.values()), len(c)
    expected = sorted((i, held[k], len(stream[k]), sum(c[w] > 0 for w in stream[k]), total, round(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in stream[k]), 6)) for k, (i, _) in enumerate(rows()))
    got = lm.scored(docs).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_model_is_a_distribution():
    tokens = np.arange(1, 6000, dtype=np.int64)
    model = lm.Model(tokens, np.maximum(1, 3000 - tokens), int(np.maximum(1, 3000 - tokens).sum()), len(tokens))
    model.weights = [np.random.Generator(np.random.PCG64(k)).normal(0, 0.3, w.shape).astype(np.float32) for k, w in enumerate(model.weights)]
    context = np.repeat(np.array([11 << model.bits | 22], dtype=np.uint64), lm.VOCABULARY + 1)
    p = 10 ** lm.log10_probabilities(model, context, np.append(np.arange(lm.VOCABULARY), -1))
    assert math.isclose(p.sum(), 1, rel_tol=1e-4)


def test_training_helps(spark):
    lines = [(k, "red apples fall and green pears stay " * 12, None, None, 0) for k in range(60)]
    got = lm.scored(spark.createDataFrame(lines, SCHEMA)).where("held_out").collect()
    assert got and all(r.score > r.base_score for r in got)


def test_all_training_documents_give_gradients(spark):
    # over 1.5 million tokens, all in copies of one text
    text = "red apples fall and green pears stay " * 2500
    documents = spark.range(0, 90, 1, 4).select(F.lit(text).alias("text"))
    own = Counter(lm.tokens([text.encode()])[0].view(np.int64).tolist())
    counts = spark.createDataFrame([(t, n * 90) for t, n in own.items()], "token long, n long")
    model = lm.train(documents, counts)
    stream, bounds = lm.tokens([text.encode()])
    p = lm.log10_probabilities(model, lm.contexts(stream, bounds, model.bits), model.find(stream)[1])
    assert np.abs(model.weights[1]).max() > 0.1 and p.mean() > -0.1


def test_model_grows_with_counts():
    n = np.maximum(1, 40_000_000 // np.arange(1, 20_001))
    model = lm.Model(np.arange(1, 20_001, dtype=np.int64), n, int(n.sum()), len(n))
    assert model.side**2 > lm.VOCABULARY and model.rows > lm.ROWS
    context = np.repeat(np.array([11 << model.bits | 22], dtype=np.uint64), model.side**2 + 1)
    assert math.isclose((10 ** lm.log10_probabilities(model, context, np.append(np.arange(model.side**2), -1))).sum(), 1, rel_tol=1e-4)


def test_masses_match_token_by_token_sums(spark):
    """Gathered contexts, dealt over buckets and tasks, against sums over the tokens of the texts."""
    texts = [documents()[k][1] for k in (0, 3, 9, 11)] + [None, "", "one"]
    raw = [(t or "").encode() for t in texts]
    stream, bounds = lm.tokens(raw)
    token, n = np.unique(stream.view(np.int64), return_counts=True)
    model = lm.Model(token, n, int(n.sum()), len(n))
    model.weights = [np.random.Generator(np.random.PCG64(k)).normal(0, 0.3, w.shape).astype(np.float32) for k, w in enumerate(model.weights)]
    context, place = lm.contexts(stream, bounds, model.bits), model.find(stream)[1]
    cls = np.where(place >= 0, place // model.side, model.side)
    seen, mass = [np.zeros(w.shape) for w in model.weights], [np.zeros(w.shape) for w in model.weights]
    p = lm._softmax(lm._logits(model.weights[0], lm._rows(model, context), model.class_bias))
    q = lm._softmax(lm._logits(model.weights[1], lm._class_rows(model, context, cls), model.member_bias[np.minimum(cls, model.side - 1)]))
    for k in range(len(stream)):
        for row in lm._rows(model, context)[k]:
            seen[0][row, cls[k]] += 1
            mass[0][row] += p[k]
        if place[k] >= 0:
            for row in lm._class_rows(model, context, cls)[k]:
                seen[1][row, place[k] % model.side] += 1
                mass[1][row] += q[k]
    shared = spark.sparkContext.broadcast(model)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    held = frame.mapInArrow(lm._dealt(shared, 5), "bucket long, entries binary").repartition(4, "bucket").mapInArrow(lm._gathered, "size long, entries binary").persist()
    shapes = [w.shape for w in model.weights]
    for got, want in ((lm._sums(held, 1, model, lm.observed, [*shapes, shapes[1]]), seen), (lm._sums(held, 1, model, lm.expected, shapes), mass)):
        assert all(np.allclose(x, y, rtol=1e-3, atol=1e-3) for x, y in zip(got, want, strict=False))
    model.weights = [np.zeros_like(w) for w in model.weights]
    entries = [lm.unpacked(r.entries) for r in held.collect()]
    assert all(np.allclose(x, y, rtol=1e-3, atol=1e-3) for x, y in zip(lm.expected(model, entries), lm.expected_at_zero(model, lm.observed(model, entries)), strict=True))


def test_entries_are_packed_without_loss():
    for keys in ([], [0], [5, 6, 2**50], [2**40]):
        keys, n = np.array(keys, dtype=np.uint64), np.arange(1, len(keys) + 1) * 300
        assert [x.tolist() for x in lm.unpacked(lm.packed(keys, n))] == [keys.tolist(), n.tolist()]


def test_model_of_nothing(none):
    assert lm.scored(none).count() == 0


def test_words_of_regular_patterns_are_no_window(spark):
    """Two words that every sum of bytes times powers takes for equal: the benchmark has one, a document the other."""
    text = "a"
    for _ in range(10):
        text += text.translate(str.maketrans("ab", "ba"))
    other = text.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, text), (2, other), (3, None), (4, f"x {text} y")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", text)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.contaminated) for r in decontaminate.digests(decontaminate.contamination(docs, bench)).collect()}
    assert got == {1: (1, True), 2: (0, False), 3: (0, False), 4: (1, True)}


def test_blocks_one_after_another_keep_the_same_documents(spark):
    rows = [(r[0], r[1], "mine") for r in documents()] + [(None, "a b c d e f g h i j k", "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hit string")
    items = [(f"i{k}", t) for k, t in enumerate([documents()[0][1], "a b c d e f g h i j", documents()[45][1], "one"])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (10**6, 7):
        kept = decontaminate.decontaminated(docs, bench, block)
        assert kept.columns == docs.columns
        ids = sorted(str(r.doc_id) for r in kept.collect())
        whole = ids if block > 7 else whole
        assert ids == whole
    hit = {r.doc_id for r in decontaminate.digests(decontaminate.contamination(docs, bench, 7)).where("contaminated").collect()}
    assert hit and sorted(str(i) for i, *_ in rows if i not in hit) == whole
