"""Scores of language ID and of the maximum-entropy model against plain loops, from the documents to the last column."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitewright.llm import language, lm

from .helpers import SCHEMA, documents, prose

TEXTS = {
    "en": "the weather is fine and there are apples under the old tree near our house", "fr": "le temps est beau et il y a des pommes sous le vieil arbre près de la maison où été",
    "de": "das wetter ist schön und es gibt äpfel unter dem alten baum neben unserem haus über",
}


def test_language_scores_match_plain_loops(spark):
    rows = []
    for k in range(36):
        lang = sorted(TEXTS)[k % 3]
        w = TEXTS[lang].split()
        rows.append((k, " ".join(w[(k * j + j * j) % len(w)] for j in range(1, 9 + k % 5)).title(), lang if k % 7 else None, "s", 0))
    rows += [(50, None, "en", None, 0), (51, "123 !?", "fr", None, 0), (52, "Zyx qqq", "en", None, 0), (53, "été the", None, None, 0)]
    raw = language.pieces()
    pieces, longest = set(raw), max(map(len, raw))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    words = lambda t: re.findall(rb"[a-z\x80-\xff]+", (t or "").lower().encode())

    def ways(word, p):
        text = b" " + word
        return text, [(a, b, text[a:b]) for b in range(1, len(text) + 1) for a in range(max(0, b - longest), b) if text[a:b] in pieces], p

    def forward(text, own, p):
        alpha = [1.0] + [0.0] * len(text)
        for b in range(1, len(text) + 1):
            alpha[b] = alpha[b - 1] * language.BYTE_P + sum(alpha[a] * p[x] for a, e, x in own if e == b)
        return alpha

    models, prior = {}, Counter(lang for i, t, lang, *_ in rows if lang is not None and t is not None and not held(i))
    for name in prior:
        counts = Counter(w for i, t, lang, *_ in rows if lang == name and not held(i) for w in words(t))
        p = defaultdict(lambda: 1.0 / len(raw))
        for _ in range(language.ROUNDS):
            expected = Counter()
            for w, n in counts.items():
                text, own, _ = ways(w, p)
                alpha, beta = forward(text, own, p), [0.0] * len(text) + [1.0]
                for a in range(len(text) - 1, -1, -1):
                    beta[a] = beta[a + 1] * language.BYTE_P + sum(p[x] * beta[e] for s, e, x in own if s == a)
                for a, b, x in own:
                    expected[x] += n * alpha[a] * p[x] * beta[b] / alpha[-1]
            total = sum(expected.values()) + 0.01 * len(raw)
            p = defaultdict(lambda total=total: 0.01 / total, {x: (v + 0.01) / total for x, v in expected.items()})
        models[name] = p
    for r in language.identified(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        logs = {name: math.log(prior[name]) + sum(math.log(forward(*ways(w, p))[-1]) for w in words(text)) for name, p in models.items()}
        best = max(sorted(logs), key=logs.get)
        assert r.held_out == held(r.doc_id)
        if not words(text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            mass = sum(math.exp(x - logs[best]) for x in logs.values())
            assert r.lang_pred == best and math.isclose(r.score, 1 / mass, rel_tol=1e-6)


def test_language_model_scores_match_plain_loops(spark):
    """The trained model's weights, walked token by token: class, token within its class, and counts for what is rare."""
    rows = [(r[0], r[1]) for r in documents() if r[1] is None or len(r[1]) < 3000] + [(100 + k, prose(900 + k, 120, 150)) for k in range(30)] + [(None, "a b"), (200, "never seen words here"), (201, "never seen words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    seen = [t for i, t in rows if not held(i)]
    streams = {t: lm.tokens([(t or "").encode()]) for _, t in rows}
    counts = Counter(x for t in seen for x in streams[t][0].view("int64").tolist())
    model = lm.train(spark.createDataFrame([(t,) for t in seen], "text string"), spark.createDataFrame(list(counts.items()), "token long, n long"))
    total, distinct = sum(counts.values()), len(counts)
    place = dict(zip(model.token.tolist(), model.place.tolist(), strict=True))

    def log10(logits, k):
        top = max(logits)
        return (logits[k] - top - math.log(sum(math.exp(x - top) for x in logits))) / math.log(10)

    def score(t):
        stream, bounds = streams[t]
        out = 0.0
        for token, context in zip(stream.view("int64").tolist(), lm.contexts(stream, bounds, model.bits), strict=True):
            at = place.get(token, -1)
            cls = at // model.side if at >= 0 else model.side
            rows_ = lm._rows(model, context[None])[0]
            out += log10([float(b) + sum(float(model.weights[0][r, c]) for r in rows_) for c, b in enumerate(model.class_bias)], cls)
            if at >= 0:
                within = lm._class_rows(model, context[None], np.array([cls]))[0]
                out += log10([float(b) + sum(float(model.weights[1][r, c]) for r in within) for c, b in enumerate(model.member_bias[cls])], at % model.side)
            else:
                out += math.log10((counts[token] + 1) / (model.rare_total + model.rare_distinct + 1))
        return out

    got = lm.scored(df).collect()
    assert len(got) == len(rows)
    checked = 0
    for r in got:
        same = [t for i, t in rows if i == r.doc_id]
        base = lambda t: sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in streams[t][0].view("int64").tolist())
        t = min(same, key=lambda t: abs(base(t) - r.base_score))
        assert r.train_tokens == total and r.n_tokens == len(streams[t][0]) and r.n_known == sum(x in counts for x in streams[t][0].view("int64").tolist())
        assert math.isclose(r.base_score, base(t), rel_tol=1e-9, abs_tol=1e-9)
        if len(streams[t][0]) < 200 and checked < 25:
            assert math.isclose(r.score, score(t), rel_tol=1e-3, abs_tol=1e-3), r
            checked += 1
    assert checked == 25


@pytest.mark.parametrize("text", ["a" * 100, "aé" * 60])
def test_parts_of_long_words_are_hashed_as_words(text):
    """In learning, words are cut each 40 bytes: a part is the same word wherever it stands."""
    words, _, inverse, _ = language._distinct([text.encode(), text.encode()[:40].decode(errors="ignore").encode()], cut=True)
    assert sorted(set(words)) == sorted({text.encode()[k : k + 40] for k in range(0, len(text.encode()), 40)} | {text.encode()[:40].decode(errors="ignore").encode()})
    assert len(inverse) == -(-len(text.encode()) // 40) + 1
