"""Toxicity by classifier chains.

Categories stand in an order. Each has a linear model over hashed words, and over the probabilities of all categories before it.
So that a later model doesn't trust earlier ones more than they deserve, these probabilities are, in training, out-of-fold: of
each document they come from a model that was trained without it. Models are fitted by Spark tasks, one for each category, fold
and the whole sample, with an L1 penalty that leaves few weights; scoring adds up the weights of a text's distinct words.

Categories here: `low_quality` (quality 0), then `toxic`. The models learn from a sample of labelled rows of about SAMPLE
documents (all, if there are fewer), which is the bound on what is gathered and broadcast; every document is scored whole.

A word's features are itself and its first five bytes, so that inflected and unseen forms count too.

Defined cases: a null or blank text has no features, probability 0 in each category and isn't toxic; labels that are null, or whose
document isn't there, teach nothing; of a doc_id labelled more than once the largest labels count; with no labels at all nothing
is toxic; repeated rows get equal results each; an empty table gives no rows; only doc_id and text are looked at.
A text is looked at whole by one task, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written
from .textnp import _U, byte_table, column, mixed, text_chunks, words_of

SAMPLE = 12_000
FOLDS = 3
BITS = 18
PREFIX = 5
LETTERS = byte_table({*range(0x61, 0x7B), *range(0x80, 0x100)})
PENALTY, STEPS = 2e-4, 200


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the distinct hashed features of each text, sorted."""
    found = words_of([None if t is None else t.decode().lower().encode() for t in texts], LETTERS)
    text = np.repeat(np.arange(len(texts)), np.diff(found.bounds))
    whole = found.hashes()
    ends = found.ends
    found.ends = np.minimum(ends, found.starts + PREFIX)
    long_ = ends > found.ends
    begins = mixed(found.hashes() ^ _U(0x9FB21C651E98DF25))
    mask = _U((1 << BITS) - 1)
    both = np.concatenate((text << BITS | (whole & mask).astype(np.int64), (text << BITS | (begins & mask).astype(np.int64))[long_]))
    both = np.unique(both)
    return both >> BITS, both & ((1 << BITS) - 1)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches):
        text, feature = features(texts)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([column(batch, "_id"), column(batch, "labels"), lists], names=["_id", "labels", "features"])


class Linear:
    """A logistic model: sparse weights over features, dense ones over earlier categories, and a constant."""

    def __init__(self, index: np.ndarray, weight: np.ndarray, chain: np.ndarray, constant: float):
        self.index, self.weight, self.chain, self.constant = index, weight, chain, constant

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.index] = self.weight
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(doc: np.ndarray, feature: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Accelerated proximal gradient steps on the logistic loss with an L1 penalty; features of under 3 documents are left out."""
    n = len(y)
    used = np.flatnonzero(np.bincount(feature, minlength=1 << BITS) >= 3)
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    keep = place[feature] >= 0
    doc, at = doc[keep], place[feature[keep]]
    df = np.maximum(1, np.bincount(at, minlength=len(used)))
    # features are scaled by their frequency: else frequent words alone set the length of a step
    scale = 1 / np.sqrt(df / n)
    value = scale[at]
    rows = np.bincount(doc, value**2, minlength=n) + (earlier**2).sum(axis=1) + 1
    # a few power steps for the largest curvature
    v = np.random.Generator(np.random.PCG64(7)).random(len(used) + earlier.shape[1] + 1)
    m = len(used)

    def forward(w):
        return np.bincount(doc, value * w[at], minlength=n) + earlier @ w[m:-1] + w[-1]

    def backward(r):
        return np.concatenate((np.bincount(at, value * r[doc], minlength=m), earlier.T @ r, [r.sum()]))

    top = float(rows.max())
    for _ in range(15):
        v = backward(forward(v / np.linalg.norm(v)))
        top = float(np.linalg.norm(v))
    step = 4 * n / max(top, 1e-9)
    w = np.zeros(m + earlier.shape[1] + 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    z, t = w, 1.0
    penalty = np.concatenate((PENALTY * scale, np.zeros(earlier.shape[1] + 1)))
    for _ in range(STEPS):
        g = backward(_sigmoid(forward(z)) - y) / n
        new = z - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    some = np.flatnonzero(w[:m])
    return Linear(used[some], w[some] * scale[some], w[m:-1].copy(), float(w[-1]))


def _scores(model: Linear, doc: np.ndarray, feature: np.ndarray, earlier: np.ndarray, n: int) -> np.ndarray:
    return _sigmoid(np.bincount(doc, model.dense()[feature], minlength=n) + earlier @ model.chain + model.constant)


_FITTED = "_id long, p double, index array<long>, weight array<double>, chain array<double>, constant double"


def _fit_group(rank: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        """Fold f is predicted by what was trained without it; the group of number FOLDS trains on all, and gives its weights."""
        rows = rows.sort_values("_id", kind="stable").reset_index(drop=True)
        lengths = np.array([len(x) for x in rows["features"]])
        feature = np.concatenate([np.asarray(x, dtype=np.int64) for x in rows["features"]]) if len(rows) else np.zeros(0, dtype=np.int64)
        doc = np.repeat(np.arange(len(rows)), lengths)
        y = np.array([x[rank] for x in rows["labels"]], dtype=float)
        earlier = logit(np.array([list(x) for x in rows["earlier"]], dtype=float).reshape(len(rows), rank))
        whole = key[0] == FOLDS
        out = (rows["fold"] == key[0]).to_numpy()
        train = np.flatnonzero(~out)
        place = np.full(len(rows), -1)
        place[train] = np.arange(len(train))
        own = place[doc] >= 0
        none = [[] for _ in range(int(out.sum()))]
        model = fit(place[doc[own]], feature[own], earlier[train], y[train]) if len(train) else Linear(np.zeros(0, dtype=int), np.zeros(0), np.zeros(rank), -9.0)
        if whole:
            return pd.DataFrame({"_id": [None], "p": [None], "index": [model.index], "weight": [model.weight], "chain": [model.chain], "constant": [model.constant]})
        p = _scores(model, doc, feature, earlier, len(rows))
        return pd.DataFrame({"_id": rows["_id"][out], "p": p[out], "index": none, "weight": none, "chain": none, "constant": 0.0})

    return run


class Chain:
    def __init__(self, names: list[str], models: list[Linear], threshold: float):
        self.names, self.models, self.threshold = names, models, threshold


def categories() -> dict[str, Column]:
    """Name -> label column, in the order of the chain; the last one is what documents are rejected for."""
    return {"low_quality": (F.col("quality") == 0), "toxic": (F.col("toxic") == 1)}


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, chain: dict[str, Column] | None = None) -> Chain:
    chain = chain or categories()
    named = labels.select(F.col("doc_id").cast("long").alias("_id"), F.array(*[c.cast("int") for c in chain.values()]).alias("labels")).where(F.col("_id").isNotNull() & ~F.exists("labels", lambda x: x.isNull()))
    total = named.count()
    drawn = named.where(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1_000_000)) * max(1, total) < 1_000_000 * sample).groupBy("_id").agg(F.max("labels").alias("labels"))
    # about `sample` rows at most, so they may be broadcast, and no text is shuffled
    text = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(drawn), "_id")
    # of texts under one doc_id the one with the least features, whichever comes first
    least = text.mapInArrow(_featured, "_id long, labels array<int>, features array<int>").groupBy("_id").agg(F.min(F.struct("features", "labels")).alias("row"))
    base = Written(least.select("_id", "row.labels", "row.features"), "toxicity-sample").df
    base = base.withColumn("fold", F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(FOLDS)).cast("int")).withColumn("earlier", F.array().cast("array<double>"))
    models, threshold = [], 0.5
    for rank, _ in enumerate(chain):
        groups = base.withColumn("model", F.explode(F.array(*map(F.lit, range(FOLDS + 1)))))
        fitted = Written(groups.groupBy("model").applyInPandas(_fit_group(rank), _FITTED), "toxicity-models").df
        row = fitted.where(F.col("_id").isNull()).first()
        models.append(Linear(np.array(row["index"], dtype=np.int64), np.array(row["weight"]), np.array(row["chain"]), row["constant"]) if row else Linear(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(rank), -9.0))
        oof = fitted.where(F.col("_id").isNotNull()).select("_id", "p")
        base = base.join(oof, "_id").withColumn("earlier", F.concat("earlier", F.array("p")))
        if rank + 1 == len(chain):
            told = base.select(F.element_at("labels", -1).alias("y"), "p").toPandas()
            threshold = best_threshold(told["p"].to_numpy(), told["y"].to_numpy())
        base = Written(base.drop("p"), "toxicity-sample").df
    return Chain(list(chain), models, threshold)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap in the probabilities at which F1 is best, of out-of-fold predictions; at least 0.2, at most 0.8."""
    if not y.any():
        return 0.8
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order[k]] + below) / 2, 0.2, 0.8))


def _judged(shared):
    def probabilities(texts: list[bytes | None]) -> np.ndarray:
        chain = shared.value
        text, feature = features(texts)
        earlier = np.zeros((len(texts), 0))
        blank = np.bincount(text, minlength=len(texts)) == 0
        for dense, model in zip(_dense(chain), chain.models, strict=True):
            p = _sigmoid(np.bincount(text, dense[feature], minlength=len(texts)) + logit(earlier) @ model.chain + model.constant)
            earlier = np.column_stack((earlier, p))
        earlier[blank] = 0.0
        return earlier

    return probabilities


def _dense(chain: Chain) -> list[np.ndarray]:
    if not hasattr(chain, "dense"):
        chain.dense = [m.dense() for m in chain.models]
    return chain.dense


def score(documents: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> of each category of the chain, and toxic: whether the last one reaches the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(chain)
    probabilities = _judged(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            p = probabilities(texts)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(p[:, -1] >= shared.value.threshold)], names=["doc_id", *[f"p_{c}" for c in shared.value.names], "toxic"])

    schema = ", ".join(["doc_id long", *[f"p_{c} double" for c in chain.names], "toxic boolean"])
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def not_toxic(documents: DataFrame, chain: Chain) -> DataFrame:
    """The documents, with all their columns, that the chain doesn't reject."""
    shared = documents.sparkSession.sparkContext.broadcast(chain)
    probabilities = _judged(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            yield batch.filter(pa.array(probabilities(texts)[:, -1] < shared.value.threshold))

    return documents.mapInArrow(run, documents.schema)
