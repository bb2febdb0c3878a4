"""MinHash near-duplicates: documents whose sets of 2-word shingles are at least 0.8 similar, by banded signatures and Bayesian tests.

A signature has a minimum per hash function over a set's shingles; two sets agree in each with the probability of their
similarity. Signatures are cut into BANDS bands of ROWS minima; sets that share a band are candidates. At similarity t a pair
shares none with the chance (1 - t**ROWS)**BANDS, 4e-9 here. Candidates are then compared batch by batch of minima: after m
agreements among n, and with all similarities held equally likely before, the posterior chance of a similarity of t or more is
that of at most m successes in n + 1 trials of chance t; where it is below MISS the pair is dropped, and so most candidates are
after the first batch. (That a band is shared already speaks for a pair, so it only ever adds to the agreements.) Those that
stay are verified on the full sets of their texts.

What groups cost, how equal sets are one node, and how links become classes is the join's that `jaccard` has; see there. Keys of
a band are kept where more than one set has them; the set with most company stands for a key's group, and members are held
against it, then, where classes differ still, against each other in blocks. So no link between different texts is lost but by the
two chances above, and a group of copies costs a link per member.

Defined cases: as in `jaccard`, but that a text of one word is a set of that word alone; a null doc_id is the
smallest id, so such a document is kept, and its class has a null component_id; of rows that share a doc_id all are kept, or none; an empty
table gives no rows; columns other than doc_id and text are not looked at. A text is held by one task, however long it is.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .jaccard import may_match
from .textnp import _U, mixed

N, PERCENT = 2, 80
ROWS, BANDS = 6, 64
#: Minima of a signature that pairs are compared by, and how many at a time; the chance, at most, that a test drops a similar pair.
COMPARED, BATCH, MISS = 128, 32, 1e-9
#: Shingles that are hashed at once: their working space stays in a core's cache.
HASHED = 1 << 15

_ODD = np.random.Generator(np.random.PCG64(20251107)).integers(0, 2**31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(set, hash function): the least hash of each set's shingles; of an empty set, the greatest number there is."""
    out = np.full((len(bounds) - 1, len(_ODD)), 2**32 - 1, dtype=np.uint32)
    filled = np.flatnonzero(np.diff(bounds) > 0)
    at = 0
    while at < len(filled):
        to = max(at + 1, int(np.searchsorted(bounds[filled], bounds[filled[at]] + HASHED, "right")) - 1)
        own = filled[at:to]
        first = bounds[own[0]]
        part = (values[first : bounds[own[-1] + 1]] >> _U(32)).astype(np.uint32)
        begins = bounds[own] - first
        for k, odd in enumerate(_ODD):
            out[own, k] = np.minimum.reduceat(part * odd, begins)
        at = to
    return out


def signatures(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Sixteen bits of each of the minima that pairs are compared by."""
    low = (mixed(minima(values, bounds)[:, :COMPARED].astype(_U)) & _U(0xFFFF)).astype(np.uint16)
    return [x.tobytes() for x in low]


def band_keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) for each band of each set that isn't empty."""
    filled = np.flatnonzero(np.diff(bounds) > 0)
    own = minima(values, bounds)[filled].reshape(len(filled), BANDS, ROWS)
    key = np.tile(np.arange(BANDS, dtype=_U), (len(filled), 1))
    for k in range(ROWS):
        key = mixed(key * _U(0x9E3779B97F4A7C15) + own[:, :, k])
    return np.repeat(filled, BANDS), key.reshape(-1)


@lru_cache(maxsize=None)
def least_agreements(n: int) -> int:
    """How many of n minima must agree that a similarity of PERCENT is not ruled out, with a posterior chance of MISS."""
    t, below = PERCENT / 100, 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below >= MISS:
            return m
    return n


def _undecided(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the pairs of signatures pass the tests after each batch."""
    open_ = np.arange(len(left))
    agree = np.zeros(len(left), dtype=np.int64)
    for at in range(0, COMPARED, BATCH):
        agree[open_] += (left[open_, at : at + BATCH] == right[open_, at : at + BATCH]).sum(axis=1)
        open_ = open_[agree[open_] >= least_agreements(at + BATCH)]
    out = np.zeros(len(left), dtype=bool)
    out[open_] = True
    return out


def _stacked(signs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signs), np.uint16).reshape(len(signs), COMPARED)


def near_by_signature(n1: np.ndarray, n2: np.ndarray, s1: list[bytes], s2: list[bytes]) -> np.ndarray:
    """Which pairs of sets neither sizes nor the sequential tests rule out."""
    return may_match(n1, n2, PERCENT) & _undecided(_stacked(s1), _stacked(s2))


def rows_by_signature(n: np.ndarray, signs: list[bytes]):
    """(x, right) -> those of the sets `right` of a block that neither sizes nor the tests rule out beside set x."""
    all_ = _stacked(signs)

    def near(x: int, right: np.ndarray) -> np.ndarray:
        right = right[may_match(n[right], n[x], PERCENT)]
        return right[_undecided(np.broadcast_to(all_[x], (len(right), COMPARED)), all_[right])]

    return near


class MinHash(jaccard.Join):
    """The join by banded signatures."""

    n, percent = N, PERCENT
    sketches, keys = staticmethod(signatures), staticmethod(band_keys)
    near, rows_near = staticmethod(near_by_signature), staticmethod(rows_by_signature)

    def n_keys(self) -> int:
        return BANDS * self.nodes.count()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document: kept is the one with the smallest doc_id of each class."""
    return jaccard.similar(documents, by=MinHash).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents, with all their columns, without those that a document with a smaller doc_id stands for."""
    return jaccard.one_of_each(documents, by=MinHash)


#: Shared shingles and a closure over links; for tables in which each doc_id stands once.
SQL = r"""WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) END AS g FROM t),
x AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.g))
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM c"""
