"""Words of many texts at once, as numpy arrays: places and 64-bit hashes, computed without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

CHUNK = 1 << 20
#: Bytes that are hashed at once: their working space stays in a core's cache.
HASHED = 1 << 17
_U = np.uint64


def byte_table(pattern_bytes: set[int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(pattern_bytes)] = True
    return out


#: Bytes of words `[^\x20\x09-\x0D]+`, and of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased text.
BY_SPACE = byte_table(set(range(256)) - {0x20, *range(0x09, 0x0E)})
ALPHANUMERIC = byte_table({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)})

_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64)
_B = 0x9E3779B97F4A7C15
_powers = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base and of its inverse, mod 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_B, pow(_B, -1, 1 << 64))):
            factors = np.full(size, base, dtype=_U)
            factors[0] = 1
            _powers[k] = np.cumprod(factors)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Words:
    """Words of a list of texts. Text k has the words from bounds[k] to bounds[k + 1]; offsets[k] is its first byte in buf."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray

    def hashes(self, seed: int = 0) -> np.ndarray:
        """One 64-bit hash per word, the same wherever the word stands: the sum of a scrambled (byte, place in the word) of each byte.

        A sum of bytes times powers would make words of some regular patterns equal under every base. Long inputs go block by block.
        """
        out = np.empty(len(self.starts), dtype=_U)
        i = 0
        while i < len(out):
            first = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, first + HASHED, "right")))
            part = self.buf[first : int(self.ends[j - 1])]
            a, b = self.starts[i:j] - first, self.ends[i:j] - first
            place = np.arange(len(part)) - np.repeat(a, np.diff(a, append=len(part)))
            sums = np.zeros(len(part) + 1, dtype=_U)
            np.cumsum(mixed(((place.view(_U) << _U(8)) | part) * _U(_B) ^ _U(seed)), out=sums[1:])
            out[i:j] = sums[b] - sums[a]
            i = j
        return mixed(out)

    def ids(self) -> np.ndarray:
        """A number per word, equal where the words' bytes are equal, and only there: hashes propose, bytes decide."""
        _, first, inverse = np.unique(self.hashes(), return_index=True, return_inverse=True)
        size = self.ends - self.starts
        same = size == size[first[inverse]]
        before = np.cumsum(np.where(same, size, 0)) - np.where(same, size, 0)
        own = np.repeat((self.starts - before)[same], size[same]) + np.arange(int(size[same].sum()))
        other = np.repeat((self.starts[first[inverse]] - before)[same], size[same]) + np.arange(int(size[same].sum()))
        if same.all() and np.array_equal(self.buf[own], self.buf[other]):
            return inverse
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(self.buf[a:b].tobytes(), len(seen)) for a, b in zip(self.starts, self.ends, strict=True)], dtype=np.int64)


def words_of(texts: list[bytes | None], table: np.ndarray = BY_SPACE, lower: bool = True) -> Words:
    """Words of texts in UTF-8 (None: no words); `lower` lower-cases A-Z."""
    joined = b"\n".join(t or b"" for t in texts)
    buf = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)), out=offsets[1:])
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = table[buf]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return Words(buf, starts, ends, np.searchsorted(starts, offsets), offsets)


_ROLL = [_U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(64)]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for every run of n consecutive words, by its first word; runs across texts are there too."""
    if len(hashes) < n:
        return np.zeros(0, dtype=_U)
    total = hashes[: len(hashes) - n + 1] * _ROLL[0]
    for k in range(1, n):
        total = total + hashes[k : len(hashes) - n + 1 + k] * _ROLL[k]
    return mixed(total)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of record batches with about `limit` bytes of text each, and these texts as UTF-8."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()
        start = size = 0
        for k, t in enumerate(texts):
            size += len(t or b"") + 1
            if size >= limit or k + 1 == len(texts):
                yield batch.slice(start, k + 1 - start), texts[start : k + 1]
                start, size = k + 1, 0


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def frame(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def as_int64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def as_frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)
