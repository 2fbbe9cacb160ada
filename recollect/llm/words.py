"""Words of mixed English and Chinese text, hashed in numpy batches.

A word is one Han character, or an unbroken run of other letters or digits; case,
punctuation and spacing do not count.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HAN = "〇㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
WORD = re.compile(rf"[{HAN}]|[^\W_{HAN}]+")
U = np.uint64


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Vocabulary(dict):
    """Word -> 64-bit hash. Emptied when it grows beyond ``limit`` entries; hashes don't depend on it."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def hashed(texts: list, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each text. A null has none."""
    rows = [WORD.findall(x.lower()) if x else () for x in texts]
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((vocabulary[w] for r in rows for w in r), U, int(counts.sum()))
    return flat, counts


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (murmur3's)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets(counts).astype(np.int32)), pa.array(values))


def sampled(df: DataFrame, keys: list, rows: int, most: int) -> DataFrame:
    """About ``most`` of ``rows`` rows (all, if there are fewer): those whose hash of the keys lies under a threshold.

    Each row is kept or not by itself, so nothing is sorted or gathered; the expected size is at most ``most``.
    """
    if rows <= most:
        return df
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int(most / rows * (1 << 40)))


def slices(batch: pa.RecordBatch, column: str, most_chars: int = 2_000_000):
    """Parts of a batch with a bounded amount of text, so that a worker's memory stays bounded."""
    texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
    start, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x or "") + 1
        if size >= most_chars:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield batch.slice(start), texts[start:]
