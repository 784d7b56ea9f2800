"""Learned vectors of texts (U13): counts of letter trigrams, weighted by how few names have them, in the main directions of a dictionary.

Trigrams are hashed to ``PLACES``.  A randomised range finder takes the dictionary in three passes of sums: the document
frequency of each place; the product of the weighted counts' transpose with their random projection, repeated once to sharpen it; and the small
Gram matrix in the directions found.  What reaches the driver is a matrix of ``PLACES`` by ``WIDTH`` + ``SPARE``, whatever the dictionary's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES, WIDTH, SPARE = 4096, 96, 16
#: Sums that the driver adds up.
GROUPS = 8


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's trigrams, and how often each comes."""
    low = f"  {(text or '').lower()} "
    return np.unique([crc32(low[k : k + 3].encode()) % PLACES for k in range(len(low) - 2)], return_counts=True)


def _row(text: str | None, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's weighted counts at unit length: places and values."""
    at, n = _counts(text)
    x = (1 + np.log(n)) * weights[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


@dataclass(frozen=True, eq=False)
class Learned:
    """An embedder: ``weights`` of places and ``directions`` (places by width)."""

    weights: np.ndarray
    directions: np.ndarray

    def vector(self, text: str | None) -> np.ndarray:
        at, x = _row(text, self.weights)
        v = x @ self.directions[at]
        norm = np.sqrt(v @ v)
        return v / norm if norm else v

    def __call__(self, texts: pd.Series) -> list[list[float]]:
        return [self.vector(t).tolist() for t in texts]


def _summed(names: DataFrame, part, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``part`` over the names of each Arrow batch: partitions are summed by groups, and the groups on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for text in batch.column("name").to_pylist():
                part(total, text)
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for raw in batch.column("total"):
                total += np.frombuffer(raw.as_buffer()).reshape(shape)
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    few = names.mapInArrow(run, "total binary").repartition(GROUPS).mapInArrow(added, "total binary")
    return sum((np.frombuffer(r["total"]).reshape(shape) for r in few.collect()), np.zeros(shape))  # ``GROUPS`` rows


def fit(dictionary: DataFrame, name: str = "name", width: int = WIDTH, seed: int = 1) -> Learned:
    """Learn from the distinct names of ``dictionary``."""
    names = dictionary.select(F.trim(name).alias("name")).where("name <> ''").distinct()

    def seen(total: np.ndarray, text: str) -> None:
        total[_counts(text)[0]] += 1
        total[PLACES] += 1

    counts = _summed(names, seen, (PLACES + 1,))
    weights = np.log1p((counts[PLACES] - counts[:PLACES] + 0.5) / (counts[:PLACES] + 0.5))
    directions = np.random.default_rng(seed).standard_normal((PLACES, width + SPARE))
    for _ in range(2):
        now = directions

        def ranged(total: np.ndarray, text: str, now=now) -> None:
            at, x = _row(text, weights)
            total[at] += np.outer(x, x @ now[at])

        directions = np.linalg.qr(_summed(names, ranged, directions.shape))[0]

    basis = directions

    def gram(total: np.ndarray, text: str) -> None:
        at, x = _row(text, weights)
        v = x @ basis[at]
        total += np.outer(v, v)

    small = _summed(names, gram, (basis.shape[1],) * 2)
    _, vectors = np.linalg.eigh(small)  # by ascending value
    return Learned(weights, np.ascontiguousarray(basis @ vectors[:, ::-1][:, :width]))
