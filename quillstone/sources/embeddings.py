"""Embedding providers. The built-in one hashes character trigrams (FNV-1a), needs no service and gives unit vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The hash's offset and prime.
OFFSET, PRIME = 2166136261, 16777619


class Provider(Protocol):
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Trigrams:
    """Counts of hashed character trigrams of the lowered text, as a unit vector."""

    def __init__(self, dims: int = 384):
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, t in enumerate(texts):
            codes = np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            if len(codes) < 3:
                continue
            h = np.full(len(codes) - 2, OFFSET, np.uint64)
            for k in range(3):
                h = (h ^ codes[k : len(codes) - 2 + k]) * np.uint64(PRIME) & np.uint64(0xFFFFFFFF)
            out[row] = np.bincount((h % np.uint64(self.dims)).astype(np.int64), minlength=self.dims)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


def embedded(df: DataFrame, key: str, column: str, provider: Provider | None = None, batch: int = 64) -> DataFrame:
    """(key, embedding) of a text column, in small batches; null texts give zero vectors."""
    provider = provider or Trigrams()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                v = provider.embed([t or "" for t in part[column].to_pylist()]).astype(np.float32)
                cuts = pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part[key], pa.ListArray.from_arrays(cuts, pa.array(v.ravel()))], [key, "embedding"])

    return df.select(key, column).mapInArrow(run, f"{key} {kind}, embedding array<float>")
