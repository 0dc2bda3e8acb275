"""Plug-in surface for encoders: a function from texts to vectors, run batch by batch; and a hashing encoder for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashing_encoder(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors from word hashes; blank texts give zero vectors."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[row, h % size] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)

    return encode


def with_vectors(rows: DataFrame, text: str, factory: Callable[[], Callable[[list[str]], np.ndarray]], name: str = "vec") -> DataFrame:
    """Adds the encoder's vector of a text column. The factory is sent to the workers, and makes the encoder once a task."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = factory()
        for batch in batches:
            yield pd.Series(list(encoder(batch.fillna("").tolist())))

    return rows.withColumn(name, vectors(text))
