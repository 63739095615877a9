"""Embedding as a column: a provider's function over batches of texts, and an offline stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashed_vectors(texts: list[str], size: int = 64) -> list[list[float]]:
    """Offline stand-in without semantics: signed hashes of words, at unit length (zero for no words)."""
    from zlib import crc32

    out = []
    for text in texts:
        v = np.zeros(size)
        for word in (text or "").lower().split():
            h = crc32(word.encode("utf-8", "surrogatepass"))
            v[h % size] += 1 if h >> 16 & 1 else -1
        out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
    return out


def embedded(text: Column, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 256) -> Column:
    """Vectors of a text column. `load` runs once per task and returns the provider's function."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for texts in parts:
            yield pd.Series([v for low in range(0, len(texts), batch) for v in embed(list(texts.iloc[low : low + batch]))])

    return run(text)
