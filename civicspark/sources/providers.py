"""Models behind interfaces: embedding, reranking, text recognition.

The defaults are deterministic and need no network: a hash embedding, and a
reranker that keeps the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Unit vectors that depend on the words of a text only."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


def embedded(inputs: DataFrame, text: str, embedder: Embedder, batch: int = 16, tries: int = 3) -> DataFrame:
    """``inputs`` with their ``embedding``: batches of ``batch`` texts, tried again if the provider fails."""
    schema = StructType([*inputs.schema.fields, StructField("embedding", ArrayType(DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            texts = frame[text].fillna("").tolist()
            for lo in range(0, len(texts), batch):
                for attempt in range(tries):
                    try:
                        vectors += embedder.embed(texts[lo : lo + batch])
                        break
                    except ConnectionError:
                        if attempt == tries - 1:
                            raise
            yield frame.assign(embedding=vectors)

    return inputs.mapInPandas(run, schema)


def recognized(pages: DataFrame, cache: DataFrame, recognize, key: str = "page_hash") -> DataFrame:
    """Text of scanned pages: from the cache where it is, else from ``recognize(bytes) -> str``; a page without content has none."""
    missing = pages.join(cache.select(key), key, "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "text": [None if x is None else recognize(x) for x in frame["content"]]})

    return cache.select(key, "text").unionByName(missing.select(key, F.col("content")).mapInPandas(run, f"{key} string, text string"))


def fetched(urls: DataFrame, fetch, tries: int = 3) -> DataFrame:
    """``url`` and ``body`` of each distinct URL, fetched in the partitions side by side; a URL that fails ``tries`` times has a null body and its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url in frame["url"]:
                error = None
                for _ in range(tries):
                    try:
                        rows.append((url, fetch(url), None))
                        break
                    except (ConnectionError, TimeoutError) as e:
                        error = str(e)
                else:
                    rows.append((url, None, error))
            yield pd.DataFrame(rows, columns=["url", "body", "error"])

    return urls.select("url").distinct().mapInPandas(run, "url string, body string, error string")
