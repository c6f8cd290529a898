"""Vectors of texts from a provider that the caller brings: a function from a list of
texts to a list of vectors.  It runs inside tasks, on batches of texts of like length.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Provider = Callable[[list[str]], list[list[float]]]

#: Dimensions, most tokens, and what goes before a query and a document.
MODELS = {
    "gte-small": (384, 512, "", ""),
    "all-MiniLM-L6-v2": (384, 256, "", ""),
    "gte-base": (768, 512, "", ""),
    "bge-small-en-v1.5": (384, 512, "Represent this sentence: ", "Represent this sentence: "),
    "bge-base-en-v1.5": (768, 512, "Represent this sentence: ", "Represent this sentence: "),
    "nomic-embed-text-v1.5": (768, 8192, "search_query: ", "search_document: "),
    "multilingual-e5-small": (384, 512, "query: ", "passage: "),
}


def hashing_provider(dimensions: int) -> Provider:
    """Signed counts of words by hash: a vector without any model."""

    def vectors(texts: list[str]) -> list[list[float]]:
        import xxhash

        out = []
        for text in texts:
            v = [0.0] * dimensions
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word.encode())
                v[h % dimensions] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out

    return vectors


def _tried(provider: Provider, texts: list[str], tries: int, wait: float) -> list[list[float]] | None:
    """The vectors, or None when all tries fail; each wait is twice the last."""
    for n in range(tries):
        try:
            return provider(texts)
        except Exception:  # noqa: BLE001  whatever a provider raises
            if n + 1 < tries:
                time.sleep(wait * 2**n)
    return None


def vectors_of(provider: Provider, texts: list[str], batch: int, tries: int, wait: float) -> list[list[float] | None]:
    """In the order of the texts.  Batches hold texts of like length; where one fails its
    texts go one by one, and those that fail alone have none."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    out: list[list[float] | None] = [None] * len(texts)
    for a in range(0, len(order), batch):
        part = order[a : a + batch]
        found = _tried(provider, [texts[i] for i in part], tries, wait)
        if found is None:
            found = [x[0] if (x := _tried(provider, [texts[i]], tries, wait)) else None for i in part]
        for i, v in zip(part, found, strict=True):
            out[i] = v
    return out


def embedded(df: DataFrame, text: str, provider: Provider, model: str | None = None, query: bool = False, batch: int = 16, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """``df`` with ``embedding``; rows whose text has no vector, or one of another size
    than the model's, are left out.  Null texts are empty ones."""
    size, _, before_query, before_doc = MODELS[model] if model else (None, None, "", "")
    prefix = before_query if query else before_doc

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [prefix + (t or "") for t in frame[text]]
            found = vectors_of(provider, texts, batch, tries, wait)
            keep = [v is not None and (size is None or len(v) == size) for v in found]
            if any(keep):
                yield frame[keep].assign(embedding=[v for v, k in zip(found, keep) if k])

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))
