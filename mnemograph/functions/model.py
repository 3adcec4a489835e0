"""Columns filled by a caller's model: embeddings and text.

The caller passes a plain function over a list of texts. It runs in Arrow batches on
the executors; a failing batch yields nulls and the error text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

EMBED_BATCH = 250


def embed_column(
    rows: DataFrame, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], batch: int = EMBED_BATCH
) -> DataFrame:
    """(id, embedding, error) for ``rows(id, text)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                vectors, error = [None] * len(part), None
                try:
                    vectors = [np.asarray(v, dtype=np.float32) for v in embed(list(part["text"]))]
                except Exception as exc:
                    error = str(exc)
                yield pd.DataFrame({"id": part["id"], "embedding": vectors, "error": error})

    return rows.select("id", "text").mapInPandas(run, "id string, embedding array<float>, error string")


def model_column(rows: DataFrame, ask: Callable[[Sequence[str], Sequence[str], int], Sequence[str]], max_tokens: int = 1024, batch: int = 16) -> DataFrame:
    """(id, text, error) for ``rows(id, system, prompt)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                texts, error = [None] * len(part), None
                try:
                    texts = list(ask(list(part["system"]), list(part["prompt"]), max_tokens))
                except Exception as exc:
                    error = str(exc)
                yield pd.DataFrame({"id": part["id"], "text": texts, "error": error})

    return rows.select("id", "system", "prompt").mapInPandas(run, "id string, text string, error string")


def hashed_words(dim: int = 64) -> Callable[[Sequence[str]], list[np.ndarray]]:
    """Stand-in embedder: signed feature hashing of words, unit length."""

    def embed(texts: Sequence[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                v[h % dim] += 1.0 if (h >> 32) & 1 else -1.0
            norm = np.sqrt(v @ v)
            out.append(v / norm if norm else v)
        return out

    return embed
