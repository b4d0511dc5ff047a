"""Embedding of stale texts by a pluggable model, one instance a Python worker."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.store import stale


class EmbeddingProvider(Protocol):
    """What a model has to offer. A query may be embedded with an instruction that documents do not get."""

    model_version: str
    dim: int

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class HashingProvider:
    """Deterministic feature hashing of words: no model file, unit vectors."""

    def __init__(self, dim: int = 64):
        self.dim, self.model_version = dim, f"hashing#f32#sum@{dim}"

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dim))
        for row, t in zip(out, texts):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                row[h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([text])[0]


def embed_stale(records: DataFrame, make: Callable[[], EmbeddingProvider], version: str, batch: int = 32) -> DataFrame:
    """(id, vector, model_version) of records (id, composite_text, model_version) that need a vector.

    A batch that fails is left out, so its records stay stale and are tried again by the next pass.
    """

    def run(batches):
        provider = make()
        for pdf in batches:
            ids, vectors = [], []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    made = provider.embed_documents(part["composite_text"].tolist())
                except RuntimeError:
                    continue
                ids += part["id"].tolist()
                vectors += [v.astype("float32") for v in made]
            yield pd.DataFrame({"id": ids, "vector": vectors, "model_version": [version] * len(ids)})

    todo = records.where(stale(F.col("model_version"), version, F.col("composite_text")))
    return todo.select("id", "composite_text").mapInPandas(run, "id string, vector array<float>, model_version string")
