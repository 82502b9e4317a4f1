"""Embedding of texts by an encoder, for those rows only whose vectors are missing or stale."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import fingerprint, model_prefix


class Encoder(Protocol):
    """name: of the model. encode: a row of numbers for every text. Made in each Python worker, so it must be picklable."""

    name: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


_LOADED: dict[str, Encoder] = {}


class LazyEncoder:
    """An encoder that ``make`` makes on its first use in a Python worker, where it stays for all later tasks; only the recipe is sent."""

    def __init__(self, name: str, make: Callable[[], Encoder]):
        self.name, self.make = name, make

    def encode(self, texts: list[str]) -> np.ndarray:
        if self.name not in _LOADED:
            _LOADED[self.name] = self.make()
        return _LOADED[self.name].encode(texts)


class HashingEncoder:
    """Deterministic stand-in for a model: signed hashed words, at length one. The hashes are such that SQL has them too."""

    def __init__(self, name: str = "hashing-64", dim: int = 64):
        self.name, self.dim, self.known = name, dim, {}

    def place(self, word: str) -> tuple[int, int]:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            h = hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
            self.known[word] = int(h[:4], 16) % self.dim, 1 if h[4] >= "8" else -1
        return self.known[word]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                at, sign = self.place(w)
                out[i, at] += sign
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def missing(items: DataFrame, stored: DataFrame, encoder: Encoder, kind: str) -> DataFrame:
    """Items (id, text) with the fingerprint they need, of which ``stored`` has no vector."""
    return items.withColumn("fingerprint", fingerprint(encoder.name, kind, "id", "text")).join(stored.select("id", "fingerprint"), ["id", "fingerprint"], "left_anti")


def embed(items: DataFrame, encoder: Encoder, kind: str = "passage", batch: int = 32) -> DataFrame:
    """(id, embedding, fingerprint) of items (id, text)."""
    prefix = model_prefix(encoder.name, kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                rows = encoder.encode([prefix + (t or "") for t in part.text])
                rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"id": part.id, "embedding": list(rows.astype(np.float32)), "fingerprint": part.fingerprint})

    kind_of_id = items.schema["id"].dataType.simpleString()
    given = items.select("id", "text", fingerprint(encoder.name, kind, "id", "text").alias("fingerprint"))
    return given.mapInPandas(run, f"id {kind_of_id}, embedding array<float>, fingerprint string")


def embed_cached(items: DataFrame, stored: DataFrame, encoder: Encoder, kind: str = "passage", force: bool = False) -> DataFrame:
    """Vectors of all items: those in store whose fingerprint holds, and newly made ones; with ``force`` all anew."""
    if force:
        return embed(items, encoder, kind)
    valid = stored.join(items.select("id", fingerprint(encoder.name, kind, "id", "text").alias("fingerprint")), ["id", "fingerprint"], "left_semi")
    return valid.select("id", "embedding", "fingerprint").unionByName(embed(missing(items, stored, encoder, kind).select("id", "text"), encoder, kind))
