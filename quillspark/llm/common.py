"""What the operators of this subpackage share: reading tables, cutting lineage, hashing."""

from __future__ import annotations

import os

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.lineage import cut, cut_clean, release

__all__ = ["INVISIBLE", "TOKENIZER_DIR", "cut", "cut_clean", "hash64", "mix64", "pages", "release", "table"]

#: Where the public tokenizers' files lie unless the caller says otherwise.
TOKENIZER_DIR = os.environ.get("QUILLSPARK_TOKENIZERS", "/opt/tokenizers")

#: Code points that show nothing: soft hyphen, zero-width characters, direction marks, byte-order mark, variation selectors.
INVISIBLE = "­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(docs: DataFrame, kind: str | None = None) -> DataFrame:
    """(file, domain, kind, page, text, fetched_at), a row per page; failed parses and null texts have no row."""
    if kind is not None:
        docs = docs.where(F.col("kind") == kind)
    return docs.select("file", "domain", "kind", "fetched_at", F.explode("pages").alias("p")).select(
        "file", "domain", "kind", F.col("p.page").alias("page"), F.col("p.text").alias("text"), "fetched_at"
    ).where(F.col("text").isNotNull())


def hash64(data: bytes) -> int:
    """Signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of uint64 values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
