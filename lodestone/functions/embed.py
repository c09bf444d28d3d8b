"""Embedders: anything with a name, a dimension and two encoders of texts.

An embedder's ``encode`` takes a list of texts and returns a matrix; ``embedded`` runs
it over a column, Arrow batch by Arrow batch.  ``HashingEmbedder`` needs no model.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Embedder(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...

    def encode_query(self, text: str) -> np.ndarray: ...


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows over their L2 norm; a zero row stays zero."""
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms == 0, 1, norms)


class HashingEmbedder:
    """Signed counts of hashed words, normalised: slot ``h % dim``, +1 for an odd h and -1
    for an even one, h the little-endian 8-byte BLAKE2b of the case-folded word."""

    def __init__(self, dim: int = 384):
        self.name, self.dim = f"hashing-{dim}", dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out, known = np.zeros((len(texts), self.dim)), {}
        for row, text in enumerate(texts):
            for word in re.findall(r"[\w-]+", (text or "").casefold()):
                h = known.get(word)
                if h is None:
                    h = known[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[row, h % self.dim] += 1 if h & 1 else -1
        return unit_rows(out).astype(np.float32)

    def encode_query(self, text: str) -> np.ndarray:
        return checked(self.encode([text]), 1, self.dim)[0]


def checked(x: np.ndarray, rows: int, dim: int) -> np.ndarray:
    if x.shape != (rows, dim):
        raise ValueError(f"an embedder gave {x.shape}, not {(rows, dim)}")
    return x


def embedded(df: DataFrame, embedder: Embedder, *, text: str = "text", out: str = "embedding", rows: int = 512) -> DataFrame:
    """``df`` with ``out``: the embedding of ``text``; null text is empty text."""
    df = df.drop(out)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                x = checked(embedder.encode(part.column(at).to_pylist()), part.num_rows, embedder.dim).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, embedder.dim, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))
