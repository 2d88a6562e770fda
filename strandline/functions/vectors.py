"""Vector functions: cosine similarity, the little-endian codec, the offline embedder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 8


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different lengths, empty ones and zero vectors."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.coalesce(F.when(usable, _dot(a, b) / norms), F.lit(0.0))


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


@F.pandas_udf(T.BinaryType())
def encode_floats(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_floats(raw: pd.Series) -> pd.Series:
    """Trailing bytes that are no whole float are ignored."""
    return raw.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))


def embed_text(text: str | None) -> np.ndarray:
    """The deterministic embedder: byte sums by position modulo 8, unit length."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    sums = np.bincount(np.arange(len(raw)) % DIMENSIONS, raw, DIMENSIONS)
    norm = float(np.sqrt(np.sum(sums * sums)))
    return (sums / norm if norm else sums).astype(np.float32)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    return texts.map(embed_text)


def embed_with(embedder):
    """``embedder`` as a function of a text column; it gets whole Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embedded(texts: pd.Series) -> pd.Series:
        found = embedder.embed([t or "" for t in texts]) if len(texts) else []
        return pd.Series([np.asarray(v, np.float32) for v in found], dtype=object)

    return embedded
