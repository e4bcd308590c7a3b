"""Vectors as ARRAY<FLOAT> columns: exact cosine, and a hashing embedder in place of a model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeweave.functions.text import code_tokens

DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def vector(values) -> Column:
    """A driver-side vector as a literal column."""
    return F.array(*[F.lit(float(v)) for v in values])


def embed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A feature-hashing embedding: signed counts of token hashes, scaled to length 1. Deterministic, needs no model.

    Tokens are made and hashed in the JVM; an Arrow batch of hashes becomes one matrix.
    """

    def run(hashes: pd.Series) -> pd.Series:
        sizes = np.array([0 if h is None else len(h) for h in hashes])
        flat = np.concatenate([np.asarray(h, dtype=np.int64) for h in hashes if h is not None and len(h)] or [np.zeros(0, dtype=np.int64)])
        row = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.zeros((len(sizes), dimensions))
        np.add.at(counts, (row, flat % dimensions), np.where((flat >> 40) & 1, 1.0, -1.0))
        length = np.sqrt((counts**2).sum(axis=1, keepdims=True))
        return pd.Series(list(counts / np.where(length > 0, length, 1.0)))

    return F.pandas_udf(run, "array<double>")(F.transform(code_tokens(text), lambda t: F.xxhash64(t)))
