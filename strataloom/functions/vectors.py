"""Vectors and token matrices: norms, checks, the little-endian codec, cosine and late interaction."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def valid_vector(v: Column, dimension: int) -> Column:
    """Right length, finite values, and a finite norm above zero."""
    return F.coalesce((F.size(v) == dimension) & F.forall(v, finite) & (norm(v) > 0) & (norm(v) < float("inf")), F.lit(False))


def valid_matrix(m: Column, dimension: int) -> Column:
    """At least one token, each of the dimension, all finite."""
    return F.coalesce((F.size(m) > 0) & F.forall(m, lambda v: (F.size(v) == dimension) & F.forall(v, finite)), F.lit(False))


def unit(v: Column) -> Column:
    """The vector over its norm; a zero vector stays as it is."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: (x / norm(v)).cast("float"))).otherwise(v)


def literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def cosine(v: Column, query: Sequence[float]) -> Column:
    """Cosine with a query vector; null if either has no length, so that such rows are never ranked."""
    length = math.sqrt(sum(float(x) * float(x) for x in query))
    if not length or not math.isfinite(length):
        return F.lit(None).cast("double")
    n = norm(v)
    return F.when(n > 0, dot(v, literal(query)) / (n * length))


def maxsim(document: Column, query: Sequence[Sequence[float]]) -> Column:
    """Sum over query tokens of the best dot product with a document token."""

    def best(q: Sequence[float]) -> Column:
        return F.array_max(F.transform(document, lambda d: dot(d, literal(q))))

    return sum(map(best, query), F.lit(0.0))


def maxsim_batches(query: Sequence[Sequence[float]]):
    """The same as a pandas UDF over flattened matrices: one matrix product a document, for wide matrices."""
    q = np.asarray(query, dtype=np.float32)

    @F.pandas_udf(T.DoubleType())
    def score(flat: pd.Series) -> pd.Series:
        return flat.map(lambda x: float((q @ np.asarray(x, dtype=np.float32).reshape(-1, q.shape[1]).T).max(axis=1).sum()) if x is not None and len(x) else None)

    return score


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


@F.pandas_udf(T.BinaryType())
def encode(vectors: pd.Series) -> pd.Series:
    """float32, little-endian."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4").astype(np.float32))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def mean_pool(flat: pd.Series, tokens: pd.Series) -> pd.Series:
    """Mean of the rows of a flattened matrix of so many tokens."""
    return pd.Series([None if f is None or not t else np.asarray(f, dtype=np.float32).reshape(int(t), -1).mean(axis=0) for f, t in zip(flat, tokens, strict=True)])
