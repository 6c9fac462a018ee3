"""Column expressions on vectors, and hash embeddings of text."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.text import eval_tokens


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def soft_cosine(a: Column, b: Column) -> Column:
    """The retrieval form: a small constant keeps the quotient finite."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-8))


def unit(v: Column) -> Column:
    """Length one; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def _hash_counts(parts: pd.Series, dim: int, memo: dict[str, int]) -> pd.Series:
    """Counts of md5-hashed parts modulo ``dim`` (a power of two up to 256), as unit vectors.

    Each distinct part is hashed once per worker; counting is one bincount per Arrow batch.
    """
    n = parts.map(len).to_numpy()
    flat = [x for own in parts for x in own]
    fresh = set(flat).difference(memo)
    if len(memo) > 1_000_000:
        memo.clear()
        fresh = set(flat)
    memo.update((x, md5(x.encode("utf-8", "surrogatepass")).digest()[-1]) for x in fresh)
    slots = np.fromiter(map(memo.__getitem__, flat), np.int64, len(flat)) % dim
    x = np.bincount(np.repeat(np.arange(len(n)), n) * dim + slots, minlength=len(n) * dim).reshape(len(n), dim).astype(float)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return pd.Series(list(x / np.where(length == 0, 1, length)))


def word_embedding(text: Column, dim: int = 128) -> Column:
    """Counts of hashed words, as a unit vector; zeros for null and blank texts."""
    memo: dict[str, int] = {}

    @F.pandas_udf("array<double>")
    def embed(words: pd.Series) -> pd.Series:
        return _hash_counts(words, dim, memo)

    return embed(eval_tokens(text))


def trigram_embedding(text: Column, dim: int = 128) -> Column:
    """Counts of hashed character triples of the lower-case text, as a unit vector; zeros for texts under three characters."""
    memo: dict[str, int] = {}

    @F.pandas_udf("array<double>")
    def embed(lower: pd.Series) -> pd.Series:
        return _hash_counts(lower.map(lambda t: [t[i : i + 3] for i in range(len(t) - 2)]), dim, memo)

    return embed(F.lower(F.coalesce(text, F.lit(""))))
