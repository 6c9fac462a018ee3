"""Embedding with a cache: each distinct text is embedded once, whatever function does it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.vectors import dot, norm


#: Words as the built-in pattern sees them: only ASCII white space parts them.
_PLAIN = re.compile(r"[^ \t\n\r\f\x0b]+")


def cache_key(model: str, text: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{model}:"), text).cast("binary"))


def embed_cached(df: DataFrame, id_col: str, text_col: str, embed: Callable[[list[str]], list[list[float]]], model: str = "hash", known: DataFrame | None = None, batch: int = 256) -> tuple[DataFrame, DataFrame]:
    """Vectors of all rows (id, key, embedding) and the cache that holds them (key, embedding).

    ``known`` is a cache of earlier runs, whose texts are not embedded again. ``embed`` gets lists of up to ``batch``
    texts. Null texts have no vector; repeated texts share one.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), cache_key(model, F.col(text_col)).alias("key"))
    fresh = rows.where("text IS NOT NULL").groupBy("key").agg(F.min("text").alias("text"))
    if known is not None:
        fresh = fresh.join(known.select("key"), "key", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            vectors = [v for at in range(0, len(pdf), batch) for v in embed(pdf["text"].iloc[at : at + batch].tolist())]
            yield pd.DataFrame({"key": pdf["key"], "embedding": [list(map(float, v)) for v in vectors]})

    cache = fresh.mapInPandas(run, "key string, embedding array<double>")
    cache = cache.unionByName(known.select("key", "embedding")) if known is not None else cache
    return rows.select("id", "key").join(cache, "key", "left").select("id", "key", "embedding"), cache


def unseen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key no known row has."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def hash_words(texts: list[str], dim: int = 128) -> list[list[float]]:
    """An embedder for tests and baselines: counts of hashed words as a unit vector."""
    out = []
    for t in texts:
        v = np.bincount([md5(w.encode("utf-8", "surrogatepass")).digest()[-1] % dim for w in _PLAIN.findall(t.lower())], minlength=dim).astype(float)
        out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
    return out


def cache_stats(df: DataFrame, text_col: str) -> DataFrame:
    """One row: lookups, texts that had to be embedded, and hits over those (which can exceed 1)."""
    out = df.where(F.col(text_col).isNotNull()).agg(F.count("*").alias("lookups"), F.countDistinct(text_col).alias("embedded"))
    hits = F.col("lookups") - F.col("embedded")
    return out.select("lookups", "embedded", hits.alias("hits"), F.round(hits / F.greatest("embedded", F.lit(1)), 6).alias("hit_rate"))


def batch_similarity(query: Column, vectors: Column) -> Column:
    """Cosine where a vector without length divides by 1."""
    length = lambda v: F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))
    return dot(query, vectors) / (length(query) * length(vectors))
