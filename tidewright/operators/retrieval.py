"""One search over texts and their vectors: dense, sparse, or both fused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators import bm25, dense, fusion
from tidewright.session import first

MODES = ("dense", "sparse", "hybrid", "hybrid_rrf", "hybrid_weighted")


def matches(metadata: Column, wanted: dict[str, object]) -> Column:
    """Whether a map of strings has every wanted value; a list means any of its values, a missing key fails."""
    out = F.lit(True)
    for key, value in wanted.items():
        x = F.try_element_at(metadata, F.lit(key))
        own = x.isin(*value) if isinstance(value, (list, tuple, set)) else x == value
        out = out & F.coalesce(own, F.lit(False))
    return out


def _dense(docs: DataFrame, queries: DataFrame, dim: int, k: int, keep: Column | None) -> DataFrame:
    items = docs.where(keep) if keep is not None else docs  # filters stand before the cut
    return dense.dense_top(items.select(F.col("doc_id").alias("item_id"), "vec"), queries.select("query_id", "vec"), dim, k)


def _sparse(docs: DataFrame, queries: DataFrame, k: int, keep: Column | None) -> DataFrame:
    """The first 2k by BM25, then the filters, then k: a filter stands behind the cut."""
    scored = bm25.score(docs, "doc_id", "text", queries.select("query_id", "query")).withColumn("score", F.round("score", 9))
    best = bm25.top(scored, 2 * k)
    if keep is not None:
        best = best.join(docs.where(keep).select("doc_id"), "doc_id", "left_semi")
    return first(best, ["query_id"], ["rank"], k).select("query_id", F.col("doc_id").alias("item_id"), "score", "rank")


def retrieve(docs: DataFrame, queries: DataFrame, mode: str = "hybrid", k: int = 0, keep: Column | None = None, dim: int = 128, default: int = 5) -> DataFrame:
    """query_id, item_id, score, rank (from 0): the k best documents of each query; k = 0 means ``default``.

    ``docs`` has doc_id, text, vec and what ``keep`` (a condition on metadata) looks at; ``queries`` query_id, query, vec.
    ``hybrid`` is ``hybrid_rrf``. Hybrid modes fuse the first 2k of each search.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    k = k or default
    if mode == "dense":
        return _dense(docs, queries, dim, k, keep)
    if mode == "sparse":
        return _sparse(docs, queries, k, keep)
    both = _dense(docs, queries, dim, 2 * k, keep), _sparse(docs, queries, 2 * k, keep)
    fused = fusion.weighted(*both, k) if mode == "hybrid_weighted" else fusion.rrf(*both, k)
    return fused.select("query_id", "item_id", "score", "rank")


def embedded(rows: DataFrame, text_col: str, embed: Callable[[Column], Column]) -> DataFrame:
    """Rows with ``vec``, what an embedding expression makes of their text."""
    return rows.withColumn("vec", embed(F.col(text_col)))


def index_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, those with a vector, the vectors' length (the most frequent), and documents with words."""
    words = F.size(bm25.search_tokens("text")) > 0
    return docs.agg(F.count("*").alias("documents"), F.count("vec").alias("embedded"), F.coalesce(F.mode(F.size("vec"), True), F.lit(0)).alias("dim"), F.sum(words.cast("bigint")).alias("with_words"))
