"""Fusing two rankings, and reranking candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import first


def _both(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    d = dense.select("query_id", "item_id", F.col("score").alias("d_score"), F.col("rank").alias("d_rank"))
    s = sparse.select("query_id", "item_id", F.col("score").alias("s_score"), F.col("rank").alias("s_rank"))
    return d.join(s, ["query_id", "item_id"], "full_outer")


def _first(fused: DataFrame, k: int) -> DataFrame:
    return first(fused, ["query_id"], [F.round("score", 12).desc(), "item_id"], k)


def rrf(dense: DataFrame, sparse: DataFrame, k: int, c: int = 60) -> DataFrame:
    """Reciprocal ranks added up; an item that one list lacks ranks there behind the whole union."""
    union = F.count("*").over(Window.partitionBy("query_id"))
    one = lambda r: 1 / (c + F.coalesce(F.col(r) + 1, union + 1))
    return _first(_both(dense, sparse).withColumn("score", one("d_rank") + one("s_rank")), k).select("query_id", "item_id", "score", "rank")


def weighted(dense: DataFrame, sparse: DataFrame, k: int, share: float = 0.7) -> DataFrame:
    """Scores divided by each side's largest, mixed ``share`` to the rest; what a side lacks counts 0."""
    w = Window.partitionBy("query_id")
    part = lambda x: F.coalesce(F.col(x), F.lit(0.0)) / F.greatest(F.coalesce(F.max(x).over(w), F.lit(0.0)), F.lit(1e-8))
    scaled = _both(dense, sparse).select("query_id", "item_id", part("d_score").alias("dense_score"), part("s_score").alias("sparse_score"))
    mixed = scaled.withColumn("score", share * F.col("dense_score") + (1 - share) * F.col("sparse_score"))
    return _first(mixed, k).select("query_id", "item_id", "score", "dense_score", "sparse_score", "rank")


def minmax(score: Column, w) -> Column:
    """0 to 1 within the window; all 1 if all are equal."""
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low))


def softmax(score: Column, w) -> Column:
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def rerank(cands: DataFrame, k: int, how: str = "minmax", least: float | None = None) -> DataFrame:
    """Normalise scores per query, keep k, then those at least ``least``; new_rank may so have gaps.

    ``cands`` has query_id, item_id, score and rank; ties keep the order of rank.
    """
    w = Window.partitionBy("query_id")
    new = {"minmax": minmax, "softmax": softmax}[how](F.col("score"), w) if how != "none" else F.col("score")
    scored = cands.withColumn("rerank_score", new)
    out = first(scored, ["query_id"], [F.round("rerank_score", 12).desc(), "rank", "item_id"], k, "new_rank")
    out = out.where(F.col("rerank_score") >= least) if least is not None else out
    return out.select("query_id", "item_id", "score", F.col("rank").alias("original_rank"), "rerank_score", "new_rank")


def pipeline(cands: DataFrame, stages: list[tuple[str, int]], final: int) -> DataFrame:
    """Stages (how, k) one after the other, the last one with ``final`` and then once more on its own result.

    No stages give no results.
    """
    if not stages:
        return rerank(cands, 0)
    rows = cands
    for i, (how, k) in enumerate([*stages, stages[-1]]):
        out = rerank(rows, final if i >= len(stages) - 1 else k, how)
        rows = out.select("query_id", "item_id", F.col("rerank_score").alias("score"), F.col("new_rank").alias("rank"))
    return out


def mmr(cands: DataFrame, k: int, trade: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance: query_id, item_id, relevance, new_rank.

    ``cands`` has query_id, item_id, score, rank and vec, a bounded candidate list per query (what a first stage
    kept); a query's list is read by one task. Relevance is the min-max score; without vectors it alone decides.
    """
    w = Window.partitionBy("query_id")
    rows = cands.select("query_id", "item_id", "rank", minmax(F.col("score"), w).alias("relevance"), "vec")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rel = pdf["relevance"].to_numpy(float)
        dim = max((len(v) for v in pdf["vec"] if v is not None), default=0)
        x = np.array([np.zeros(dim) if v is None or len(v) != dim else np.asarray(v, float) for v in pdf["vec"]]).reshape(len(pdf), dim)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
        left, near, chosen = np.ones(len(pdf), bool), np.zeros(len(pdf)), []
        for _ in range(min(k, len(pdf))):
            at = int(np.argmax(np.where(left, np.round(trade * rel - (1 - trade) * near, 9), -np.inf)))
            near = x @ x[at] if not chosen else np.maximum(near, x @ x[at])
            chosen.append(at)
            left[at] = False
        out = pdf.iloc[chosen][["query_id", "item_id", "relevance"]].copy()
        out["new_rank"] = np.arange(len(chosen), dtype=np.int32)
        return out

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the query that the batch before ended in
        for pdf in parts:
            pdf = pd.concat([held, pdf]) if held is not None else pdf
            if not len(pdf):
                continue
            open_ = pdf["query_id"] == pdf["query_id"].iloc[-1]
            held, whole = pdf[open_], pdf[~open_]
            if len(whole):
                yield pd.concat([pick(own) for _, own in whole.groupby("query_id", sort=False)])
        if held is not None and len(held):
            yield pick(held)

    ordered = rows.repartition("query_id").sortWithinPartitions("query_id", "rank", "item_id")
    return ordered.mapInPandas(run, f"query_id {dict(rows.dtypes)['query_id']}, item_id {dict(rows.dtypes)['item_id']}, relevance double, new_rank int")


def judged(cands: DataFrame, replies: Column, k: int, most: int = 20) -> DataFrame:
    """Candidates reranked by a judge's replies: the first ``most`` by rank are asked, a reply without a number leaves the own score.

    query_id, item_id, rerank_score, new_rank; ties keep the order of rank.
    """
    asked = first(cands, ["query_id"], ["rank", "item_id"], most, "place").withColumn("rerank_score", F.coalesce(judge_score(replies), F.col("score")))
    return first(asked, ["query_id"], [F.col("rerank_score").desc(), "rank", "item_id"], k, "new_rank").select("query_id", "item_id", "rerank_score", "new_rank")


def cross_encoded(cands: DataFrame, model: Callable[[list[str], list[str]], list[float]], k: int, chars: int = 1000) -> DataFrame:
    """Candidates (query_id, query, item_id, text, rank) reranked by a model of pairs, called with a batch of queries and texts of up to ``chars`` characters."""

    @F.pandas_udf("double")
    def scored(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(model(query.tolist(), text.tolist()), dtype=float)

    rows = cands.withColumn("rerank_score", scored(F.coalesce("query", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, chars)))
    return first(rows, ["query_id"], [F.col("rerank_score").desc(), "rank", "item_id"], k, "new_rank").select("query_id", "item_id", "rerank_score", "new_rank")


def judge_score(reply: Column) -> Column:
    """The first number of a judge's reply, held between 0 and 10, as a share; null if there is none."""
    number = F.regexp_extract(reply, r"(\d+(?:\.\d+)?)", 1)
    return F.when(number != "", F.greatest(F.lit(0.0), F.least(F.lit(10.0), number.cast("double"))) / 10)
