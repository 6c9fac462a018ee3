"""Conversations and stored memories: recent turns, context budgets, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import eval_tokens, keyword_share
from tidewright.operators.dense import dense_top
from tidewright.operators.state import expired
from tidewright.session import first

ORDER = ("turn", "message_id")


def turns(messages: DataFrame) -> DataFrame:
    """conv_id, turn, message_id, role, content of each message once; null contents are empty."""
    return messages.select("conv_id", "turn", "message_id", "role", F.coalesce("content", F.lit("")).alias("content")).dropDuplicates()


def recent_turns(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n turns of each conversation, numbered from the newest (1)."""
    w = Window.partitionBy("conv_id").orderBy(*[F.col(c).desc() for c in ORDER])
    return messages.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= n)


def context(messages: DataFrame, max_words: int = 200) -> DataFrame:
    """The newest turns of each conversation that fit a budget of words, in reading order: conv_id, context, words, turns.

    Turns count as ``role: content``; the first that doesn't fit ends the context. Each line has a word at least, so a
    context has at most ``max_words`` lines however long the conversation is.
    """
    line = F.concat_ws(": ", F.coalesce("role", F.lit("")), "content")
    rows = messages.select("conv_id", *ORDER, line.alias("line"), F.size(eval_tokens(line)).alias("n"))
    w = Window.partitionBy("conv_id").orderBy(*[F.col(c).desc() for c in ORDER]).rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") <= max_words)
    return kept.groupBy("conv_id").agg(
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "line"))), lambda x: x["line"])).alias("context"), F.max("upto").alias("words"), F.count("*").alias("turns")
    )


def conversation_summary(messages: DataFrame, chars: int = 100) -> DataFrame:
    """Number of turns, first and last content (cut to ``chars``) of each conversation."""
    at = F.struct(*ORDER)
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.substring(F.min_by("content", at), 1, chars).alias("first"), F.substring(F.max_by("content", at), 1, chars).alias("last")
    )


def running_summary(messages: DataFrame, every: int = 20) -> DataFrame:
    """At each turn from the ``every``-th on: that turn's content and the one ``every - 1`` turns before."""
    w = Window.partitionBy("conv_id").orderBy(*ORDER)
    rows = messages.withColumn("i", F.row_number().over(w)).withColumn("before", F.lag("content", every - 1).over(w))
    return rows.where(F.col("i") >= every).select("conv_id", "message_id", "i", F.substring("before", 1, 100).alias("first"), F.substring("content", 1, 100).alias("last"))


def memory_filter(memories: DataFrame, as_of: Column, least: float = 0.0, tags: list[str] | None = None) -> DataFrame:
    """Memories that haven't expired, are important enough and share a tag."""
    out = memories.where(~expired(F.col("created_at"), F.col("ttl"), as_of)).where(F.coalesce("importance", F.lit(0.0)) >= least)
    return out.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else out


def search_words(memories: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The k memories that share most of the query's words: memory_id, score, rank (score 0 is kept)."""
    text = F.concat_ws(" ", "key", "value")
    scored = memories.select("memory_id", F.round(keyword_share(F.lit(query), text), 12).alias("score"))
    best = scored.orderBy(F.col("score").desc(), "memory_id").limit(k)  # k rows, numbered in one task
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "memory_id")) - 1)


def search_vectors(memories: DataFrame, queries: DataFrame, dim: int, k: int = 10) -> DataFrame:
    """query_id, memory_id, score, rank: the k memories most similar to each query (query_id, vec), in blocks of queries.

    Memories without a usable vector of that length score 0, and scores of 0 and below are kept.
    """
    items = memories.select(F.col("memory_id").alias("item_id"), F.col("embedding").alias("vec"))
    near = dense_top(items, queries, dim, k, above=-2.0).select("query_id", F.col("item_id").alias("memory_id"), F.round("score", 9).alias("score"))
    zero = F.coalesce((F.size("vec") != dim) | F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("vec", lambda x: x != 0), F.lit(True))
    blank = items.where(zero).orderBy("item_id").limit(k).select(F.col("item_id").alias("memory_id"))  # no more of them can be among the first k
    asked = queries.where(~zero).select("query_id")
    rest = asked.crossJoin(F.broadcast(blank)).withColumn("score", F.lit(0.0))
    return first(near.unionByName(rest.select("query_id", "memory_id", "score")), ["query_id"], [F.col("score").desc(), "memory_id"], k)


def episodes(memories: DataFrame, query: str, as_of: Column, k: int = 10) -> DataFrame:
    """Episodes by word share, importance and age: share * (1 + importance) * (1 + max(0, 1 - days / 30))."""
    days = (F.unix_micros(as_of) - F.unix_micros("created_at")) / 1e6 / 86400
    s = keyword_share(F.lit(query), F.col("value")) * (1 + F.coalesce("importance", F.lit(0.0))) * (1 + F.greatest(F.lit(0.0), 1 - days / 30))
    return memories.select("memory_id", F.round(s, 9).alias("score")).orderBy(F.col("score").desc(), "memory_id").limit(k)


def keep_important(memories: DataFrame, n: int = 100) -> DataFrame:
    """What is left of each type when the least important (then oldest) went first: the n most important, newest."""
    w = Window.partitionBy("memory_type").orderBy(F.coalesce("importance", F.lit(0.0)).desc(), F.col("created_at").desc(), F.col("memory_id").desc())
    return memories.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def last_values(memories: DataFrame) -> DataFrame:
    """The newest value of each key: a working memory's final state."""
    at = F.struct("created_at", "memory_id")
    return memories.groupBy("key").agg(F.max_by("value", at).alias("value"), F.max_by("memory_id", at).alias("memory_id"), F.count("*").alias("writes"))


def stats(memories: DataFrame, as_of: Column) -> DataFrame:
    """Per type: entries, mean importance, accesses and how many expired."""
    gone = F.sum(F.when(expired(F.col("created_at"), F.col("ttl"), as_of), 1).otherwise(0)).cast("bigint")
    return memories.groupBy("memory_type").agg(
        F.count("*").alias("entries"), F.round(F.sum(F.coalesce("importance", F.lit(0.0))) / F.greatest(F.count("*"), F.lit(1)), 9).alias("mean_importance"), F.sum("access_count").alias("accesses"), gone.alias("expired")
    )


def cache_stats(lookups: DataFrame, by: list[str]) -> DataFrame:
    """hits, misses and hit rate (4 digits) of lookups that say ``hit``."""
    hits = F.sum(F.when(F.col("hit"), 1).otherwise(0)).cast("bigint")
    return lookups.groupBy(*by).agg(hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.round(hits / F.count("*"), 4).alias("hit_rate"))


def first_use(requests: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Adds ``hit``: whether an earlier row has the same key, as an unbounded cache would find."""
    return requests.withColumn("hit", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)
