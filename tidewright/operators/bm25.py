"""BM25 over an inverted index: postings are joined with the query's terms, texts never travel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import search_tokens
from tidewright.session import durable, few, first


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, term, tf and doc_len of every term of every text: the index to store when queries come more than once."""
    tokens = docs.select(F.col(id_col).alias("doc_id"), search_tokens(text_col).alias("t"))
    counted = tokens.select("doc_id", F.size("t").alias("doc_len"), F.explode_outer("t").alias("term")).where("term IS NOT NULL")
    return counted.groupBy("doc_id", "term", "doc_len").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: n_docs and avgdl."""
    return docs.select(F.size(search_tokens(text_col)).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avgdl"))


def _asked(queries: DataFrame) -> tuple[DataFrame, bool]:
    """query_id, term and how often the query has it; and whether these rows are few enough to be broadcast."""
    terms = queries.select("query_id", F.explode_outer(search_tokens("query")).alias("term")).where("term IS NOT NULL")
    asked = durable(terms.groupBy("query_id", "term").agg(F.count("*").alias("times")))
    return asked, few(asked)


def _rank(tf: DataFrame, stats: DataFrame, asked: DataFrame, is_few: bool, k1: float, b: float) -> DataFrame:
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).select(  # one row of statistics
        "term", F.greatest("avgdl", F.lit(1.0)).alias("avgdl"), F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )
    weights = asked.join(idf, "term")  # as many rows as asked
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avgdl")))
    return tf.join(F.broadcast(weights) if is_few else weights, "term").groupBy("query_id", "doc_id").agg(F.sum(part * F.col("times")).alias("score"))


def _only(rows: DataFrame, asked: DataFrame, is_few: bool) -> DataFrame:
    terms = asked.select("term").distinct()
    return rows.join(F.broadcast(terms) if is_few else terms, "term", "left_semi")


def search(index: DataFrame, stats: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score from a stored index (:func:`postings`, best bucketed by term) and its statistics.

    A term that the query repeats counts again. Only postings of asked terms leave the scan.
    """
    asked, is_few = _asked(queries)
    return _rank(_only(index, asked, is_few).select("doc_id", "doc_len", "term", "tf"), stats, asked, is_few, k1, b)


def score(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The same straight from texts, for one batch of queries (query_id, query).

    Words are matched with the asked terms where the texts are read, so the shuffle carries matches, not the corpus;
    the matches are kept, as document frequencies and scores both need them. Each text also gives one row without a
    term, from which the corpus statistics come, so texts are read and split once.
    """
    asked, is_few = _asked(queries)
    tokens = docs.select(F.col(id_col).alias("doc_id"), search_tokens(text_col).alias("t"))
    # a text's own row is the null term that explode_outer would give for an empty list anyway
    rows = tokens.select("doc_id", F.size("t").alias("doc_len"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "t")).alias("term"))
    terms = asked.select("term", F.lit(True).alias("wanted")).distinct()
    met = rows.join(F.broadcast(terms) if is_few else terms, "term", "left").where("wanted OR term IS NULL")
    kept = durable(met.groupBy("doc_id", "doc_len", "term").agg(F.count("*").alias("tf")))
    stats = kept.where("term IS NULL").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("doc_len") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    return _rank(kept.where("term IS NOT NULL"), stats, asked, is_few, k1, b)


def top(scored: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """The first k per query by score, then doc_id, of those above 0 (and not below ``least``); rank from 0."""
    ranked = first(scored.where("score > 0"), ["query_id"], [F.col("score").desc(), "doc_id"], k)
    return ranked.where(F.col("score") >= least) if least is not None else ranked
