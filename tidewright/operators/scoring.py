"""Scores of a candidate text against a reference, one row per pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.text import eval_tokens, exact_form
from tidewright.functions.vectors import dot, word_embedding

METRICS = ("bleu", "rouge1", "rouge2", "rouge_l", "semantic", "exact_match", "f1")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _overlap(cand: pd.Series, ref: pd.Series) -> pd.Series:
    """For n = 1 to 4: clipped matches and number of the candidate's n-grams, then the numbers of distinct n-grams of both.

    The words of a batch become numbers, an n-gram the number of its first n - 1 words and its last word together; then
    grams are counted per row and the counts of both sides met by key, all in whole arrays.
    """
    n_rows = len(cand)
    length = np.r_[cand.map(len).to_numpy(np.int64), ref.map(len).to_numpy(np.int64)]
    row = np.repeat(np.r_[np.arange(n_rows), np.arange(n_rows)], length)
    text = np.repeat(np.arange(2 * n_rows), length)
    word, kinds = pd.factorize(np.array([w for own in (*cand, *ref) for w in own], object))
    out, code = np.zeros((n_rows, 16), np.int64), word.astype(np.int64)
    per = lambda keys, width, weight=None: np.bincount(keys // width, weight, n_rows).astype(np.int64)
    for n in range(1, 5):
        if n > 1:  # grams that begin at each place but the last ones
            code = np.unique(code[:-1] * (len(kinds) + 1) + word[n - 1 :], return_inverse=True)[1].astype(np.int64) if len(code) else code
        start, end = np.arange(len(code)), np.arange(len(code)) + n - 1
        whole = text[start] == text[end]
        width = int(code.max(initial=0)) + 1
        key, mine = row[start] * width + code, text[start] < n_rows
        c, c_n = np.unique(key[whole & mine], return_counts=True)
        r, r_n = np.unique(key[whole & ~mine], return_counts=True)
        both, i, j = np.intersect1d(c, r, assume_unique=True, return_indices=True)
        out[:, 4 * n - 4 : 4 * n] = np.stack([per(both, width, np.minimum(c_n[i], r_n[j])), per(c, width, c_n), per(c, width), per(r, width)], 1)
    return pd.Series(list(out))


@F.pandas_udf(T.IntegerType())
def _lcs(cand: pd.Series, ref: pd.Series) -> pd.Series:
    """Length of the longest common subsequence, a row of the table at a time."""
    out = []
    for c, r in zip(cand, ref):
        c, r = list(c), list(r)
        words: dict[str, int] = {}
        a = np.array([words.setdefault(w, len(words)) for w in c])
        b = np.array([words.setdefault(w, len(words)) for w in r])
        row = np.zeros(len(b) + 1, np.int64)
        for x in a:
            step = np.where(b == x, row[:-1] + 1, 0)
            row[1:] = np.maximum.accumulate(np.maximum(step, row[1:]))
        out.append(int(row[-1]) if len(row) else 0)
    return pd.Series(out)


def _f(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def rouge_n(o: Column, n: int) -> Column:
    """F of clipped matches over *distinct* n-grams, so repeats can exceed 1; see :func:`rouge_n_standard`."""
    at = 4 * (n - 1)
    return _f(_ratio(o[at], o[at + 2]), _ratio(o[at], o[at + 3]))


def rouge_n_standard(o: Column, n: int, refs: Column) -> Column:
    """The same over all n-grams, as usually defined."""
    at = 4 * (n - 1)
    return _f(_ratio(o[at], o[at + 1]), _ratio(o[at], F.greatest(F.size(refs) - (n - 1), F.lit(0))))


def bleu(o: Column, cand: Column, ref: Column) -> Column:
    """Geometric mean of the four clipped precisions with a brevity penalty; 0 if any order has no match.

    Orders for which the candidate is too short count as full precision; an empty candidate scores 0.
    """
    logs = F.lit(0.0)
    zero = F.size(cand) == 0
    for n in range(1, 5):
        hit, all_ = o[4 * (n - 1)], o[4 * (n - 1) + 1]
        zero = zero | ((all_ > 0) & (hit == 0))
        logs = logs + F.log(F.when((all_ > 0) & (hit > 0), hit / all_).otherwise(F.lit(1.0)))
    short = F.size(cand) < F.size(ref)
    brevity = F.when(short, F.exp(1 - F.size(ref) / F.greatest(F.size(cand), F.lit(1)))).otherwise(F.lit(1.0))
    return F.when(zero, F.lit(0.0)).otherwise(brevity * F.exp(logs / 4))


def token_f1(c: Column, r: Column) -> Column:
    """F over the sets of tokens."""
    a, b = F.array_distinct(c), F.array_distinct(r)
    both = F.size(F.array_intersect(a, b))
    return _f(_ratio(both, F.size(a)), _ratio(both, F.size(b)))


def score(pairs: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """pair_id, the asked metrics and avg_score, their mean. ``pairs`` has pair_id, candidate and reference; null is empty."""
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    rows = pairs.select("pair_id", "candidate", "reference", eval_tokens("candidate").alias("c"), eval_tokens("reference").alias("r"))
    rows = rows.withColumn("o", _overlap("c", "r"))
    made = {
        "bleu": lambda: bleu(F.col("o"), F.col("c"), F.col("r")),
        "rouge1": lambda: rouge_n(F.col("o"), 1),
        "rouge2": lambda: rouge_n(F.col("o"), 2),
        "rouge_l": lambda: _rouge_l(),
        "semantic": lambda: dot(word_embedding(F.col("candidate")), word_embedding(F.col("reference"))),
        "exact_match": lambda: (exact_form(F.coalesce("candidate", F.lit(""))) == exact_form(F.coalesce("reference", F.lit("")))).cast("double"),
        "f1": lambda: token_f1(F.col("c"), F.col("r")),
    }
    out = rows.select("pair_id", *[made[m]().alias(m) for m in metrics])
    mean = sum((F.col(m) for m in metrics), F.lit(0.0)) / max(1, len(metrics))
    return out.withColumn("avg_score", mean)


def _rouge_l() -> Column:
    lcs = _lcs("c", "r")
    return _f(_ratio(lcs, F.size("c")), _ratio(lcs, F.size("r")))


def zipped(lists: DataFrame, id_col: str, candidates: str, references: str) -> DataFrame:
    """id, position (from 0), candidate, reference: two lists paired by position up to the shorter one; null lists give none."""
    n = F.least(F.size(candidates), F.size(references))
    each = lists.where(F.coalesce(n, F.lit(0)) > 0).select(id_col, F.posexplode(F.arrays_zip(F.slice(candidates, F.lit(1), n).alias("candidate"), F.slice(references, F.lit(1), n).alias("reference"))).alias("position", "x"))
    return each.select(id_col, "position", "x.candidate", "x.reference")


def aggregate(scored: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """metric, mean, low, high, std (sample; 0 for one row), n."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])).alias("s")
    long = scored.select(stack).select("s.metric", "s.x")
    return long.groupBy("metric").agg(
        F.avg("x").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"), F.count("x").alias("n")
    )
