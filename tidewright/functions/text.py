"""Column expressions on text: tokens, n-grams, normal forms, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore of any script; the same matches in Java and RE2.
WORD = r"([\p{L}\p{N}_]+)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def search_tokens(text: Column | str) -> Column:
    """Lower-case word tokens for retrieval; none for a null text."""
    return F.coalesce(F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD), F.lit(1)), F.array().cast("array<string>"))


def eval_tokens(text: Column | str) -> Column:
    """Lower-case tokens between white space for scoring."""
    return F.coalesce(F.regexp_extract_all(F.lower(_c(text)), F.lit(r"(\S+)"), F.lit(1)), F.array().cast("array<string>"))


def char_tokens(text: Column | str) -> Column:
    """Single characters without spaces, case kept: tokens of scripts without word breaks."""
    return F.filter(F.split(F.replace(_c(text), F.lit(" "), F.lit("")), ""), lambda x: x != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams, joined by a space; none if there are fewer than n tokens."""
    count = F.size(tokens) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(count >= 1, grams).otherwise(F.array().cast("array<string>"))


def squash(text: Column | str) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), r"\s+", " "))


def exact_form(text: Column | str) -> Column:
    """The form two texts are compared in: squashed, then without punctuation."""
    return F.regexp_replace(squash(text), r"[^\p{L}\p{N}_\s]", "")


def preview(text: Column | str, n: int = 500) -> Column:
    return F.substring(_c(text), 1, n)


def text_length(text: Column | str) -> Column:
    """chars, words and lines of a text."""
    t = _c(text)
    return F.struct(
        F.length(t).alias("chars"),
        F.size(F.regexp_extract_all(t, F.lit(r"(\S+)"), F.lit(1))).alias("words"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).alias("lines"),
    )


def message_text(messages: Column | str) -> Column:
    """The contents of a list of messages, joined by a space."""
    return F.array_join(F.transform(_c(messages), lambda m: F.coalesce(m["content"], F.lit(""))), " ")


def parts_text(contents: Column | str) -> Column:
    """The texts of contents that are lists of parts (type, text), joined by a space; parts without a text count as empty."""
    return F.array_join(F.transform(F.flatten(_c(contents)), lambda p: F.coalesce(p["text"], F.lit(""))), " ")


def sentences(text: Column | str) -> Column:
    """Parts between sentence ends followed by white space, trimmed, without blank ones."""
    parts = F.split(_c(text), r"(?<=[.!?。！？\n])\s+")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")


def keyword_share(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has."""
    q, t = F.array_distinct(eval_tokens(query)), F.array_distinct(eval_tokens(text))
    return F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))
