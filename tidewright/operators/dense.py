"""Exact dense retrieval of a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import first

QUERY_BLOCK = 20_000


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold ``dim`` finite numbers with some length, and their doubles."""
    right = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    x = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(right), dim)
    fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return right[fine], x[fine]


def dense_top(items: DataFrame, queries: DataFrame, dim: int, k: int = 10, above: float = 0.0) -> DataFrame:
    """query_id, item_id, score, rank (from 0): the k items of highest cosine ``above`` a bound of each query.

    ``items`` has item_id and vec, ``queries`` query_id and vec. Queries go out in blocks of 20,000 vectors, so the
    broadcast has a bound; each partition keeps k items per query before the shuffle.
    """
    spark = items.sparkSession
    numbered = queries.select("query_id", "vec")
    if dict(items.dtypes)["item_id"] != "bigint" or dict(queries.dtypes)["query_id"] != "bigint":
        raise ValueError("item_id and query_id must be bigint")
    blocks = max(1, -(-numbered.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        own = numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        held = own.toArrow().combine_chunks()
        column = held.column("vec").combine_chunks() if held.num_rows else pa.array([], pa.list_(pa.float32()))
        rows, x = _vectors(column, dim)
        ids = held.column("query_id").to_numpy()[rows] if held.num_rows else np.zeros(0, np.int64)
        sent = spark.sparkContext.broadcast((ids, x, np.linalg.norm(x, axis=1)))
        found = items.select("item_id", "vec").mapInArrow(_search(sent, dim, k, above), "query_id bigint, item_id bigint, score double")
        out = out.unionByName(found) if out else found
    return first(out, ["query_id"], [F.col("score").desc(), "item_id"], k)


def _search(sent, dim: int, k: int, above: float, block: int = 512):
    """A task's best k items of each query; scores stand for ``block`` queries and one Arrow batch of items at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, qn = sent.value
        row, item, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        bar = np.full(len(ids), -np.inf)  # what an item must reach to be among a query's best so far
        for batch in batches:
            right, x = _vectors(batch.column(1), dim)
            if not len(right) or not len(ids):
                continue
            own, xn = batch.column(0).to_numpy()[right], np.linalg.norm(x, axis=1)
            rows, items, scores = [row], [item], [score]
            for at in range(0, len(ids), block):
                s = np.round((q[at : at + block] @ x.T) / (qn[at : at + block, None] * xn + 1e-8), 12)
                least = bar[at : at + block]
                if s.shape[1] > k:
                    least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                r, c = np.nonzero((s >= least[:, None]) & (s > above))
                rows.append(r + at)
                items.append(own[c])
                scores.append(s[r, c])
            row, item, score = np.concatenate(rows), np.concatenate(items), np.concatenate(scores)
            order = np.lexsort((item, -score, row))
            row, item, score = row[order], item[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            bar[row[place == k - 1]] = score[place == k - 1]
            row, item, score = row[place < k], item[place < k], score[place < k]
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(item), pa.array(score)], ["query_id", "item_id", "score"])

    return run
