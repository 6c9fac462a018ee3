"""Top N items within every group by secondary sort.

Rows are sorted by group, score and identifier inside their partitions and streamed as Arrow batches; a
group is never held in memory, only the ids already emitted for the one group that is open (at most N).
The stream runs twice: over the input's own partitions, so that no partition sends more than N rows of a
group into the shuffle (a group with a third of all rows is cut down where it lies), and again after
hash-partitioning what is left by group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import tidy


def _emit(n: int):
    """Per batch: the first n distinct items of each group of a stream sorted by group, score, item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen = object(), set()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, items = batch.column(0), batch.column(1)
            codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            ends = np.r_[starts[1:], len(codes)]
            keep, ranks = [], []
            for a, b in zip(starts.tolist(), ends.tolist()):
                key = keys[a].as_py()
                if key != group:
                    group, seen = key, set()
                at = a
                while at < b and len(seen) < n:
                    part = items.slice(at, min(b - at, 4 * n)).to_pylist()
                    for i, item in enumerate(part):
                        if item not in seen:
                            seen.add(item)
                            keep.append(at + i)
                            ranks.append(len(seen))
                            if len(seen) == n:
                                break
                    at += len(part)
            if keep:
                out = batch.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.columns[:3], pa.array(ranks, pa.int32())], ["group", "item", "score", "rank"])

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10) -> DataFrame:
    """The n best distinct items of every group: columns ``group``, ``item``, ``score`` and ``rank`` from 1, under the input's names.

    Order: score descending (-0.0 equals 0.0), then item ascending. Rows whose score is null or NaN, or whose
    item is null, are left out. An item that occurs several times in a group counts once, with its best score.
    A null group is a group of its own. Extra columns are ignored, whatever their names; an empty table gives
    an empty result.
    """
    rows = df.select(F.col(f"`{group}`").alias("group"), F.col(f"`{item}`").alias("item"), tidy(F.col(f"`{score}`")).alias("score"))
    rows = rows.where("score IS NOT NULL AND item IS NOT NULL")
    order = [F.col("group").asc(), F.col("score").desc(), F.col("item").asc()]
    kinds = dict(rows.dtypes)
    schema = f"group {kinds['group']}, item {kinds['item']}, score double, rank int"
    local = rows.sortWithinPartitions(*order).mapInArrow(_emit(n), schema).drop("rank")
    final = local.repartition(F.col("group")).sortWithinPartitions(*order).mapInArrow(_emit(n), schema)
    names = [group, item, score, "rank"]
    return final.toDF(*names) if len(set(names)) == 4 else final
