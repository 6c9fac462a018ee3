"""Filling containers of fixed capacity by planning over the histogram of lengths.

The plan is made from counts: at most ``capacity`` different lengths exist, so the histogram is small however
many items there are. Best fit decreasing runs over it and yields patterns (which lengths share a container)
with the number of containers filled alike. Items take their planned slots by joining on their rank within
their length; ranks are counted in salted buckets, so a length that a third of all items have is no hot group.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Items of one length that one task ranks, and the fewest buckets.
OF_BUCKET, BUCKETS = 500_000, 64


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots as (length, first_rank, ranks, container, per_container, offset); ranks and containers count from 0.

    Opens a container with the longest length left, then fills it each time with the longest length that fits
    (the best fit for what is left); the pattern found is repeated until one of its lengths runs out.
    """
    left = {size: n for size, n in counts.items() if 0 < size <= capacity and n > 0}
    order = sorted(left)
    used = dict.fromkeys(left, 0)
    slots, container = [], 0
    while order:
        room, pattern, taken = capacity, [], {}
        while True:
            i = bisect.bisect_right(order, room) - 1
            while i >= 0 and taken.get(order[i], 0) >= left[order[i]]:
                i -= 1
            if i < 0:
                break
            size = order[i]
            n = min(room // size, left[size] - taken.get(size, 0))
            pattern.append((size, n, capacity - room))
            taken[size] = taken.get(size, 0) + n
            room -= n * size
        times = min(left[size] // n for size, n in taken.items())
        for size, n, offset in pattern:
            slots.append((size, used[size], n * times, container, n, offset))
            used[size] += n * times
            left[size] -= n * times
            if not left[size]:
                order.remove(size)
        container += times
    return slots


def _ranked(items: DataFrame, buckets: int) -> DataFrame:
    """Rank from 0 within the length: rank in a salted bucket plus the sizes of the buckets before it."""
    salted = items.withColumn("bucket", F.pmod(F.xxhash64("id", "part"), F.lit(buckets)).cast("int"))
    sizes = salted.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")
    offsets = sizes.select("size", "bucket", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("id", "part")) - 1
    local = salted.withColumn("own", own)
    return local.join(offsets, ["size", "bucket"]).select("id", "part", "size", (F.col("before") + F.col("own")).alias("rank"))


def pack(df: DataFrame, id_col: str, size_col: str, capacity: int = 2048) -> DataFrame:
    """Container and place of every item: ``id_col``, part, container, position (offset in the container), size.

    An item is cut only if it is longer than a container: into parts of the full capacity, each a container of
    its own, and a last part that is packed like an item. Items of size null, 0 or less take no room: they come
    out with container null and position null. Ties are broken by id, so the result is the same on each run; repeated rows
    are items of their own. Extra columns are ignored.
    """
    spark = df.sparkSession
    items = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{size_col}`"), F.lit(0)).cast("bigint").alias("whole"))
    parts = F.greatest(F.ceil(F.col("whole") / capacity), F.lit(1)).cast("int")
    cut = items.select("id", "whole", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    size = F.when(F.col("part") < F.col("parts") - 1, capacity).otherwise(F.col("whole") - (F.col("parts") - 1) * capacity)
    sized = cut.select("id", "part", size.cast("int").alias("size"))
    some = sized.where("size > 0")
    counts = {r["size"]: r["n"] for r in some.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    ranked = _ranked(some, max(BUCKETS, max(counts.values(), default=0) // OF_BUCKET))
    placed = ranked.mapInArrow(_place(spark, plan(counts, capacity)), f"id {dict(items.dtypes)['id']}, part int, container bigint, position int, size int")
    none = sized.where("size <= 0").select("id", "part", F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("int").alias("position"), F.lit(0).alias("size"))
    return placed.unionByName(none).withColumnRenamed("id", id_col)


def _place(spark: SparkSession, rows: list[tuple[int, int, int, int, int, int]]):
    """Looks up each item's slot by length and rank; a few slots for each of at most ``capacity`` lengths are broadcast."""
    slots = np.array(rows, np.int64).reshape(-1, 6)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    sent = spark.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, container, per, offset = sent.value.T
        starts = length.astype(np.uint64) << np.uint64(40) | first.astype(np.uint64)
        for batch in batches:
            size, rank = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            at = np.searchsorted(starts, size.astype(np.uint64) << np.uint64(40) | rank.astype(np.uint64), side="right") - 1
            into = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(container[at] + into // per[at]), pa.array((offset[at] + into % per[at] * size).astype(np.int32)), batch.column(2)], ["id", "part", "container", "position", "size"]
            )

    return run
