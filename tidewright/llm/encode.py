"""Encoding of a corpus with a public byte-level BPE vocabulary, through a table of distinct words.

The texts are split into words in the JVM by the vocabulary's own pattern; BPE never crosses a word, so each
distinct word is encoded once, on the executors, and the ids go back to every place of the word by a join.
The most frequent words, as many as ``table_bound`` bytes hold, are broadcast and joined by a vectorised look-up where
the texts lie. What that leaves, the places of rare words, is joined by a shuffle by word: no word of it is hot, as
every hot word was among the broadcast ones. Texts are not moved.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import durable, widen

#: Fixed value: the public word pattern of the byte_bpe_50k vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZERS = "/opt/tokenizers"


def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: one piece in base64 and its id per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def words(df: DataFrame, id_col: str, text_col: str, pattern: str = WORD_PATTERN) -> DataFrame:
    """``id`` and ``words``, the words of each text in order; none for null and empty texts."""
    split = F.regexp_extract_all(F.col("text"), F.lit(f"(?U){pattern}"), F.lit(0))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return widen(rows).select("id", split.alias("words"))


def word_table(split: DataFrame, path: str, pattern: str = WORD_PATTERN) -> DataFrame:
    """Distinct words with their ids and how often they occur: ``word``, ``n``, ``ids``."""

    split.sparkSession.sparkContext.addFile(path)  # executors need not have the tokenizers' folder

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        held = ranks(SparkFiles.get(os.path.basename(path)))
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=held, special_tokens={})
        for batch in batches:
            ids = [own.encode_ordinary(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    # partial aggregation leaves one row per word and partition before the shuffle
    distinct = split.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return durable(distinct.mapInArrow(encode, "word string, n bigint, ids array<int>"))


def encode(df: DataFrame, id_col: str, text_col: str, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k", pattern: str = WORD_PATTERN, table_bound: int = 48 << 20) -> DataFrame:
    """``id_col`` and ``ids``, the token ids of each text without special tokens; an empty list for null and empty texts.

    Strings that look like special tokens are ordinary text. One row per input row: repeated rows are encoded
    each for itself, null ids are kept, extra columns are ignored, an empty table gives an empty result.
    """
    path = os.path.join(tokenizers, f"{name}.tiktoken")
    split = words(df, id_col, text_col, pattern)
    table = word_table(split, path, pattern)
    least = _least(table, table_bound)
    if least is None:
        return _look_up(split, table).select(F.col("id").alias(id_col), "ids")
    return _fill(_look_up(split, table.where(F.col("n") >= least)), table.where(F.col("n") < least)).withColumnRenamed("id", id_col)


def _least(table: DataFrame, bound: int) -> int | None:
    """How often a word must occur to be broadcast, so that these words take ``bound`` bytes at most; None if all do.

    Word counts are told apart by their number of bits, so the driver gets some sixty rows.
    """
    sizes = F.sum(F.octet_length("word") + 4 * F.size("ids") + 16).alias("size")
    rows = table.groupBy(F.length(F.bin("n")).alias("bits")).agg(sizes).orderBy(F.col("bits").desc()).collect()
    held = 0
    for r in rows:
        held += r["size"]
        if held > bound:
            return 1 << r["bits"]
    return None


def _look_up(split: DataFrame, table: DataFrame) -> DataFrame:
    """id, ids, gaps: the join against a table of checked size, in Arrow's hash look-up.

    ``gaps`` has the words that the table lacks, each with the place in ``ids`` where its ids belong.
    """
    held = table.select("word", "ids").toArrow().combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema) as out:
        out.write_table(held)
    sent = split.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    gap = pa.struct([("at", pa.int32()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = pa.ipc.open_stream(sent.value).read_all()
        known, lists = (side.column(c).combine_chunks() if side.num_rows else pa.array([], t) for c, t in (("word", pa.string()), ("ids", pa.list_(pa.int32()))))
        flat, length = lists.flatten().to_numpy(), np.r_[lists.value_lengths().to_numpy().astype(np.int64), 0]
        first = np.cumsum(length) - length

        def found(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = batch.column(1)
            each = rows.flatten()
            at = pc.index_in(each, value_set=known).fill_null(len(known)).to_numpy(zero_copy_only=False).astype(np.int64)
            n = length[at]
            into = np.cumsum(n) - n
            ids = flat[np.repeat(first[at] - into, n) + np.arange(n.sum())]
            stop = np.cumsum(rows.value_lengths().to_numpy().astype(np.int64))  # each row's last word
            ends = np.r_[0, np.r_[0, np.cumsum(n)][stop]]
            out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            lacking = np.flatnonzero(at == len(known))
            place = into[lacking] - ends[np.searchsorted(stop, lacking, side="right")]
            pairs = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), each.take(pa.array(lacking))], fields=list(gap))
            gaps = pa.ListArray.from_arrays(pa.array(np.r_[0, np.searchsorted(lacking, stop)].astype(np.int32)), pairs)
            return pa.RecordBatch.from_arrays([batch.column(0), out, gaps], ["id", "ids", "gaps"])

        # the look-up hashes the whole table each time, so batches are put together until they have more words than it
        waiting, count = [], 0
        for batch in batches:
            waiting.append(batch)
            count += len(batch.column(1).flatten())
            if count >= len(known):
                yield from map(found, pa.Table.from_batches(waiting).combine_chunks().to_batches())
                waiting, count = [], 0
        if waiting:
            yield from map(found, pa.Table.from_batches(waiting).combine_chunks().to_batches())

    return split.mapInArrow(run, f"id {dict(split.dtypes)['id']}, ids array<int>, gaps array<struct<at:int,word:string>>")


def _fill(looked: DataFrame, table: DataFrame) -> DataFrame:
    """Puts the ids of rare words into their gaps; rows without gaps take no part in the joins."""
    rows = durable(looked.withColumn("row", F.monotonically_increasing_id()))
    # gaps of one place keep their order; a text's gaps come together in one row, as its words did
    places = rows.select("row", F.posexplode("gaps").alias("i", "gap")).select("row", "i", "gap.at", "gap.word")
    back = places.join(table.select("word", F.col("ids").alias("own")), "word").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "at", "own"))).alias("fill"))
    full = rows.where(F.size("gaps") > 0).select("row", "id", "ids").join(back, "row").select("id", "ids", F.col("fill.at").alias("at"), F.col("fill.own").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, at, own in zip(batch.column(1), batch.column(2), batch.column(3)):
                n = own.values.value_lengths().to_numpy()
                out.append(np.insert(ids.values.to_numpy(), np.repeat(at.values.to_numpy(), n), own.values.flatten().to_numpy()))
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*out, np.zeros(0, np.int32)]), pa.int32()))], ["id", "ids"])

    return rows.where(F.size("gaps") == 0).select("id", "ids").unionByName(full.mapInArrow(run, f"id {dict(looked.dtypes)['id']}, ids array<int>"))


def pieces(spark, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """The vocabulary as a table: ``token``, ``piece`` (bytes). Its size is fixed by the vocabulary file."""
    table = ranks(os.path.join(tokenizers, f"{name}.tiktoken"))
    return spark.createDataFrame([(i, bytearray(b)) for b, i in table.items()], "token int, piece binary")


def decode(encoded: DataFrame, id_col: str, pieces_table: DataFrame) -> DataFrame:
    """``id_col`` and ``text`` from ``ids`` through a join of ids with pieces; bytes that are no UTF-8 become U+FFFD."""
    rows = encoded.select(F.col(f"`{id_col}`").alias("id"), "ids")
    places = rows.select("id", F.posexplode_outer("ids").alias("pos", "token"))
    joined = places.join(F.broadcast(pieces_table), "token", "left")
    ordered = joined.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("piece").alias("hex")))).alias("x"))
    data = F.unhex(F.concat_ws("", F.col("x.hex")))
    return ordered.select("id", F.make_valid_utf8(data.cast("string")).alias("text")).withColumnRenamed("id", id_col)
