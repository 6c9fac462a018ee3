"""Near-duplicate texts after small edits: BK-trees over fingerprints, in shards, then an exact check.

A text is the set of its word k-tuples. Texts with the same set form one class and are searched once. A class
has a fingerprint of 192 bits (the sign of each bit's vote over the set), whose Hamming distance follows the
angle between two sets, and a key in each of ``bands`` shards (the minima of ``rows`` hash functions). Every shard
becomes a BK-tree, children keyed by their integer Hamming distance to the parent; each of its classes is looked
up in the tree by following only the edges within the radius. All trees of a task grow and are searched together,
one level at a time, in whole arrays (:class:`Forest`). Pairs found are checked exactly on their sets.

Trees are built where the shuffle brings a shard together instead of being broadcast: all trees together hold
every class once per band, so no broadcast of them has a size bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import durable, few

U = np.uint64
WORD_SEED = 0x9E3779B97F4A7C15
#: Columns of the fingerprint, 64 bits each, and the seeds of their votes.
PRINTS = ("f1", "f2", "f3")
VOTE_SEEDS = (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible pattern (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(WORD_SEED, -1, 1 << 64)
    return np.cumprod(np.full(n, WORD_SEED, U)), np.cumprod(np.full(n, inverse, U))


def tuples(texts: list[str | None], k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct k-tuples of lower-case words of each text, sorted by both.

    Words are maximal runs of letters or digits. One pass over the code points of all texts: word hashes are
    differences of prefix sums of a polynomial, tuple hashes mix k neighbours of one text.
    """
    lower = [t.lower() if t else "" for t in texts]
    length = np.fromiter(map(len, lower), np.int64, len(lower))
    code = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum(length + 1) - (length + 1)
    edge = np.diff(np.r_[False, _alnum()[code], False].astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(a) < k:
        return np.zeros(0, np.int64), np.zeros(0, U)
    power, inverse = _powers(1 << max(20, int(len(code) + 1).bit_length()))
    total = np.r_[U(0), np.cumsum(mix(code.astype(U) + U(1)) * power[: len(code)])]
    word = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(U))
    owner = np.searchsorted(first, a, side="right") - 1
    n = len(word) - k + 1
    h = np.zeros(n, U)
    for i in range(k):
        h = mix(h * U(3) + word[i : i + n])
    whole = owner[k - 1 :] == owner[:n]
    owner, h = owner[:n][whole], h[whole]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    return owner[new], h[new]


def signatures(owner: np.ndarray, h: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text that has tuples: its index, the hash of its set, the fingerprint's words, and its key in each band."""
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    texts, size = owner[start], np.diff(np.r_[start, len(owner)])
    same = mix(np.add.reduceat(mix(h ^ U(0x5851F42D4C957F2D)), start) + size.astype(U))
    words = []
    for seed in VOTE_SEEDS:
        bits = np.unpackbits((h * U(seed) ^ (h >> U(29))).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
        words.append(np.packbits(votes * 2 > size[:, None], axis=1).view(U).ravel())
    keys = np.empty((len(start), bands), U)
    for band in range(bands):
        key = np.full(len(start), band + 1, U)
        for row in range(rows):
            seed = int(mix(np.array([band * rows + row + 1], U))[0])
            key = mix(key * U(3) + np.minimum.reduceat((h ^ U(seed)) * U(seed | 1), start))
        keys[:, band] = key
    return texts, same, np.stack(words, 1), keys


class Forest:
    """BK-trees of many shards, grown and searched level by level."""

    def __init__(self, shard: np.ndarray, prints: np.ndarray):
        """Rows must be sorted by shard, each print once in a shard; the first row of each is its tree's root."""
        n = len(shard)
        self.prints = prints
        self.root = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.tree = np.cumsum(np.r_[True, shard[1:] != shard[:-1]]) - 1
        self.visits = 0  # distances that searches have asked for
        node = np.full(n, -1, np.int64)
        node[self.root] = self.root
        at = self.root[self.tree]  # where each unplaced row stands on its way down
        open_rows = np.flatnonzero(node < 0)
        parent, edge, child = [], [], []
        while len(open_rows):
            d = self.distance(at[open_rows], open_rows)
            slot = at[open_rows] * 256 + d
            taken, who = np.unique(slot, return_index=True)  # the first row that comes becomes the child
            new = open_rows[who]
            parent.append(taken // 256)
            edge.append(taken % 256)
            child.append(new)
            node[new] = new
            at[open_rows] = new[np.searchsorted(taken, slot)]
            open_rows = open_rows[node[open_rows] < 0]
        parent, edge, child = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parent, edge, child))
        order = np.argsort(parent * 256 + edge, kind="stable")
        self.slot, self.child = (parent * 256 + edge)[order], child[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.prints[a] ^ self.prints[b]).sum(axis=1, dtype=np.int64)

    def search(self, radius: int, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (found row, query row), found before query, of each shard within the radius.

        A row stands below earlier rows only, so a subtree that begins behind the query holds nothing for it: each pair
        of rows is looked at once at most.
        """
        for low in range(0, len(self.tree), block):
            query = np.arange(low, min(low + block, len(self.tree)))
            node = self.root[self.tree[query]]
            query, node = query[node < query], node[node < query]
            while len(query):
                self.visits += len(query)
                d = self.distance(query, node)
                hit = d <= radius
                yield node[hit], query[hit]
                # children whose edge lies within the radius of this distance stand next to each other
                a = np.searchsorted(self.slot, node * 256 + np.maximum(d - radius, 0))
                b = np.searchsorted(self.slot, node * 256 + np.minimum(d + radius, 255), side="right")
                n = b - a
                query = np.repeat(query, n)
                node = self.child[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                query, node = query[node < query], node[node < query]


def near_pairs(shard: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
    """Pairs of row numbers (a, b), a < b, of one shard whose prints lie within the radius; and the distances asked for.

    Rows must be sorted by shard. Rows of equal print share one node of the tree.
    """
    order = np.lexsort((*prints.T, shard))
    s, p = shard[order], prints[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (p[1:] != p[:-1]).any(axis=1)]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(order)])
    forest = Forest(s[first], p[first])
    several = np.flatnonzero(size > 1)
    found = [np.stack([several, several], 1), *(np.stack(x, 1) for x in forest.search(radius))]
    pair = np.concatenate(found)
    n = size[pair[:, 0]] * size[pair[:, 1]]
    which = np.repeat(np.arange(len(pair)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = size[pair[which, 1]]
    a, b = order[first[pair[which, 0]] + at // wide], order[first[pair[which, 1]] + at % wide]
    both = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
    twice = pair[which, 0] == pair[which, 1]
    return both[~twice | (a < b)], forest.visits


_PRINTS = ", ".join(f"{c} bigint" for c in PRINTS)


def _prepare(df: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """id, same (hash of the set), the fingerprint, keys (of the bands; null if the class came before in this partition)."""
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                owner, h = tuples(part.column(1).to_pylist(), k)
                if not len(h):
                    continue
                texts, same, prints, keys = signatures(owner, h, bands, rows)
                fresh = []
                for s in same.tolist():
                    fresh.append(s not in seen)
                    seen.add(s)
                flat = pa.array([r.tobytes() if f else None for r, f in zip(keys, fresh)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(texts)), pa.array(same.view(np.int64)), *[pa.array(np.ascontiguousarray(p).view(np.int64)) for p in prints.T], flat], ["id", "same", *PRINTS, "keys"]
                )

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, same bigint, {_PRINTS}, keys binary")


def _shards(prepared: DataFrame, bands: int) -> DataFrame:
    """One row per class and band: key, same and the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)
                again = np.repeat(np.arange(n), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *[c.take(pa.array(again)) for c in batch.columns[1:]]], ["key", "same", *PRINTS])

    return prepared.where("keys IS NOT NULL").select("keys", "same", *PRINTS).mapInArrow(run, f"key bigint, same bigint, {_PRINTS}")


def _hot(shards: DataFrame, limit: int, sample: int = 64) -> DataFrame:
    """Keys that hold more than about ``limit`` classes, with the number of blocks to cut them into: key, blocks.

    Estimated on the classes of every ``sample``-th hash value; it steers the work's spread and loses nothing.
    """
    part = shards.where(F.pmod(F.xxhash64("same"), F.lit(sample)) == 0).groupBy("key").agg((F.approx_count_distinct("same") * sample).alias("n"))
    return part.where(F.col("n") > limit).select("key", ((F.col("n") / limit).cast("int") + 1).alias("blocks"))


def _blocks(shards: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds ``side``: 0 for plain shards. A hot shard is cut into blocks, each pair of which is a shard of its own.

    The list of hot keys is broadcast while it is short, else joined by a shuffle, in which AQE splits what is skewed.
    """
    hot = durable(hot)
    if hot.isEmpty():
        return shards.withColumn("side", F.lit(0))
    joined = shards.join(F.broadcast(hot) if few(hot) else hot, "key", "left")
    own = F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int")
    copies = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    each = joined.withColumn("own", own).withColumn("other", F.explode(copies))
    pair = F.when(F.col("blocks").isNull(), 0).otherwise(1 + F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    return each.select("key", "same", *PRINTS, pair.cast("int").alias("side"))


def _candidates(shards: DataFrame, radius: int, chunk: int = 1 << 19) -> DataFrame:
    """Distinct pairs of classes (a, b), a < b, that some tree finds within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            key, side, same, *words = map(np.concatenate, zip(*held))
            shard = mix(key.view(U) + mix(side.astype(U)))
            order = np.lexsort((same, shard))
            shard, same = shard[order], same[order]
            new = np.r_[True, (shard[1:] != shard[:-1]) | (same[1:] != same[:-1])]  # a class that several partitions sent
            order, shard, same = order[new], shard[new], same[new]
            twice = np.r_[False, shard[1:] == shard[:-1]]
            twice = twice | np.r_[twice[1:], False]
            shard, same, prints = shard[twice], same[twice], np.stack([w[order[twice]] for w in words], 1).view(U)
            if not len(shard):
                return
            pair = same[near_pairs(shard, prints, radius)[0]]
            unique = np.unique(np.stack([pair.min(axis=1), pair.max(axis=1)], 1), axis=0) if len(pair) else np.zeros((0, 2), np.int64)
            for at in range(0, len(unique), 1 << 16):
                part = unique[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["a", "b"])

        held: list[list[np.ndarray]] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy() for c in batch.columns]
            if count + batch.num_rows >= chunk:  # rows come sorted by key: all but the open shard can go
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                if cut or held and held[-1][0][-1] != rows[0][0]:
                    yield from found([*held, [c[:cut] for c in rows]])
                    held, count, rows = [], 0, [c[cut:] for c in rows]
            held.append(rows)
            count += len(rows[0])
        if held:
            yield from found(held)

    rows = shards.select("key", "side", "same", *PRINTS).repartition("key", "side").sortWithinPartitions("key")
    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _bits(n: int) -> int:
    """Bits of a bitmap for n values: eight each, within 1 Mbit and 256 Mbit (32 MB, the most that is broadcast)."""
    return 1 << min(28, max(20, (8 * n - 1).bit_length()))


def _place(column: str, bits: int):
    return F.pmod(F.xxhash64(column), F.lit(bits)).cast("int")


def _bitmap(rows: DataFrame, column: str, bits: int) -> bytes:
    """A bit for each hash of the column; it tells any number of values from the rest, in part when they are very many."""
    place = _place(column, bits) + 1  # Spark counts buckets and their bits from 1
    parts = rows.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = bytearray(bits // 8)
    for r in parts.collect():  # the bitmap's own size
        m = bytes(r["m"])
        out[(r["n"] - 1) * len(m) : r["n"] * len(m)] = m
    return bytes(out)


def _marked(rows: DataFrame, column: str, bitmap: bytes) -> DataFrame:
    """The rows whose column has its bit set: all that are wanted and, by chance, some more."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            p = batch.column(batch.num_columns - 1).to_numpy()
            yield batch.filter(pa.array(((bits[p >> 3] >> (p & 7)) & 1).astype(bool))).select(list(range(batch.num_columns - 1)))

    return rows.withColumn("__place", _place(column, 8 * len(bitmap))).mapInArrow(keep, schema)


def _sets(df: DataFrame, prepared: DataFrame, ends: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """same, tuples (as bytes) of one text of each class in ``ends`` (a few others may come along).

    Bitmaps keep the texts that no pair asks for out of the join's shuffle.
    """
    bits = _bits(ends.count())
    first = _marked(prepared.where("keys IS NOT NULL").select("id", "same"), "same", _bitmap(ends, "same", bits))
    some = durable(first.groupBy("same").agg(F.min("id").alias("id")))
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    texts = _marked(texts, "id", _bitmap(some, "id", bits)).join(some, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                owner, h = tuples(part.column(0).to_pylist(), k)
                cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
                data = [h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(data, pa.binary())], ["same", "tuples"])

    return texts.select("text", "same").mapInArrow(run, "same bigint, tuples binary")


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets are at least ``least`` similar, with their similarity."""
    left = pairs.join(sets.select(F.col("same").alias("a"), F.col("tuples").alias("x")), "a")
    both = left.join(sets.select(F.col("same").alias("b"), F.col("tuples").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = np.empty(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                u, v = np.frombuffer(x, U), np.frombuffer(y, U)
                both_ = np.sort(np.concatenate([u, v]))
                common = int(np.count_nonzero(both_[1:] == both_[:-1]))
                share[i] = common / (len(u) + len(v) - common)
            good = pa.array(share >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], ["a", "b", "similarity"]).filter(good)

    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, similarity double")


def similar(df: DataFrame, id_col: str, text_col: str, k: int = 5, least: float = 0.8, bands: int = 20, rows: int = 4, radius: int = 55, shard_limit: int = 5_000) -> tuple[DataFrame, DataFrame]:
    """Classes of equal tuple sets and the pairs of classes that are at least ``least`` similar.

    Returns ``members`` (id, same) and ``pairs`` (a, b, similarity; a and b are values of ``same``). Rows with a
    null id or text, or with fewer than k words, belong to no class; repeated rows are members again; extra columns
    are ignored; an empty table gives empty results.
    """
    prepared = durable(_prepare(df, id_col, text_col, k, bands, rows))
    shards = _shards(prepared, bands)
    pairs = durable(_candidates(_blocks(shards, _hot(shards, shard_limit)), radius))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("same"))
    checked = _checked(pairs, _sets(df, prepared, ends, id_col, text_col, k), least)
    return prepared.select("id", "same"), checked


def expand(members: DataFrame, pairs: DataFrame, block: int = 1000) -> DataFrame:
    """Pairs of rows (id_a, id_b), id_a < id_b: all pairs of similar classes, and all of one class, whatever its size.

    The result grows with the square of a class, as the pairs do; :func:`groups` is the linear form. The rows of a class
    of more than ``block`` rows are spread over blocks, so that no task puts out all its pairs; this loses nothing.
    """
    once = members.distinct()
    sizes = once.groupBy("same").agg(F.count("*").alias("n")).where("n > 1")  # counted map-side first
    known = durable(once.join(sizes, "same", "left"))
    blocks = (F.coalesce(F.col("n"), F.lit(1)) / block).cast("int") + 1
    known = known.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own")
    large = known.where("blocks > 1").select(F.col("same").alias("b"), "blocks").distinct()
    a, b = known.select(F.col("same").alias("a"), F.col("id").alias("x")), known.select(F.col("same").alias("b"), "own", F.col("id").alias("y"))
    ends = pairs.select("a", "b").join(large, "b", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    across = ends.join(a, "a").select("b", "x", each).join(b, ["b", "own"]).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    several = known.where("n > 1")
    left, right = several.select("same", F.col("id").alias("id_a"), each), several.select("same", "own", F.col("id").alias("id_b"))
    within = left.join(right, ["same", "own"]).where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within)


def groups(members: DataFrame, pairs: DataFrame, most: int = 30) -> DataFrame:
    """One row per row of the table: id, class_id, group_id, links.

    A class or group is named by its smallest id; a group is what links hold together over any number of steps. ``links``
    counts the other classes that are similar to the row's own. Labels spread over the links and jump to their label's
    label each round, so rounds grow with the logarithm of the longest chain.
    """
    both = durable(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    label = durable(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("same"), F.least("u", "v").alias("label")))
    for _ in range(most):
        near = both.join(label.select(F.col("same").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = label.join(near, label.same == near.u).select("same", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.join(step.select(F.col("same").alias("label"), F.col("label").alias("far")), "label", "left")
        after = durable(jump.select("same", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        label = after.select("same", "label")
        if after.where("old <> label").isEmpty():
            break
    else:
        raise RuntimeError("groups did not settle; raise `most`")
    links = both.groupBy("u").agg(F.count("*").alias("links")).withColumnRenamed("u", "same")
    classes = members.groupBy("same").agg(F.min("id").alias("class_id"))
    info = classes.join(label, "same", "left").join(links, "same", "left").withColumn("label", F.coalesce("label", "same"))
    info = info.join(info.groupBy("label").agg(F.min("class_id").alias("group_id")), "label")
    return members.join(info, "same").select("id", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
