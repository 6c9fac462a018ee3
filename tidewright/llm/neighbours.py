"""The k most similar vectors of every vector, by overlapping cells and exact cosines.

Vectors are made unit vectors; equal ones form one row. A coarse codebook of two levels cuts the collection into
cells, their number following the collection's so that cells stay small: about the square root of it on top, and under
each top centre as many centres as its share of the vectors asks for. A vector looks at the cells of its nearest top
centres only. It lies in each of the cells nearest to it and asks there, so that two vectors meet when any of their
cells is the same: that a neighbour lies beyond a border loses it only if all of their cells differ, however many cells
there are. All of a cell's vectors are scored by their cosines.

Top centres are fitted on a bounded sample (``train`` vectors of smallest hash), the cells under a top centre on
``PER_CELL`` vectors a cell, in Spark; all vectors are indexed and queried. Additive codes (:func:`encode`) are no
part of the search: the products that they approximate cost less than their tables here, and a cut by them loses cases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import durable

F4 = np.float32
#: Bytes of all cells' centres, which every task holds: cells grow beyond their wanted size only when this is used up.
CENTRE_BYTES = 64 << 20
#: Vectors that fit a cell's centre, and cells under one top centre at most.
PER_CELL, CELLS_OF_TOP = 16, 4096
BEAM = 16


@dataclass
class Index:
    """Coarse centres (and additive codebooks, where vectors are encoded)."""

    tops: np.ndarray  # tops x dim
    first: np.ndarray  # number of the first cell of each top, and of all cells
    centres: np.ndarray  # cells x dim
    books: np.ndarray  # books x words x dim

    @property
    def words(self) -> np.ndarray:
        return self.books.reshape(-1, self.books.shape[2])


def _nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + block] @ centres.T - half, axis=1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds; a centre that lost all its vectors starts again at a random one."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        order = np.argsort(own, kind="stable")
        cells, start = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(x[order], start, axis=0)
        centres[cells] = sums / np.diff(np.r_[start, len(x)])[:, None]
        empty = np.setdiff1d(np.arange(len(centres)), cells)
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def encode(rest: np.ndarray, books: np.ndarray, beam: int = 4, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Codes (one word of each book) and reconstructions, by beam search on the whole residual.

    The squared error of a partial sum s and a next word w grows by |w|^2 - 2<x, w> + 2<s, w>; all three come from
    tables, so no residual is formed until the end.
    """
    n_books, n_words, dim = books.shape
    words = books.reshape(-1, dim)
    gram = words @ words.T
    square = np.diag(gram).reshape(n_books, n_words)
    codes = np.zeros((len(rest), n_books), np.uint8)
    for at in range(0, len(rest), block):
        x = rest[at : at + block]
        n = len(x)
        dots = (x @ words.T).reshape(n, n_books, n_words)
        error, chosen = np.zeros((n, 1), F4), np.zeros((n, 1, 0), np.int64)
        for m in range(n_books):
            grow = (square[m] - 2 * dots[:, m])[:, None, :] + error[:, :, None]
            for j in range(m):
                grow += 2 * gram[chosen[:, :, j] + j * n_words, m * n_words : (m + 1) * n_words]
            flat = grow.reshape(n, -1)
            keep = min(beam if m < n_books - 1 else 1, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(flat.shape[1]), (n, 1))
            error = np.take_along_axis(flat, best, 1)
            old, word = best // n_words, best % n_words
            chosen = np.concatenate([np.take_along_axis(chosen, old[:, :, None], 1), word[:, :, None]], 2)
        codes[at : at + n] = chosen[:, 0]
    return codes, decode(codes, books)


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum((books[m][codes[:, m]] for m in range(books.shape[0])), np.zeros((len(codes), books.shape[2]), F4))


def cells_for(n: int, dim: int, cell: int) -> tuple[int, int]:
    """Numbers of top centres and of cells for n vectors: cells of about ``cell`` vectors, as far as the centres' bytes go."""
    cells = max(1, min(n // cell, CENTRE_BYTES // (4 * dim)))
    return int(np.ceil(np.sqrt(cells))), cells


def under(x: np.ndarray, top: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the cells under one top centre, fitted on its vectors, and how many of these each has."""
    centres = kmeans(x, max(1, min(cells, CELLS_OF_TOP, len(x))), 6, np.random.default_rng(top)).astype(F4)
    return centres, np.bincount(_nearest(x, centres), minlength=len(centres))


def books_for(x: np.ndarray, index: Index, n_books: int = 4, n_words: int = 64, seed: int = 1) -> np.ndarray:
    """Residual codebooks, each fitted on what beam search with the books before leaves."""
    rng = np.random.default_rng(seed)
    some = x[rng.choice(len(x), min(len(x), 16_384), replace=False)]
    some = some - index.centres[near_cells(some, index, 1)[:, 0]]
    books: list[np.ndarray] = []
    left = some
    for _ in range(n_books):
        book = kmeans(left, n_words, 6, rng)
        if len(book) < n_words:
            book = np.concatenate([book, np.zeros((n_words - len(book), x.shape[1]), F4)])
        books.append(book.astype(F4))
        left = some - encode(some, np.stack(books))[1]
    return np.stack(books)


def near_cells(x: np.ndarray, index: Index, p: int, beam: int = BEAM) -> np.ndarray:
    """The p cells nearest to each vector among those of its ``beam`` nearest top centres, nearest first; -1 where there are fewer."""
    n, tops = len(x), len(index.tops)
    beam = min(beam, tops)
    score = x @ index.tops.T - (index.tops * index.tops).sum(1) / 2
    chosen = np.argpartition(-score, beam - 1, axis=1)[:, :beam] if beam < tops else np.tile(np.arange(tops), (n, 1))
    half = (index.centres * index.centres).sum(1) / 2
    best, cell = np.full((n, beam * p), -np.inf, F4), np.full((n, beam * p), -1, np.int64)
    order = np.argsort(chosen, axis=None, kind="stable")
    owners, cuts = np.unique(chosen.ravel()[order], return_index=True)
    for t, at in zip(owners.tolist(), np.split(order, cuts[1:])):
        row, place = at // beam, at % beam
        a, b = index.first[t], index.first[t + 1]
        s = x[row] @ index.centres[a:b].T - half[a:b]
        k = min(p, b - a)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < b - a else np.tile(np.arange(k), (len(row), 1))
        into = (place * p)[:, None] + np.arange(k)
        best[row[:, None], into] = np.take_along_axis(s, top, 1)
        cell[row[:, None], into] = top + a
    order = np.lexsort((cell, -best), axis=1)[:, :p]
    return np.take_along_axis(cell, order, 1)


def _unit(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), F4).reshape(-1, dim)


def units(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """id, same (hash of the unit vector), unit (its float32 bytes) of each usable vector.

    Usable: an id, and ``dim`` numbers, none null, NaN or infinite, not all zero.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = np.flatnonzero(batch.column(1).value_lengths().to_numpy() == dim)
            part = batch.take(pa.array(right))
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(right), dim)
            fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = _unit(x[fine]).astype(F4) + F4(0)  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(fine)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "unit"])

    return rows.mapInArrow(run, "id bigint, unit binary").select("id", F.xxhash64("unit").alias("same"), "unit")


def _sample(vectors: DataFrame, n: int, rows: int) -> DataFrame:
    """About ``rows`` of n different vectors, those of smallest hash, each once."""
    share = min(1.0, 1.1 * rows / n)
    some = vectors if share == 1 else vectors.where(F.pmod("same", F.lit(1 << 30)) < int(share * (1 << 30)))
    return some.select("same", "unit").distinct()


def _train(vectors: DataFrame, n: int, dim: int, train: int, cell: int, probes: int, cell_limit: int, query_limit: int) -> tuple[Index, np.ndarray, np.ndarray]:
    """The index, and into how many sides (of items) and blocks (of queries) to cut each cell, by the samples' estimate of its size."""
    tops, cells = cells_for(n, dim, cell)
    some = _sample(vectors, n, train).orderBy(F.pmod("same", F.lit(1 << 30)), "unit").limit(train)
    x = _matrix(some.select("unit").toArrow().column(0).combine_chunks(), dim)
    rng = np.random.default_rng(1)
    top = kmeans(x, min(tops, max(1, len(x) // 8)), 6, rng).astype(F4)
    own = _nearest(x, top)
    share = np.bincount(own, minlength=len(top)) / len(x)
    wanted = np.maximum(1, np.round(share * cells)).astype(np.int64)
    if cells * PER_CELL <= len(x):
        made = [under(x[own == t], t, wanted[t]) if share[t] else (top[t : t + 1], np.zeros(1, np.int64)) for t in range(len(top))]
        seen = len(x)
    else:
        made, seen = _under_in_spark(_sample(vectors, n, cells * PER_CELL).select("unit"), top, wanted, dim)
    index = Index(top, np.cumsum([0, *(len(c) for c, _ in made)]), np.concatenate([c for c, _ in made]), np.zeros((0, 0, dim), F4))
    size = probes * np.concatenate([m for _, m in made]) * (n / seen)
    return index, 1 + (size / cell_limit).astype(np.int64), 1 + (size / query_limit).astype(np.int64)


def _under_in_spark(sample: DataFrame, top: np.ndarray, wanted: np.ndarray, dim: int) -> tuple[list, int]:
    """The same fit of cells, one task a top centre: the driver gets centres and counts (``CENTRE_BYTES`` at most), no vectors."""
    sent = sample.sparkSession.sparkContext.broadcast((top, wanted))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_nearest(_matrix(batch.column(0), dim), sent.value[0]).astype(np.int32)), batch.column(0)], ["top", "unit"])

    def fit(rows: pa.Table) -> pa.Table:
        t = rows.column("top")[0].as_py()
        x = np.frombuffer(b"".join(sorted(rows.column("unit").to_pylist())), F4).reshape(-1, dim)  # sorted: the same fit on each run
        centres, count = under(x, t, sent.value[1][t])
        return pa.table({"top": pa.array([t], pa.int32()), "centres": pa.array([centres.tobytes()], pa.binary()), "n": pa.array([count.astype(np.int64).tobytes()], pa.binary())})

    rows = sample.mapInArrow(own, "top int, unit binary").groupBy("top").applyInArrow(fit, "top int, centres binary, n binary").collect()
    got = {r["top"]: (np.frombuffer(r["centres"], F4).reshape(-1, dim), np.frombuffer(r["n"], np.int64)) for r in rows}
    made = [got.get(t, (top[t : t + 1], np.zeros(1, np.int64))) for t in range(len(top))]
    return made, max(1, int(sum(m.sum() for _, m in made)))


def _assign(vectors: DataFrame, index: Index, sides: np.ndarray, blocks: np.ndarray, dim: int, probes: int) -> DataFrame:
    """Rows for the places of cells: key, rep, unit, asks (whether it is a query there).

    A cell's places are its sides times its blocks. In each of the ``probes`` cells nearest to it a vector is an item,
    on one side and in all blocks, and a query, in one block and on all sides; where both meet, one row is both.
    ``key`` is twice the place's number, plus one for rows that only ask, so that they come after the items.
    """
    sent = vectors.sparkSession.sparkContext.broadcast((index, sides, blocks, np.cumsum(sides * blocks) - sides * blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n_sides, n_blocks, start = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                n = part.num_rows
                x, ids = _matrix(part.column(1), dim), part.column(0).to_numpy()
                near = near_cells(x, own, probes)
                row, rank = np.nonzero(near >= 0)
                cell = near[row, rank]
                side, block = ids[row] % n_sides[cell], ids[row] // 7 % n_blocks[cell]
                asks = np.repeat(np.arange(len(row)), n_sides[cell])  # a query: its block, every side
                asked_side = np.arange(len(asks)) - np.repeat(np.cumsum(n_sides[cell]) - n_sides[cell], n_sides[cell])
                lies = np.repeat(np.arange(len(row)), n_blocks[cell])  # an item: its side, every block
                in_block = np.arange(len(lies)) - np.repeat(np.cumsum(n_blocks[cell]) - n_blocks[cell], n_blocks[cell])
                other = in_block != block[lies]
                lies, in_block = lies[other], in_block[other]
                which = np.r_[asks, lies]
                item = np.r_[asked_side == side[asks], np.ones(len(lies), bool)]
                place = start[cell[which]] + np.r_[asked_side, side[lies]] * n_blocks[cell[which]] + np.r_[block[asks], in_block]
                take = pa.array(row[which])
                asking = np.r_[np.ones(len(asks), bool), np.zeros(len(lies), bool)]
                yield pa.RecordBatch.from_arrays([pa.array(place * 2 + ~item), part.column(0).take(take), part.column(1).take(take), pa.array(asking)], ["key", "rep", "unit", "asks"])

    return vectors.select(F.col("id").alias("rep"), "unit").mapInArrow(run, "key bigint, rep bigint, unit binary, asks boolean")


def _score(items: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the ids and cosines of its k best items of one place (-1 and -2 where there are fewer).

    A few more than k are taken by products of single precision and ranked by those of double precision, which are the
    same wherever a pair meets.
    """
    single = queries @ items.T
    single[query_ids[:, None] == ids[None, :]] = -4
    r = min(k + 8, len(items))
    some = np.argpartition(-single, r - 1, axis=1)[:, :r] if r < len(items) else np.tile(np.arange(r), (len(queries), 1))
    exact = np.einsum("qd,qrd->qr", queries.astype(np.float64), items[some].astype(np.float64))
    own = ids[some] == query_ids[:, None]
    exact = np.where(own, -4, exact)
    order = np.lexsort((ids[some], -exact), axis=1)[:, :k]
    best, which = np.take_along_axis(exact, order, 1), np.take_along_axis(ids[some], order, 1)
    which, best = np.where(best < -3, -1, which), np.where(best < -3, -2, best)
    if r < k:
        which = np.pad(which, ((0, 0), (0, k - which.shape[1])), constant_values=-1)
        best = np.pad(best, ((0, 0), (0, k - best.shape[1])), constant_values=-2)
    return which, best.astype(np.float64)


@dataclass
class _Place:
    """The items of one place: at most about ``cell_limit``; what only asks streams by."""

    ids: np.ndarray
    x: np.ndarray

    def answer(self, ids: np.ndarray, x: np.ndarray, k: int, block: int) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(ids), block):
            which, best = [], []
            for low in range(0, len(self.ids), 4096):  # items in blocks too, so that one block of scores has a bound
                part = slice(low, low + 4096)
                w, s = _score(self.x[part], self.ids[part], x[a : a + block], ids[a : a + block], k)
                which.append(w)
                best.append(s)
            w, s = np.concatenate(which, 1), np.concatenate(best, 1)
            if len(which) > 1:
                order = np.lexsort((w, -s), axis=1)[:, :k]
                w, s = np.take_along_axis(w, order, 1), np.take_along_axis(s, order, 1)
            both = np.concatenate([w.astype("<i8").view(np.uint8).reshape(len(w), -1), s.astype("<f4").view(np.uint8).reshape(len(s), -1)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + block]), pa.array([r.tobytes() for r in both], pa.binary())], ["rep", "found"])


def _search(assigned: DataFrame, dim: int, k: int, block: int) -> DataFrame:
    """rep, found (bytes of k ids and k cosines): the best of each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal place
            if rows:
                t = pa.Table.from_batches(rows)
                place, asks = _Place(t.column("rep").to_numpy(), _matrix(t.column("unit"), dim)), t.column("asks").to_numpy()
                yield from place.answer(place.ids[asks], place.x[asks], k, block)

        held: list[pa.RecordBatch] = []  # items of the open place, until its first row that only asks
        place: _Place | None = None
        number = -1
        for batch in batches:
            key = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)] if len(key) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(a, b - a)
                if key[a] >> 1 != number:
                    yield from close(held)
                    held, place, number = [], None, key[a] >> 1
                if not key[a] & 1:
                    held.append(part)
                    continue
                yield from close(held)
                held = []
                if place:  # else nothing lies here
                    yield from place.answer(part.column(1).to_numpy(), _matrix(part.column(2), dim), k, block)
        yield from close(held)

    rows = assigned.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return rows.mapInArrow(run, "rep bigint, found binary")


def _merge(found: DataFrame, k: int) -> DataFrame:
    """rep, near, score: the best k over all cells of a query; an item that it meets in several counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: np.ndarray, raw: np.ndarray) -> Iterator[pa.RecordBatch]:
            w = np.ascontiguousarray(raw[:, : 8 * k]).view("<i8").ravel()
            s = np.ascontiguousarray(raw[:, 8 * k :]).view("<f4").ravel().astype(np.float64)
            q = np.repeat(ids, k)
            q, w, s = (x[w >= 0] for x in (q, w, s))
            order = np.lexsort((-s, w, q))
            q, w, s = q[order], w[order], s[order]
            new = np.r_[True, (q[1:] != q[:-1]) | (w[1:] != w[:-1])][: len(q)]
            q, w, s = q[new], w[new], s[new]
            order = np.lexsort((w, -s, q))
            q, w, s = q[order], w[order], s[order]
            start = np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], np.arange(len(q)), 0)) if len(q) else np.zeros(0, np.int64)
            top = np.arange(len(q)) - start < k
            yield pa.RecordBatch.from_arrays([pa.array(q[top]), pa.array(w[top]), pa.array(s[top])], ["rep", "near", "score"])

        ids, raws = np.zeros(0, np.int64), np.zeros((0, 12 * k), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            ids, raws = np.r_[ids, batch.column(0).to_numpy()], np.concatenate([raws, raw])
            whole = np.flatnonzero(ids != ids[-1])
            if len(whole):
                yield from flush(ids[: whole[-1] + 1], raws[: whole[-1] + 1])
                ids, raws = ids[whole[-1] + 1 :], raws[whole[-1] + 1 :]
        if len(ids):
            yield from flush(ids, raws)

    return found.repartition("rep").sortWithinPartitions("rep").mapInArrow(run, "rep bigint, near bigint, score double")


def neighbours(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 5, probes: int = 6, cell: int = 200, train: int = 50_000, cell_limit: int = 20_000, query_limit: int = 200_000) -> DataFrame:
    """id, neighbor_id, score, place (from 1): for each usable vector its k most similar others by cosine.

    Equal vectors tie and the smaller id wins, also at the end of the list. With fewer than k other vectors there
    are fewer rows. Ids are unique; an id that is repeated with equal vectors counts once. Unusable vectors (see :func:`units`) are
    neither queries nor neighbours. Extra columns are ignored; an empty table gives an empty result.
    """
    vectors = units(df, id_col, vec_col, dim)
    members = durable(vectors.select("id", "same").distinct())
    reps = members.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    n = reps.count()  # different vectors: copies take no part in the fit
    if not n:
        return members.select("id", F.col("id").alias("neighbor_id"), F.lit(0.0).alias("score"), F.lit(0).alias("place"))
    several = durable(reps.where("n > 1"))
    copies = members.join(several, "same")  # equal vectors; one of each class is indexed
    index, sides, blocks = _train(vectors, n, dim, train, cell, probes, cell_limit, query_limit)
    later = copies.where("id <> rep").select("id")
    assigned = _assign(vectors.join(later, "id", "left_anti"), index, sides, blocks, dim, probes)
    near = _merge(_search(assigned, dim, k, 1024), k)
    # the smallest k + 1 ids of a class stand for it: one may be the asking vector itself
    place = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    few = copies.select("rep", "id", place.alias("i")).where(F.col("i") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    few = durable(few)
    wide = near.join(few.withColumnRenamed("rep", "near"), "near", "left").select("rep", "score", F.explode(F.coalesce("ids", F.array("near"))).alias("id"))
    own = few.select("rep", F.lit(2.0).alias("score"), F.explode("ids").alias("id"))
    ranked = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k + 1)
    lists = wide.unionByName(own).groupBy("rep").agg(ranked.alias("best"))
    asks = members.join(several, "same", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    mine = asks.join(lists, "rep").select("id", F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k).alias("best"))
    return mine.select("id", F.posexplode("best").alias("place", "x")).select(
        "id", F.col("x.id").alias("neighbor_id"), F.least(-F.col("x.s"), F.lit(1.0)).alias("score"), (F.col("place") + 1).alias("place")
    )
