"""Splitting oversized texts at natural boundaries by pointer doubling.

All boundaries of all texts of an Arrow batch stand in one table. Each boundary is joined once to its farthest
legal successor (:func:`successors`); the table is then squared again and again, which marks every cut of the
greedy split in log2(cuts) passes over whole arrays instead of a walk through each text. A text is one row and
its pieces depend on no other row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters other than white space after which a text may be cut.
SENTENCE_ENDS = "。！？"


def _flags() -> np.ndarray:
    """Per code point of the BMP: 1 white space, 2 sentence end."""
    kind = np.zeros(0x10000, np.uint8)
    kind[[i for i in range(0x10000) if chr(i).isspace()]] = 1
    kind[[ord(c) for c in SENTENCE_ENDS]] = 2
    return kind


def reach(step: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mask of the nodes on the chains that begin at ``starts`` and follow ``step`` (a fixed point ends a chain).

    Pass i knows the nodes within 2**i steps and the table of 2**i-fold steps; the next pass adds their images
    and squares the table.
    """
    on = np.zeros(len(step), bool)
    on[starts] = True
    jump = step
    while True:
        on[jump[np.flatnonzero(on)]] = True
        squared = jump[jump]
        if np.array_equal(squared, jump):
            return on
        jump = squared


def successors(points: np.ndarray, owner_end: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary taken as a piece's end: index of the boundary where the next piece starts, and of its end.

    ``points`` rise within and across texts; ``owner_end`` is the index of the last boundary of each one's text.
    The next piece starts at the first boundary at or after ``end - overlap`` and ends at the last boundary within
    ``limit`` of its start; where that would not go beyond this end, it starts here instead.
    """
    here = np.arange(len(points))
    back = np.searchsorted(points, points - overlap, side="left")
    first = np.searchsorted(owner_end, owner_end, side="left")  # index of the first boundary of the same text
    start = np.maximum(np.minimum(back, here), first)
    last = lambda i: np.minimum(np.searchsorted(points, points[i] + limit, side="right") - 1, owner_end)
    stop = last(start)
    stuck = stop <= here
    start = np.where(stuck, here, start)
    return start, np.where(stuck, last(start), stop)


def split_batch(texts: list[str], limit: int, overlap: int, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Piece starts, ends (in characters of their text), the piece's text index, and per text whether it is forced."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(lengths + 2 * limit) - (lengths + 2 * limit)  # texts stand so far apart that no piece crosses
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    flag = np.where(code < 0x10000, kind[np.minimum(code, 0xFFFF)], 0)
    owner = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # a boundary lies behind white space or a sentence end; a run of white space has one, at its end
    white_next = np.r_[flag[1:] == 1, False] & np.r_[owner[1:] == owner[:-1], False] if len(code) else np.zeros(0, bool)
    cut = np.flatnonzero((flag > 0) & ~((flag == 1) & white_next))
    own = np.r_[owner[cut], np.arange(len(texts)), np.arange(len(texts))]
    pos = np.r_[at[cut] + 1, np.zeros(len(texts), np.int64), lengths]
    points = np.unique(base[own] + pos)
    text_of = np.searchsorted(base, points, side="right") - 1
    # stretches without any boundary character, for the verdict and for forced cuts
    mark = np.flatnonzero(flag > 0)
    edge = np.r_[owner[mark], np.arange(len(texts)), np.arange(len(texts))]
    place = np.r_[at[mark], np.full(len(texts), -1), lengths]
    order = np.lexsort((place, edge))
    edge, place = edge[order], place[order]
    run = np.where(edge[1:] == edge[:-1], place[1:] - place[:-1] - 1, 0)
    forced = np.zeros(len(texts), bool)
    forced[edge[1:][run > limit]] = True
    # where neighbours are farther apart than a piece may grow, boundaries are set every `limit - overlap` characters
    gap = np.r_[np.where(text_of[1:] == text_of[:-1], points[1:] - points[:-1], 0), 0]
    wide = np.flatnonzero(gap > limit - overlap)
    if len(wide):
        step = max(1, limit - overlap)
        n = (gap[wide] - 1) // step
        extra = np.repeat(points[wide], n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
        every = np.unique(np.r_[points, extra])
        soft = np.isin(every, points)
        points, text_of = every, np.searchsorted(base, every, side="right") - 1
    else:
        soft = np.ones(len(points), bool)
    owner_end = np.searchsorted(text_of, text_of, side="right") - 1
    start, stop = successors(points, owner_end, limit, overlap)
    # a natural boundary wins over a set one within the same reach if the piece advances and outgrows the overlap
    natural = np.maximum.accumulate(np.where(soft, np.arange(len(points)), -1))
    better = natural[stop]
    stop = np.where((better > np.arange(len(points))) & (points[better] > points[start] + overlap), better, stop)
    firsts = np.searchsorted(text_of, np.arange(len(texts)), side="left")
    lasts = np.r_[firsts[1:], len(points)] - 1
    head = np.minimum(np.searchsorted(points, points[firsts] + limit, side="right") - 1, lasts)
    head = np.where(points[natural[head]] > points[firsts] + overlap, natural[head], head)
    ends = np.flatnonzero(reach(stop, head) & (np.arange(len(points)) > firsts[text_of]))
    first = ends == head[text_of[ends]]
    # the end before, in the same text, says where a piece starts
    before = np.r_[0, ends[:-1]]
    begin = np.where(first, firsts[text_of[ends]], start[before])
    return points[begin] - base[text_of[ends]], points[ends] - base[text_of[ends]], text_of[ends], forced


def split(df: DataFrame, id_col: str, text_col: str, limit: int = 1200, overlap: int = 100) -> DataFrame:
    """Pieces of every text longer than ``limit`` characters: columns ``id_col``, piece, text, start_char, end_char, token_count, cut.

    Greedy: a piece ends at the last boundary within the limit, the next starts at the first boundary in the last
    ``overlap`` characters before that end (at the end itself if there is none, or if the piece could not advance).
    Boundaries lie behind white space and behind 。！？. Where a stretch without boundary is too long, boundaries are
    set in it every ``limit - overlap`` characters. Joined without their overlaps the pieces give the text again.
    ``cut`` is ``forced`` if some stretch of more than ``limit`` characters holds no boundary character, else
    ``natural``. Characters are Unicode code points; token_count is the piece's number of characters. Null, empty
    and short texts have no pieces. Repeated rows are split each for itself; extra columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text") > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _flags()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                starts, ends, own, forced = split_batch(texts, limit, overlap, kind)
                first = np.searchsorted(own, own, side="left")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(own)),
                        pa.array((np.arange(len(own)) - first).astype(np.int32)),
                        pa.array([texts[o][a:b] for o, a, b in zip(own.tolist(), starts.tolist(), ends.tolist())], pa.string()),
                        pa.array(starts.astype(np.int32)),
                        pa.array(ends.astype(np.int32)),
                        pa.array((ends - starts).astype(np.int32)),
                        pa.array(np.where(forced[own], "forced", "natural"), pa.string()),
                    ],
                    ["id", "piece", "text", "start_char", "end_char", "token_count", "cut"],
                )

    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(run, f"id {kind}, piece int, text string, start_char int, end_char int, token_count int, cut string")
    return out.withColumnRenamed("id", id_col)


def cuts(split_pieces: DataFrame, id_col: str) -> DataFrame:
    """One row per split text with its ``cut``: that of its first piece, which each text has once per row."""
    keep: list[Column | str] = [id_col, "cut"]
    return split_pieces.where("piece = 0").select(*keep)
