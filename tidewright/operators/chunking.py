"""Chunkers: one text in, ordered chunks out. Each text is split for itself, so nothing is shuffled.

A batch of texts is one array of code points. Tables over it say where white space begins and ends, where sentences and
paragraphs may be cut and where the separators lie; parts are spans in it. A chunk that begins at some part ends at the
farthest part that still fits, which a search in the running sum of sizes tells. So all texts of a batch go forward
together, a chunk at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Chunk = tuple[str, int, int]  # text, start, end
#: Sizes of many strings; without one a string counts its characters.
Counter = Callable[[list[str]], list[int]]

# Separators of the recursive chunker, coarse to fine, and of the fixed-size one; ends of sentences;
# sentences below this length are merged; headers.
SEPARATORS = ("\n\n", "\n", ". ", "。", " ", "")
BREAKS = (". ", "\n", " ")
SENTENCE_ENDS = ".!?。！？\n"
LEAST_SENTENCE = 20
_HEADER = re.compile(r"^#{1,6}\s+.+$", re.M)


def words(texts: list[str]) -> list[int]:
    """A counter: words between white space."""
    return [len(t.split()) for t in texts]


def sliding_window(docs: DataFrame, id_col: str, text_col: str, size: int = 100, overlap: int = 20) -> DataFrame:
    """Windows of ``size`` words: id, chunk_index, text, start_word, end_word. All built-in: words, starts, slices.

    The step is size - overlap, at least 1; the first window that reaches the end is the last. Null and blank texts
    have none.
    """
    step = max(1, size - overlap)
    w = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(r"(\S+)"), F.lit(1)).alias("w")).where(F.size("w") > 0)
    last = F.ceil(F.greatest(F.size("w") - size, F.lit(0)) / step).cast("int")
    cut = w.select("id", F.size("w").alias("n"), "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    end = F.least(start + size, F.col("n"))
    return cut.select("id", "chunk_index", F.array_join(F.slice("w", start + 1, F.lit(size)), " ").alias("text"), start.alias("start_word"), end.alias("end_word"))


# ---------------------------------------------------------------- tables over a batch


@lru_cache(maxsize=1)
def _is_space() -> np.ndarray:
    return np.fromiter((chr(i).isspace() for i in range(0x110000)), bool, 0x110000)


class Batch:
    """Texts one after the other, a NUL behind each, with the tables that cuts are read from."""

    def __init__(self, texts: list[str]):
        self.text = "".join(t + "\0" for t in texts)
        self.code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.stop = np.cumsum(length + 1) - 1
        self.start = self.stop - length
        space = _is_space()[self.code]
        at = np.arange(len(self.code))
        # the nearest place from here on, and up to here, that is no white space
        self.next_ink = np.minimum.accumulate(np.where(space, len(at), at)[::-1])[::-1]
        self.last_ink = np.maximum.accumulate(np.where(space, -1, at))
        edge = np.diff(np.r_[False, space, False].astype(np.int8))
        self.space_start, self.space_stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def _first_in_space(self, marked: np.ndarray) -> np.ndarray:
        """The first marked place of each run of white space that has one."""
        place = np.flatnonzero(marked)
        first = place[np.searchsorted(place, self.space_start).clip(max=max(0, len(place) - 1))] if len(place) else np.zeros(len(self.space_start), np.int64) - 1
        return first[(first >= self.space_start) & (first < self.space_stop)]

    def sentence_cuts(self) -> np.ndarray:
        """Where white space begins that stands behind the end of a sentence (a line's end is one)."""
        ends = np.isin(self.code, [ord(c) for c in SENTENCE_ENDS])
        return self._first_in_space(np.r_[False, ends[:-1]] & (self.next_ink != np.arange(len(self.code))))

    def paragraph_cuts(self) -> np.ndarray:
        """Where white space begins that has two line ends."""
        lines = np.cumsum(np.r_[0, self.code == 10])
        return self.space_start[lines[self.space_stop] - lines[self.space_start] >= 2]

    def parts(self, cuts: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(span, from, to) of what lies between the cuts within each span, without white space around; blank parts are left out."""
        low, high = np.searchsorted(cuts, start, side="right"), np.searchsorted(cuts, stop)
        n = np.maximum(high - low, 0) + 1
        span = np.repeat(np.arange(len(start)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        edges = np.r_[cuts, 0]
        a = np.where(place == 0, start[span], edges[(low[span] + place - 1).clip(0, len(cuts))])
        b = np.where(place == n[span] - 1, stop[span], edges[(low[span] + place).clip(0, len(cuts))])
        full = b > a
        span, a, b = span[full], a[full], b[full]
        a, b = self.next_ink[a], self.last_ink[b - 1] + 1
        ink = b > a
        return span[ink], a[ink], b[ink]

    def sizes(self, start: np.ndarray, stop: np.ndarray, count: Counter | None) -> np.ndarray:
        return stop - start if count is None else np.asarray(count([self.text[a:b] for a, b in zip(start.tolist(), stop.tolist())]), np.int64).reshape(len(start))


def _bounds(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-last position of each owner's rows in a sorted list of owners."""
    return np.searchsorted(owner, np.arange(n)), np.searchsorted(owner, np.arange(n), side="right")


def _merged(owner: np.ndarray, length: np.ndarray, n: int, least: int) -> np.ndarray:
    """First parts of sentences: a part joins the one before while both together stay under ``least`` characters.

    In the running sum each part counts its length and a space. What stands before a text's first part is an empty
    sentence, which its first part joins if it is short enough.
    """
    run = np.r_[0, np.cumsum(length + 1)]
    at, stop = _bounds(owner, n)
    at, stop = at[at < stop], stop[at < stop]
    bound = np.where(length[at] < least, least + 1, least + 2)
    heads = []
    while len(at):
        heads.append(at)
        at = np.minimum(np.maximum(np.searchsorted(run, run[at] + bound) - 1, at + 1), stop)
        on = at < stop
        at, stop, bound = at[on], stop[on], np.full(int(on.sum()), least + 2)
    return np.sort(np.concatenate(heads)) if heads else np.zeros(0, np.int64)


def _packed(owner: np.ndarray, size: np.ndarray, n: int, limit: int, again: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Chunks as (first, behind-last) positions of items whose sizes add up to ``limit`` at most, in order.

    ``again`` says from first and behind-last which item the next chunk begins with, its new items coming after; a chunk
    takes one new item at least. Items marked ``alone`` end a chunk and are left out.
    """
    run = np.r_[0, np.cumsum(size)]
    at, stop = _bounds(owner, n)
    at, stop = at[at < stop], stop[at < stop]
    fresh = at
    wall = np.r_[np.flatnonzero(alone), len(size)] if alone is not None else np.array([len(size)])
    first, last = [], []
    while len(at):
        end = np.maximum(np.searchsorted(run, run[at] + limit, side="right") - 1, fresh + 1)
        end = np.minimum(np.minimum(end, stop), wall[np.searchsorted(wall, fresh)])
        some = end > at
        first.append(at[some])
        last.append(end[some])
        at = np.where(some & (again is not None), again(at, end) if again else end, np.where(some, end, end + 1))
        fresh = np.where(some, end, end + 1)
        on = fresh < stop
        at, fresh, stop = at[on], fresh[on], stop[on]
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(first), np.concatenate(last)
    order = np.argsort(b, kind="stable")
    return a[order], b[order]


class Chunks:
    """Rows of a result: span, text, start, end, in the order of ``key`` within a span."""

    def __init__(self, span: np.ndarray, key: np.ndarray, text: list[str], start: np.ndarray, end: np.ndarray):
        self.span, self.key, self.text, self.start, self.end = span, key, text, start, end

    def lists(self, n: int) -> list[list[Chunk]]:
        out: list[list[Chunk]] = [[] for _ in range(n)]
        for i in np.lexsort((self.key, self.span)).tolist():
            out[self.span[i]].append((self.text[i], int(self.start[i]), int(self.end[i])))
        return out


def _joined(b: Batch, span: np.ndarray, start: np.ndarray, stop: np.ndarray, glue: str) -> tuple[str, np.ndarray]:
    """All parts with ``glue`` behind each as one string, and where each begins there."""
    return "".join(b.text[x:y] + glue for x, y in zip(start.tolist(), stop.tolist())), np.r_[0, np.cumsum(stop - start + len(glue))]


def _sentences(b: Batch, start: np.ndarray, stop: np.ndarray, size: int, count: Counter | None) -> Chunks:
    span, x, y = b.parts(b.sentence_cuts(), start, stop)
    head = _merged(span, y - x, len(start), LEAST_SENTENCE)
    whole, place = _joined(b, span, x, y, " ")
    first = np.r_[head, len(x)]
    a, z = place[first[:-1]], place[first[1:]] - 1
    length = z - a
    sizes = length if count is None else np.asarray(count([whole[i:j] for i, j in zip(a.tolist(), z.tolist())]), np.int64).reshape(len(a))
    lo, hi = _packed(span[head], sizes, len(start), size, lambda i, j: j - np.maximum(1, (j - i) // 5))
    text = [whole[i:j] for i, j in zip(a[lo].tolist(), z[hi - 1].tolist())] if len(lo) else []
    owner = span[head][lo]
    seen = np.r_[0, np.cumsum(length)]
    end = seen[hi] - seen[_bounds(span[head], len(start))[0][owner]]
    return Chunks(owner, hi, text, end - np.fromiter(map(len, text), np.int64, len(text)), end)


def _paragraphs(b: Batch, start: np.ndarray, stop: np.ndarray, size: int, count: Counter | None) -> Chunks:
    span, x, y = b.parts(b.paragraph_cuts(), start, stop)
    sizes = b.sizes(x, y, count)
    long = sizes > size
    lo, hi = _packed(span, sizes, len(start), size, alone=long)
    whole, place = _joined(b, span, x, y, "\n\n")
    text = [whole[i:j] for i, j in zip(place[lo].tolist(), (place[hi] - 2).tolist())]
    seen = np.r_[0, np.cumsum(y - x)]
    end = seen[hi] - seen[_bounds(span, len(start))[0][span[lo]]] if len(lo) else np.zeros(0, np.int64)
    at = np.flatnonzero(long)
    inner = _sentences(b, x[at], y[at], size, count)  # offsets of its own
    key = np.r_[lo.astype(float), at[inner.span] + (inner.key + 1) / (len(inner.key) + inner.key.max(initial=0) + 2)]
    return Chunks(np.r_[span[lo], span[at][inner.span]], key, text + inner.text, np.r_[end - np.fromiter(map(len, text), np.int64, len(text)), inner.start], np.r_[end, inner.end])


# ---------------------------------------------------------------- the strategies, over lists of texts


def fixed_sizes(texts: list[str], size: int = 1000, overlap: int = 0, count: Counter | None = None) -> list[list[Chunk]]:
    """Pieces of ``size`` characters that end after the last break in their second half, if there is one.

    The next piece starts ``overlap`` before the end. Splitting stops when a piece reaches the text's end; the overlap
    must be less than half the size, so that each piece gets on.
    """
    if not 0 <= overlap < (size + 1) // 2:
        raise ValueError("overlap must be less than half the size")
    b = Batch(texts)
    before = []  # for each break the nearest place up to here where it stands
    for sep in BREAKS:
        here = b.code == ord(sep[0])
        if len(sep) == 2:
            here = here & np.r_[b.code[1:] == ord(sep[1]), False]
        before.append(np.maximum.accumulate(np.where(here, np.arange(len(here)), -1)))
    row = np.flatnonzero(b.stop > b.start)
    at = b.start[row]
    spans = []
    while len(row):
        end = np.minimum(at + size, b.stop[row])
        open_ = end < b.stop[row]
        for sep, place in zip(BREAKS, before):
            found = place[np.maximum(end - len(sep), 0)]
            good = open_ & (found > at + size // 2)
            end = np.where(good, found + len(sep), end)
            open_ &= ~good
        spans.append((row, at, end))
        on = end < b.stop[row]
        row, at = row[on], (end - overlap)[on]
    out: list[list[Chunk]] = [[] for _ in texts]
    for row, at, end in spans:
        a, z = b.next_ink[at], b.last_ink[end - 1] + 1
        for i in np.flatnonzero(z > a).tolist():
            own = row[i]
            out[own].append((b.text[a[i] : z[i]], int(at[i] - b.start[own]), int(end[i] - b.start[own])))
    return out


def sentences(texts: list[str], size: int = 1000, count: Counter | None = None) -> list[list[Chunk]]:
    """Whole sentences packed up to ``size``; each chunk repeats the last fifth (one at least) of the one before.

    Spaces between sentences don't count. An end adds up the lengths of all sentences so far, a start lies the chunk's
    length before it.
    """
    b = Batch(texts)
    return _sentences(b, b.start, b.stop, size, count).lists(len(texts))


def paragraphs(texts: list[str], size: int = 1000, count: Counter | None = None) -> list[list[Chunk]]:
    """Paragraphs (between blank lines) packed up to ``size``; a larger one is split by sentence, with offsets of its own."""
    b = Batch(texts)
    return _paragraphs(b, b.start, b.stop, size, count).lists(len(texts))


def markdowns(texts: list[str], size: int = 1000, count: Counter | None = None) -> list[list[tuple[str, int, int, str]]]:
    """Sections under Markdown headers, the text before the first one included: chunk, start, end, section (the header line).

    A section whose body fits is one chunk with its header on top; a larger one is split by paragraph, each part with
    the header. Offsets add up what was put out; those of a split section are its own.
    """
    b = Batch(texts)
    row, title, start, stop = [], [], [], []
    for i, text in enumerate(texts):
        heads = [(m[0], m.start(), m.end()) for m in _HEADER.finditer(text)]
        for (name, _, a), z in zip([("", 0, 0), *heads], [*(h[1] for h in heads), len(text)]):
            row.append(i)
            title.append(name)
            start.append(b.start[i] + a)
            stop.append(b.start[i] + z)
    row, start, stop = (np.array(x, np.int64) for x in (row, start, stop))
    titled = np.array([t != "" for t in title], bool)
    lead_only = np.r_[titled[1:], False] | np.r_[row[1:] != row[:-1], True]  # untouched where there is no header at all
    ink = np.minimum(b.next_ink[start], stop)
    end = np.maximum(b.last_ink[np.maximum(stop - 1, 0)] + 1, ink)
    headless = ~titled & ((np.r_[row[1:] != row[:-1], True]) if len(row) else titled)
    ink, end = np.where(headless, start, ink), np.where(headless, stop, end)
    keep = titled | ((end > ink) & (np.minimum(b.next_ink[start], stop) < stop)) & lead_only
    fits = b.sizes(ink, end, count) <= size
    large = np.flatnonzero(keep & ~fits)
    split = _paragraphs(b, ink[large], end[large], size, count).lists(len(large))
    where = dict(zip(large.tolist(), split))
    out: list[list[tuple[str, int, int, str]]] = [[] for _ in texts]
    at = [0] * len(texts)
    for i in np.flatnonzero(keep).tolist():
        r, name = row[i], title[i]
        if fits[i]:
            body = b.text[ink[i] : end[i]]
            shown = f"{name}\n{body}" if name else body
            out[r].append((shown.strip(), at[r], at[r] + len(shown), name))
            at[r] += len(shown)
        else:
            out[r] += [(f"{name}\n{piece}" if name else piece, a, z, name) for piece, a, z in where[i]]
            at[r] += int(end[i] - ink[i])
    return out


def recursives(texts: list[str], size: int = 1000, overlap: int = 100, count: Counter | None = None) -> list[list[Chunk]]:
    """Split at the first separator, coarse to fine, that leaves several merged parts.

    Parts are merged while their own sizes fit; the next piece repeats a tail that joins to at most ``overlap``
    (one part at least). A part that is too large is split from the coarsest separator again, after the open tail went
    out as a piece. Without any separator: steps of size - overlap characters. Offsets add up piece lengths.
    """
    b = Batch(texts)
    cuts = []
    for sep in filter(None, SEPARATORS):
        here = np.flatnonzero(b.code == ord(sep[0]))
        if len(sep) == 2:
            here = here[b.code[here + 1] == ord(sep[1])]  # a NUL ends the batch
        cuts.append((len(sep), here))
    out: list[list[Chunk]] = []
    for start, stop in zip(b.start.tolist(), b.stop.tolist()):
        at, own = 0, []
        for x, y in _pieces(b, cuts, start, stop, size, overlap, count):
            own.append((b.text[x:y], at, at + y - x))
            at += y - x
        out.append(own)
    return out


def _between(places: np.ndarray, width: int, start: int, stop: int) -> np.ndarray:
    """Separators of one kind in a span, none overlapping the one before: where they begin."""
    inside = places[np.searchsorted(places, start) : np.searchsorted(places, stop - width, side="right")]
    if width == 1 or len(inside) < 2 or (np.diff(inside) >= width).all():
        return inside
    chain = np.cumsum(np.r_[True, np.diff(inside) > 1])  # in a run of touching ones every other counts
    rank = np.arange(len(inside)) - np.searchsorted(chain, chain)
    return inside[rank % width == 0]


def _pieces(b: Batch, cuts: list[tuple[int, np.ndarray]], start: int, stop: int, size: int, overlap: int, count: Counter | None) -> list[tuple[int, int]]:
    """Spans of the pieces: parts keep their separators between them, so a piece is a span of the text itself."""
    measure = lambda x, y: int(b.sizes(np.array([x]), np.array([y]), count)[0])
    if measure(start, stop) <= size:
        return [(start, stop)] if b.next_ink[start] < stop else []
    for width, places in cuts:
        at = _between(places, width, start, stop)
        if not len(at):
            continue
        x, y = np.r_[start, at + width], np.r_[at, stop]
        sizes = b.sizes(x, y, count)
        run, large = np.r_[0, np.cumsum(sizes)], np.r_[np.flatnonzero(sizes > size), len(x)]
        plan: list[tuple[str, int, int]] = []  # spans of parts: merged, or to be split again
        a = fresh = 0
        while fresh < len(x):
            wall = int(large[np.searchsorted(large, fresh)])
            end = min(max(int(np.searchsorted(run, run[a] + size, side="right")) - 1, fresh + 1), wall)
            if end > a:
                plan.append(("merged", a, end))
                if end == len(x):
                    break
                # the longest tail that joins to at most the overlap, else the last part
                tail = a + int(np.searchsorted(-(y[end - 1] - x[a:end]), -overlap)) if count is None else next((i for i in range(a, end - 1) if measure(x[i], y[end - 1]) <= overlap), end - 1)
                a, fresh = min(tail, end - 1), end
            if fresh == wall and fresh < len(x):
                if a < fresh:
                    plan.append(("merged", a, fresh))
                plan.append(("again", fresh, fresh + 1))
                a = fresh = fresh + 1
        made: list[tuple[int, int]] = []
        for kind, i, j in plan:
            made += [(int(x[i]), int(y[j - 1]))] if kind == "merged" else _pieces(b, cuts, int(x[i]), int(y[i]), size, overlap, count)
        if len(made) > 1:
            return made
    if size == overlap:
        raise ValueError("size and overlap must differ")
    steps = range(start, stop, size - overlap) if size > overlap else ()
    return [(x, min(x + size, stop)) for x in steps if b.next_ink[x] < min(x + size, stop)]


# ---------------------------------------------------------------- the same for one text


def fixed_size(text: str, size: int = 1000, overlap: int = 0) -> list[Chunk]:
    return fixed_sizes([text], size, overlap)[0]


def split_sentences(text: str) -> list[str]:
    """Sentences; a part joins the one before while both together stay under 20 characters."""
    b = Batch([text])
    span, x, y = b.parts(b.sentence_cuts(), b.start, b.stop)
    whole, place = _joined(b, span, x, y, " ")
    first = np.r_[_merged(span, y - x, 1, LEAST_SENTENCE), len(x)]
    return [whole[place[i] : place[j] - 1] for i, j in zip(first[:-1], first[1:])]


def by_sentence(text: str, size: int = 1000) -> list[Chunk]:
    return sentences([text], size)[0]


def by_paragraph(text: str, size: int = 1000) -> list[Chunk]:
    return paragraphs([text], size)[0]


def recursive(text: str, size: int = 1000, overlap: int = 100) -> list[Chunk]:
    return recursives([text], size, overlap)[0]


def markdown(text: str, size: int = 1000) -> list[tuple[str, int, int, str]]:
    return markdowns([text], size)[0]


_STRATEGIES: dict[str, Callable[..., list]] = {"fixed_size": fixed_sizes, "sentence": sentences, "paragraph": paragraphs, "recursive": recursives, "markdown": markdowns}


def register(name: str, split: Callable[..., list]) -> None:
    """Add a chunker: a function of a text (and options) that gives (chunk, start, end[, section])."""
    _STRATEGIES[name] = lambda texts, count=None, **options: [split(t, **options) for t in texts]


def chunk(docs: DataFrame, id_col: str, text_col: str, strategy: str, count: Counter | None = None, **options) -> DataFrame:
    """id, chunk_index, text, start_char, end_char, token_count, section of every chunk; none for null and blank texts.

    ``count`` gives the sizes that limits and token_count are told in (see :func:`words`); characters by default. The
    fixed-size chunker always cuts by characters.
    """
    if strategy == "sliding_window":
        raise ValueError("use sliding_window() for word windows")
    if strategy not in _STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    split = _STRATEGIES[strategy]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL AND text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                lists = split(part.column(1).to_pylist(), count=count, **options)
                row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                flat = [x for own in lists for x in own]
                text = [x[0] for x in flat]
                index = np.arange(len(row)) - np.searchsorted(row, row)
                sizes = [len(t) for t in text] if count is None else count(text)
                section = pa.array([x[3] if len(x) > 3 else None for x in flat], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(index.astype(np.int32)), pa.array(text, pa.string()), *(pa.array(x, pa.int32()) for x in ([c[1] for c in flat], [c[2] for c in flat], sizes)), section],
                    ["id", "chunk_index", "text", "start_char", "end_char", "token_count", "section"],
                )

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, chunk_index int, text string, start_char int, end_char int, token_count int, section string")
