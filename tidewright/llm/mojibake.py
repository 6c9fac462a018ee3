"""Texts that went through a wrong character encoding: detection and restoration by description length.

Each sentence is decoded along candidate chains (read as encoding X what was written in Y, once or twice); every
candidate is compressed with the zstandard dictionary of each language, and the chain with the smallest length
plus its own cost wins. The unchanged sentence is a candidate of cost nothing, so sound text stays as it is.
Dictionaries are trained here, on all texts without any sign of damage: what is frequent is counted over every one of them,
and only the model that comes of it has a bound.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import durable, widen

#: Encodings by which UTF-8 is commonly misread, and pairs (misread as, written in) of others.
MISREAD = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp437", "cp850", "cp866", "mac-roman", "cp1254", "iso8859-15")
PAIRS = tuple((x, y) for y in ("cp1251", "koi8-r", "cp866") for x in ("cp1251", "koi8-r", "cp866", "latin-1", "cp1252", "mac-roman", "cp437", "cp850") if x != y) + tuple(
    (x, y) for y in ("cp932", "euc-jp", "gbk", "euc-kr") for x in ("latin-1", "cp1252", "mac-roman", "cp437", "cp850", "cp1251")
)
LATIN_PAIRS = tuple((x, y) for x in ("cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp1250", "cp1251") for y in ("cp1252", "mac-roman", "cp437", "cp850", "cp1250") if x != y)
STEP_COST, STRANGE_COST, DICT_BYTES, LANGUAGES, MEMO = 3, 7, 48 << 10, 32, 1 << 16
#: Bytes of a window; counters of windows a language, and into how many slices they are cut; candidates for a dictionary in each half of the texts; signs of a segment at most.
WINDOW, COUNTERS, SLICES, BUCKETS, SEGMENT = 8, 1 << 18, 64, 4096, 160
#: Texts of a language that a sign's share is stated for, how many of them must show a familiar sign, and from how many on nobody asks whether these are sound.
OF_TEXTS, SHOWN, CERTAIN = 400, 3, 24

_UTF8 = regex.compile(r"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_SENTENCE = regex.compile(r"(?<=[.!?])[ \t]+|\r\n|\r|\n")
_QUOTED = regex.compile(r"`[^`\n]{1,24}`")
_HIGH = regex.compile(r"[^\x00-\x7f]")
_RUN = regex.compile(r"[^\x00-\x7f]{2,}")
_CONTROL = regex.compile(r"[\x80-\x9f]")
# whole words beyond ASCII, one after another; the second byte of a CJK sign may be an ASCII one
_STRETCH = regex.compile(r"(?<![A-Za-z])(?=\P{ASCII}*[^\p{ASCII}\p{Z}\p{P}])\P{ASCII}{2,}(?![A-Za-z])(?:[ ,.;:()-]+\P{ASCII}+(?![A-Za-z]))*")
_STRETCH_CJK = regex.compile(r"(?<![A-Za-z])(?=\P{ASCII}*[^\p{ASCII}\p{Z}\p{P}])(?:\P{ASCII}[\x40-\x7e]?)*\P{ASCII}{2}(?:\P{ASCII}[\x40-\x7e]?)*(?![A-Za-z])")
_WRITTEN = regex.compile(r"[\p{Cyrillic}\p{ASCII}№«»—–…\xa0]+")
_WRITTEN_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{ASCII}\p{P}\u3000ー]+")
ASCII = frozenset(map(chr, range(128)))
_CYRILLIC = regex.compile(r"\p{Cyrillic}")
_CJK = frozenset(("cp932", "euc-jp", "gbk", "euc-kr"))
PAIRS_ONE_BYTE, PAIRS_CJK = tuple(p for p in PAIRS if p[1] not in _CJK), tuple(p for p in PAIRS if p[1] in _CJK)


@lru_cache(maxsize=None)
def _bytes_of(codec: str) -> dict[int, int]:
    """Character to byte for the upper half of a one-byte encoding; undefined bytes are read as controls."""
    table = {}
    for b in range(128, 256):
        try:
            table.setdefault(ord(bytes([b]).decode(codec)), b)
        except UnicodeDecodeError:
            pass
    for b in range(128, 256):
        if b not in table.values():
            table.setdefault(b, b)
    return table


@lru_cache(maxsize=None)
def _signs(codec: str) -> frozenset[str]:
    return frozenset(map(chr, _bytes_of(codec)))


@lru_cache(maxsize=None)
def _utf8_signs(codec: str) -> tuple[frozenset[str], frozenset[str]]:
    """Signs that may begin a UTF-8 sequence misread in the encoding, and those that may go on with it; no sequence lacks either."""
    table = _bytes_of(codec)
    return frozenset(chr(c) for c, b in table.items() if 0xC2 <= b <= 0xF4), frozenset(chr(c) for c, b in table.items() if b < 0xC0)


@lru_cache(maxsize=None)
def _becoming_letters(pair: tuple[str, str]) -> frozenset[str]:
    """Signs of the first one-byte encoding that the second reads as Cyrillic letters."""
    again = {c: bytes([b]).decode(pair[1], "ignore") for c, b in _bytes_of(pair[0]).items()}
    return frozenset(chr(c) for c, x in again.items() if x and _CYRILLIC.match(x))


def _may_be(pair: tuple[str, str], own: frozenset[str]) -> bool:
    """Whether signs can come from the pair: read again, half of those that the pair knows must be letters of its script."""
    met = own & _signs(pair[0])
    return bool(met) and (pair[1] in _CJK or 2 * len(met & _becoming_letters(pair)) >= len(met))


@lru_cache(maxsize=1 << 14)
def _possible(own: frozenset[str], pairs: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str], ...]:
    return tuple(p for p in pairs if _may_be(p, own))


@lru_cache(maxsize=1 << 14)
def _possible_utf8(own: frozenset[str]) -> tuple[str, ...]:
    return tuple(c for c in MISREAD if not any(map(own.isdisjoint, _utf8_signs(c))))


@lru_cache(maxsize=None)
def _class(codec: str) -> regex.Pattern:
    return regex.compile("[" + "".join(regex.escape(chr(c)) for c in sorted(_bytes_of(codec))) + r"\x00-\x7f]+")


class _ToByte(dict):
    """str.translate table; what the encoding lacks becomes a character that is no byte."""

    def __missing__(self, c: int) -> int:
        return c if c < 128 else 0xFFFF


@lru_cache(maxsize=None)
def _translate(codec: str) -> _ToByte:
    return _ToByte(_bytes_of(codec))


@lru_cache(maxsize=1 << 16)
def _undo_run(run: str, codec: str) -> str:
    raw = run.translate(_translate(codec))

    def good(m: regex.Match) -> str:
        try:
            return m[0].encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            return run[m.start() : m.end()]

    spans, out, at = list(_UTF8.finditer(raw)), [], 0
    for m in spans:
        out += [run[at : m.start()], good(m)]
        at = m.end()
    return "".join(out) + run[at:] if spans else run


def undo_utf8(text: str, codec: str) -> str:
    """Replace every run that is valid UTF-8 when written in ``codec``; the rest stays."""
    return _RUN.sub(lambda m: _undo_run(m[0], codec), text)


def undo_pair(text: str, read_as: str, written_in: str) -> str:
    """Re-read the stretches that ``read_as`` can write; unchanged where that gives no valid text."""
    try:  # mostly the text is one stretch
        raw = text.encode(read_as)
    except UnicodeEncodeError:
        raw = None
    if raw is not None:
        try:
            return raw.decode(written_in)
        except UnicodeDecodeError:
            return text

    def again(m: regex.Match) -> str:
        if m[0].isascii():
            return m[0]
        try:
            return m[0].translate(_translate(read_as)).encode("latin-1").decode(written_in)
        except (UnicodeDecodeError, UnicodeEncodeError):
            return m[0]

    return _class(read_as).sub(again, text)


@lru_cache(maxsize=1 << 14)
def _misread_utf8(stretch: str) -> bool:
    return any(2 * len(undo_utf8(stretch, codec)) <= len(stretch) for codec in ("latin-1", "cp1252"))


@lru_cache(maxsize=1 << 15)
def _undo_stretch(stretch: str, pair: tuple[str, str], cjk: bool) -> str:
    """The stretch read again, if that gives nothing but words of the script and the stretch isn't UTF-8 misread."""
    if _misread_utf8(stretch):
        return stretch
    again = undo_pair(stretch, *pair)
    return again if (_WRITTEN_CJK if cjk else _WRITTEN).fullmatch(again) else stretch


class Restorer:
    """Holds the dictionaries; one per Python worker."""

    def __init__(self, dictionaries: dict[str, bytes], familiar: frozenset[str]):
        plain = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False)
        make = lambda d: zstandard.ZstdCompressor(compression_params=plain, **({"dict_data": zstandard.ZstdCompressionDict(d)} if d else {}))
        self.by_language = {k: make(d) for k, d in dictionaries.items()} or {"": make(None)}
        # the letters beyond ASCII that a dictionary knows: a text that hardly has others is measured by those that know its own
        self.letters = {k: frozenset(c for c in dictionaries.get(k, b"").decode("utf-8", "ignore") if c > "\x7f" and c.isalpha()) for k in self.by_language}
        self.memo: dict[str, str] = {}
        self.familiar = familiar

    def length(self, text: str) -> int:
        data = text.encode("utf-8", "surrogatepass")
        tools = self.by_language
        if len(data) > 3 * len(text) // 2:  # more than half of its signs lie beyond ASCII
            own = set(text)
            known = {k: len(own & x) for k, x in self.letters.items()}
            most = max(known.values())
            tools = {k: c for k, c in tools.items() if 2 * known[k] >= most}
        return min(len(c.compress(data)) for c in tools.values())

    def candidates(self, text: str) -> dict[str, int]:
        """Decoded forms and what each chain costs.

        A step through UTF-8 costs its name, as hardly any sound text is valid there. Any bytes are valid in a
        one-byte encoding, so a step between such costs one more for every four signs it alters (also where only the
        stretches of foreign signs are read again, however small their share of the sentence is), and between Latin ones, where
        few signs speak for it, as much as a strange sign more.
        """
        found = {text: 0}
        if _RUN.search(text):
            for step in (1, 2):
                for source in [t for t, n in found.items() if n == STEP_COST * (step - 1)]:
                    own = frozenset(_HIGH.findall(source))
                    for codec in _possible_utf8(own):  # in others it can't have been read
                        found.setdefault(undo_utf8(source, codec), STEP_COST * step)
        signs = _HIGH.findall(text)
        high, own = len(signs), frozenset(signs)
        if high >= 6 and high * 5 >= len(text) or _CONTROL.search(text):
            for pair in _possible(own, PAIRS):
                found.setdefault(undo_pair(text, *pair), STEP_COST + high // 4)
        if _RUN.search(text):  # damage in part: only the stretches are read again, and only their signs count
            for rx, cjk, written in ((_STRETCH, False, PAIRS_ONE_BYTE), (_STRETCH_CJK, True, PAIRS_CJK)):
                spans = [m.span() for m in rx.finditer(text)]
                altered = sum(len(_HIGH.findall(text, a, b)) for a, b in spans)
                inside = frozenset(c for a, b in spans for c in text[a:b] if c > "\x7f")
                for pair in _possible(inside, written) if spans else ():
                    again = [_undo_stretch(text[a:b], pair, cjk) for a, b in spans]
                    if any(text[a:b] != x for (a, b), x in zip(spans, again)):
                        ends = [0, *(b for _, b in spans)]
                        found.setdefault("".join(text[e:a] + x for e, (a, _), x in zip(ends, spans, again)) + text[ends[-1] :], STEP_COST + altered // 4)
        if not self.familiar.issuperset(text):
            for pair in LATIN_PAIRS:
                if not own.isdisjoint(_signs(pair[0])):
                    found.setdefault(undo_pair(text, *pair), STEP_COST + (STRANGE_COST + 1) * high)
        return found

    def sentence(self, text: str) -> str:
        """The candidate of least description length; a sentence that comes again is not judged again."""
        good = self.memo.get(text)
        if good is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            good = self.memo[text] = self._sentence(text)
        return good

    def _sentence(self, text: str) -> str:
        forms = self.candidates(text)
        if len(forms) == 1:
            return text
        # besides its bytes, a sign that sound texts hardly have costs an escape; what costs more before a byte is counted can't win
        extra = {t: cost + STRANGE_COST * sum(map(t.count, set(t) - self.familiar)) for t, cost in forms.items()}
        best = (self.length(text) + extra[text], 0, text)
        for t in sorted(extra, key=extra.get):
            if extra[t] >= best[0]:
                break
            if t != text:
                best = min(best, (self.length(t) + extra[t], forms[t], t))
        return best[2]

    def restore(self, text: str) -> tuple[str, bool]:
        """The text as far as it can be restored, and whether it is damaged outside of short quoted examples."""
        if text.isascii():
            return text, False
        quoted = [m.span() for m in _QUOTED.finditer(text)]
        out, at, damaged = [], 0, False
        for a, b in [*[m.span() for m in _SENTENCE.finditer(text)], (len(text), len(text))]:
            part = text[at:a]
            if not part.isascii():
                inside = [(x - at, y - at) for x, y in quoted if at <= x and y <= a]
                if inside:  # examples stay, what stands around them is looked at
                    pieces, p = [], 0
                    for x, y in inside:
                        pieces += [self._one(part[p:x]), part[x:y]]
                        p = y
                    good = "".join(pieces) + self._one(part[p:])
                    plain = "".join(part[i:j] for i, j in zip([0, *[y for _, y in inside]], [*[x for x, _ in inside], len(part)]))
                else:
                    good, plain = self._one(part), part
                damaged |= good != part or "�" in plain
                part = good
            out += [part, text[a:b]]
            at = b
        return "".join(out), damaged

    def _one(self, part: str) -> str:
        return part if part.isascii() else self.sentence(part)


def looks_sound(text: str) -> bool:
    """No replacement or control sign, and no misreading of UTF-8 explains half of the signs beyond ASCII."""
    if text.isascii():
        return True
    if "�" in text or _CONTROL.search(text):
        return False
    if not _RUN.search(text):
        return True
    signs = _HIGH.findall(text)
    return all(2 * (len(text) - len(undo_utf8(text, c))) < len(signs) for c in _possible_utf8(frozenset(signs)))


def _segments(text: str) -> list[bytes]:
    """The sentences of a text that look sound by themselves, long ones cut, as far as they hold a window."""
    parts = (x[i : i + SEGMENT].encode() for x in _SENTENCE.split(text) if not x.isspace() and looks_sound(x) for i in range(0, len(x), SEGMENT))
    return [p for p in parts if len(p) >= WINDOW]


def _blocks(parts: list[bytes], n: int = 8192) -> Iterator[list[bytes]]:
    """The parts in blocks, so that their windows (eight bytes for each byte, several times) have a bound."""
    return (parts[i : i + n] for i in range(0, len(parts), n))


def _windows(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every window of eight bytes within the parts, and where each part's begin."""
    size = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    n = len(data) - WINDOW + 1
    key = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        key |= data[i : n + i] << np.uint64(8 * i)
    inside = np.ones(n, bool)
    inside[(np.cumsum(size)[:-1, None] - np.arange(1, WINDOW)).ravel()] = False
    key = key[inside] * np.uint64(0x9E3779B97F4A7C15)
    own = size - WINDOW + 1
    return (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), np.cumsum(own) - own


def _slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _count(rows: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, int], dict[str, Counter]]:
    """Over all sound texts of each language: how often windows occur, how many texts there are, and how many show a sign.

    Every task adds up its own; the driver gets ``COUNTERS`` numbers a language and a row for every sign.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows: dict[str, np.ndarray] = {}
        texts, signs = Counter(), {}
        for pdf in parts:
            for lang, own in pdf.groupby("lang")["text"]:
                good = [t for t in own if looks_sound(t)]
                texts[lang] += len(good)
                seen = signs.setdefault(lang, Counter())
                for t in good:
                    if not t.isascii():
                        seen.update(set(_HIGH.findall(t)))
                for cut in _blocks([p for t in good for p in _segments(t)]):
                    windows[lang] = windows.get(lang, 0) + np.bincount(_slot(_windows(cut)[0]), minlength=COUNTERS)
        yield pd.DataFrame([(k, "", n, -1, None) for k, n in texts.items()] + [(k, c, n, -1, None) for k, x in signs.items() for c, n in x.items()], columns=["lang", "sign", "n", "slice", "counts"])
        for k, x in windows.items():
            yield pd.DataFrame([(k, None, 0, i, y.astype("<i8").tobytes()) for i, y in enumerate(np.split(x, SLICES)) if y.any()], columns=["lang", "sign", "n", "slice", "counts"])

    @F.pandas_udf("binary")
    def added(x: pd.Series) -> bytes:
        return sum(np.frombuffer(b, "<i8") for b in x).tobytes()

    each = durable(rows.mapInPandas(run, "lang string, sign string, n bigint, slice int, counts binary"))
    counts: dict[str, np.ndarray] = {}
    for r in each.where("slice >= 0").groupBy("lang", "slice").agg(added("counts").alias("counts")).toLocalIterator():
        own, width = counts.setdefault(r["lang"], np.zeros(COUNTERS, np.uint32)), COUNTERS // SLICES
        own[r["slice"] * width : (r["slice"] + 1) * width] = np.minimum(np.frombuffer(r["counts"], "<i8"), 0xFFFFFFFF)
    texts, signs = {}, {}
    for r in each.where("slice < 0").groupBy("lang", "sign").agg(F.sum("n").alias("n")).collect():
        if r["sign"]:
            signs.setdefault(r["lang"], Counter())[r["sign"]] = r["n"]
        else:
            texts[r["lang"]] = r["n"]
    return counts, texts, signs


def _best_segments(rows: DataFrame, counts: dict[str, np.ndarray]) -> list[dict[str, list[bytes]]]:
    """For each half of the texts and each language, segments made of what is frequent over all texts.

    Segments that share their window of smallest hash mostly say the same; of those in one bucket by it the best is taken:
    that whose windows occur most often for its bytes. All segments take part, however many there are.
    """
    sent = rows.sparkSession.sparkContext.broadcast(counts)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[str, int, int], tuple[float, bytes]] = {}
        for pdf in parts:
            for (lang, half), own in pdf.groupby(["lang", "half"])["text"]:
                for cut in _blocks(list({p for t in own if looks_sound(t) for p in _segments(t)})):
                    key, start = _windows(cut)
                    size = np.array([len(p) for p in cut])
                    score = np.add.reduceat(sent.value[lang][_slot(key)].astype(np.float64), start) / (size + 2 * WINDOW)
                    bucket = np.minimum.reduceat(key, start) % np.uint64(BUCKETS)
                    for b, x, p in zip(bucket.tolist(), score.tolist(), cut):
                        if (x, p) > best.get((lang, half, b), (0.0, b"")):
                            best[lang, half, b] = x, p
        yield pd.DataFrame([(*k, *v) for k, v in best.items()], columns=["lang", "half", "bucket", "score", "segment"])

    each = rows.mapInPandas(run, "lang string, half int, bucket int, score double, segment binary")
    top = each.groupBy("lang", "half", "bucket").agg(F.max(F.struct("score", "segment")).alias("x"))
    halves: list[dict[str, list[bytes]]] = [{}, {}]
    for r in top.select("lang", "half", "x.segment").orderBy("lang", "half", "x.score", "segment").toLocalIterator():
        halves[r["half"]].setdefault(r["lang"], []).append(bytes(r["segment"]))
    return halves


def _shares(signs: dict[str, Counter], texts: dict[str, int]) -> Counter:
    """Each sign's number of texts, as if every language had at most ``OF_TEXTS``."""
    out: Counter = Counter()
    for lang, own in signs.items():
        for c, n in own.items():
            out[c] += n * min(1.0, OF_TEXTS / texts[lang])
    return out


def train(df: DataFrame, text_col: str, lang_col: str, id_col: str) -> tuple[dict[str, bytes], frozenset[str]]:
    """A dictionary per language and the signs seen often, from all sound texts.

    Texts without a language are a language of their own; beyond the ``LANGUAGES`` most frequent ones the rest share one
    dictionary. What is sent to the driver follows the languages, not the texts: counters of windows, and the best
    segments of either half, each half being screened by what the other half teaches, so that damage which looks sound
    by itself drops out. So it does for signs that are not certain: all texts that show one are judged.
    """
    lang = F.coalesce(F.lower(F.trim(F.col(f"`{lang_col}`"))), F.lit(""))
    half = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(2)).cast("int")
    rows = df.select(lang.alias("lang"), F.col(f"`{text_col}`").alias("text"), half.alias("half")).where("text IS NOT NULL")
    own = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).collect()]
    rows = widen(rows.withColumn("lang", F.when(F.col("lang").isin(own), F.col("lang")).otherwise(F.lit("other"))))
    counts, texts, signs = _count(rows)
    shares = _shares(signs, texts)
    halves = _best_segments(rows, counts)
    strict = frozenset(c for c, n in shares.items() if n >= 2 * SHOWN)
    models = [({k: _dictionary(own) for k, own in x.items()}, ASCII | strict) for x in halves]
    screens = [Restorer(*m) for m in models]
    kept: dict[str, list[bytes]] = {}
    for i in (0, 1):
        for k, segments in halves[i].items():
            kept.setdefault(k, []).extend(p for p in segments if not screens[1 - i].restore(p.decode("utf-8"))[1])
    doubtful = frozenset(c for c, n in shares.items() if SHOWN <= n < CERTAIN)
    sound = _shares(_screened(rows, models, doubtful), texts)
    familiar = frozenset(c for c, n in shares.items() if n >= CERTAIN or c in doubtful and sound[c] >= SHOWN)
    return {k: d for k, own in kept.items() if (d := _dictionary(own))}, ASCII | familiar


def _screened(rows: DataFrame, models: list[tuple[dict[str, bytes], frozenset[str]]], doubtful: frozenset[str]) -> dict[str, Counter]:
    """How many texts of each language show each of these signs, without those that the other half's model finds damaged."""
    if not doubtful:
        return {}
    some = rows.where(F.col("text").rlike("[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(doubtful)) + "]"))
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        screens = [Restorer(*m) for m in sent.value]
        seen: Counter = Counter()
        for pdf in parts:
            for lang, half, t in zip(pdf["lang"], pdf["half"], pdf["text"]):
                if looks_sound(t) and not screens[1 - half].restore(t)[1]:
                    seen.update((lang, c) for c in set(t) & doubtful)
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["lang", "sign", "n"])

    out: dict[str, Counter] = {}
    for r in some.mapInPandas(run, "lang string, sign string, n bigint").groupBy("lang", "sign").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["lang"], Counter())[r["sign"]] = r["n"]
    return out


def _dictionary(parts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the texts themselves
        return b"\n".join(parts)[:DICT_BYTES]


def _producible() -> frozenset[str]:
    """Signs that some misreading can leave behind: those of the encodings that texts are misread in, and the replacement sign."""
    return frozenset(c for x in {*MISREAD, *(a for a, _ in (*PAIRS, *LATIN_PAIRS))} for c in _signs(x)) | {"�"}


def own_signs(df: DataFrame, text_col: str, least: int = 3, share: float = 1e-4) -> frozenset[str]:
    """Signs that are sound beyond doubt, counted over all texts: they stand in one run with a sign that no misreading leaves behind.

    So the letters of a script that few texts have cost nothing. At least ``least`` texts and a ``share`` of all must show
    it. There are no more rows than Unicode has signs.
    """
    known = "".join(f"\\x{{{ord(c):x}}}" for c in sorted(_producible()))
    runs = F.filter(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"[^\x00-\x7f]+"), F.lit(0)), lambda r: r.rlike(rf"[^\x00-\x7f{known}]"))
    rows = df.select(F.explode_outer(F.array_distinct(F.split(F.array_join(runs, ""), ""))).alias("sign"))
    n = df.count()
    counted = rows.where("sign <> ''").groupBy("sign").agg(F.count("*").alias("n")).where(F.col("n") >= max(least, share * n))
    return frozenset(r["sign"] for r in counted.collect())


def repair(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """id_col, restored, damaged for every row: the text as far as it can be restored.

    Damaged means that a stretch outside of short examples in backticks was decoded wrongly, restorable or not
    (replacement signs). Null texts stay null and are not damaged; repeated rows are treated each for itself; extra
    columns are ignored. The language only chooses the dictionary that a text trains; null is fine.
    """
    dictionaries, familiar = train(df, text_col, lang_col, id_col)
    familiar = familiar | own_signs(df, text_col)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Restorer(dictionaries, familiar)
        for pdf in parts:
            done = [own.restore(t) if t is not None else (None, False) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "restored": [r for r, _ in done], "damaged": [x for _, x in done]})

    return widen(rows).mapInPandas(run, f"id {dict(rows.dtypes)['id']}, restored string, damaged boolean").withColumnRenamed("id", id_col)
