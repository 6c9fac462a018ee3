"""Percentiles per group from mergeable rank-interval summaries.

A summary of n values is a short list of tuples (value, rmin, rmax): in the sorted values the tuple's value
has a rank of at least rmin and at most rmax. A summary built from sorted values is exact before it is
compressed. Compression drops tuples and so widens the gap between neighbours by about ``n / k`` ranks;
merging adds the rank bounds of both sides. Every summary carries ``err``, the bound in ranks on any answer it
gives: half the widest ``rmax[i + 1] - rmin[i]``. As rmin and rmax add up through all merges, the bound holds
for what was lost at every level. Summaries of partitions, days or runs can be stored and merged later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("n", "err", "value", "rmin", "rmax")
SUMMARY = "n bigint, err double, value array<double>, rmin array<double>, rmax array<double>"


def build(values: np.ndarray, k: int) -> dict:
    """Summary of unsorted values, at most about k + 2 tuples."""
    v = np.sort(values)
    r = np.arange(1, len(v) + 1, dtype=float)
    return compress(dict(n=len(v), err=0.5, value=v, rmin=r, rmax=r), k)


def compress(s: dict, k: int) -> dict:
    """Keep the first and last tuple and, for each of k evenly spaced ranks, the tuple nearest to it."""
    size = len(s["value"])
    if size <= k + 2:
        return s
    mid = (s["rmin"] + s["rmax"]) / 2
    want = np.linspace(1, s["n"], k)
    right = np.clip(np.searchsorted(mid, want), 1, size - 1)
    near = np.where(want - mid[right - 1] <= mid[right] - want, right - 1, right)
    keep = np.unique(np.r_[0, near, size - 1])
    out = {x: s[x][keep] for x in ("value", "rmin", "rmax")}
    return out | {"n": s["n"], "err": bound(out["rmin"], out["rmax"])}


def bound(rmin: np.ndarray, rmax: np.ndarray) -> float:
    """Ranks by which :func:`query` can be wrong."""
    return float(max(np.max(rmax[1:] - rmin[:-1], initial=0) / 2, np.max(rmax - rmin, initial=0) / 2))


def merge(a: dict, b: dict) -> dict:
    """Union of two summaries; a tuple's bounds grow by those of its neighbours on the other side."""
    if not a["n"] or not b["n"]:
        return a if a["n"] else b

    def placed(x: dict, y: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(y["value"], x["value"], side=side)  # y's tuples before x's value
        low = np.where(at > 0, y["rmin"][np.maximum(at - 1, 0)], 0)
        high = np.where(at < len(y["value"]), y["rmax"][np.minimum(at, len(y["value"]) - 1)] - 1, y["n"])
        return x["rmin"] + low, x["rmax"] + np.maximum(high, low)

    (al, ah), (bl, bh) = placed(a, b, "left"), placed(b, a, "right")
    value = np.r_[a["value"], b["value"]]
    order = np.argsort(value, kind="stable")
    rmin, rmax = np.r_[al, bl][order], np.r_[ah, bh][order]
    return dict(n=a["n"] + b["n"], err=bound(rmin, rmax), value=value[order], rmin=rmin, rmax=rmax)


def query(s: dict, q: float) -> float:
    """The value whose rank is surest to be near ``q * (n - 1) + 1``: off by ``err`` at most."""
    target = q * (s["n"] - 1) + 1
    return float(s["value"][np.argmin(np.maximum(target - s["rmin"], s["rmax"] - target))])


def _pack(key: tuple, names: list[str], s: dict) -> dict:
    return dict(zip(names, key)) | {x: s[x] if x in ("n", "err") else s[x].tolist() for x in FIELDS}


def _key(name) -> tuple:
    return tuple(None if pd.isna(x) else x for x in (name if isinstance(name, tuple) else (name,)))


def _fields(keys: list[str], kinds: dict[str, str]) -> str:
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def summarise(df: DataFrame, keys: list[str], value: str | Column, k: int = 2000) -> DataFrame:
    """One summary per key and input partition, built map-side; nothing is shuffled.

    A partition is sorted by key and value, so it holds one key's summary and a buffer of ``64 * k`` numbers at a time
    and gives the same result on each run. Null and NaN values are left out; null keys are keys of their own.
    """
    v = value if isinstance(value, Column) else F.col(f"`{value}`")
    rows = df.select(*[F.col(f"`{x}`") for x in keys], (v.cast("double") + F.lit(0.0)).alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    kinds = dict(rows.dtypes)

    def own(buffers: list[np.ndarray]) -> dict:
        return build(np.concatenate(buffers), k)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, done = None, [], None
        for pdf in parts:
            grouped = pdf.groupby(keys, dropna=False, sort=False)["__v"] if keys else [((), pdf["__v"])]
            out = []
            for name, x in grouped:
                name = _key(name)
                if key is not None and name != key:
                    done = own(held) if done is None else merge(done, own(held)) if held else done
                    out.append(_pack(key, keys, compress(done, k)))
                    held, done = [], None
                key = name
                held.append(x.to_numpy(float))
                if sum(map(len, held)) >= 64 * k:
                    done, held = own(held) if done is None else compress(merge(done, own(held)), k), []
            if out:
                yield _frame(out, [*keys, *FIELDS])
        if key is not None:
            if held:
                done = own(held) if done is None else merge(done, own(held))
            yield _frame([_pack(key, keys, compress(done, k))], [*keys, *FIELDS])

    ordered = rows.sortWithinPartitions(*[F.col(f"`{x}`") for x in keys], "__v")
    return ordered.mapInPandas(run, f"{_fields(keys, kinds)}{', ' if keys else ''}{SUMMARY}")


def combine(summaries: DataFrame, keys: list[str], k: int = 2000, fan: int = 16) -> DataFrame:
    """Merge summaries that share a key, in two levels.

    Level one merges at most about 1/fan of a key's summaries per task, level two the ``fan`` results, so a hot
    key is spread. Summaries come sorted by key and content; one key is open at a time, as a binary counter of
    summaries, so that each is compressed a logarithmic number of times and the result is the same on each run.
    """
    kinds = dict(summaries.dtypes)
    columns = [*keys, *FIELDS]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own = None, {}

        def close() -> dict:
            s = None
            for level in sorted(own):
                s = own[level] if s is None else merge(s, own[level])
            return _pack(key, keys, compress(s, k))

        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                name = _key(row[: len(keys)])
                if key is not None and name != key:
                    out.append(close())
                    own = {}
                key = name
                s = dict(n=row.n, err=row.err, value=np.asarray(row.value), rmin=np.asarray(row.rmin), rmax=np.asarray(row.rmax))
                level = 0
                while level in own:
                    s, level = compress(merge(own.pop(level), s), k), level + 1
                own[level] = s
            if out:
                yield _frame(out, columns)
        if key is not None:
            yield _frame([close()], columns)

    schema = f"{_fields(keys, kinds)}{', ' if keys else ''}{SUMMARY}"
    named = [F.col(f"`{x}`") for x in keys]
    content = F.xxhash64("n", "value", "rmin")
    salted = summaries.select(*columns).repartition(*named, F.pmod(content, F.lit(fan))).sortWithinPartitions(*named, content)
    once = salted.mapInPandas(run, schema)
    last = once.repartition(*named) if keys else once.coalesce(1)
    return last.sortWithinPartitions(*named, content).mapInPandas(run, schema)


def percentiles(summaries: DataFrame, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """One row per summary: the percentiles ``qs`` names, ``n`` and ``rank_error``, the bound in ranks."""
    kinds = dict(summaries.dtypes)
    names = [*keys, "n", "rank_error", *qs]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for row in pdf.itertuples(index=False):
                s = {x: np.asarray(getattr(row, x)) if x in ("value", "rmin", "rmax") else getattr(row, x) for x in FIELDS}
                rows.append([*(None if pd.isna(x) else x for x in row[: len(keys)]), row.n, row.err, *(query(s, q) for q in qs.values())])
            yield _frame(rows, names)

    ordered = summaries.select(*[F.col(f"`{x}`") for x in keys], "n", "err", "value", "rmin", "rmax")
    extra = "n bigint, rank_error double, " + ", ".join(f"{x} double" for x in qs)
    return ordered.mapInPandas(run, f"{_fields(keys, kinds)}{', ' if keys else ''}{extra}")
