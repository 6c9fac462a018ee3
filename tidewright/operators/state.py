"""Keyed state machines over ordered events: rate limits, caches, breakers. One key's events are folded in order by one
task with a small state; keys are spread by hash. A single cache or bucket is one sequence and can't be spread further."""

from __future__ import annotations

import heapq
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(events: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, object], tuple], schema: str) -> DataFrame:
    """Run a state machine per key: rows sorted by key and order stream through it, only the open key's state is held.

    ``step(state, row)`` gives (new state, output tuple). Output rows: the keys, the order columns and the outputs.
    """
    rows = events.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    names = [*keys, *order, *[f.split()[0] for f in schema.split(", ")]]
    kinds = dict(rows.dtypes)
    full = ", ".join(f"{c} {kinds[c]}" for c in [*keys, *order]) + ", " + schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                own = tuple(getattr(row, k) for k in keys)
                if own != key:
                    key, state = own, start()
                state, made = step(state, row)
                out.append((*own, *(getattr(row, c) for c in order), *made))
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, full)


def token_bucket(events: DataFrame, key: str, rate: float, capacity: float, amount: str | None = None) -> DataFrame:
    """allowed, tokens (left) and retry_after of each request (epoch, request_id): refill by rate up to capacity, full at first."""

    def step(state, row):
        tokens, last = state
        if last is not None:
            tokens = min(capacity, tokens + max(0.0, row.epoch - last) * rate)
        need = float(getattr(row, amount)) if amount else 1.0
        ok = tokens >= need
        tokens -= need if ok else 0.0
        wait = 0.0 if ok else (need - tokens) / rate if rate > 0 else float("inf")
        return (tokens, row.epoch), (ok, tokens, wait)

    columns = [key, "epoch", "request_id", *([amount] if amount else [])]
    return fold(events.select(*columns), [key], ["epoch", "request_id"], lambda: (capacity, None), step, "allowed boolean, tokens double, retry_after double")


def shared_buckets(events: DataFrame, lane: str, key: str, requests: tuple[float, float], tokens: tuple[float, float], own: tuple[float, float], own_tokens: tuple[float, float]) -> DataFrame:
    """Requests (lane, epoch, request_id, key, amount) that must pass four buckets, each given as (rate, capacity).

    In order: the lane's requests, the key's requests, the lane's tokens, the key's tokens (amounts over 1 only). A
    denial by the key's requests gives nothing back; a denial by tokens gives the lane's request back, nothing else.
    Says whether it passed, and which bucket denied it.
    """
    limits = {"requests": requests, "tokens": tokens, "own": own, "own_tokens": own_tokens}

    def take(held: dict, name: tuple, need: float, now: float) -> bool:
        rate, capacity = limits[name[0]]
        left, last = held.get(name, (capacity, now))
        left = min(capacity, left + max(0.0, now - last) * rate)
        ok = left >= need
        held[name] = (left - need if ok else left, now)
        return ok

    def step(held: dict, row):
        k, need = getattr(row, key), float(row.amount)
        if not take(held, ("requests",), 1.0, row.epoch):
            return held, (False, "requests")
        if not take(held, ("own", k), 1.0, row.epoch):
            return held, (False, "own")
        if need > 1:
            for name in (("tokens",), ("own_tokens", k)):
                if not take(held, name, need, row.epoch):
                    left, last = held[("requests",)]
                    held[("requests",)] = (min(requests[1], left + 1.0), last)
                    return held, (False, name[0])
        return held, (True, None)

    return fold(events.select(lane, "epoch", "request_id", key, "amount"), [lane], ["epoch", "request_id"], dict, step, "passed boolean, denied_by string")


def breaker(events: DataFrame, key: str, failures: int = 5, cooldown: float = 60.0, successes: int = 2) -> DataFrame:
    """Circuit breaker per key over (epoch, request_id, success): the state after each event and whether it was let through."""

    def step(state, row):
        name, bad, good, since = state
        if name == "open" and row.epoch - since >= cooldown:
            name, good = "half_open", 0
        if name == "open":
            return (name, bad, good, since), (False, name)
        if row.success:
            good += 1
            bad = 0
            if name == "half_open" and good >= successes:
                name, good = "closed", 0
        else:
            bad += 1
            if name == "half_open" or bad >= failures:
                name, bad, since = "open", 0, row.epoch
        return (name, bad, good, since), (True, name)

    return fold(events.select(key, "epoch", "request_id", "success"), [key], ["epoch", "request_id"], lambda: ("closed", 0, 0, 0.0), step, "let_through boolean, state string")


def lru_cache(ops: DataFrame, cache: str, capacity: int, ttl: float | None = None) -> DataFrame:
    """Replay lookups (cache, epoch, op_id, key) against an LRU cache that stores what it misses: hit and evicted key."""

    def step(held: OrderedDict, row):
        born = held.get(row.key)
        hit = born is not None and (ttl is None or row.epoch - born <= ttl)
        evicted = None
        if hit:
            held.move_to_end(row.key)
        else:
            held.pop(row.key, None)
            if len(held) >= capacity:
                evicted = held.popitem(last=False)[0]
            held[row.key] = row.epoch
        return held, (hit, evicted)

    return fold(ops.select(cache, "epoch", "op_id", "key"), [cache], ["epoch", "op_id"], OrderedDict, step, "hit boolean, evicted string")


def semantic_cache(ops: DataFrame, cache: str, least: float = 0.92, recent: int = 20) -> DataFrame:
    """Lookups with vectors (cache, epoch, op_id, key, vec): exact key, else the most similar of the ``recent`` last stored keys."""

    def step(store: tuple[set, deque], row):
        held, last = store
        if row.key in held:
            return store, ("exact", row.key, 1.0)
        v = np.asarray(row.vec, float)
        length = np.linalg.norm(v)
        best, near = -1.0, None
        for key, w, n in last:
            c = float(v @ w / (length * n)) if length and n else 0.0
            if c > best:
                best, near = c, key
        if near is not None and best >= least:
            return store, ("similar", near, best)
        held.add(row.key)
        last.append((row.key, v, length))
        return store, ("miss", None, best if near is not None else None)

    return fold(ops.select(cache, "epoch", "op_id", "key", "vec"), [cache], ["epoch", "op_id"], lambda: (set(), deque(maxlen=recent)), step, "outcome string, found string, similarity double")


def bounded_memory(ops: DataFrame, store: str, capacity: int) -> DataFrame:
    """Upserts (store, epoch, op_id, key, importance) into a store that evicts the least important, oldest first: the evicted key."""

    def step(store_: tuple, row):
        # a heap of (importance, number of the write); what was written over since is passed by
        held, heap, n = store_
        held[row.key] = (row.importance, n)
        heapq.heappush(heap, (row.importance, n, row.key))
        evicted = None
        if len(held) > capacity:
            while True:
                importance, at, evicted = heapq.heappop(heap)
                if held.get(evicted) == (importance, at):
                    del held[evicted]
                    break
        return (held, heap, n + 1), (evicted,)

    return fold(ops.select(store, "epoch", "op_id", "key", "importance"), [store], ["epoch", "op_id"], lambda: ({}, [], 0), step, "evicted string")


def expired(created: Column, ttl: Column, as_of: Column) -> Column:
    """Strictly older than its ttl in seconds; a null ttl never expires."""
    return F.coalesce((F.unix_micros(as_of) - F.unix_micros(created)) / 1e6 > ttl, F.lit(False))


def slots(events: DataFrame, key: str, most: int) -> DataFrame:
    """Requests (epoch, request_id, done) of a key that find fewer than ``most`` others running are admitted and hold a slot until ``done``."""

    def step(busy: list, row):
        while busy and busy[0] <= row.epoch:
            heapq.heappop(busy)
        ok = len(busy) < most
        if ok:
            heapq.heappush(busy, row.done)
        return busy, (ok,)

    return fold(events.select(key, "epoch", "request_id", "done"), [key], ["epoch", "request_id"], list, step, "admitted boolean")


def cache_key(messages: Column, model: Column, how: str = "exact", temperature: Column | None = None, max_tokens: Column | None = None, custom: Callable[[Column, Column], Column] | None = None) -> Column:
    """sha256 of what makes two requests equal: all of it, its squashed lower-case text, its structure, or a caller's own.

    Temperature and max_tokens count for exact and normalized keys; what isn't given counts as 0.7 and 1024. ``custom``
    makes a column of messages and model that is hashed instead.
    """
    if custom is not None:
        return F.sha2(F.to_json(F.struct(custom(messages, model).alias("c"))), 256)
    role = F.transform(messages, lambda m: m["role"])
    text = F.transform(messages, lambda m: m["content"])
    if how == "normalized":
        text = F.transform(text, lambda t: F.trim(F.regexp_replace(F.lower(t), r"\s+", " ")))
    heat = F.coalesce(temperature if temperature is not None else F.lit(None).cast("double"), F.lit(0.7))
    most = F.coalesce(max_tokens if max_tokens is not None else F.lit(None).cast("int"), F.lit(1024))
    parts = {"exact": [model, role, text, heat, most], "normalized": [model, role, text, heat, most], "structure": [model, role, F.size(messages)]}[how]
    return F.sha2(F.to_json(F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)])), 256)
