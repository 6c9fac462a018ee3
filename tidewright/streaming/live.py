"""Live twins of the batch operators, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts, successes and tokens per provider in tumbling (or sliding) windows; rows later than ``late`` are dropped."""
    w = F.window("start_time", width, slide) if slide else F.window("start_time", width)
    agg = stream.withWatermark("start_time", late).groupBy(w.alias("w"), "provider").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("success"), 1).otherwise(0)).cast("bigint").alias("succeeded"), F.sum("total_tokens").alias("tokens")
    )
    return agg.select(F.col("w.start").alias("window_start"), "provider", "n", "succeeded", "tokens")


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests per session of a key, a session ending after ``gap`` without any."""
    agg = stream.withWatermark("start_time", late).groupBy(F.session_window("start_time", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return agg.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Drops repeats of a key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Run a stream until its source is used up; ``path`` gets what each batch changed, as parquet."""
    write = lambda batch, _: batch.write.mode("append").parquet(path)
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def token_bucket(stream: DataFrame, key: str, rate: float, capacity: float) -> DataFrame:
    """key, request_id, epoch, allowed, tokens: one bucket of state per key; a batch's events are taken in time order."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(parts)).sort_values(["epoch", "request_id"])
        allowed, left = [], []
        for t in rows["epoch"]:
            if last is not None and t > last:
                tokens = min(capacity, tokens + (t - last) * rate)
            last = t if last is None else max(t, last)
            ok = tokens >= 1
            tokens -= ok
            allowed.append(bool(ok))
            left.append(float(tokens))
        state.update((float(tokens), float(last)))
        yield pd.DataFrame({key: k[0], "request_id": rows["request_id"], "epoch": rows["epoch"], "allowed": allowed, "tokens": left})

    kind = dict(stream.dtypes)[key]
    return stream.select(key, "request_id", "epoch").groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, request_id string, epoch double, allowed boolean, tokens double", "tokens double, last double", "append", GroupStateTimeout.NoTimeout
    )


def breaker(stream: DataFrame, key: str, failures: int = 5, cooldown: float = 60.0, successes: int = 2) -> DataFrame:
    """key, request_id, epoch, let_through, state: a circuit breaker per key, as in the batch fold."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, bad, good, since = state.get if state.exists else ("closed", 0, 0, 0.0)
        rows = pd.concat(list(parts)).sort_values(["epoch", "request_id"])
        through, names = [], []
        for t, ok in zip(rows["epoch"], rows["success"]):
            if name == "open" and t - since >= cooldown:
                name, good = "half_open", 0
            passed = name != "open"
            if passed and ok:
                good, bad = good + 1, 0
                if name == "half_open" and good >= successes:
                    name, good = "closed", 0
            elif passed:
                bad += 1
                if name == "half_open" or bad >= failures:
                    name, bad, since = "open", 0, float(t)
            through.append(passed)
            names.append(name)
        state.update((name, int(bad), int(good), float(since)))
        yield pd.DataFrame({key: k[0], "request_id": rows["request_id"], "epoch": rows["epoch"], "let_through": through, "state": names})

    kind = dict(stream.dtypes)[key]
    return stream.select(key, "request_id", "epoch", "success").groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, request_id string, epoch double, let_through boolean, state string", "name string, bad int, good int, since double", "append", GroupStateTimeout.NoTimeout
    )
