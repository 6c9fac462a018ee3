"""Aggregates and ordered analytics over request logs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import durable, few, first

KEY = ("provider", "model")
P = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def requests(metrics: DataFrame) -> DataFrame:
    """The log with each request once, providers trimmed and in lower case, and latencies that were not measured null.

    Repeated rows are dropped by request_id and start_time; null providers and models become ``unknown``.
    """
    latency = F.when((F.col("latency_ms") >= 0) & ~F.isnan("latency_ms"), F.col("latency_ms"))
    once = metrics.dropDuplicates(["request_id", "start_time"])
    return once.withColumns(
        {
            "provider": F.coalesce(F.lower(F.trim("provider")), F.lit("unknown")),
            "model": F.coalesce("model", F.lit("unknown")),
            "latency_ms": latency,
            "epoch": F.unix_micros("start_time") / 1e6,
        }
    )


def _some(flag: Column) -> Column:
    return F.sum(F.when(flag, 1).otherwise(0)).cast("bigint")


def _bucket(value: Column) -> Column:
    """A number of a narrow range of values that never falls as values rise."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * 1024).cast("bigint")


def ranked_values(rows: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, n and for each name the value at that place (from 0) of a key's sorted values, exact, in whatever number.

    ``places`` gives the place from a key's number of values. Values are counted in narrow ranges first (a bounded number
    of rows a key), so only those ranges are sorted that hold a wanted place, each for itself, equal values as one row.
    """
    own = rows.select(*keys, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)").withColumn("__b", _bucket(F.col("__v")))
    w = Window.partitionBy(*keys)
    counts = own.groupBy(*keys, "__b").agg(F.count("*").alias("__c"))
    run = F.sum("__c").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
    spans = counts.withColumns({"__n": F.sum("__c").over(w), "__upto": run})
    want = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("__n")).cast("bigint").alias("place")) for name, place in places.items()])).alias("__w")
    asked = spans.select(*keys, "__b", "__n", "__c", "__upto", want).where("__w.place < __upto AND __w.place >= __upto - __c")
    asked = durable(asked.select(*keys, "__b", "__n", F.col("__w.name").alias("__name"), (F.col("__w.place") - F.col("__upto") + F.col("__c")).alias("__at")))
    same = lambda a, b, names: reduce(and_, [a[k].eqNullSafe(b[k]) for k in names])
    some = asked.select(*keys, "__b").distinct()  # a few ranges a key
    met = own.join(F.broadcast(some) if few(some) else some, same(own, some, [*keys, "__b"]), "left_semi")
    each = met.groupBy(*keys, "__b", "__v").agg(F.count("*").alias("__c"))
    inside = each.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    right = asked.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__r"), "__n", "__name", "__at")
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__b") == F.col("__r"))
    hit = inside.join(right, on & (F.col("__at") < F.col("__upto")) & (F.col("__at") >= F.col("__upto") - F.col("__c")))
    return hit.groupBy(*keys).agg(F.max("__n").alias("n"), *[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in places])


def percentiles(rows: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """keys, n and exact percentiles with linear interpolation, however many values a key has (see :func:`ranked_values`)."""
    places: dict[str, Callable[[Column], Column]] = {}
    for name, q in qs.items():
        places[f"__lo_{name}"] = lambda n, q=q: F.floor((n - 1) * q)
        places[f"__hi_{name}"] = lambda n, q=q: F.ceil((n - 1) * q)
    out = ranked_values(rows, keys, value, places)
    share = lambda q: (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    return out.select(*keys, "n", *[(F.col(f"__lo_{x}") + (F.col(f"__hi_{x}") - F.col(f"__lo_{x}")) * share(q)).alias(x) for x, q in qs.items()])


def with_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null; the keys stay the left side's."""
    named = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return left.join(named, on, how).drop(*[f"__k{i}" for i in range(len(keys))])


def only(log: DataFrame, provider: str | None = None, model: str | None = None, since: Column | None = None) -> DataFrame:
    """The requests of a provider, of a model, and from a time on."""
    out = log.where(F.col("provider") == provider) if provider is not None else log
    out = out.where(F.col("model") == model) if model is not None else out
    return out.where(F.col("epoch") >= since) if since is not None else out


def by_target(log: DataFrame, window_seconds: float | None = None, as_of: Column | None = None) -> DataFrame:
    """Counts, latency range and percentiles (linear), tokens, cost and derived rates per provider and model.

    With a window only requests that started in the ``window_seconds`` before ``as_of`` count (default: the log's
    last start). Percentiles are exact at any size.
    """
    rows = log
    if window_seconds is not None:
        last = log.agg(F.max("epoch").alias("__now")) if as_of is None else log.sparkSession.range(1).select(as_of.alias("__now"))
        rows = log.crossJoin(F.broadcast(last)).where(F.col("epoch") >= F.col("__now") - window_seconds)  # one row
    plain = rows.groupBy(*KEY).agg(
        F.count("*").alias("requests"),
        _some(F.col("success")).alias("succeeded"),
        _some(~F.col("success")).alias("failed"),
        F.sum("latency_ms").alias("latency_sum"),
        F.min("latency_ms").alias("latency_min"),
        F.max("latency_ms").alias("latency_max"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("cost").alias("cost"),
        _some(F.col("cached")).alias("cached"),
        F.count("latency_ms").alias("measured"),
    )
    n = F.col("requests")
    out = with_same(plain, percentiles(rows, list(KEY), "latency_ms", P).drop("n"), list(KEY))
    return out.select(
        "*", (F.col("succeeded") / n).alias("success_rate"),
        F.when(F.col("measured") > 0, F.col("latency_sum") / F.col("measured")).otherwise(F.lit(0.0)).alias("avg_latency"), (F.coalesce("cost", F.lit(0.0)) / n).alias("avg_cost"),
        (n / window_seconds if window_seconds else F.lit(0.0)).alias("throughput"),
    )


def totals(log: DataFrame) -> DataFrame:
    """Totals over all and per provider in one pass by grouping sets; the whole has provider null."""
    return log.rollup("provider").agg(
        F.count("*").alias("requests"), _some(F.col("success")).alias("succeeded"), F.sum("total_tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.grouping_id().alias("level")
    )


def last_n(log: DataFrame, keys: list[str], n: int, order: tuple[str, ...] = ("epoch", "request_id"), direct: int = 1000) -> DataFrame:
    """The last n rows of each key: what a ring buffer would hold.

    A window cuts groups before it sorts them only for small n. For a larger one, hourly counts of each key tell first
    from which hour on its rows can be among the last n; ``order`` begins with a time in seconds then.
    """
    rows = log
    if n > direct:
        hour = F.floor(F.col(order[0]) / 3600)
        hours = log.groupBy(*keys, hour.alias("__h")).agg(F.count("*").alias("__c"))
        after = F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.col("__h").desc()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")
        since = hours.withColumn("__after", after).where(F.col("__after") < n).groupBy(*keys).agg(F.min("__h").alias("__since"))
        rows = with_same(log, since, keys, "inner").where(hour >= F.col("__since")).drop("__since")
    return first(rows, keys, [F.col(c).desc() for c in order], n, "__n").drop("__n")


def latency_percentiles(log: DataFrame, n: int = 10_000) -> DataFrame:
    """Latency figures per provider and model over the last n measured requests of each."""
    rows = last_n(log.where("latency_ms IS NOT NULL"), list(KEY), n)
    plain = rows.groupBy(*KEY).agg(F.min("latency_ms").alias("low"), F.max("latency_ms").alias("high"), F.avg("latency_ms").alias("mean"))
    return with_same(plain, percentiles(rows, list(KEY), "latency_ms", P), list(KEY)).select(*KEY, "n", *P, "low", "high", "mean")


def last_successes(log: DataFrame, n: int = 100) -> DataFrame:
    """p50 and p95 of the last n measured successes of each target, with their number and summed cost."""
    rows = last_n(log.where("success AND latency_ms IS NOT NULL"), list(KEY), n)
    p = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95)))  # n values a group at most
    return rows.groupBy(*KEY).agg(F.count("*").alias("n"), p.alias("p"), F.sum("cost").alias("cost")).select(*KEY, "n", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), "cost")


def latency_stats(log: DataFrame, keys: list[str]) -> DataFrame:
    """min, max, mean, median, sample stddev and floor-index percentiles of successful requests.

    pXX is the value at index floor(n * q) of the sorted values, so p50 need not be the median.
    """
    ok = log.where("success AND latency_ms IS NOT NULL")
    floor = {name: (lambda n, q=q: F.least(F.floor(n * F.lit(q)), n - 1)) for name, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))}
    middle = {"__lo": lambda n: F.floor((n - 1) / 2), "__hi": lambda n: F.ceil((n - 1) / 2)}
    at = ranked_values(ok, keys, "latency_ms", {**floor, **middle})
    plain = ok.groupBy(*keys).agg(F.min("latency_ms").alias("low"), F.max("latency_ms").alias("high"), F.avg("latency_ms").alias("mean"), F.coalesce(F.stddev_samp("latency_ms"), F.lit(0.0)).alias("stddev"))
    return with_same(plain, at, keys, "inner").select(*keys, "n", "low", "high", "mean", ((F.col("__lo") + F.col("__hi")) / 2).alias("median"), "stddev", *floor)


def summary(log: DataFrame, by: str) -> DataFrame:
    """One row per configuration: success rate, requests per second of its span, cost and tokens per successful request."""
    ok = F.col("success")
    out = log.groupBy(by).agg(
        F.count("*").alias("requests"), _some(ok).alias("succeeded"), (F.max("epoch") - F.min("epoch")).alias("span"), F.sum(F.when(ok, F.col("cost"))).alias("cost"), F.sum(F.when(ok, F.col("total_tokens"))).alias("tokens")
    )
    each = F.greatest("succeeded", F.lit(1))
    return out.select(
        by, "requests", "succeeded", (F.col("succeeded") / F.col("requests")).alias("success_rate"), F.when(F.col("span") > 0, F.col("requests") / F.col("span")).otherwise(F.lit(0.0)).alias("rps"),
        (F.coalesce("cost", F.lit(0.0)) / each).alias("cost_per_success"), (F.coalesce("tokens", F.lit(0)) / each).alias("tokens_per_success"),
    )


def error_histogram(log: DataFrame, keys: list[str], first: int = 5) -> DataFrame:
    """Types of the first errors of each key, as its error list would show them."""
    w = Window.partitionBy(*keys).orderBy("epoch", "request_id")
    some = log.where("NOT success").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= first)
    return some.groupBy(*keys, F.coalesce("error_type", F.lit("unknown")).alias("error")).agg(F.count("*").alias("n"))


def ema(log: DataFrame, keys: list[str], alpha: float = 0.2) -> DataFrame:
    """Exponential average of successful latencies in time order, seeded by the first.

    The fold is linear, so a key's history is cut into runs by time, each run is folded to (decay, sum) by one task
    and the runs are chained: no task holds a whole hot key.
    """
    ok = log.where("success AND latency_ms IS NOT NULL").select(*keys, "epoch", "request_id", "latency_ms")
    day = F.floor(F.col("epoch") / 3600)
    w = Window.partitionBy(*keys, "__run").orderBy("epoch", "request_id")
    ranked = ok.withColumn("__run", day).withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "__run")))
    weight = F.pow(F.lit(1 - alpha), F.col("__n") - F.col("__i")) * alpha
    runs = ranked.groupBy(*keys, "__run").agg(
        F.sum(weight * F.col("latency_ms")).alias("s"), F.pow(F.lit(1 - alpha), F.max("__n")).alias("d"), F.sum(F.when(F.col("__i") == 1, F.col("latency_ms") * F.pow(F.lit(1 - alpha), F.col("__n")))).alias("seed"), F.count("*").alias("c")
    )
    # the hours of one key, oldest first: a list as long as the log's hours, not as its rows
    lists = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__run", "s", "d", "seed"))).alias("x"), F.sum("c").alias("n"))
    start = F.struct(F.lit(None).cast("double").alias("v"))
    fold = F.aggregate("x", start, lambda a, r: F.struct((r["s"] + F.coalesce(a["v"] * r["d"], r["seed"])).alias("v")), lambda a: a["v"])
    return lists.select(*keys, fold.alias("ema"), "n")


def health(log: DataFrame) -> DataFrame:
    """0 to 100 per target: 70 for success, 30 for latency against the best; 0 without any success."""
    rate = log.groupBy(*KEY).agg(F.avg(F.col("success").cast("double")).alias("sr"))
    both = rate.join(ema(log, list(KEY)), list(KEY), "left")
    best = F.min("ema").over(Window.partitionBy(F.lit(1)))  # a row per target
    fast = F.coalesce(F.least(F.lit(100.0), best / F.greatest("ema", F.lit(1.0)) * 100), F.lit(100.0))
    return both.select(*KEY, "sr", "ema", F.when(F.col("sr") == 0, F.lit(0.0)).otherwise(F.col("sr") * 70 + 0.3 * fast).alias("health"))


def _micros() -> Column:
    return F.round(F.col("epoch") * 1e6).cast("bigint")


def _sliced(rows: DataFrame, seconds: Column | float, wide: float) -> DataFrame:
    """Rows with ``__t`` (microseconds), ``__slice`` (their time range of ``wide`` seconds) and ``__own``.

    A row that a window of ``seconds`` can still see from the next range comes there a second time, not as its own. So a
    hot key's windows are worked on range by range, by many tasks.
    """
    width = max(1, int(wide * 1e6))
    timed = rows.withColumn("__t", _micros()).withColumn("__s", F.floor(F.col("__t") / width))
    seen = (F.col("__s") + 1) * width - F.col("__t") <= seconds * 1e6
    each = timed.withColumn("__slice", F.explode(F.when(seen, F.array("__s", F.col("__s") + 1)).otherwise(F.array("__s"))))
    return each.withColumn("__own", F.col("__slice") == F.col("__s")).drop("__s")


class _Frame:
    """Sums over the last ``micros`` microseconds up to each row, as the sum up to the row less the sum before the frame.

    Both parts only grow along the order, so each row is added twice, however many rows a frame holds.
    """

    def __init__(self, by: list[str], micros: int):
        w = Window.partitionBy(*by).orderBy("__t")
        self.upto, self.before = w.rangeBetween(Window.unboundedPreceding, Window.currentRow), w.rangeBetween(Window.unboundedPreceding, -micros - 1)

    def count(self, flag: Column) -> Column:
        one = F.when(flag, 1).otherwise(0)
        return F.sum(one).over(self.upto) - F.coalesce(F.sum(one).over(self.before), F.lit(0))

    def total(self, value: Column) -> Column:
        """Null where no row of the frame has a value."""
        sums = F.coalesce(F.sum(value).over(self.upto), F.lit(0)) - F.coalesce(F.sum(value).over(self.before), F.lit(0))
        return F.when(self.count(value.isNotNull()) > 0, sums)

    def mean(self, value: Column) -> Column:
        return self.total(value) / self.count(value.isNotNull())

    def span(self) -> Column:
        """Seconds between the frame's first row and the last: ``__next`` is the time of the row behind each row."""
        start = F.coalesce(F.max("__next").over(self.before), F.min("epoch").over(self.upto))
        return F.greatest(F.col("epoch") - start, F.lit(0.001))


def _with_next(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.withColumn("__next", F.lead("epoch").over(Window.partitionBy(*by).orderBy("__t")))


def sliding(log: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """At each request: mean latency, error rate, cost and tokens of the ``seconds`` up to it, and throughput over its span."""
    by = [*keys, "__slice"]
    rows = _with_next(_sliced(log.select(*keys, "request_id", "epoch", "latency_ms", "success", "cost", "total_tokens"), seconds, 4 * seconds), by)
    f = _Frame(by, int(seconds * 1e6))
    n = f.count(F.lit(True))
    out = rows.select(
        *keys, "request_id", "epoch", "__own", n.alias("n"), f.mean(F.col("latency_ms")).alias("latency"), f.mean((~F.col("success")).cast("double")).alias("error_rate"), f.total(F.col("cost")).alias("cost"),
        f.total(F.col("total_tokens")).alias("tokens"), F.when(n < 2, F.lit(0.0)).otherwise(n / f.span()).alias("throughput"),
    )
    return out.where("__own").drop("__own")


#: Columns of a table of alert rules; empty or null lists mean all, ``op`` is gt, lt, gte or lte.
RULES = "rule string, metric string, op string, bound double, seconds double, cooldown double, providers array<string>, models array<string>"


def rule_values(log: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, epoch, request_id, provider, model, value and the rule's op, bound and cooldown: each rule's metric at each request in its scope.

    The metric looks at the requests in the rule's scope of the ``seconds`` up to the request: latency (mean), success_rate,
    error_rate, cost, token_count (sums) or throughput. ``rules`` is a short table.
    """
    scope = lambda names, x: F.coalesce(F.size(names), F.lit(0)).isin(0, -1) | F.array_contains(names, F.col(x))
    short = F.broadcast(rules) if few(rules, 10_000) else rules
    met = log.select("epoch", "request_id", "provider", "model", "latency_ms", "success", "cost", "total_tokens").join(short, scope(F.col("providers"), "provider") & scope(F.col("models"), "model"))
    width = rules.agg(F.max("seconds").alias("x")).first()["x"] or 1.0
    rows = _sliced(met, F.col("seconds"), 4 * float(width))
    by, out = ["rule", "__slice"], None
    for seconds in sorted({r["seconds"] for r in rules.select("seconds").distinct().collect()}):  # as many as rules
        f = _Frame(by, int(seconds * 1e6))
        n, good = f.count(F.lit(True)), f.mean(F.col("success").cast("double"))
        value = (
            F.when(F.col("metric") == "latency", F.coalesce(f.total(F.col("latency_ms")), F.lit(0.0)) / n).when(F.col("metric") == "success_rate", good).when(F.col("metric") == "error_rate", 1 - good)
            .when(F.col("metric") == "cost", F.coalesce(f.total(F.col("cost")), F.lit(0.0))).when(F.col("metric") == "token_count", F.coalesce(f.total(F.col("total_tokens")), F.lit(0)).cast("double"))
            .when(F.col("metric") == "throughput", F.when(n < 2, F.lit(0.0)).otherwise(n / f.span())).otherwise(F.lit(0.0))
        )
        each = _with_next(rows.where(F.col("seconds") == seconds), by)
        own = each.select("rule", "epoch", "request_id", "provider", "model", value.alias("value"), "op", "bound", "cooldown", "__own").where("__own").drop("__own")
        out = out.unionByName(own) if out else own
    return out if out is not None else met.select("rule", "epoch", "request_id", "provider", "model", F.lit(0.0).alias("value"), "op", "bound", "cooldown")


def rule_alerts(log: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, epoch, request_id, provider, model, value: the firings of a table of rules (see ``RULES``), none within a rule's cooldown of the last."""
    v, bound = F.round("value", 9), F.col("bound")
    hot = ((F.col("op") == "gt") & (v > bound)) | ((F.col("op") == "lt") & (v < bound)) | ((F.col("op") == "gte") & (v >= bound)) | ((F.col("op") == "lte") & (v <= bound))
    return fired(rule_values(log, rules).where(hot)).select("rule", "epoch", "request_id", "provider", "model", "value")


def alerts(values: DataFrame, rule: str, value: str, above: float, cooldown: float) -> DataFrame:
    """Firings of one rule on a stream of values (epoch, request_id, value): strictly above, none within the cooldown of the last."""
    hot = values.where(F.col(value) > above).select(F.lit(rule).alias("rule"), "epoch", "request_id", F.col(value).alias("value"), F.lit(float(cooldown)).alias("cooldown"))
    return fired(hot).select("rule", "epoch", "request_id", "value")


def _next(t: np.ndarray, cooldown: float) -> np.ndarray:
    """Of each candidate the first that may fire after it."""
    return np.maximum(np.searchsorted(t - t[0], t - t[0] + cooldown - 1e-9), np.arange(len(t)) + 1) if len(t) else np.zeros(0, np.int64)


def fired(hot: DataFrame) -> DataFrame:
    """The candidates (rule, epoch, request_id, cooldown, ...) that fire: in time order, none within the cooldown of the one before.

    The chain is sequential, but what it does in a range of time depends only on when the last firing before was. So each
    range is first reduced to a short table (for a first firing here, the last one here), the ranges of a rule are chained
    by these tables, and then each range replays its own firings. No task holds a rule's candidates of more than one range.
    """
    span = F.greatest(F.col("cooldown") * 16, F.lit(86400.0))
    rows = durable(hot.withColumn("__range", F.floor(F.col("epoch") / span).cast("bigint")))

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["epoch"].to_numpy())
        cooldown = float(pdf["cooldown"].iloc[0])
        far = np.append(_next(t, cooldown), len(t))
        last = np.append(np.arange(len(t)), len(t))
        while (far[last[:-1]] < len(t)).any():  # jumps double
            step = np.where(far[last] < len(t), far[last], last)
            last = last[step]
        starts = np.arange(min(len(t), int(np.searchsorted(t, t[0] + cooldown)) + 1))
        # only what comes first within a cooldown of the range can be its first firing; equal ends are one row
        keep = np.r_[last[starts][1:] != last[starts][:-1], True]
        return pd.DataFrame({"rule": pdf["rule"].iloc[0], "__range": pdf["__range"].iloc[0], "cooldown": cooldown, "first": [t[starts[keep]].tolist()], "last": [t[last[starts][keep]].tolist()]})

    tables = rows.select("rule", "__range", "epoch", "cooldown").groupBy("rule", "__range").applyInPandas(reduced, "rule string, __range bigint, cooldown double, first array<double>, last array<double>")

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__range")
        before, entry = -np.inf, []
        for first_, last_, cooldown in zip(pdf["first"], pdf["last"], pdf["cooldown"]):
            entry.append(before)
            at = int(np.searchsorted(np.asarray(first_), before + cooldown - 1e-9)) if np.isfinite(before) else 0
            if at < len(first_):
                before = last_[at]
        return pdf[["rule", "__range"]].assign(__before=entry)

    entries = tables.groupBy("rule").applyInPandas(chained, "rule string, __range bigint, __before double")
    joined = rows.join(durable(entries), ["rule", "__range"])

    def replayed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["epoch", "request_id"])
        t, cooldown, before = pdf["epoch"].to_numpy(), float(pdf["cooldown"].iloc[0]), float(pdf["__before"].iloc[0])
        at, keep = int(np.searchsorted(t, before + cooldown - 1e-9)) if np.isfinite(before) else 0, []
        far = _next(t, cooldown)
        while at < len(t):
            keep.append(at)
            at = int(far[at])
        return pdf.iloc[keep].drop(columns=["__range", "__before"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in hot.dtypes)
    return joined.select(*hot.columns, "__range", "__before").groupBy("rule", "__range").applyInPandas(replayed, kinds)


def peak_concurrency(log: DataFrame, key: str, slice_seconds: int = 3600) -> DataFrame:
    """Most requests in flight at once per key: +1 at each start, -1 at each end, ends first at equal times.

    Steps are added up by instant, then run within slices of time; a slice's peak stands on the sum of those before.
    """
    steps = log.where("end_time >= start_time").select(key, F.explode(F.array(F.struct(F.col("start_time").alias("t"), F.lit(1).alias("s")), F.struct(F.col("end_time").alias("t"), F.lit(-1).alias("s")))).alias("x"))
    each = steps.select(key, "x.t", "x.s").groupBy(key, "t").agg(F.sum("s").alias("net")).withColumn("__slice", F.floor(F.unix_micros("t") / (slice_seconds * 1_000_000)))
    run = F.sum("net").over(Window.partitionBy(key, "__slice").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    slices = each.withColumn("busy", run).groupBy(key, "__slice").agg(F.max("busy").alias("top"), F.sum("net").alias("net"))
    before = F.sum("net").over(Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("net")
    return slices.withColumn("busy", before + F.col("top")).groupBy(key).agg(F.max("busy").alias("peak"))


def fallback_stats(log: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """kind, name, n: all failures, failures by reason, and (from chains: source, target) the length of each fallback chain."""
    bad = log.where("NOT success").select(error_class(F.col("error_message")).alias("name"))
    out = bad.rollup("name").agg(F.count("*").alias("n"), F.grouping("name").alias("g")).select(F.when(F.col("g") == 1, F.lit("total")).otherwise(F.lit("reason")).alias("kind"), F.coalesce("name", F.lit("all")).alias("name"), "n")
    if chains is None:
        return out
    return out.unionByName(chains.groupBy("source").agg(F.count("target").alias("n")).select(F.lit("chain").alias("kind"), F.col("source").alias("name"), "n"))


def failure_history(log: DataFrame, reason: str | None = None, n: int = 50) -> DataFrame:
    """The last n failures, of one reason or of all, newest first: request_id, provider, model, reason."""
    bad = log.where("NOT success").select("epoch", "request_id", "provider", "model", error_class(F.col("error_message")).alias("reason"))
    bad = bad.where(F.col("reason") == reason) if reason else bad
    return bad.orderBy(F.col("epoch").desc(), F.col("request_id").desc()).limit(n).select("request_id", "provider", "model", "reason")


def windowed(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Tumbling windows per provider: the batch twin of the live aggregation."""
    return log.groupBy(F.window("start_time", width).alias("w"), "provider").agg(F.count("*").alias("n"), _some(F.col("success")).alias("succeeded"), F.sum("total_tokens").alias("tokens")).select(
        F.col("w.start").alias("window_start"), "provider", "n", "succeeded", "tokens"
    )


def _any(message: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [message.contains(w) for w in words])


# What the two error classifiers look for, in their orders; all groups of a class must be met.
FALLBACK_CLASSES = (
    ("timeout", (("timeout", "timed out"),)),
    ("rate_limit", (("429", "rate limit"),)),
    ("auth_error", (("401", "unauthorized", "auth"),)),
    ("context_length", (("context",), ("length", "exceed"))),
)
PROVIDER_CLASSES = (
    ("auth_error", (("401", "unauthorized", "invalid api key"),)),
    ("rate_limit", (("429", "rate limit"),)),
    ("timeout", (("timeout", "timed out"),)),
    ("context_length", (("context_length", "maximum context"),)),
    ("bad_request", (("400",),)),
)


def error_class(message: Column, classes: tuple = FALLBACK_CLASSES) -> Column:
    """The first class whose words the message has, in any case; ``provider_error`` if none, also for null."""
    m = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("provider_error")
    for name, groups in reversed(classes):
        out = F.when(reduce(and_, [_any(m, g) for g in groups]), F.lit(name)).otherwise(out)
    return out


def provider_error_class(message: Column) -> Column:
    """The classes in the provider's own order."""
    return error_class(message, PROVIDER_CLASSES)
