import random
import re

import numpy as np
import pytest

from tidewright.llm import quantiles, split, topn


def test_topn_matches_brute_force_with_ties_repeats_and_dirt(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(40), rng.choice([None, float("nan"), -0.0, 0.0, 0.5, 1.5, -2.0]), "x") for _ in range(3000)]
    df = spark.createDataFrame(rows, "q bigint, c bigint, s double, rank string").repartition(5)
    got = {(r["q"], r["c"], r["s"], r["rank"]) for r in topn.top_n(df, "q", "c", "s", 10).collect()}
    best = {}
    for q, c, s, _ in rows:
        if s is not None and s == s:
            best[q, c] = max(best.get((q, c), -9), s + 0.0)
    want = set()
    for q in {q for q, _ in best}:
        for i, (c, s) in enumerate(sorted(((c, s) for (p, c), s in best.items() if p == q), key=lambda x: (-x[1], x[0]))[:10], 1):
            want.add((q, c, s, i))
    assert got == want


def test_topn_of_an_empty_table_and_of_one_group(spark):
    empty = spark.createDataFrame([], "q bigint, c bigint, s double")
    assert topn.top_n(empty, "q", "c", "s").count() == 0
    one = spark.range(5000).selectExpr("1 AS q", "id AS c", "1.0D AS s")
    assert [r["c"] for r in topn.top_n(one, "q", "c", "s", 3).orderBy("rank").collect()] == [0, 1, 2]


def test_quantile_summary_stays_within_its_bound():
    rng = np.random.default_rng(0)
    parts = [np.round(rng.lognormal(0, 2, rng.integers(1, 3000)), 1) for _ in range(40)]
    s = None
    for p in parts:
        own = quantiles.build(p, 200)
        s = own if s is None else quantiles.compress(quantiles.merge(s, own), 200)
    values = np.sort(np.concatenate(parts))
    assert s["n"] == len(values) and len(s["value"]) <= 202
    for q in (0, 0.01, 0.5, 0.95, 0.99, 1):
        v, target = quantiles.query(s, q), q * (len(values) - 1) + 1
        low, high = np.searchsorted(values, v, "left") + 1, np.searchsorted(values, v, "right")
        assert max(0, low - target, target - high) <= s["err"]


def test_quantiles_combine_over_days_and_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(int(d), k, float(v)) for d, k, v in zip(rng.integers(0, 5, 20000), rng.choice(["a", "a", "a", "b"], 20000), rng.exponential(5, 20000))]
    rows += [(0, None, 1.0), (0, "c", None), (0, "c", float("nan"))]
    df = spark.createDataFrame(rows, "day int, key string, v double").repartition(6)
    daily = quantiles.combine(quantiles.summarise(df, ["day", "key"], "v", 100), ["day", "key"], 100)
    out = quantiles.percentiles(quantiles.combine(daily.drop("day"), ["key"], 100), ["key"], {"p50": 0.5, "p99": 0.99}).collect()
    by = {r["key"]: r for r in out}
    assert set(by) == {"a", "b", None} and by[None]["n"] == 1 and by[None]["p50"] == 1.0
    for key in "ab":
        values = np.sort([v for _, k, v in rows if k == key])
        assert by[key]["n"] == len(values)
        assert by[key]["rank_error"] < 0.05 * len(values)
        for name, q in (("p50", 0.5), ("p99", 0.99)):
            low, high = np.searchsorted(values, by[key][name], "left") + 1, np.searchsorted(values, by[key][name], "right")
            target = q * (len(values) - 1) + 1
            assert max(0, low - target, target - high) <= by[key]["rank_error"]


def test_quantiles_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "key string, v double")
    assert quantiles.combine(quantiles.summarise(empty, ["key"], "v"), ["key"]).count() == 0


def _check(text, starts, ends, limit, overlap):
    assert starts[0] == 0 and ends[-1] == len(text)
    assert all(0 < b - a <= limit for a, b in zip(starts, ends))
    assert all(e - overlap <= s <= e for s, e in zip(starts[1:], ends))
    assert all(x < y for x, y in zip(ends, ends[1:])) and all(x < y for x, y in zip(starts, starts[1:]))
    back = text[: ends[0]] + "".join(text[e:f] for e, f in zip(ends, ends[1:]))
    assert back == text


@pytest.mark.parametrize("overlap", [0, 5, 10])
def test_split_pieces_cover_the_text_within_the_limit(overlap):
    rng, kind = random.Random(overlap), split._flags()
    for _ in range(300):
        p = rng.choice([0.0, 0.01, 0.05, 0.3])
        texts = ["".join(rng.choice(" \n。") if rng.random() < p else rng.choice("ab😀é") for _ in range(rng.randint(31, 300))) for _ in range(3)]
        s, e, own, forced = split.split_batch(texts, 30, overlap, kind)
        for i, t in enumerate(texts):
            _check(t, s[own == i].tolist(), e[own == i].tolist(), 30, overlap)
            assert forced[i] == (re.search(r"[^\s。！？]{31}", t) is not None)


def test_split_matches_a_sequential_walk_where_no_cut_is_forced():
    rng, kind, limit, overlap = random.Random(7), split._flags(), 60, 12
    for _ in range(200):
        text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60))
        bounds = [0, *[m.end() for m in re.finditer(r"\s+", text)], len(text)]
        want, start = [], 0
        while True:
            end = max(b for b in bounds if b <= start + limit)
            want.append((start, end))
            if end == len(text):
                break
            nxt = min(b for b in bounds if b >= end - overlap)
            start = nxt if max(b for b in bounds if b <= nxt + limit) > end else end
        s, e, _, _ = split.split_batch([text], limit, overlap, kind)
        assert list(zip(s.tolist(), e.tolist())) == want


def test_split_rows_nulls_and_long_texts(spark):
    rows = [(1, None, "p"), (2, "", "p"), (3, "short", "p"), (4, "x" * 5000, "p"), (5, "word " * 40000, "p"), (5, "word " * 40000, "p")]
    df = spark.createDataFrame(rows, "k bigint, body string, piece string")
    got = split.split(df, "k", "body").collect()
    assert {r["k"] for r in got} == {4, 5} and {r["cut"] for r in got if r["k"] == 4} == {"forced"}
    assert sum(r["k"] == 5 and r["piece"] == 0 for r in got) == 2
    assert all(r["token_count"] == len(r["text"]) == r["end_char"] - r["start_char"] <= 1200 for r in got)
    assert split.split(df.where("false"), "k", "body").count() == 0
    with pytest.raises(ValueError):
        split.split(df, "k", "body", 100, 100)
