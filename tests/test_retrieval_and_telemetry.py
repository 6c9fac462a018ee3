import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import bm25, dense, fusion, telemetry


def test_bm25_of_four_texts(spark):
    docs = ["Python is a programming language", "Java is a programming language too", "Python programming with data", "Cats sleep all day long"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    q = spark.createDataFrame([(0, "Python programming"), (1, "python python")], "query_id bigint, query string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in bm25.score(df, "doc_id", "text", q).collect()}
    tokens = [d.lower().split() for d in docs]
    avgdl = sum(map(len, tokens)) / 4
    for i, query in ((0, ["python", "programming"]), (1, ["python", "python"])):
        for j, t in enumerate(tokens):
            s = 0.0
            for w in query:
                df_ = sum(w in x for x in tokens)
                if w in t:
                    tf = t.count(w)
                    s += math.log(1 + (4 - df_ + 0.5) / (df_ + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))
            assert got.get((i, j), 0.0) == pytest.approx(s)
    stored = bm25.search(bm25.postings(df, "doc_id", "text"), bm25.corpus_stats(df, "doc_id", "text"), q)
    assert {(r["query_id"], r["doc_id"]): pytest.approx(r["score"]) for r in stored.collect()} == got
    assert bm25.top(bm25.score(df.where("false"), "doc_id", "text", q), 3).count() == 0


def test_dense_top_in_blocks_equals_one_block(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, list(map(float, rng.normal(size=8)))) for i in range(300)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0])]
    items = spark.createDataFrame(rows, "item_id bigint, vec array<double>").repartition(3)
    queries = items.where("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), "vec")
    one = {tuple(r) for r in dense.dense_top(items, queries, 8, 4).select("query_id", "item_id", "rank").collect()}
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    assert one == {tuple(r) for r in dense.dense_top(items, queries, 8, 4).select("query_id", "item_id", "rank").collect()}
    assert all(q == i for q, i, rank in one if rank == 0)


def _list(spark, rows):
    return spark.createDataFrame(rows, "query_id int, item_id int, score double, rank int")


def test_rrf_ranks_missing_items_behind_the_union(spark):
    a, b = _list(spark, [(1, 10, 0.9, 0), (1, 11, 0.8, 1)]), _list(spark, [(1, 11, 5.0, 0), (1, 12, 4.0, 1)])
    got = {r["item_id"]: r["score"] for r in fusion.rrf(a, b, 5).collect()}
    assert got == pytest.approx({10: 1 / 61 + 1 / 64, 11: 1 / 62 + 1 / 61, 12: 1 / 64 + 1 / 62})


def test_rerank_and_pipeline(spark):
    cands = _list(spark, [(1, 4, 0.9, 0), (1, 2, 0.8, 1), (1, 1, 0.5, 2), (1, 3, 0.3, 3)])
    assert [(r["item_id"], round(r["rerank_score"], 6)) for r in fusion.rerank(cands, 2).orderBy("new_rank").collect()] == [(4, 1.0), (2, 0.833333)]
    ten = _list(spark, [(1, i, i / 10, 9 - i) for i in range(10)])
    assert [r["item_id"] for r in fusion.pipeline(ten, [("minmax", 3), ("minmax", 2)], 2).orderBy("new_rank").collect()] == [9, 8]
    assert fusion.pipeline(ten, [], 2).count() == 0


def test_mmr_prefers_what_differs(spark):
    rows = [(1, 1, 1.0, 0, [1.0, 0.0]), (1, 2, 0.99, 1, [1.0, 0.01]), (1, 3, 0.6, 2, [0.0, 1.0]), (1, 4, 0.1, 3, None)]
    df = spark.createDataFrame(rows, "query_id int, item_id int, score double, rank int, vec array<double>")
    assert [r["item_id"] for r in fusion.mmr(df, 2, 0.5).orderBy("new_rank").collect()] == [1, 3]


def test_judge_score(spark):
    df = spark.createDataFrame([("score: -3",), ("8.5/10",), ("12",), ("none",)], "r string")
    assert [r[0] for r in df.select(fusion.judge_score(F.col("r"))).collect()] == pytest.approx([0.3, 0.85, 1.0, None])


def _log(spark, rows):
    df = spark.createDataFrame(rows, "request_id string, provider string, model string, epoch double, latency_ms double, success boolean, cost double, total_tokens bigint, error_type string")
    return df.withColumn("start_time", F.timestamp_seconds("epoch"))


def test_ema_in_runs_equals_a_plain_fold(spark):
    rng = random.Random(4)
    rows = [(f"r{i:05d}", rng.choice(["a", "a", "b"]), "m", 1.7e9 + rng.randrange(500_000), rng.random() * 1000, rng.random() < 0.9, 0.1, 5, None) for i in range(3000)]
    got = {r["provider"]: (r["ema"], r["n"]) for r in telemetry.ema(_log(spark, rows), ["provider"]).collect()}
    for p in "ab":
        own = [r[4] for r in sorted(rows, key=lambda r: (r[3], r[0])) if r[1] == p and r[5]]
        e = own[0]
        for x in own[1:]:
            e = 0.2 * x + 0.8 * e
        assert got[p][1] == len(own) and got[p][0] == pytest.approx(e)


def test_floor_index_percentiles(spark):
    rows = [(f"r{i}", "a", "m", float(i), float(v), True, 0.0, 1, None) for i, v in enumerate([5, 1, 3, 3, 9, 7])]
    r = telemetry.latency_stats(_log(spark, rows), ["provider"]).first()
    s = sorted([5, 1, 3, 3, 9, 7])
    assert (r["p50"], r["p90"], r["p99"], r["median"]) == (s[3], s[5], s[5], 4.0)


def test_alert_cooldown(spark):
    df = spark.createDataFrame([(float(t), f"r{t}", v) for t, v in [(0, 600.0), (10, 700.0), (30, 400.0), (61, 900.0), (62, 900.0)]], "epoch double, request_id string, v double")
    assert [r["epoch"] for r in telemetry.alerts(df, "slow", "v", 500.0, 60.0).collect()] == [0.0, 61.0]


def test_error_classes(spark):
    df = spark.createDataFrame([("Request timed out",), ("429 Too many",), ("unknown author",), ("context length exceeded",), (None,), ("400 bad",)], "m string")
    got = [tuple(r) for r in df.select(telemetry.error_class(F.col("m")), telemetry.provider_error_class(F.col("m"))).collect()]
    assert [g[0] for g in got] == ["timeout", "rate_limit", "auth_error", "context_length", "provider_error", "provider_error"]
    assert [g[1] for g in got] == ["timeout", "rate_limit", "provider_error", "provider_error", "provider_error", "bad_request"]
