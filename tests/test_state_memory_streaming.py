import os
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import memory, state, tools
from tidewright.sources import readers
from tidewright.streaming import live


def _events(seed, n=400):
    rng = random.Random(seed)
    t = {"a": 0.0, "b": 0.0}
    rows = []
    for i in range(n):
        k = rng.choice("aab")
        t[k] += rng.choice([0.1, 0.5, 2.0, 70.0 if rng.random() < 0.1 else 0.3])
        rows.append((k, round(1.7e9 + t[k], 3), f"r{i:04d}", rng.random() < 0.6))
    return rows


KIND = "key string, epoch double, request_id string, success boolean"


def _bucket(rows, rate, capacity):
    out, held = {}, {}
    for k, t, r, _ in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        tokens, last = held.get(k, (capacity, t))
        tokens = min(capacity, tokens + (t - last) * rate)
        ok = tokens >= 1
        tokens -= ok
        held[k] = (tokens, t)
        out[r] = (ok, round(tokens, 6))
    return out


def test_token_bucket_batch_equals_plain_python(spark):
    rows = _events(1)
    got = {r["request_id"]: (r["allowed"], round(r["tokens"], 6)) for r in state.token_bucket(spark.createDataFrame(rows, KIND), "key", 0.5, 3.0).collect()}
    assert got == _bucket(rows, 0.5, 3.0)
    zero = state.token_bucket(spark.createDataFrame(rows[:40], KIND), "key", 0.0, 1.0).collect()
    assert sum(r["allowed"] for r in zero) == 2 and all(r["retry_after"] == float("inf") for r in zero if not r["allowed"])
    assert state.token_bucket(spark.createDataFrame([], KIND), "key", 1.0, 1.0).count() == 0


def _in_order(folder):
    """A stream takes the oldest files first: set their times by their folders' names."""
    for path in folder.rglob("*.parquet"):
        os.utime(path, (1.7e9 + int(path.parent.name), 1.7e9 + int(path.parent.name)))


def _run(spark, rows, tmp_path, f, steps=3):
    """Feed the rows in time order as several files through a stream; what it put out in all."""
    folder = tmp_path / "in"
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    size = -(-len(rows) // steps)
    for i in range(steps):
        spark.createDataFrame(rows[i * size : (i + 1) * size], KIND).coalesce(1).write.mode("append").parquet(str(folder / f"{i}"))
    _in_order(folder)
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    q = f(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_live_bucket_and_breaker_equal_their_batch_twins(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _events(2, 120)
    live_rows = _run(spark, rows, tmp_path / "bucket", lambda s: live.token_bucket(s, "key", 0.5, 3.0))
    assert {r["request_id"]: (r["allowed"], round(r["tokens"], 6)) for r in live_rows} == _bucket(rows, 0.5, 3.0)
    batch = {r["request_id"]: (r["let_through"], r["state"]) for r in state.breaker(spark.createDataFrame(rows, KIND), "key", 2, 5.0).collect()}
    live_rows = _run(spark, rows, tmp_path / "breaker", lambda s: live.breaker(s, "key", 2, 5.0))
    assert {r["request_id"]: (r["let_through"], r["state"]) for r in live_rows} == batch
    assert {s for _, s in batch.values()} == {"closed", "open", "half_open"}


def test_live_windows_drop_late_rows(spark, tmp_path):
    kind = "request_id string, provider string, start_time timestamp, success boolean, total_tokens bigint"
    rows = [(f"r{i}", "p", 1.7e9 // 3600 * 3600 + 60 * i, True, 2) for i in range(200)]

    def frame(x):
        return spark.createDataFrame(x, "request_id string, provider string, t double, success boolean, total_tokens bigint").select("request_id", "provider", F.timestamp_seconds("t").alias("start_time"), "success", "total_tokens").coalesce(1)

    frame(rows).write.parquet(str(tmp_path / "in" / "1"))
    frame([("r200", "p", rows[-1][2] + 60, True, 2)]).write.parquet(str(tmp_path / "in" / "2"))  # the watermark holds from the batch after next
    frame([("late", "p", rows[0][2] + 1, True, 2), ("next", "p", rows[-1][2] + 7200, True, 2)]).write.parquet(str(tmp_path / "in" / "3"))
    _in_order(tmp_path / "in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = live.windowed(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    got = [r["n"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()]
    assert got[:3] == [60, 60, 60]  # the late row is not counted


def test_breaker_opens_and_closes(spark):
    def run(events, **kw):
        df = spark.createDataFrame([("k", float(t), f"r{i}", ok) for i, (t, ok) in enumerate(events)], KIND)
        return [(r["let_through"], r["state"]) for r in state.breaker(df, "key", **kw).orderBy("epoch").collect()]

    fails = [(0, False), (1, False), (2, False)]
    assert run(fails, failures=3)[-1] == (True, "open")
    assert run([*fails, (3, True), (70, True), (71, True)], failures=3)[-3:] == [(False, "open"), (True, "half_open"), (True, "closed")]
    assert run([*fails, (70, False)], failures=3)[-1] == (True, "open")


def test_lru_evicts_the_oldest_and_expires(spark):
    ops = [("c", float(i), i, k) for i, k in enumerate(["k1", "k2", "k3", "k1", "k4", "k2"])]
    rows = state.lru_cache(spark.createDataFrame(ops, "cache string, epoch double, op_id int, key string"), "cache", 3).orderBy("op_id").collect()
    assert [r["hit"] for r in rows] == [False, False, False, True, False, False] and rows[4]["evicted"] == "k2"
    late = [("c", 0.0, 0, "k"), ("c", 5.0, 1, "k"), ("c", 20.0, 2, "k")]
    rows = state.lru_cache(spark.createDataFrame(late, "cache string, epoch double, op_id int, key string"), "cache", 3, 10.0).orderBy("op_id").collect()
    assert [r["hit"] for r in rows] == [False, True, False]


def test_semantic_cache_and_bounded_memory(spark):
    ops = [("c", 0.0, 0, "a", [1.0, 0.0]), ("c", 1.0, 1, "b", [0.99, 0.05]), ("c", 2.0, 2, "d", [0.0, 1.0]), ("c", 3.0, 3, "a", [9.0, 9.0])]
    rows = state.semantic_cache(spark.createDataFrame(ops, "cache string, epoch double, op_id int, key string, vec array<double>"), "cache").orderBy("op_id").collect()
    assert [(r["outcome"], r["found"]) for r in rows] == [("miss", None), ("similar", "a"), ("miss", None), ("exact", "a")]
    up = [("s", float(i), i, k, w) for i, (k, w) in enumerate([("a", 0.5), ("b", 0.1), ("c", 0.9), ("a", 0.05)])]
    rows = state.bounded_memory(spark.createDataFrame(up, "store string, epoch double, op_id int, key string, importance double"), "store", 2).orderBy("op_id").collect()
    assert [r["evicted"] for r in rows] == [None, None, "b", None]


def test_context_budget_reads_back_in_order(spark):
    rows = [("c", i, i, "user", f"word{i} more words") for i in range(6)] + [("d", 0, 9, None, "")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, message_id int, role string, content string")
    got = {r["conv_id"]: (r["context"], r["words"], r["turns"]) for r in memory.context(df, 9).collect()}
    assert got["c"] == ("user: word4 more words\nuser: word5 more words", 8, 2)


def test_cache_keys(spark):
    kind = "i int, model string, messages array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(1, "m", [("user", "Hello   World")]), (2, "m", [("user", "hello world")]), (3, "n", [("user", "x")])], kind)
    key = lambda how: [r[0] for r in df.orderBy("i").select(state.cache_key(F.col("messages"), F.col("model"), how)).collect()]
    assert key("normalized")[0] == key("normalized")[1] and key("exact")[0] != key("exact")[1]
    assert key("structure")[0] == key("structure")[1] != key("structure")[2]


def test_tools(spark):
    assert tools.calculate("2 * (3 + 4) ** 2") == "98" and tools.calculate("sqrt(16)") == "4.0"
    assert tools.calculate("__import__('os')").startswith("Error") and tools.calculate("9 ** 99999").startswith("Error") and tools.calculate(None) is None
    df = spark.createDataFrame([("Thought: think\nAction: search\nAction Input: {\"q\": 1}\nObservation: none",), ("Final Answer: done\nfully",), (None,)], "r string")
    got = [r[0] for r in df.select(tools.react(F.col("r"))).collect()]
    assert (got[0]["thought"], got[0]["action"], got[0]["action_input"], got[0]["final_answer"]) == ("think", "search", '{"q": 1}', None)
    assert got[1]["final_answer"] == "done\nfully" and got[2]["thought"] is None

    @tools.tool("shout")
    def shout(x):
        return x.upper()

    assert "shout" in tools.register_all(spark)
    assert spark.sql("SELECT shout('a') AS x, calculator('1 + 1') AS y").first().asDict() == {"x": "A", "y": "2"}
    with pytest.raises(ValueError):
        tools.tool("bad", "tuple")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / "b.txt").write_text("two\nlines")
    (tmp_path / "t" / "sub" / "a.txt").write_text("one")
    (tmp_path / "t" / "c.md").write_text("not a text")
    rows = readers.text_folder(spark, str(tmp_path / "t")).collect()
    assert [r["text"] for r in rows] == ["two\nlines", "one"]
    assert readers.text_folder(spark, str(tmp_path / "t"), 1).count() == 1
    df = spark.createDataFrame([(1, "k", None, [1.5])], "memory_id bigint, key string, value string, embedding array<double>").withColumn("created_at", F.timestamp_micros(F.lit(1_700_000_000_123_456)))
    readers.export_memories(df, str(tmp_path / "m"))
    assert readers.import_memories(spark, str(tmp_path / "m"), df.schema).collect() == df.collect()
    assert readers.as_json(spark.createDataFrame([(1, None)], "a int, b string")).first()["json"] == '{"a":1,"b":null}'


def test_shared_buckets_give_back_only_the_lane_request(spark):
    kind = "lane string, epoch double, request_id string, key string, amount double"
    rows = [("l", 0.0, "r0", "a", 1.0), ("l", 0.0, "r1", "a", 1.0), ("l", 0.0, "r2", "b", 9.0), ("l", 0.0, "r3", "c", 2.0), ("l", 0.0, "r4", "d", 1.0)]
    out = state.shared_buckets(spark.createDataFrame(rows, kind), "lane", "key", (0.0, 4.0), (0.0, 5.0), (0.0, 1.0), (0.0, 5.0)).orderBy("request_id").collect()
    assert [(r["passed"], r["denied_by"]) for r in out] == [(True, None), (False, "own"), (False, "tokens"), (True, None), (True, None)]


def test_embedding_each_text_once(spark):
    from tidewright.operators.embedding import embed_cached

    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "i int, t string")
    rows, cache = embed_cached(df, "i", "t", lambda texts: [[float(len(t))] for t in texts])
    assert {r["id"]: r["embedding"] for r in rows.collect()} == {1: [1.0], 2: [2.0], 3: [1.0], 4: None} and cache.count() == 2
    again, more = embed_cached(df, "i", "t", lambda texts: [[-1.0] for _ in texts], known=cache)
    assert {r["id"]: r["embedding"] for r in again.collect()}[1] == [1.0] and more.count() == 2
