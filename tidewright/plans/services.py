"""Queries on retrieval, telemetry, state and tools whose DuckDB twins fold a sequence by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import vectors as V
from tidewright.operators import fusion, memory, retrieval, state, telemetry, tools
from tidewright.plans import catalog as C
from tidewright.plans.catalog import ORACLE, query
from tidewright.session import scratch, table
from tidewright.sources import readers
from tidewright.streaming import live

# ------------------------------------------------------------------ one search for all modes

_MODEL_DIM = 128
_EMBEDDED = rf"""
hd AS (SELECT chunk_id, slot, x FROM ({C._embed_sql(r"regexp_extract_all(lower(text), '(\S+)', 1)", _MODEL_DIM)})),
qw AS (SELECT CAST(query_id AS BIGINT) AS query_id, query, unnest(regexp_extract_all(lower(query), '(\S+)', 1)) AS w FROM {C._values(C.ASKED, 'query_id, query')}),
qc AS (SELECT query_id, {C._HASH} % {_MODEL_DIM} AS slot, count(*) AS n FROM qw GROUP BY ALL),
hq AS (SELECT query_id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS x FROM qc),
dall AS (SELECT query_id, chunk_id AS item_id, round(sum(hd.x * hq.x) / (1 + 1e-8), 7) AS score FROM hd JOIN hq USING (slot) JOIN text_chunks USING (chunk_id) WHERE {{keep}} GROUP BY ALL)"""


def _modes_sql(k: int, keep: str) -> str:
    """dense and sparse lists of k each, dl and sl; the sparse one is cut at 2k before the filter."""
    bm25 = C._bm25_sql("(SELECT chunk_id AS doc_id, text FROM text_chunks)")
    return f"""{_EMBEDDED.replace("{keep}", keep)},
dl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1 AS rank FROM dall WHERE score > 0) WHERE rank < {k}),
{bm25},
sl AS (SELECT * FROM (SELECT r.query_id, r.doc_id AS item_id, r.score, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) - 1 AS rank FROM ranked r JOIN text_chunks t ON t.chunk_id = r.doc_id WHERE r.rank < {2 * k} AND {keep}) WHERE rank < {k}),
u AS (SELECT coalesce(dl.query_id, sl.query_id) AS query_id, coalesce(dl.item_id, sl.item_id) AS item_id, dl.score AS ds, sl.score AS ss, dl.rank AS dr, sl.rank AS sr FROM dl FULL JOIN sl ON dl.query_id = sl.query_id AND dl.item_id = sl.item_id)"""


def _retrieve(spark: SparkSession, d: str, mode: str, k: int, keep: dict | None = None) -> DataFrame:
    # six digits of each coordinate are enough to tell scores apart and are summed alike on both sides
    embed = lambda text: F.transform(V.word_embedding(F.coalesce(text, F.lit("")), _MODEL_DIM), lambda x: F.round(x, 9))
    docs = retrieval.embedded(table(spark, d, "text_chunks", F.col("chunk_id").alias("doc_id"), "text", "metadata"), "text", embed)
    queries = retrieval.embedded(C._asked(spark), "query", embed)
    cond = retrieval.matches(F.col("metadata"), keep) if keep else None
    out = retrieval.retrieve(docs, queries, mode, k, cond, _MODEL_DIM)
    return out.select("query_id", "item_id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_EN_DE = "coalesce(metadata['lang'] IN ('en', 'de'), false)"
_DE_FR = "coalesce(metadata['lang'] IN ('de', 'fr'), false)"


@query(f"WITH {_modes_sql(5, _DE_FR)} SELECT query_id, item_id, round(score, 4) AS score, rank FROM dl")
def retrieve_dense(spark: SparkSession, d: str) -> DataFrame:
    return _retrieve(spark, d, "dense", 5, {"lang": ["de", "fr"]})


@query(f"WITH {_modes_sql(10, _EN_DE)} SELECT query_id, item_id, round(score, 4) AS score, rank FROM sl")
def retrieve_sparse(spark: SparkSession, d: str) -> DataFrame:
    return _retrieve(spark, d, "sparse", 10, {"lang": ["en", "de"]})


@query(
    f"""WITH {_modes_sql(10, "true")}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS c FROM u),
f AS (SELECT query_id, item_id, 1.0::DOUBLE / (60 + coalesce(dr + 1, c + 1)) + 1.0::DOUBLE / (60 + coalesce(sr + 1, c + 1)) AS score FROM n)
SELECT query_id, item_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) - 1 AS rank FROM f) WHERE rank < 5"""
)
def retrieve_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The default mode and number of results: reciprocal ranks of the engine's own two searches."""
    return _retrieve(spark, d, "hybrid", 0)


@query(
    f"""WITH {_modes_sql(20, _DE_FR)},
n AS (SELECT query_id, item_id, coalesce(ds, 0) / greatest(coalesce(max(ds) OVER w, 0), 1e-8) AS a, coalesce(ss, 0) / greatest(coalesce(max(ss) OVER w, 0), 1e-8) AS b FROM u WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, item_id, 0.7::DOUBLE * a + 0.3::DOUBLE * b AS score FROM n)
SELECT query_id, item_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) - 1 AS rank FROM f) WHERE rank < 10"""
)
def retrieve_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _retrieve(spark, d, "hybrid_weighted", 10, {"lang": ["de", "fr"]})


@query(
    rf"""SELECT count(*) AS documents, count(embedding) AS embedded, (SELECT len(embedding) FROM text_chunks WHERE embedding IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC LIMIT 1) AS dim,
CAST(count(*) FILTER (len({C._TOKENS}) > 0) AS BIGINT) AS with_words FROM text_chunks"""
)
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "text_chunks", "text", F.col("embedding").alias("vec"))
    return retrieval.index_stats(rows).withColumn("dim", F.col("dim").cast("bigint"))


# ------------------------------------------------------------------ reranking

_USABLE = "len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0"
ORACLE["mmr"] = f"""WITH RECURSIVE {C._CANDS},
rel AS MATERIALIZED (SELECT query_id, item_id, rank, CAST({C._MINMAX} AS DOUBLE) AS rel FROM c WINDOW w AS (PARTITION BY query_id)),
v AS (SELECT query_id, item_id, CAST(embedding AS DOUBLE[]) AS v FROM rel JOIN text_chunks ON chunk_id = item_id WHERE embedding IS NOT NULL AND len(embedding) = 64 AND {_USABLE}),
l AS (SELECT *, greatest(sqrt(list_inner_product(v, v)), 1e-8) AS n FROM v),
sims AS MATERIALIZED (SELECT a.query_id, a.item_id, b.item_id AS other, list_inner_product(a.v, b.v) / (a.n * b.n) AS cos FROM l a JOIN l b ON a.query_id = b.query_id),
m AS (SELECT query_id, item_id, rank, rel, 0.0::DOUBLE AS near, false AS taken, 0 AS step, NULL::BIGINT AS pick FROM rel
  UNION ALL SELECT x.query_id, x.item_id, x.rank, x.rel, CASE WHEN step = 0 THEN coalesce(cos, 0) ELSE greatest(near, coalesce(cos, 0)) END, taken OR x.item_id = best, step + 1, best
  FROM (SELECT m.*, first_value(item_id) OVER w AS best, first_value(taken) OVER w AS over_ FROM m WHERE step < 10 WINDOW w AS (PARTITION BY query_id ORDER BY taken, round(0.7 * rel - 0.3 * near, 9) DESC, rank)) x
  LEFT JOIN sims s ON s.query_id = x.query_id AND s.item_id = x.item_id AND s.other = x.best WHERE NOT over_)
SELECT DISTINCT m.query_id, m.pick AS item_id, round(r.rel, 9) AS relevance, m.step - 1 AS new_rank FROM m JOIN rel r ON r.query_id = m.query_id AND r.item_id = m.pick WHERE pick IS NOT NULL"""


@query(ORACLE["mmr"])
def mmr(spark: SparkSession, d: str) -> DataFrame:
    usable = "size(embedding) = 64 AND NOT exists(embedding, x -> x IS NULL OR isnan(x))"
    vec = table(spark, d, "text_chunks", F.col("chunk_id").alias("item_id"), "embedding").where(usable).withColumnRenamed("embedding", "vec")
    return fusion.mmr(C._cands(spark, d).join(vec, "item_id", "left"), 10).withColumn("relevance", F.round("relevance", 9))


_TEXTED = f"t AS (SELECT c.*, q.query, left(coalesce(x.text, ''), 1000) AS text FROM c JOIN (SELECT query_id, min(query) AS query FROM retrieval_results GROUP BY 1) q USING (query_id) JOIN text_chunks x ON x.chunk_id = c.item_id)"


def _texted(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "retrieval_results", "query_id", "query").groupBy("query_id").agg(F.min("query").alias("query"))
    texts = table(spark, d, "text_chunks", F.col("chunk_id").alias("item_id"), "text")
    return C._cands(spark, d).join(asked, "query_id").join(texts, "item_id")


def _length_share(queries: list[str], texts: list[str]) -> list[float]:
    """A stand-in for a model of pairs: how much of the text's length the query has."""
    return [round(min(len(q), len(t)) / max(len(q), len(t), 1), 9) for q, t in zip(queries, texts)]


@query(
    f"""WITH {C._CANDS}, {_TEXTED}, s AS (SELECT query_id, item_id, rank, round(least(length(coalesce(query, '')), length(text)) / greatest(length(coalesce(query, '')), length(text), 1), 9) AS r FROM t)
SELECT query_id, item_id, r AS rerank_score, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, rank, item_id) - 1 AS new_rank FROM s) WHERE new_rank < 10"""
)
def rerank_cross_encoder(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of query and text (1,000 characters of it, as defined) through a model that is called in batches."""
    return fusion.cross_encoded(_texted(spark, d), _length_share, 10).withColumn("new_rank", F.col("new_rank").cast("bigint"))


@query(
    f"""WITH {C._CANDS}, {_TEXTED}, a AS (SELECT *, regexp_extract(text, '(\\d+(?:\\.\\d+)?)', 1) AS x FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, item_id) AS place FROM t) WHERE place <= 20),
s AS (SELECT query_id, item_id, rank, CASE WHEN x <> '' THEN greatest(0.0, least(10.0, CAST(x AS DOUBLE))) / 10 ELSE score END AS r FROM a)
SELECT query_id, item_id, round(r, 9) AS rerank_score, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, rank, item_id) - 1 AS new_rank FROM s) WHERE new_rank < 10"""
)
def rerank_judge(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 candidates by a judge's replies; a reply without a number leaves the own score."""
    rows = _texted(spark, d).withColumn("text", F.substring(F.coalesce("text", F.lit("")), 1, 1000))
    out = fusion.judged(rows, F.col("text"), 10)
    return out.select("query_id", "item_id", F.round("rerank_score", 9).alias("rerank_score"), F.col("new_rank").cast("bigint").alias("new_rank"))


# ------------------------------------------------------------------ telemetry


@query(f"WITH {C._LOG} SELECT request_id, provider, model FROM log WHERE provider = 'auralis' AND model = (SELECT min(model) FROM route_targets WHERE provider = 'auralis') AND epoch >= (SELECT max(epoch) FROM log) - 7 * 86400")
def metrics_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The last week of one provider and model."""
    model = table(spark, d, "route_targets", "provider", "model").where("provider = 'auralis'").agg(F.min("model").alias("m")).first()["m"]
    log = C._log(spark, d)
    last = log.agg((F.max("epoch") - 7 * 86400).alias("since"))
    return telemetry.only(log.crossJoin(F.broadcast(last)), "auralis", model, F.col("since")).select("request_id", "provider", "model")  # one row


@query(
    f"""WITH {C._LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY provider, model ORDER BY epoch DESC, request_id DESC) AS n FROM log WHERE success AND latency_ms IS NOT NULL)
SELECT provider, model, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(sum(cost), 6) AS cost FROM r WHERE n <= 100 GROUP BY ALL"""
)
def last_successes(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.last_successes(C._log(spark, d)).withColumns({c: F.round(c, 6) for c in ("p50", "p95", "cost")})


_REASON = "CASE WHEN contains(m, 'timeout') OR contains(m, 'timed out') THEN 'timeout' WHEN contains(m, '429') OR contains(m, 'rate limit') THEN 'rate_limit' WHEN contains(m, '401') OR contains(m, 'unauthorized') OR contains(m, 'auth') THEN 'auth_error' WHEN contains(m, 'context') AND (contains(m, 'length') OR contains(m, 'exceed')) THEN 'context_length' ELSE 'provider_error' END"
_FAILED = f"{C._LOG}, bad AS (SELECT request_id, provider, model, epoch, {_REASON} AS reason FROM (SELECT *, {C._M} AS m FROM log WHERE NOT success))"


@query(
    f"""WITH {_FAILED} SELECT 'total' AS kind, 'all' AS name, count(*) AS n FROM bad UNION ALL SELECT 'reason', reason, count(*) FROM bad GROUP BY reason
UNION ALL SELECT 'chain', provider, count(*) FROM route_targets GROUP BY provider"""
)
def fallback_stats(spark: SparkSession, d: str) -> DataFrame:
    """Failures in all and by reason, and how many targets each provider's chain has."""
    chains = table(spark, d, "route_targets", F.col("provider").alias("source"), F.col("model").alias("target"))
    return telemetry.fallback_stats(C._log(spark, d), chains)


@query(f"WITH {_FAILED} SELECT request_id, provider, model, reason FROM bad WHERE reason = 'rate_limit' ORDER BY epoch DESC, request_id DESC LIMIT 50")
def failure_history(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.failure_history(C._log(spark, d), "rate_limit", 50)


#: rule, metric, op, bound, window, cooldown, providers, models
ALERT_RULES = (
    ("slow", "latency", "gt", 4000.0, 3600.0, 7200.0, (), ()), ("failing", "error_rate", "gte", 0.5, 1800.0, 3600.0, ("auralis", "corvane"), ()),
    ("cheap", "cost", "lt", 0.0005, 600.0, 86400.0, ("dunmere",), ()), ("idle", "token_count", "lte", 50.0, 900.0, 43200.0, (), ()),
    ("busy", "throughput", "gt", 0.5, 1200.0, 3600.0, ("brimstack",), ()), ("sound", "success_rate", "lte", 0.4, 7200.0, 600.0, ("eskolin", "ferrowick"), ()),
)
_VALUE = {
    "latency": "coalesce(sum(latency_ms) OVER w, 0) / count(*) OVER w", "error_rate": "1 - avg(CAST(success AS DOUBLE)) OVER w", "success_rate": "avg(CAST(success AS DOUBLE)) OVER w", "cost": "coalesce(sum(cost) OVER w, 0)",
    "token_count": "CAST(coalesce(sum(total_tokens) OVER w, 0) AS DOUBLE)", "throughput": "CASE WHEN count(*) OVER w < 2 THEN 0 ELSE count(*) OVER w / greatest(max(epoch) OVER w - min(epoch) OVER w, 0.001) END",
}
_OPS = {"gt": ">", "lt": "<", "gte": ">=", "lte": "<="}


def _rules_sql() -> str:
    names = [r[0] for r in ALERT_RULES]
    slides = ", ".join(
        f"""{r[0]}_v AS MATERIALIZED (SELECT '{r[0]}' AS rule, {r[5]}::DOUBLE AS cooldown, epoch, request_id, provider, model, value FROM (SELECT *, {_VALUE[r[1]]} AS value FROM log
  {"WHERE provider IN (" + ", ".join(f"'{p}'" for p in r[6]) + ")" if r[6] else ""} WINDOW w AS (ORDER BY epoch RANGE BETWEEN {r[4]} PRECEDING AND CURRENT ROW)) WHERE round(value, 9) {_OPS[r[2]]} {r[3]})"""
        for r in ALERT_RULES
    )
    hot = " UNION ALL ".join(f"SELECT * FROM {n}_v" for n in names)
    return f"""WITH RECURSIVE {C._LOG}, {slides}, hot AS MATERIALIZED ({hot}),
fired AS (SELECT rule, cooldown, epoch, request_id, provider, model, value FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY epoch, request_id) AS i FROM hot) WHERE i = 1
  UNION ALL SELECT rule, cooldown, epoch, request_id, provider, model, value FROM (SELECT h.*, row_number() OVER (PARTITION BY h.rule ORDER BY h.epoch, h.request_id) AS i FROM hot h JOIN fired f ON f.rule = h.rule WHERE h.epoch - f.epoch >= h.cooldown) WHERE i = 1)
SELECT rule, request_id, provider, model, round(value + 1e-7, 4) AS value FROM fired"""


@query(_rules_sql())
def rule_alerts(spark: SparkSession, d: str) -> DataFrame:
    """A table of rules: every metric and comparison, scopes of providers, windows and cooldowns of their own."""
    rules = spark.createDataFrame([(*r[:6], list(r[6]), list(r[7])) for r in ALERT_RULES], telemetry.RULES)
    return telemetry.rule_alerts(C._log(spark, d), rules).select("rule", "request_id", "provider", "model", F.round(F.col("value") + 1e-7, 4).alias("value"))


@query(
    f"""WITH t AS ({C._by_target_sql()}), g AS (SELECT sum(requests) AS total_requests, sum(succeeded) AS total_successes, round(sum(cost), 4) AS total_cost FROM t)
SELECT provider, model, requests AS request_count, success_rate, avg_latency AS avg_latency_ms, p95 AS p95_latency_ms, cost AS total_cost, CAST(g.total_requests AS BIGINT) AS total_requests, CAST(g.total_successes AS BIGINT) AS total_successes, g.total_cost AS global_cost,
'{C.AS_OF}' AS exported_at FROM t, g"""
)
def metrics_json(spark: SparkSession, d: str) -> DataFrame:
    """The whole export document, written as one JSON text and read again."""
    by = C._target_rows(telemetry.by_target(C._log(spark, d)))
    doc = readers.metrics_document(by, F.lit(C.AS_OF))
    return readers.read_metrics_document(doc).withColumn("global_cost", F.round("global_cost", 4))


@query(
    f"""WITH s AS ({ORACLE["latency_stats"]}), c AS ({ORACLE["strategy_compare"]})
SELECT strategy AS name, requests AS total_requests, succeeded AS successful, requests - succeeded AS failed, success_rate, rps AS throughput_rps, mean AS mean_ms, p95 AS p95_ms, cost_per_success AS cost_per_request, requests - succeeded AS errors_count FROM c LEFT JOIN s USING (strategy)"""
)
def benchmark_json(spark: SparkSession, d: str) -> DataFrame:
    """A result document per configuration, written as JSON and read again."""
    docs = readers.benchmark_documents(C.strategy_compare(spark, d), C.latency_stats(spark, d), "strategy")
    return readers.read_benchmark_documents(docs)


_ROW = "printf('%-20s %7.1f%% %9.0fms %9.0fms %7.1f', strategy, round(success_rate * 100 + 1e-9, 1), round(mean + 1e-9, 0), round(p95 + 1e-9, 0), round(rps + 1e-9, 1))"


@query(
    f"""WITH s AS ({ORACLE["latency_stats"]}), c AS ({ORACLE["strategy_compare"]}), r AS (SELECT {_ROW} AS line, row_number() OVER (ORDER BY strategy) AS i FROM c JOIN s USING (strategy))
SELECT 0 AS line_no, printf('%-20s %8s %11s %11s %7s', 'Name', 'Success', 'Mean Lat', 'P95 Lat', 'RPS') AS line UNION ALL SELECT CAST(i AS INTEGER), line FROM r"""
)
def metrics_report(spark: SparkSession, d: str) -> DataFrame:
    """The comparing report, a line a configuration."""
    return readers.compare_report(C.strategy_compare(spark, d), C.latency_stats(spark, d), "strategy")


@query(
    f"""WITH {C._LOG}, g AS (SELECT provider, start_time, CASE WHEN start_time - lag(start_time) OVER (PARTITION BY provider ORDER BY start_time) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM log),
s AS (SELECT provider, start_time, sum(new) OVER (PARTITION BY provider ORDER BY start_time ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT provider, min(start_time) AS session_start, max(start_time) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY provider, i"""
)
def request_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The live sessions over a table at rest."""
    return live.sessions(C._log(spark, d), "provider")


@query(ORACLE["windowed_metrics"])
def windowed_metrics_stream(spark: SparkSession, d: str) -> DataFrame:
    """The table as a stream until it is used up: one query drops repeats within the watermark, a second one counts in windows what the first wrote."""
    rest = table(spark, d, "request_metrics")
    stream = spark.readStream.schema(rest.schema).parquet(f"{d}/request_metrics.parquet*")
    named = stream.withColumn("provider", F.coalesce(F.lower(F.trim("provider")), F.lit("unknown")))
    once, out = scratch(spark), scratch(spark)
    live.run_once(live.once(named, "request_id", "start_time"), once, scratch(spark), "append")
    live.run_once(live.windowed(spark.readStream.schema(named.schema).parquet(once)), out, scratch(spark))
    return spark.read.parquet(out)


# ------------------------------------------------------------------ sequences of state


def _take(left: str, last: str, rate: str, cap: float) -> str:
    return f"least({cap}::DOUBLE, coalesce({left}, {cap}) + greatest(0, epoch - coalesce({last}, epoch)) * {rate})"


_ENTRY = "list_filter({x}, lambda h: h.k = provider)[1]"
ORACLE["shared_buckets"] = f"""WITH RECURSIVE {C._LOG},
o AS MATERIALIZED (SELECT CAST(start_time AS DATE) AS day, provider, epoch, request_id, coalesce(total_tokens, 0)::DOUBLE AS need, row_number() OVER (PARTITION BY CAST(start_time AS DATE) ORDER BY epoch, request_id) AS i FROM log),
b AS (SELECT DISTINCT day, 0::BIGINT AS i, NULL::VARCHAR AS request_id, NULL::DOUBLE AS rl, NULL::DOUBLE AS rt, NULL::DOUBLE AS tl, NULL::DOUBLE AS tt, []::STRUCT(k VARCHAR, l DOUBLE, t DOUBLE)[] AS own, []::STRUCT(k VARCHAR, l DOUBLE, t DOUBLE)[] AS tok, NULL::BOOLEAN AS passed, NULL::VARCHAR AS denied_by FROM o
  UNION ALL SELECT day, i, request_id, CASE WHEN NOT p1 THEN r WHEN p2 AND NOT p4 THEN least(10, r) ELSE r - 1 END, epoch,
    CASE WHEN p2 AND big THEN CASE WHEN p3 THEN t - need ELSE t END ELSE tl END, CASE WHEN p2 AND big THEN epoch ELSE tt END,
    CASE WHEN p1 THEN list_append(list_filter(own, lambda h: h.k <> provider), {{'k': provider, 'l': CASE WHEN p2 THEN w - 1 ELSE w END, 't': epoch}}) ELSE own END,
    CASE WHEN p3 AND big THEN list_append(list_filter(tok, lambda h: h.k <> provider), {{'k': provider, 'l': CASE WHEN p4 THEN u - need ELSE u END, 't': epoch}}) ELSE tok END,
    p4, CASE WHEN NOT p1 THEN 'requests' WHEN NOT p2 THEN 'own' WHEN NOT p3 THEN 'tokens' WHEN NOT p4 THEN 'own_tokens' END
  FROM (SELECT *, p3 AND (NOT big OR u >= need) AS p4 FROM (SELECT *, p2 AND (NOT big OR t >= need) AS p3 FROM (SELECT *, p1 AND w >= 1 AS p2, need > 1 AS big FROM (SELECT *, r >= 1 AS p1 FROM (
    SELECT o.*, b.rl, b.rt, b.tl, b.tt, b.own, b.tok, {_take("b.rl", "b.rt", "(1.0::DOUBLE / 120)", 10.0)} AS r, {_take(_ENTRY.replace("{x}", "b.own") + ".l", _ENTRY.replace("{x}", "b.own") + ".t", "(1.0::DOUBLE / 600)", 3.0)} AS w,
      {_take("b.tl", "b.tt", "2.0", 20000.0)} AS t, {_take(_ENTRY.replace("{x}", "b.tok") + ".l", _ENTRY.replace("{x}", "b.tok") + ".t", "1.0", 5000.0)} AS u
    FROM b JOIN o ON o.day = b.day AND o.i = b.i + 1)))))) 
SELECT day, request_id, passed, denied_by FROM b WHERE i > 0"""


@query(ORACLE["shared_buckets"])
def shared_buckets(spark: SparkSession, d: str) -> DataFrame:
    """A day and its requests are a lane; requests and tokens are limited for the lane and for each provider."""
    rows = C._log(spark, d).withColumn("day", F.to_date("start_time")).withColumn("amount", F.coalesce("total_tokens", F.lit(0)).cast("double"))
    out = state.shared_buckets(rows, "day", "provider", (1 / 120, 10.0), (2.0, 20000.0), (1 / 600, 3.0), (1.0, 5000.0))
    return out.select("day", "request_id", "passed", "denied_by")


_LRU = """RECURSIVE look AS (SELECT DISTINCT coalesce(lower(trim(provider)), 'unknown') AS cache, epoch_us(start_time) / 1e6 AS epoch, request_id AS op_id, concat_ws('|', coalesce(model, ''), tags['tenant']) AS key FROM request_metrics),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cache ORDER BY epoch, op_id) AS i FROM look),
s AS (SELECT DISTINCT cache, 0::BIGINT AS i, NULL::VARCHAR AS op_id, []::STRUCT(k VARCHAR, b DOUBLE)[] AS held, NULL::BOOLEAN AS hit, NULL::VARCHAR AS evicted FROM o
  UNION ALL SELECT cache, i, op_id, CASE WHEN hit THEN list_append(rest, {'k': key, 'b': born}) WHEN len(rest) >= 50 THEN list_append(rest[2:], {'k': key, 'b': epoch}) ELSE list_append(rest, {'k': key, 'b': epoch}) END, hit,
    CASE WHEN NOT hit AND len(rest) >= 50 THEN rest[1].k END
  FROM (SELECT *, born IS NOT NULL AND epoch - born <= 86400 AS hit FROM (SELECT o.*, list_filter(s.held, lambda h: h.k <> o.key) AS rest, list_filter(s.held, lambda h: h.k = o.key)[1].b AS born FROM s JOIN o ON o.cache = s.cache AND o.i = s.i + 1)))"""


@query(f"WITH {_LRU} SELECT cache, op_id, hit, evicted FROM s WHERE i > 0")
def cache_lru(spark: SparkSession, d: str) -> DataFrame:
    return state.lru_cache(C._lookups(spark, d), "cache", 50, 86400.0).select("cache", "op_id", "hit", "evicted")


@query(f"WITH {_LRU} SELECT cache, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 4) AS hit_rate FROM s WHERE i > 0 GROUP BY cache")
def cache_lru_stats(spark: SparkSession, d: str) -> DataFrame:
    return memory.cache_stats(state.lru_cache(C._lookups(spark, d), "cache", 50, 86400.0), ["cache"])


@query(
    f"""WITH RECURSIVE tri AS (SELECT entry_id, {C._HASH} % 256 AS slot, count(*)::DOUBLE AS n FROM (SELECT entry_id, unnest(list_transform(range(1, greatest(length(key) - 1, 1)), lambda i: substring(lower(key), i, 3))) AS w FROM cache_entries WHERE length(key) >= 3) GROUP BY ALL),
vec AS (SELECT entry_id, list_transform(range(0, 256), lambda q: coalesce(map_extract_value(m, q), 0.0::DOUBLE)) AS v FROM (SELECT entry_id, map(list(slot::BIGINT), list(n)) AS m FROM tri GROUP BY entry_id)),
o AS MATERIALIZED (SELECT e.entry_id AS op_id, e.key, coalesce(v, list_transform(range(0, 256), lambda q: 0.0::DOUBLE)) AS v, row_number() OVER (ORDER BY epoch_us(created_at), e.entry_id) AS i FROM cache_entries e LEFT JOIN vec USING (entry_id) WHERE e.key IS NOT NULL),
n AS MATERIALIZED (SELECT *, sqrt(list_inner_product(v, v)) AS len_ FROM o),
s AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS op_id, []::VARCHAR[] AS keys, []::STRUCT(k VARCHAR, v DOUBLE[], n DOUBLE)[] AS recent, NULL::VARCHAR AS outcome, NULL::VARCHAR AS found, NULL::DOUBLE AS similarity
  UNION ALL SELECT i, op_id, CASE WHEN outcome = 'miss' THEN list_append(keys, key) ELSE keys END, CASE WHEN outcome = 'miss' THEN list_append(recent, {{'k': key, 'v': v, 'n': len_}})[-20:] ELSE recent END, outcome,
    CASE outcome WHEN 'exact' THEN key WHEN 'similar' THEN recent[place].k END, CASE outcome WHEN 'exact' THEN 1.0 ELSE best END
  FROM (SELECT *, CASE WHEN list_contains(keys, key) THEN 'exact' WHEN coalesce(best, -1) >= 0.92 THEN 'similar' ELSE 'miss' END AS outcome FROM (SELECT *, list_max(sims) AS best, list_position(sims, list_max(sims)) AS place FROM (
    SELECT n.*, s.keys, s.recent, list_transform(s.recent, lambda h: CASE WHEN h.n * n.len_ = 0 THEN 0.0 ELSE list_inner_product(h.v, n.v) / (h.n * n.len_) END) AS sims FROM s JOIN n ON n.i = s.i + 1))))
SELECT op_id, outcome, found, round(similarity, 6) AS similarity FROM s WHERE i > 0"""
)
def cache_semantic(spark: SparkSession, d: str) -> DataFrame:
    """One cache over all entries, in the order they were stored."""
    rows = table(spark, d, "cache_entries", F.col("entry_id").alias("op_id"), "key", (F.unix_micros("created_at") / 1e6).alias("epoch")).where("key IS NOT NULL")
    one = rows.select(F.lit("all").alias("cache"), "op_id", "epoch", "key", V.trigram_embedding(F.col("key"), 256).alias("vec"))
    return state.semantic_cache(one, "cache").select("op_id", "outcome", "found", F.round("similarity", 6).alias("similarity"))


@query(
    """WITH RECURSIVE o AS MATERIALIZED (SELECT coalesce(memory_type, 'none') AS store, memory_id AS op_id, key, coalesce(importance, 0) AS imp, row_number() OVER (PARTITION BY coalesce(memory_type, 'none') ORDER BY coalesce(epoch_us(created_at) / 1e6, 0), memory_id) AS i FROM memory_entries),
s AS (SELECT DISTINCT store, 0::BIGINT AS i, NULL::BIGINT AS op_id, []::STRUCT(k VARCHAR, m DOUBLE)[] AS held, NULL::VARCHAR AS evicted FROM o
  UNION ALL SELECT store, i, op_id, CASE WHEN len(all_) > 50 THEN list_concat(all_[:place - 1], all_[place + 1:]) ELSE all_ END, CASE WHEN len(all_) > 50 THEN all_[place].k END
  FROM (SELECT *, list_position(list_transform(all_, lambda h: h.m), list_min(list_transform(all_, lambda h: h.m))) AS place FROM (
    SELECT o.store, o.i, o.op_id, list_append(list_filter(s.held, lambda h: h.k IS DISTINCT FROM o.key), {'k': o.key, 'm': o.imp}) AS all_ FROM s JOIN o ON o.store = s.store AND o.i = s.i + 1)))
SELECT store, op_id, evicted FROM s WHERE i > 0"""
)
def memory_evictions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_entries", F.col("memory_id").alias("op_id"), "memory_type", "key", "importance", (F.unix_micros("created_at") / 1e6).alias("epoch"))
    ops = rows.select(F.coalesce("memory_type", F.lit("none")).alias("store"), "op_id", "key", F.coalesce("importance", F.lit(0.0)).alias("importance"), F.coalesce("epoch", F.lit(0.0)).alias("epoch"))
    return state.bounded_memory(ops, "store", 50).select("store", "op_id", "evicted")


@query(
    f"""WITH RECURSIVE {C._LOG}, o AS MATERIALIZED (SELECT provider, request_id, epoch, epoch_us(end_time) / 1e6 AS done, row_number() OVER (PARTITION BY provider ORDER BY epoch, request_id) AS i FROM log WHERE end_time >= start_time),
s AS (SELECT DISTINCT provider, 0::BIGINT AS i, NULL::VARCHAR AS request_id, []::DOUBLE[] AS busy, NULL::BOOLEAN AS admitted FROM o
  UNION ALL SELECT provider, i, request_id, CASE WHEN len(left_) < 1 THEN list_append(left_, done) ELSE left_ END, len(left_) < 1 FROM (SELECT o.*, list_filter(s.busy, lambda e: e > o.epoch) AS left_ FROM s JOIN o ON o.provider = s.provider AND o.i = s.i + 1))
SELECT provider, request_id, admitted FROM s WHERE i > 0"""
)
def concurrency_slots(spark: SparkSession, d: str) -> DataFrame:
    """One slot a provider: a request that finds it taken is denied and holds nothing."""
    rows = C._log(spark, d).where("end_time >= start_time").withColumn("done", F.unix_micros("end_time") / 1e6)
    return state.slots(rows, "provider", 1).select("provider", "request_id", "admitted")


# ------------------------------------------------------------------ memories and cache keys


@query(
    f"""WITH v AS (SELECT memory_id, CASE WHEN embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS v FROM memory_entries),
s AS (SELECT q.memory_id AS query_id, m.memory_id, CASE WHEN m.v IS NULL THEN 0.0 ELSE round(list_inner_product(q.v, m.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(m.v, m.v)) + 1e-8), 9) END AS score FROM v q, v m WHERE q.v IS NOT NULL AND q.memory_id % 100 = 0)
SELECT query_id, memory_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) - 1 AS rank FROM s) WHERE rank < 10"""
)
def memory_search_vector(spark: SparkSession, d: str) -> DataFrame:
    """The memories whose id is divisible by 100 ask all memories."""
    rows = table(spark, d, "memory_entries", "memory_id", "embedding")
    asks = rows.where("memory_id % 100 = 0").select(F.col("memory_id").alias("query_id"), F.col("embedding").alias("vec"))
    out = memory.search_vectors(rows, asks, 64)
    return out.select("query_id", "memory_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT memory_id FROM memory_entries WHERE NOT {C._GONE} AND coalesce(importance, 0) >= 0.2 AND list_has_any(tags, ['router', 'benchmark'])")
def memory_filter_tags(spark: SparkSession, d: str) -> DataFrame:
    return memory.memory_filter(C._memories(spark, d), C._now(), 0.2, ["router", "benchmark"]).select("memory_id")


_PARAMS = "CAST(CASE WHEN completion_id % 3 = 0 THEN 0.0 ELSE 0.7 END AS VARCHAR), CAST(CASE WHEN completion_id % 2 = 0 THEN 256 ELSE 1024 END AS VARCHAR)"


@query(C._same_key_sql(f"{C._ROLES}, array_to_string(list_transform(messages, lambda m: coalesce(m.content, '~')), chr(1)), {_PARAMS}"))
def cache_keys_params(spark: SparkSession, d: str) -> DataFrame:
    """Requests that differ in temperature or max_tokens have different keys; parameters that aren't given count as 0.7 and 1024."""
    return _keyed(spark, d, lambda r: state.cache_key(F.col("messages"), F.col("model"), "exact", F.when(F.col("completion_id") % 3 == 0, 0.0), F.when(F.col("completion_id") % 2 == 0, 256)))


@query(C._same_key_sql("CAST(len(messages) AS VARCHAR)"))
def cache_keys_custom(spark: SparkSession, d: str) -> DataFrame:
    """A caller's own key."""
    return _keyed(spark, d, lambda r: state.cache_key(F.col("messages"), F.col("model"), custom=lambda messages, model: F.struct(model.alias("m"), F.size(messages).alias("n"))))


def _keyed(spark: SparkSession, d: str, key) -> DataFrame:
    rows = table(spark, d, "chat_completions", "completion_id", "messages", "model", "created").where("messages IS NOT NULL").dropDuplicates(["completion_id"])
    first = memory.first_use(rows.withColumn("key", key(rows)), "key", ("created", "completion_id"))
    return first.select("completion_id", F.min("completion_id").over(C.Window.partitionBy("key")).alias("first_id"), "hit")


@query(
    """SELECT tool, count(*) AS calls, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, CASE WHEN count(*) FILTER (ok) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS counted_rate, round(count(*) FILTER (ok) / count(*), 6) AS success_rate
FROM (SELECT s.action AS tool, s.observation IS NOT NULL AND NOT starts_with(lower(s.observation), 'error') AS ok FROM (SELECT unnest(any_value(steps)) AS s FROM agent_runs GROUP BY run_id) WHERE s.action IS NOT NULL) GROUP BY tool"""
)
def tool_execution_stats(spark: SparkSession, d: str) -> DataFrame:
    """A call fails without an observation, or if it begins with an error."""
    steps = table(spark, d, "agent_runs", "run_id", "steps").dropDuplicates(["run_id"]).select(F.explode("steps").alias("s")).where("s.action IS NOT NULL")
    ok = F.col("s.observation").isNotNull() & ~F.coalesce(F.lower("s.observation").startswith("error"), F.lit(False))
    return tools.execution_stats(steps.select(F.col("s.action").alias("tool"), ok.alias("ok")), "tool")
