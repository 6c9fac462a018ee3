"""The pN_ queries over whole tables with production parameters."""

from __future__ import annotations

import secrets
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm import encode, mojibake, neardup, neighbours, pack, pairs, pii, quantiles, split, topn
from tidewright.session import durable, table, widen

PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


#: TESTDATA.md asks for word triples and half of them in common.
NEAR = {"k": 3, "least": 0.5, "bands": 32, "rows": 3, "radius": 70}
TEXTS = {"text_chunks": ("chunk_id", "text"), "cache_entries": ("entry_id", "key")}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of near copies of each table."""
    out = []
    for name, (key, text) in TEXTS.items():
        found = neardup.expand(*neardup.similar(table(spark, d, name, key, text), key, text, **NEAR))
        out.append(found.select(F.lit(name).alias("source"), "id_a", "id_b"))
    return out[0].unionByName(out[1])


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """The class and group of every row, without pairs of copies."""
    out = []
    for name, (key, text) in TEXTS.items():
        members, pairs = neardup.similar(table(spark, d, name, key, text), key, text, **NEAR)
        out.append(neardup.groups(members, durable(pairs)).select(F.lit(name).alias("source"), "id", "class_id", "group_id", "links"))
    return out[0].unionByName(out[1])


def p2_defects(spark: SparkSession, d: str) -> DataFrame:
    """All defects of each pair, in the order of the rules."""
    chats = pairs.completions(widen(table(spark, d, "chat_completions", "completion_id", "messages", "choices")))
    agents = pairs.runs(widen(table(spark, d, "agent_runs", "run_id", "task", "final_answer")))
    both = chats.select(F.lit("chat_completions").alias("source"), "*").unionByName(agents.select(F.lit("agent_runs").alias("source"), "*"))
    return pairs.judge(both)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_defects(spark, d).where("place = 0").select("source", "pair_id", "defect")


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """source, vec_id, neighbor_id, place for all four collections; embed_results counts by model."""
    calls = table(spark, d, "embed_results", "model", "dimensions", "vec_ids", "embeddings")
    each = calls.select("model", F.inline(F.arrays_zip(F.col("vec_ids").alias("id"), F.col("embeddings").alias("vec"))))
    models = calls.groupBy("model").agg(F.mode("dimensions", True).alias("dim")).where("dim > 0").orderBy("model").collect()  # a row per model
    sets = [
        ("text_chunks", 64, table(spark, d, "text_chunks", F.col("chunk_id").alias("id"), F.col("embedding").alias("vec"))),
        ("memory_entries", 64, table(spark, d, "memory_entries", F.col("memory_id").alias("id"), F.col("embedding").alias("vec"))),
        *[("embed_results", r["dim"], each.where(F.col("model").eqNullSafe(r["model"])).select("id", "vec")) for r in models],
    ]
    out = None
    for source, dim, rows in sets:
        found = neighbours.neighbours(rows, "id", "vec", dim).select(F.lit(source).alias("source"), F.col("id").alias("vec_id"), "neighbor_id", "place")
        out = out.unionByName(found) if out else found
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_neighbours(spark, d).select("source", "vec_id", "neighbor_id")


def p4_split(spark: SparkSession, d: str) -> DataFrame:
    return split.split(table(spark, d, "text_chunks", "chunk_id", "text"), "chunk_id", "text")


def p4_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every split chunk put together again from its pieces without their overlaps, and how many pieces are too long."""
    pieces = p4_split(spark, d).select("chunk_id", "piece", "text", "start_char", "end_char")
    before = F.lag("end_char", 1, 0).over(Window.partitionBy("chunk_id").orderBy("piece"))
    # what a piece adds begins where the one before ended
    added = pieces.select("chunk_id", "piece", F.expr("length(text)").alias("n"), F.substring("text", before - F.col("start_char") + 1, F.length("text")).alias("new"))
    whole = added.groupBy("chunk_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("piece", "new")))["new"], "").alias("text"), F.sum(F.when(F.col("n") > 1200, 1).otherwise(0)).alias("too_long"))
    return whole


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return split.cuts(p4_split(spark, d), "chunk_id")


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Measured values of request_metrics, each request once: day, provider, model, metric, value.

    Providers are trimmed and lower-cased, null names stay groups of their own; a latency that is NaN or negative
    was not measured.
    """
    rows = table(spark, d, "request_metrics", "request_id", "provider", "model", "start_time", "latency_ms", "cost")
    once = rows.dropDuplicates(["request_id", "provider", "model", "start_time", "latency_ms", "cost"])
    latency = F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))
    values = F.array(F.struct(F.lit("latency_ms").alias("metric"), latency.alias("value")), F.struct(F.lit("cost").alias("metric"), F.col("cost").alias("value")))
    return once.select(F.to_date("start_time").alias("day"), F.lower(F.trim("provider")).alias("provider"), "model", F.inline(values)).where("value IS NOT NULL")


def p5_daily(spark: SparkSession, d: str) -> DataFrame:
    """Per-day summaries, the form that is kept and combined later."""
    keys = ["day", "provider", "model", "metric"]
    return quantiles.combine(quantiles.summarise(requests(spark, d), keys, "value"), keys)


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    keys = ["provider", "model", "metric"]
    return quantiles.percentiles(quantiles.combine(p5_daily(spark, d).drop("day"), keys), keys, PERCENTILES)


def p5_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of 40 tuples, so that every level compresses: per group whether each answer's true rank lies within its stated error, and whether that is at most a tenth of the values."""
    keys, k = ["provider", "model", "metric"], 40
    rows = durable(requests(spark, d))
    daily = quantiles.combine(quantiles.summarise(rows, ["day", *keys], "value", k), ["day", *keys], k)
    small = quantiles.percentiles(quantiles.combine(daily.drop("day"), keys, k), keys, PERCENTILES)
    named = small.select(*[F.col(c).alias(f"_{c}") for c in keys], "n", "rank_error", *PERCENTILES)
    met = rows.join(named, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]))
    counts = [F.sum(F.when(F.col("value") + 0.0 < F.col(q), 1).otherwise(0)).alias(f"below_{q}") for q in PERCENTILES] + [F.sum(F.when(F.col("value") + 0.0 <= F.col(q), 1).otherwise(0)).alias(f"upto_{q}") for q in PERCENTILES]
    each = met.groupBy(*keys, "n", "rank_error").agg(*counts)
    off = [F.greatest(F.col(f"below_{q}") + 1 - (x * (F.col("n") - 1) + 1), x * (F.col("n") - 1) + 1 - F.col(f"upto_{q}")) <= F.col("rank_error") + 1e-6 for q, x in PERCENTILES.items()]
    return each.select(*keys, "n", reduce(and_, off).alias("bounded"), (F.col("rank_error") <= F.col("n") / 10 + 1).alias("tight"))


def p6_topn(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "retrieval_results", "query_id", "chunk_id", "score"), "query_id", "chunk_id", "score")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_topn(spark, d).select("query_id", "chunk_id")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return widen(table(spark, d, "chat_messages", "message_id", "content"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return pii.items(_messages(spark, d), "message_id", "content", table(spark, d, "given_names"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_items(spark, d).select("message_id", "pii_type", "start_char")


def _key(spark: SparkSession) -> bytes:
    """The secret of the surrogates: the session's ``spark.tidewright.pii.key``; without one they differ on each run."""
    return spark.conf.get("spark.tidewright.pii.key", "").encode() or secrets.token_bytes(32)


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(_messages(spark, d), "message_id", "content", durable(p7_items(spark, d)), _key(spark))


def p7_distinct(spark: SparkSession, d: str) -> DataFrame:
    """For each kind of replaced part: how many surrogates are shared by two entities, and how many are entities of the corpus (none)."""
    made = durable(pii.surrogates(durable(p7_items(spark, d)), _key(spark)).where("kind <> 'particle' AND NOT (kind = 'given' AND length(entity) = 1)"))
    low = made.select("kind", "entity", F.lower("made").alias("made"))
    shared = low.groupBy("kind").agg((F.count("*") - F.countDistinct("made")).alias("shared"))
    real = low.select("kind", "made").join(low.select("kind", F.col("entity").alias("made")), ["kind", "made"], "left_semi").groupBy("kind").agg(F.count("*").alias("real"))
    return shared.join(real, "kind", "left").select("kind", "shared", F.coalesce("real", F.lit(0)).cast("bigint").alias("real"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_ids_joined(spark: SparkSession, d: str) -> DataFrame:
    """The same with 64 KB of words broadcast, so that the others go through the join."""
    return encode.encode(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table_bound=64 << 10)


def p8_decoded_joined(spark: SparkSession, d: str) -> DataFrame:
    return encode.decode(p8_ids_joined(spark, d), "doc_id", encode.pieces(spark))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encode.decode(p8_ids(spark, d), "doc_id", encode.pieces(spark))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = durable(p8_ids(spark, d).select("doc_id", F.size("ids").alias("n_tokens")))
    return pack.pack(sizes, "doc_id", "n_tokens")


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents packed or empty, and what must not be: containers over their capacity, places that overlap or leave a gap inside, documents cut needlessly, and lost documents."""
    parts = durable(p9_packed(spark, d))
    placed = parts.where("container IS NOT NULL")
    after = placed.withColumn("due", F.lag(F.col("position") + F.col("size"), 1, 0).over(Window.partitionBy("container").orderBy("position")))
    held = placed.groupBy("container").agg(F.sum("size").alias("n"))
    cut = placed.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("size").alias("n")).where("parts > ceil(n / 2048)")
    one = spark.range(1)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    for side in (count(parts.select("doc_id").distinct(), "documents"), count(held.where("n > 2048"), "overfull"), count(after.where("position <> due"), "misplaced"), count(cut, "cut"), count(table(spark, d, "documents", "doc_id").join(parts, "doc_id", "left_anti"), "lost")):
        one = one.crossJoin(F.broadcast(side))  # one row each
    return one.drop("id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair(table(spark, d, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_restored(spark, d).where("damaged").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_defects, p3_found, p3_neighbours, p4_split, p4_rebuilt, p4_found, p5_percentiles, p5_daily, p5_bounded, p6_topn, p6_found, p7_found, p7_redacted, p7_distinct, p8_ids, p8_ids_joined, p8_decoded, p8_decoded_joined, p9_packed, p9_checks, p10_found, p10_restored)}
