"""Queries of the reference's own operators over the driver's tables, with their DuckDB twins.

Every query reads its tables as a whole. Floating-point results are rounded on both sides where sums may differ in
their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.functions import vectors as V
from tidewright.operators import bm25, chunking, dense, embedding, fusion, memory, retrieval, scoring, state, telemetry, tools
from tidewright.session import first, table, widen

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

AS_OF = "2025-03-02 00:00:00"
ASKED = (
    (0, "cache eviction and the semantic router"),
    (1, "how does the retriever rank passages"),
    (2, "streaming tokens timeout retry"),
    (3, "vector index rebuild after rollback"),
    (4, "the the latency budget of the gateway"),
)
AGENTS = ((0, "coder", "write code python function program"), (1, "reviewer", "review risk routing plan ticket"), (2, "searcher", "search retrieve document passage index"), (3, "explainer", "explain summarize role difference"))
TOOLS = (
    ("calculator", "evaluate arithmetic expressions", "math", ("math", "number")), ("text_length", "count characters words and lines", "text", ("text",)),
    ("web_search", "search pages for a query", "search", ("text", "web")), ("current_time", "the time with an offset", "time", ("clock",)),
)


def query(sql: str | None = None):
    """Register a query and its DuckDB twin."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _values(rows: tuple, names: str) -> str:
    cell = lambda x: "[" + ", ".join(map(cell, x)) + "]" if isinstance(x, tuple) else f"'{x}'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


def _asked(spark: SparkSession, n: int = len(ASKED)) -> DataFrame:
    return spark.createDataFrame(ASKED[:n], "query_id bigint, query string")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return widen(table(spark, d, "documents", "doc_id", "text"))


# ------------------------------------------------------------------ retrieval

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '([\p{L}\p{N}_]+)', 1)"


def _bm25_sql(docs: str = "documents", asked: tuple = ASKED) -> str:
    return rf"""
asked AS (SELECT CAST(query_id AS BIGINT) AS query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '([\p{{L}}\p{{N}}_]+)', 1)) AS term
  FROM {_values(asked, "query_id, query")}) GROUP BY ALL),
tok AS (SELECT doc_id, {_TOKENS} AS t FROM {docs}),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
st AS (SELECT count(*) AS n_docs, greatest(avg(len(t)), 1.0) AS avgdl FROM tok),
idf AS (SELECT term, ln(1 + (n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(avgdl) AS avgdl FROM tf, st GROUP BY term, n_docs),
scored AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avgdl)) * times) AS score
  FROM tf JOIN idf USING (term) JOIN asked USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM scored WHERE score > 0)"""


def _stable(scored: DataFrame) -> DataFrame:
    return scored.withColumn("score", F.round("score", 9))


@query(rf"SELECT count(*) AS n_docs, round(avg(len({_TOKENS})), 9) AS avgdl FROM documents")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.corpus_stats(_docs(spark, d), "doc_id", "text").select("n_docs", F.round("avgdl", 9).alias("avgdl"))


@query(rf"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.postings(_docs(spark, d), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {_bm25_sql(asked=ASKED[:1])} SELECT doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank < 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    best = bm25.top(_stable(bm25.score(_docs(spark, d), "doc_id", "text", _asked(spark, 1))), 10)
    return best.select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_bm25_sql()} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank < 10")
def bm25_multi_query(spark: SparkSession, d: str) -> DataFrame:
    best = bm25.top(_stable(bm25.score(_docs(spark, d), "doc_id", "text", _asked(spark))), 10)
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_bm25_sql()} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank < 20 AND round(score, 9) >= 2.0")
def bm25_threshold(spark: SparkSession, d: str) -> DataFrame:
    best = bm25.top(_stable(bm25.score(_docs(spark, d), "doc_id", "text", _asked(spark))), 20, 2.0)
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_ADDED = "(SELECT doc_id, text FROM documents UNION ALL SELECT -1, 'semantic router cache eviction semantic cache')"


@query(f"WITH {_bm25_sql(_ADDED)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank < 10")
def bm25_after_add(spark: SparkSession, d: str) -> DataFrame:
    """The index after one more document: statistics are recomputed as an aggregate."""
    more = spark.createDataFrame([(-1, "semantic router cache eviction semantic cache")], "doc_id bigint, text string")
    best = bm25.top(_stable(bm25.score(_docs(spark, d).unionByName(more), "doc_id", "text", _asked(spark))), 10)
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# vectors of text_chunks that can be compared, and as queries those whose id is divisible by 100
_VECS = """
vecs AS (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS v, metadata['lang'] AS lang FROM text_chunks WHERE embedding IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""


def _dense_sql(where: str = "") -> str:
    return f"""{_VECS},
dscored AS (SELECT q.chunk_id AS query_id, i.chunk_id AS item_id,
  list_inner_product(q.v, i.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(i.v, i.v)) + 1e-8) AS score
  FROM vecs q, vecs i WHERE q.chunk_id % 100 = 0 {where}),
dranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) - 1 AS rank FROM dscored WHERE score > 0)"""


def _chunk_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_chunks", F.col("chunk_id").alias("item_id"), F.col("embedding").alias("vec"), F.element_at("metadata", F.lit("lang")).alias("lang"))


def _chunk_queries(items: DataFrame) -> DataFrame:
    return items.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "vec")


def _dense(spark: SparkSession, d: str, k: int, only: str | None = None) -> DataFrame:
    items = _chunk_items(spark, d)
    own = items.where(F.coalesce(F.col("lang") == only, F.lit(False))) if only else items
    return dense.dense_top(own, _chunk_queries(items), 64, k)


@query(f"WITH {_dense_sql()} SELECT query_id, item_id, round(score, 6) AS score, rank FROM dranked WHERE rank < 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, 10).select("query_id", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_dense_sql(chr(32) + 'AND i.lang = ' + chr(39) + 'de' + chr(39))} SELECT query_id, item_id, round(score, 6) AS score, rank FROM dranked WHERE rank < 10")
def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Metadata filters stand before the cut of a dense search."""
    return _dense(spark, d, 10, "de").select("query_id", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    f"WITH {_bm25_sql()} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT r.query_id, r.doc_id, r.score, row_number() OVER (PARTITION BY query_id ORDER BY r.rank) - 1 AS rank "
    "FROM ranked r JOIN documents d USING (doc_id) WHERE r.rank < 40 AND d.lang IN ('de', 'en')) WHERE rank < 10"
)
def sparse_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Metadata filters stand after the cut (at twice the number asked) of a sparse search."""
    best = bm25.top(_stable(bm25.score(_docs(spark, d), "doc_id", "text", _asked(spark))), 40)
    lang = table(spark, d, "documents", "doc_id", "lang").where(F.col("lang").isin("de", "en"))
    kept = first(best.join(lang, "doc_id", "left_semi").withColumnRenamed("rank", "before"), ["query_id"], ["before"], 10)
    return kept.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Dense and sparse rankings that retrieval_results recorded, each chunk once per query."""
    rows = table(spark, d, "retrieval_results", "query_id", "chunk_id", "dense_score", "sparse_score")
    each = rows.groupBy("query_id", F.col("chunk_id").alias("item_id")).agg(F.max(F.nanvl("dense_score", F.lit(None).cast("double"))).alias("dense"), F.max(F.nanvl("sparse_score", F.lit(None).cast("double"))).alias("sparse"))
    return tuple(bm25.top(each.select("query_id", F.col("item_id").alias("doc_id"), F.col(c).alias("score")), 20).withColumnRenamed("doc_id", "item_id") for c in ("dense", "sparse"))


_LISTS = """
each AS (SELECT query_id, chunk_id AS item_id, max(CASE WHEN NOT isnan(dense_score) THEN dense_score END) AS dense, max(CASE WHEN NOT isnan(sparse_score) THEN sparse_score END) AS sparse FROM retrieval_results GROUP BY ALL),
dl AS (SELECT * FROM (SELECT query_id, item_id, dense AS score, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, item_id) - 1 AS rank FROM each WHERE dense > 0) WHERE rank < 20),
sl AS (SELECT * FROM (SELECT query_id, item_id, sparse AS score, row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, item_id) - 1 AS rank FROM each WHERE sparse > 0) WHERE rank < 20),
u AS (SELECT coalesce(dl.query_id, sl.query_id) AS query_id, coalesce(dl.item_id, sl.item_id) AS item_id, dl.score AS ds, sl.score AS ss, dl.rank AS dr, sl.rank AS sr
  FROM dl FULL JOIN sl ON dl.query_id = sl.query_id AND dl.item_id = sl.item_id)"""
_RRF = f"""{_LISTS},
n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS c FROM u),
f AS (SELECT query_id, item_id, 1.0::DOUBLE / (60 + coalesce(dr + 1, c + 1)) + 1.0::DOUBLE / (60 + coalesce(sr + 1, c + 1)) AS score FROM n),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) - 1 AS rank FROM f) WHERE rank < 10)"""


@query(f"WITH {_RRF} SELECT query_id, item_id, round(score, 9) AS score, rank FROM fused")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(*_two_lists(spark, d), 10).select("query_id", "item_id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    f"""WITH {_LISTS},
n AS (SELECT query_id, item_id, coalesce(ds, 0) / greatest(coalesce(max(ds) OVER w, 0), 1e-8) AS a, coalesce(ss, 0) / greatest(coalesce(max(ss) OVER w, 0), 1e-8) AS b FROM u WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, item_id, 0.7::DOUBLE * a + 0.3::DOUBLE * b AS score, a, b FROM n)
SELECT query_id, item_id, round(score, 9) AS score, round(a, 9) AS dense_score, round(b, 9) AS sparse_score, rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) - 1 AS rank FROM f) WHERE rank < 10"""
)
def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    out = fusion.weighted(*_two_lists(spark, d), 10)
    return out.select("query_id", "item_id", *[F.round(c, 9).alias(c) for c in ("score", "dense_score", "sparse_score")], F.col("rank").cast("bigint").alias("rank"))


_CANDS = """
c AS (SELECT * FROM (SELECT query_id, chunk_id AS item_id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, chunk_id) - 1 AS rank
  FROM retrieval_results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY query_id, chunk_id) WHERE rank < 50)"""


def _cands(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "retrieval_results", "query_id", "chunk_id", "score").where("score IS NOT NULL AND NOT isnan(score)")
    each = rows.groupBy("query_id", F.col("chunk_id").alias("item_id")).agg(F.max("score").alias("score"))
    return first(each, ["query_id"], [F.col("score").desc(), "item_id"], 50)


def _reranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "item_id", F.round("rerank_score", 9).alias("rerank_score"), F.col("new_rank").cast("bigint").alias("new_rank"))


_MINMAX = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"


@query(
    f"""WITH {_CANDS}, s AS (SELECT query_id, item_id, rank, CAST({_MINMAX} AS DOUBLE) AS r FROM c WINDOW w AS (PARTITION BY query_id))
SELECT query_id, item_id, round(r, 9) AS rerank_score, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(r, 12) DESC, rank, item_id) - 1 AS new_rank FROM s) WHERE new_rank < 10 AND r >= 0.2"""
)
def rerank_minmax(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(fusion.rerank(_cands(spark, d), 10, "minmax", 0.2))


@query(
    f"""WITH {_CANDS}, e AS (SELECT query_id, item_id, rank, exp(score - max(score) OVER (PARTITION BY query_id)) AS x FROM c),
s AS (SELECT query_id, item_id, rank, x / sum(x) OVER (PARTITION BY query_id) AS r FROM e)
SELECT query_id, item_id, round(r, 9) AS rerank_score, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(r, 12) DESC, rank, item_id) - 1 AS new_rank FROM s) WHERE new_rank < 10"""
)
def rerank_softmax(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(fusion.rerank(_cands(spark, d), 10, "softmax"))


def _stage_sql(source: str, name: str, k: int) -> str:
    return f"""
{name}m AS (SELECT query_id, item_id, rank, CAST({_MINMAX} AS DOUBLE) AS r FROM {source} WINDOW w AS (PARTITION BY query_id)),
{name} AS (SELECT * FROM (SELECT query_id, item_id, r AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(r, 12) DESC, rank, item_id) - 1 AS rank FROM {name}m) WHERE rank < {k})"""


@query(f"WITH {_CANDS}, {_stage_sql('c', 'a', 20)}, {_stage_sql('a', 'b', 5)}, {_stage_sql('b', 'z', 5)} SELECT query_id, item_id, round(score, 9) AS rerank_score, rank AS new_rank FROM z")
def rerank_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The last stage runs twice, as defined."""
    return _reranked(fusion.pipeline(_cands(spark, d), [("minmax", 20), ("minmax", 5)], 5))


@query(
    r"""SELECT run_id, greatest(0.0, least(10.0, CAST(regexp_extract(final_answer, '(\d+(?:\.\d+)?)', 1) AS DOUBLE))) / 10 AS judged
FROM (SELECT DISTINCT run_id, final_answer FROM agent_runs) WHERE regexp_extract(final_answer, '(\d+(?:\.\d+)?)', 1) <> ''"""
)
def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "agent_runs", "run_id", "final_answer").distinct()
    return rows.select("run_id", fusion.judge_score(F.col("final_answer")).alias("judged")).where("judged IS NOT NULL")


@query(
    f"""SELECT chunk_id, metadata['lang'] AS lang FROM text_chunks WHERE metadata['lang'] IN ('de', 'fr') AND metadata['strategy'] = 'recursive'"""
)
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    """A list means any of its values, a single value equality; a missing key fails."""
    keep = retrieval.matches(F.col("metadata"), {"lang": ["de", "fr"], "strategy": "recursive"})
    return table(spark, d, "text_chunks", "chunk_id", "metadata").where(keep).select("chunk_id", F.element_at("metadata", F.lit("lang")).alias("lang"))


# ------------------------------------------------------------------ chunking


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(\S+)', 1) AS w FROM documents),
s AS (SELECT doc_id, w, len(w) AS n, unnest(range(0, CAST(ceil(greatest(len(w) - 100, 0) / 80.0) AS BIGINT) + 1)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id AS id, CAST(i AS INTEGER) AS chunk_index, array_to_string(list_slice(w, i * 80 + 1, i * 80 + 100), ' ') AS text, CAST(i * 80 AS INTEGER) AS start_word, CAST(least(i * 80 + 100, n) AS INTEGER) AS end_word FROM s"""
)
def chunk_sliding_window(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sliding_window(_docs(spark, d), "doc_id", "text", 100, 20)


def _chunks(strategy: str, **options):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = chunking.chunk(_docs(spark, d), "doc_id", "text", strategy, **options)
        return out if strategy == "markdown" else out.drop("section")

    run.__name__ = f"chunk_{strategy}"
    return run


for _name, _options in (("fixed_size", {"size": 600, "overlap": 60}), ("sentence", {"size": 600}), ("paragraph", {"size": 600}), ("recursive", {"size": 600, "overlap": 60}), ("markdown", {"size": 600})):
    query()(_chunks(_name, **_options))


@query(
    r"""SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？\n])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS n
FROM documents WHERE text IS NOT NULL"""
)
def sentence_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.size(T.sentences("text")).cast("bigint").alias("n"))


# ------------------------------------------------------------------ functions on text and vectors

_HASH = "CAST('0x' || right(md5(w), 2) AS INTEGER)"


def _embed_sql(parts: str, dim: int) -> str:
    return f"""WITH p AS (SELECT chunk_id, unnest({parts}) AS w FROM text_chunks WHERE text IS NOT NULL),
c AS (SELECT chunk_id, {_HASH} % {dim} AS slot, count(*) AS n FROM p GROUP BY ALL),
l AS (SELECT chunk_id, sqrt(sum(n * n)) AS length FROM c GROUP BY chunk_id)
SELECT chunk_id, CAST(slot AS INTEGER) AS slot, round(n / length, 9) AS x FROM c JOIN l USING (chunk_id)"""


def _sparse(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", F.posexplode("v").alias("slot", "x")).where("x <> 0").select("chunk_id", "slot", F.round("x", 9).alias("x"))


@query(_embed_sql(r"regexp_extract_all(lower(text), '(\S+)', 1)", 128))
def hash_embed_word(spark: SparkSession, d: str) -> DataFrame:
    return _sparse(widen(table(spark, d, "text_chunks", "chunk_id", "text")).where("text IS NOT NULL").select("chunk_id", V.word_embedding(F.col("text")).alias("v")))


_TRI = "list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substring(lower(text), i, 3))"


@query(_embed_sql(_TRI, 128))
def hash_embed_trigram128(spark: SparkSession, d: str) -> DataFrame:
    return _sparse(widen(table(spark, d, "text_chunks", "chunk_id", "text")).where("text IS NOT NULL").select("chunk_id", V.trigram_embedding(F.col("text")).alias("v")))


@query(_embed_sql(_TRI, 256))
def hash_embed_trigram256(spark: SparkSession, d: str) -> DataFrame:
    return _sparse(widen(table(spark, d, "text_chunks", "chunk_id", "text")).where("text IS NOT NULL").select("chunk_id", V.trigram_embedding(F.col("text"), 256).alias("v")))


@query(
    """SELECT a.vec_id, round(CASE WHEN na * nb = 0 THEN 0 ELSE list_inner_product(a.v, b.v) / (na * nb) END, 6) AS cosine
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS na FROM embeddings) a
JOIN (SELECT vec_id - 1 AS vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nb FROM embeddings) b USING (vec_id)"""
)
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", V.doubles(F.col("embedding")).alias("v"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u")), "vec_id")
    return pairs.select("vec_id", F.round(V.cosine(F.col("v"), F.col("u")), 6).alias("cosine"))


@query(
    """SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(CASE WHEN n = 0 THEN v[i] ELSE v[i] / n END, 6) AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i, sqrt(list_inner_product(v, v)) AS n
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"""
)
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", V.unit(V.doubles(F.col("embedding"))).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


@query(r"""SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '(\S+)', 1)) AS words, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents WHERE text IS NOT NULL""")
def text_length(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("text IS NOT NULL").select("doc_id", T.text_length("text").alias("x"))
    return rows.select("doc_id", *[F.col(f"x.{c}").cast("bigint").alias(c) for c in ("chars", "words", "lines")])


@query(r"""SELECT doc_id, substring(text, 1, 500) AS preview FROM documents""")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.preview("text").alias("preview"))


# ------------------------------------------------------------------ scoring

_PAIRS = r"""
pairs AS (SELECT DISTINCT run_id AS pair_id, coalesce(final_answer, '') AS candidate, coalesce(task, '') AS reference FROM agent_runs),
tok AS (SELECT pair_id, regexp_extract_all(lower(candidate), '(\S+)', 1) AS c, regexp_extract_all(lower(reference), '(\S+)', 1) AS r FROM pairs)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return widen(table(spark, d, "agent_runs", "run_id", "final_answer", "task")).select(F.col("run_id").alias("pair_id"), F.coalesce("final_answer", F.lit("")).alias("candidate"), F.coalesce("task", F.lit("")).alias("reference")).distinct()


def _grams_sql(n: int) -> str:
    g = lambda x: f"unnest(list_transform(range(1, greatest(len({x}) - {n - 2}, 1)), lambda i: array_to_string(list_slice({x}, i, i + {n - 1}), ' ')))"
    return f"""
c{n} AS (SELECT pair_id, g, count(*) AS n FROM (SELECT pair_id, {g("c")} AS g FROM tok) GROUP BY ALL), r{n} AS (SELECT pair_id, g, count(*) AS n FROM (SELECT pair_id, {g("r")} AS g FROM tok) GROUP BY ALL),
h{n} AS (SELECT pair_id, sum(least(c{n}.n, r{n}.n)) AS hit FROM c{n} JOIN r{n} USING (pair_id, g) GROUP BY pair_id),
a{n} AS (SELECT pair_id, sum(n) AS total, count(*) AS kinds FROM c{n} GROUP BY pair_id), b{n} AS (SELECT pair_id, count(*) AS kinds FROM r{n} GROUP BY pair_id),
o{n} AS (SELECT tok.pair_id, coalesce(hit, 0) AS hit, coalesce(a{n}.total, 0) AS total, coalesce(a{n}.kinds, 0) AS ck, coalesce(b{n}.kinds, 0) AS rk
  FROM tok LEFT JOIN h{n} USING (pair_id) LEFT JOIN a{n} USING (pair_id) LEFT JOIN b{n} USING (pair_id))"""


def _f_sql(p: str, r: str) -> str:
    return f"CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END"


def _rouge_sql(n: int) -> str:
    return f"WITH {_PAIRS}, {_grams_sql(n)} SELECT pair_id, round({_f_sql('hit / greatest(ck, 1)', 'hit / greatest(rk, 1)')}, 6) AS rouge{n} FROM o{n}"


def _score(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return scoring.score(_pairs(spark, d), (metric,)).select("pair_id", F.round(metric, 6).alias(metric))

    return run


def _named(name: str, f, sql: str | None = None) -> None:
    f.__name__ = name
    query(sql)(f)


_named("rouge1", _score("rouge1"), _rouge_sql(1))
_named("rouge2", _score("rouge2"), _rouge_sql(2))
_named(
    "bleu",
    _score("bleu"),
    f"""WITH {_PAIRS}, {", ".join(_grams_sql(n) for n in range(1, 5))}
SELECT pair_id, round(CASE WHEN len(c) = 0 OR {" OR ".join(f"(o{n}.total > 0 AND o{n}.hit = 0)" for n in range(1, 5))} THEN 0.0
  ELSE (CASE WHEN len(c) < len(r) THEN exp(1 - len(r) / len(c)) ELSE 1.0 END) * exp(({" + ".join(f"(CASE WHEN o{n}.total > 0 AND o{n}.hit > 0 THEN ln(o{n}.hit / o{n}.total) ELSE 0 END)" for n in range(1, 5))}) / 4) END, 6) AS bleu
FROM tok JOIN o1 USING (pair_id) JOIN o2 USING (pair_id) JOIN o3 USING (pair_id) JOIN o4 USING (pair_id)""",
)
_named("rouge_l", _score("rouge_l"))
_named(
    "semantic_score",
    lambda spark, d: scoring.score(_pairs(spark, d), ("semantic",)).select("pair_id", F.round("semantic", 6).alias("semantic")),
    f"""WITH {_PAIRS}, cs AS (SELECT pair_id, {_HASH} % 128 AS s, count(*) AS n FROM (SELECT pair_id, unnest(c) AS w FROM tok) GROUP BY ALL), rs AS (SELECT pair_id, {_HASH} % 128 AS s, count(*) AS n FROM (SELECT pair_id, unnest(r) AS w FROM tok) GROUP BY ALL)
SELECT pair_id, round(coalesce(x, 0) / greatest(sqrt(coalesce(cn, 0)) * sqrt(coalesce(rn, 0)), 1e-12), 6) AS semantic FROM tok
LEFT JOIN (SELECT pair_id, sum(cs.n * rs.n) AS x FROM cs JOIN rs USING (pair_id, s) GROUP BY pair_id) USING (pair_id)
LEFT JOIN (SELECT pair_id, sum(n * n) AS cn FROM cs GROUP BY pair_id) USING (pair_id) LEFT JOIN (SELECT pair_id, sum(n * n) AS rn FROM rs GROUP BY pair_id) USING (pair_id)""",
)
_EXACT = r"regexp_replace(trim(regexp_replace(lower({}), '\s+', ' ', 'g')), '[^\p{{L}}\p{{N}}_\s]', '', 'g')"
_named("exact_match", _score("exact_match"), f"WITH {_PAIRS} SELECT pair_id, CAST({_EXACT.format('candidate')} = {_EXACT.format('reference')} AS DOUBLE) AS exact_match FROM pairs")
_TOKF = "len(list_intersect(list_distinct(c), list_distinct(r)))"
_named(
    "token_f1", lambda spark, d: _score("f1")(spark, d).withColumnRenamed("f1", "token_f1"),
    f"WITH {_PAIRS} SELECT pair_id, round({_f_sql(f'{_TOKF} / greatest(len(list_distinct(c)), 1)', f'{_TOKF} / greatest(len(list_distinct(r)), 1)')}, 6) AS token_f1 FROM tok",
)

# ------------------------------------------------------------------ telemetry

_LOG = """
log AS (SELECT DISTINCT request_id, coalesce(lower(trim(provider)), 'unknown') AS provider, coalesce(model, 'unknown') AS model, start_time, end_time, epoch_us(start_time) / 1e6 AS epoch,
  CASE WHEN latency_ms >= 0 AND NOT isnan(latency_ms) THEN latency_ms END AS latency_ms, prompt_tokens, completion_tokens, total_tokens, cost, success, error_type, error_message, cached, strategy FROM request_metrics)"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    columns = "request_id provider model start_time end_time latency_ms prompt_tokens completion_tokens total_tokens cost success error_type error_message cached strategy".split()
    return telemetry.requests(table(spark, d, "request_metrics", *columns))


def _by_target_sql(where: str = "", seconds: float = 0) -> str:
    return f"""WITH {_LOG} SELECT provider, model, count(*) AS requests, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, round(sum(latency_ms), 3) AS latency_sum,
min(latency_ms) AS latency_min, max(latency_ms) AS latency_max, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(cost), 6) AS cost,
count(*) FILTER (cached) AS cached, count(latency_ms) AS measured, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99,
round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(coalesce(avg(latency_ms), 0), 6) AS avg_latency, round(coalesce(sum(cost), 0) / count(*) + 1e-12, 7) AS avg_cost,
{f"round(count(*) / {seconds}::DOUBLE, 9)" if seconds else "0.0::DOUBLE"} AS throughput FROM log {where} GROUP BY provider, model"""


def _target_rows(df: DataFrame) -> DataFrame:
    places = {"latency_sum": 3, "cost": 6, "p50": 6, "p95": 6, "p99": 6, "success_rate": 6, "avg_latency": 6, "avg_cost": 7, "throughput": 9}
    return df.select(*[F.round(F.col(c) + (1e-12 if c == "avg_cost" else 0.0), places[c]).alias(c) if c in places else F.col(c) for c in df.columns])  # sums may end on a half


@query(_by_target_sql())
def metrics_by_target(spark: SparkSession, d: str) -> DataFrame:
    return _target_rows(telemetry.by_target(_log(spark, d)))


@query(_by_target_sql("WHERE epoch >= (SELECT max(epoch) FROM log) - 86400", 86400))
def metrics_last_day(spark: SparkSession, d: str) -> DataFrame:
    return _target_rows(telemetry.by_target(_log(spark, d), 86400.0))


@query(
    f"""WITH {_LOG} SELECT provider, count(*) AS requests, count(*) FILTER (success) AS succeeded, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost, CAST(grouping(provider) AS BIGINT) AS level
FROM log GROUP BY GROUPING SETS ((provider), ())"""
)
def metrics_global(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.totals(_log(spark, d)).withColumn("cost", F.round("cost", 4))


@query(
    f"""WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY provider, model ORDER BY epoch DESC, request_id DESC) AS n FROM log WHERE latency_ms IS NOT NULL)
SELECT provider, model, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99, min(latency_ms) AS low, max(latency_ms) AS high,
round(avg(latency_ms), 6) AS mean FROM r WHERE n <= 10000 GROUP BY provider, model"""
)
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.latency_percentiles(_log(spark, d))
    return out.select("provider", "model", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "low", "high", F.round("mean", 6).alias("mean"))


@query(
    f"""WITH {_LOG} SELECT strategy, count(*) AS n, min(latency_ms) AS low, max(latency_ms) AS high, round(avg(latency_ms), 6) AS mean, round(median(latency_ms), 6) AS median, round(coalesce(stddev_samp(latency_ms), 0), 4) AS stddev,
{", ".join(f"list_sort(list(latency_ms))[CAST(least(floor(count(*) * {q}::DOUBLE), count(*) - 1) AS BIGINT) + 1] AS {name}" for name, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))}
FROM log WHERE success AND latency_ms IS NOT NULL GROUP BY strategy"""
)
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.latency_stats(_log(spark, d), ["strategy"])
    return out.withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6), "stddev": F.round("stddev", 4)})


@query(
    f"""WITH {_LOG}, s AS (SELECT strategy, count(*) AS requests, count(*) FILTER (success) AS succeeded, max(epoch) - min(epoch) AS span, sum(cost) FILTER (success) AS cost, sum(total_tokens) FILTER (success) AS tokens FROM log GROUP BY strategy)
SELECT strategy, requests, succeeded, round(succeeded / requests, 6) AS success_rate, round(CASE WHEN span > 0 THEN requests / span ELSE 0 END, 9) AS rps, round(coalesce(cost, 0) / greatest(succeeded, 1), 9) AS cost_per_success,
round(coalesce(tokens, 0) / greatest(succeeded, 1), 6) AS tokens_per_success FROM s"""
)
def strategy_compare(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.summary(_log(spark, d), "strategy")
    return out.withColumns({"success_rate": F.round("success_rate", 6), "rps": F.round("rps", 9), "cost_per_success": F.round("cost_per_success", 9), "tokens_per_success": F.round("tokens_per_success", 6)})


@query(
    f"""WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY epoch, request_id) AS n FROM log WHERE NOT success)
SELECT strategy, coalesce(error_type, 'unknown') AS error, count(*) AS n FROM r WHERE n <= 5 GROUP BY ALL"""
)
def error_histogram(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.error_histogram(_log(spark, d), ["strategy"])


_EMA = f"""{_LOG}, lists AS (SELECT provider, model, list(latency_ms ORDER BY epoch, request_id) AS x FROM log WHERE success AND latency_ms IS NOT NULL GROUP BY ALL),
ema AS (SELECT provider, model, list_reduce(x, lambda a, y: 0.2::DOUBLE * y + 0.8::DOUBLE * a) AS ema, len(x) AS n FROM lists)"""


@query(f"WITH {_EMA} SELECT provider, model, round(ema, 4) AS ema, n FROM ema")
def ema_latency(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.ema(_log(spark, d), ["provider", "model"]).withColumn("ema", F.round("ema", 4))


@query(
    f"""WITH {_EMA}, r AS (SELECT provider, model, avg(CAST(success AS DOUBLE)) AS sr FROM log GROUP BY ALL), b AS (SELECT *, min(ema) OVER () AS best FROM r LEFT JOIN ema USING (provider, model))
SELECT provider, model, round(sr, 6) AS sr, round(ema, 4) AS ema, round(CASE WHEN sr = 0 THEN 0 ELSE sr * 70 + 0.3 * coalesce(least(100.0, best / greatest(ema, 1.0) * 100), 100.0) END, 4) AS health FROM b"""
)
def health_score(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.health(_log(spark, d)).withColumns({"sr": F.round("sr", 6), "ema": F.round("ema", 4), "health": F.round("health", 4)})


_SLIDE = f"""{_LOG}, slide AS (SELECT provider, request_id, epoch, count(*) OVER w AS n, avg(latency_ms) OVER w AS latency, avg(CAST(NOT success AS DOUBLE)) OVER w AS error_rate, sum(cost) OVER w AS cost, sum(total_tokens) OVER w AS tokens,
max(epoch) OVER w - min(epoch) OVER w AS span FROM log WINDOW w AS (PARTITION BY provider ORDER BY epoch RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))"""


@query(
    f"""WITH {_SLIDE} SELECT provider, request_id, n, round(latency + 1e-7, 4) AS latency, round(error_rate + 1e-9, 6) AS error_rate, round(cost, 6) AS cost, CAST(tokens AS BIGINT) AS tokens,
round(CASE WHEN n < 2 THEN 0 ELSE n / greatest(span, 0.001) END, 6) AS throughput FROM slide"""
)
def sliding_latency(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.sliding(_log(spark, d), ["provider"], 3600.0)
    return out.select("provider", "request_id", "n", F.round(F.col("latency") + 1e-7, 4).alias("latency"), F.round(F.col("error_rate") + 1e-9, 6).alias("error_rate"), F.round("cost", 6).alias("cost"), "tokens", F.round("throughput", 6).alias("throughput"))


@query(
    f"""WITH RECURSIVE {_SLIDE}, hot AS MATERIALIZED (SELECT epoch, request_id, latency FROM slide WHERE latency > 3000.0),
fired AS ((SELECT epoch, request_id, latency FROM hot ORDER BY epoch, request_id LIMIT 1)
  UNION ALL SELECT n.epoch, n.request_id, n.latency FROM (SELECT h.*, row_number() OVER (ORDER BY h.epoch, h.request_id) AS i FROM hot h, fired f WHERE h.epoch - f.epoch >= 3600.0) n WHERE n.i = 1)
SELECT 'slow_hour' AS rule, request_id, round(latency + 1e-7, 4) AS value FROM fired"""
)
def alerts(spark: SparkSession, d: str) -> DataFrame:
    """A rule's cooldown holds across all providers."""
    out = telemetry.sliding(_log(spark, d), ["provider"], 3600.0)
    return telemetry.alerts(out, "slow_hour", "latency", 3000.0, 3600.0).select("rule", "request_id", F.round(F.col("value") + 1e-7, 4).alias("value"))


@query(
    f"""WITH {_LOG}, x AS (SELECT provider, start_time AS t, 1 AS s FROM log WHERE end_time >= start_time UNION ALL SELECT provider, end_time, -1 FROM log WHERE end_time >= start_time),
e AS (SELECT provider, t, sum(s) AS net FROM x GROUP BY ALL), r AS (SELECT provider, sum(net) OVER (PARTITION BY provider ORDER BY t) AS busy FROM e) SELECT provider, CAST(max(busy) AS BIGINT) AS peak FROM r GROUP BY provider"""
)
def peak_concurrency(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.peak_concurrency(_log(spark, d), "provider")


@query(
    f"""WITH {_LOG} SELECT date_trunc('hour', start_time) AS window_start, provider, count(*) AS n, count(*) FILTER (success) AS succeeded, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM log GROUP BY ALL"""
)
def windowed_metrics(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.windowed(_log(spark, d))


_M = "lower(coalesce(error_message, ''))"


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains({_M}, '{w}')" for w in words) + ")"


@query(
    f"""SELECT DISTINCT request_id, CASE WHEN {_has("timeout", "timed out")} THEN 'timeout' WHEN {_has("429", "rate limit")} THEN 'rate_limit' WHEN {_has("401", "unauthorized", "auth")} THEN 'auth_error'
WHEN {_has("context")} AND {_has("length", "exceed")} THEN 'context_length' ELSE 'provider_error' END AS error_class FROM request_metrics WHERE NOT success"""
)
def error_class_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "request_metrics", "request_id", "error_message", "success").where("NOT success")
    return rows.select("request_id", telemetry.error_class(F.col("error_message")).alias("error_class")).distinct()


@query(
    f"""SELECT DISTINCT request_id, CASE WHEN {_has("401", "unauthorized", "invalid api key")} THEN 'auth_error' WHEN {_has("429", "rate limit")} THEN 'rate_limit' WHEN {_has("timeout", "timed out")} THEN 'timeout'
WHEN {_has("context_length", "maximum context")} THEN 'context_length' WHEN {_has("400")} THEN 'bad_request' ELSE 'provider_error' END AS error_class FROM request_metrics WHERE NOT success"""
)
def error_class_provider(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "request_metrics", "request_id", "error_message", "success").where("NOT success")
    return rows.select("request_id", telemetry.provider_error_class(F.col("error_message")).alias("error_class")).distinct()


@query(
    f"""WITH c AS (SELECT DISTINCT request_id, start_time, {_M} AS m FROM request_metrics WHERE NOT success),
k AS (SELECT CASE WHEN contains(m, 'timeout') OR contains(m, 'timed out') THEN 'timeout' WHEN contains(m, '429') OR contains(m, 'rate limit') THEN 'rate_limit' WHEN contains(m, '401') OR contains(m, 'unauthorized') OR contains(m, 'auth') THEN 'auth_error'
WHEN contains(m, 'context') AND (contains(m, 'length') OR contains(m, 'exceed')) THEN 'context_length' ELSE 'provider_error' END AS reason FROM c) SELECT reason, count(*) AS n FROM k GROUP BY reason"""
)
def failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = _log(spark, d).where("NOT success")
    return rows.groupBy(telemetry.error_class(F.col("error_message")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_LOG} SELECT DISTINCT request_id, concat_ws(':', provider, model) AS target FROM log")
def target_key(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("request_id", F.concat_ws(":", "provider", "model").alias("target")).distinct()


# ------------------------------------------------------------------ state, caches, memory


def _bucket_sql(rate: str, capacity: float, need: str) -> str:
    """The fold as a recursion: one step takes every key's next event."""
    return f"""WITH RECURSIVE {_LOG}, o AS MATERIALIZED (SELECT provider, epoch, request_id, {need}::DOUBLE AS need, row_number() OVER (PARTITION BY provider ORDER BY epoch, request_id) AS i FROM log),
b AS (SELECT provider, i, epoch, request_id, need <= {capacity} AS allowed, CASE WHEN need <= {capacity} THEN {capacity} - need ELSE {capacity} END::DOUBLE AS tokens, need FROM o WHERE i = 1
  UNION ALL SELECT provider, i, epoch, request_id, t >= need, CASE WHEN t >= need THEN t - need ELSE t END, need
  FROM (SELECT o.*, least({capacity}::DOUBLE, b.tokens + greatest(0, o.epoch - b.epoch) * {rate}) AS t FROM b JOIN o ON o.provider = b.provider AND o.i = b.i + 1))
SELECT provider, request_id, allowed, round(tokens + 1e-9, 5) AS tokens, round(CASE WHEN allowed THEN 0 ELSE (need - tokens) / {rate} END + 1e-7, 3) AS retry_after FROM b"""


def _bucket_rows(df: DataFrame) -> DataFrame:
    return df.select("provider", "request_id", "allowed", F.round(F.col("tokens") + 1e-9, 5).alias("tokens"), F.round(F.col("retry_after") + 1e-7, 3).alias("retry_after"))


@query(_bucket_sql("(1.0::DOUBLE / 600)", 5.0, "1"))
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _bucket_rows(state.token_bucket(_log(spark, d), "provider", 1 / 600, 5.0))


@query(_bucket_sql("1.0::DOUBLE", 2000.0, "coalesce(total_tokens, 0)"))
def token_bucket_by_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = _log(spark, d).withColumn("amount", F.coalesce("total_tokens", F.lit(0)).cast("double"))
    return _bucket_rows(state.token_bucket(rows, "provider", 1.0, 2000.0, "amount"))


@query(
    f"""WITH RECURSIVE {_LOG}, o AS MATERIALIZED (SELECT provider, epoch, request_id, success, row_number() OVER (PARTITION BY provider ORDER BY epoch, request_id) AS i FROM log),
b AS (SELECT provider, i, request_id, true AS let_through, 'closed' AS state, CASE WHEN success THEN 0 ELSE 1 END AS bad, CASE WHEN success THEN 1 ELSE 0 END AS good, 0.0::DOUBLE AS since FROM o WHERE i = 1
  UNION ALL SELECT provider, i, request_id, name <> 'open',
    CASE WHEN name = 'open' THEN 'open' WHEN success AND name = 'half_open' AND good + 1 >= 2 THEN 'closed' WHEN NOT success AND (name = 'half_open' OR bad + 1 >= 3) THEN 'open' ELSE name END,
    CASE WHEN name = 'open' THEN bad WHEN success THEN 0 WHEN name = 'half_open' OR bad + 1 >= 3 THEN 0 ELSE bad + 1 END,
    CASE WHEN name = 'open' OR NOT success THEN good WHEN name = 'half_open' AND good + 1 >= 2 THEN 0 ELSE good + 1 END,
    CASE WHEN name <> 'open' AND NOT success AND (name = 'half_open' OR bad + 1 >= 3) THEN epoch ELSE since END
  FROM (SELECT o.*, b.bad, b.since, CASE WHEN b.state = 'open' AND o.epoch - b.since >= 3600 THEN 'half_open' ELSE b.state END AS name, CASE WHEN b.state = 'open' AND o.epoch - b.since >= 3600 THEN 0 ELSE b.good END AS good
    FROM b JOIN o ON o.provider = b.provider AND o.i = b.i + 1))
SELECT provider, request_id, let_through, state FROM b"""
)
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    return state.breaker(_log(spark, d), "provider", 3, 3600.0, 2).select("provider", "request_id", "let_through", "state")


def _chat_keys(spark: SparkSession, d: str, how: str) -> DataFrame:
    rows = table(spark, d, "chat_completions", "completion_id", "messages", "model", "created").where("messages IS NOT NULL").dropDuplicates(["completion_id"])
    return rows.select("completion_id", "created", "model", state.cache_key(F.col("messages"), F.col("model"), how).alias("key"))


def _same_key_sql(body: str) -> str:
    return f"""WITH k AS (SELECT DISTINCT completion_id, created, concat_ws('|', coalesce(model, '~'), {body}) AS key FROM chat_completions WHERE messages IS NOT NULL)
SELECT completion_id, min(completion_id) OVER (PARTITION BY key) AS first_id, row_number() OVER (PARTITION BY key ORDER BY created, completion_id) > 1 AS hit FROM k"""


_ROLES = "array_to_string(list_transform(messages, lambda m: coalesce(m.role, '~')), chr(1))"


def _hits(spark: SparkSession, d: str, how: str) -> DataFrame:
    rows = memory.first_use(_chat_keys(spark, d, how), "key", ("created", "completion_id"))
    return rows.select("completion_id", F.min("completion_id").over(Window.partitionBy("key")).alias("first_id"), "hit")


@query(_same_key_sql(f"{_ROLES}, array_to_string(list_transform(messages, lambda m: coalesce(m.content, '~')), chr(1))"))
def cache_keys_exact(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "exact")


@query(_same_key_sql(rf"{_ROLES}, array_to_string(list_transform(messages, lambda m: coalesce(trim(regexp_replace(lower(m.content), '\s+', ' ', 'g')), '~')), chr(1))"))
def cache_keys_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "normalized")


@query(_same_key_sql(f"{_ROLES}, CAST(len(messages) AS VARCHAR)"))
def cache_keys_structure(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "structure")


@query(
    f"""SELECT entry_id, coalesce((epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(created_at)) / 1e6 > ttl, false) AS expired FROM cache_entries"""
)
def cache_ttl(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cache_entries", "entry_id", "created_at", "ttl").select("entry_id", state.expired(F.col("created_at"), F.col("ttl"), F.lit(AS_OF).cast("timestamp")).alias("expired"))


@query(
    f"""SELECT count(*) AS entries, count(*) FILTER (coalesce((epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(created_at)) / 1e6 > ttl, false)) AS expired FROM cache_entries"""
)
def expired_count(spark: SparkSession, d: str) -> DataFrame:
    gone = state.expired(F.col("created_at"), F.col("ttl"), F.lit(AS_OF).cast("timestamp"))
    return table(spark, d, "cache_entries", "created_at", "ttl").agg(F.count("*").alias("entries"), F.sum(F.when(gone, 1).otherwise(0)).cast("bigint").alias("expired"))


@query("SELECT count(*) AS lookups, count(DISTINCT text) AS embedded, count(*) - count(DISTINCT text) AS hits, round((count(*) - count(DISTINCT text)) / greatest(count(DISTINCT text), 1), 6) AS hit_rate FROM text_chunks WHERE text IS NOT NULL")
def embed_cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return embedding.cache_stats(table(spark, d, "text_chunks", "text"), "text")


def _lookups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "request_metrics", "request_id", "provider", "model", "start_time", "tags").dropDuplicates(["request_id", "start_time"])
    key = F.concat_ws("|", F.coalesce("model", F.lit("")), F.element_at("tags", F.lit("tenant")))
    return rows.select(F.coalesce(F.lower(F.trim("provider")), F.lit("unknown")).alias("cache"), (F.unix_micros("start_time") / 1e6).alias("epoch"), F.col("request_id").alias("op_id"), key.alias("key"))


_TURNS = "turns AS (SELECT DISTINCT conv_id, turn, message_id, role, coalesce(content, '') AS content FROM chat_messages)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return memory.turns(table(spark, d, "chat_messages", "conv_id", "turn", "message_id", "role", "content"))


@query(
    rf"""WITH {_TURNS}, l AS (SELECT conv_id, turn, message_id, coalesce(role, '') || ': ' || content AS line FROM turns),
n AS (SELECT *, len(regexp_extract_all(lower(line), '(\S+)', 1)) AS n FROM l), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC, message_id DESC ROWS UNBOUNDED PRECEDING) AS upto FROM n)
SELECT conv_id, string_agg(line, chr(10) ORDER BY turn, message_id) AS context, CAST(max(upto) AS BIGINT) AS words, count(*) AS turns FROM s WHERE upto <= 200 GROUP BY conv_id"""
)
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return memory.context(_turns(spark, d))


@query(f"WITH {_TURNS} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, message_id DESC) AS INTEGER) AS from_end FROM turns) WHERE from_end <= 10")
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    return memory.recent_turns(_turns(spark, d))


@query(
    f"""WITH {_TURNS} SELECT conv_id, count(*) AS turns, substring(first(content ORDER BY turn, message_id), 1, 100) AS first, substring(last(content ORDER BY turn, message_id), 1, 100) AS last FROM turns GROUP BY conv_id"""
)
def conversation_summary(spark: SparkSession, d: str) -> DataFrame:
    return memory.conversation_summary(_turns(spark, d))


@query(
    f"""WITH {_TURNS} SELECT conv_id, message_id, i, substring(b, 1, 100) AS first, substring(content, 1, 100) AS last FROM (SELECT *, CAST(row_number() OVER w AS INTEGER) AS i, lag(content, 19) OVER w AS b FROM turns
WINDOW w AS (PARTITION BY conv_id ORDER BY turn, message_id)) WHERE i >= 20"""
)
def running_summary(spark: SparkSession, d: str) -> DataFrame:
    return memory.running_summary(_turns(spark, d))


def _memories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memory_entries")


def _now():
    return F.lit(AS_OF).cast("timestamp")


_GONE = f"coalesce((epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(created_at)) / 1e6 > ttl, false)"


@query(f"SELECT memory_id FROM memory_entries WHERE NOT {_GONE} AND coalesce(importance, 0) >= 0.5")
def memory_filter(spark: SparkSession, d: str) -> DataFrame:
    return memory.memory_filter(_memories(spark, d), _now(), 0.5).select("memory_id")


_SEARCH = "cache budget retrieval agent"
_SHARE = r"""len(list_intersect(list_distinct(regexp_extract_all(lower('{q}'), '(\S+)', 1)), list_distinct(regexp_extract_all(lower({t}), '(\S+)', 1)))) / len(list_distinct(regexp_extract_all(lower('{q}'), '(\S+)', 1)))"""


@query(
    f"""WITH s AS (SELECT memory_id, round(coalesce({_SHARE.format(q=_SEARCH, t="concat_ws(' ', key, value)")}, 0), 12) AS score FROM memory_entries)
SELECT memory_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, memory_id) - 1 AS rank FROM s) WHERE rank < 10"""
)
def memory_search(spark: SparkSession, d: str) -> DataFrame:
    return memory.search_words(_memories(spark, d), _SEARCH)


@query(
    f"""WITH s AS (SELECT memory_id, round(coalesce({_SHARE.format(q=_SEARCH, t="value")}, 0) * (1 + coalesce(importance, 0)) * (1 + greatest(0, 1 - (epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(created_at)) / 1e6 / 86400 / 30)), 9) AS score FROM memory_entries)
SELECT memory_id, score FROM s ORDER BY score DESC NULLS LAST, memory_id LIMIT 10"""
)
def episode_rank(spark: SparkSession, d: str) -> DataFrame:
    return memory.episodes(_memories(spark, d), _SEARCH, _now())


@query(
    """SELECT memory_id, memory_type, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY coalesce(importance, 0) DESC, created_at DESC NULLS LAST, memory_id DESC) AS place FROM memory_entries) WHERE place <= 100"""
)
def memory_keep_important(spark: SparkSession, d: str) -> DataFrame:
    return memory.keep_important(_memories(spark, d)).select("memory_id", "memory_type", "place")


@query("""SELECT key, last(value ORDER BY created_at NULLS FIRST, memory_id) AS value, last(memory_id ORDER BY created_at NULLS FIRST, memory_id) AS memory_id, count(*) AS writes FROM memory_entries GROUP BY key""")
def working_memory_last(spark: SparkSession, d: str) -> DataFrame:
    return memory.last_values(_memories(spark, d))


@query(
    f"""SELECT memory_type, count(*) AS entries, round(sum(coalesce(importance, 0)) / count(*), 9) AS mean_importance, CAST(sum(access_count) AS BIGINT) AS accesses, count(*) FILTER ({_GONE}) AS expired FROM memory_entries GROUP BY memory_type"""
)
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    return memory.stats(_memories(spark, d), _now())


# ------------------------------------------------------------------ tools and agents


@query(f"SELECT name, category FROM {_values(TOOLS, 'name, description, category, tags')} WHERE (contains(lower(name), 'text') OR contains(lower(description), 'text') OR contains(lower(description), 'search')) AND list_contains(tags, 'text')")
def tool_search(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(a, b, c, list(t)) for a, b, c, t in TOOLS], "name string, description string, category string, tags array<string>")
    return tools.search_tools(rows, "text", "text").unionByName(tools.search_tools(rows, "search", "text")).select("name", "category").distinct()


@query(
    rf"""WITH t AS (SELECT DISTINCT run_id AS task_id, task FROM agent_runs), w AS (SELECT task_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(task, '')), '([\p{{L}}\p{{N}}_]+)', 1))) AS word FROM t),
a AS (SELECT position, agent, unnest(list_distinct(regexp_extract_all(lower(description), '([\p{{L}}\p{{N}}_]+)', 1))) AS word FROM {_values(AGENTS, 'position, agent, description')}),
h AS (SELECT task_id, agent, position, count(*) AS shared FROM w JOIN a USING (word) GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY shared DESC, position) AS n FROM h)
SELECT t.task_id, f.agent, coalesce(f.shared, 0) AS shared FROM t LEFT JOIN f ON t.task_id = f.task_id AND f.n = 1"""
)
def best_agent(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "agent_runs", F.col("run_id").alias("task_id"), "task").distinct()
    return tools.best_agent(tasks, spark.createDataFrame(AGENTS, "position int, agent string, description string"))


@query(
    """SELECT DISTINCT run_id, CAST(len(coalesce(steps, [])) AS INTEGER) AS n_steps, CAST(coalesce(list_sum(list_transform(steps, lambda s: coalesce(s.tokens_used, 0))), 0) AS BIGINT) AS tokens,
CAST(coalesce(len(list_filter(steps, lambda s: s.action IS NOT NULL)), 0) AS INTEGER) AS actions FROM agent_runs"""
)
def agent_totals(spark: SparkSession, d: str) -> DataFrame:
    return tools.step_totals(table(spark, d, "agent_runs", "run_id", "steps")).distinct()


@query(
    """SELECT s.action AS tool, count(*) AS calls, CAST(sum(coalesce(s.tokens_used, 0)) AS BIGINT) AS tokens, count(*) FILTER (s.observation IS NOT NULL) AS observed
FROM (SELECT run_id, unnest(any_value(steps)) AS s FROM agent_runs GROUP BY run_id) WHERE s.action IS NOT NULL GROUP BY ALL"""
)
def tool_stats(spark: SparkSession, d: str) -> DataFrame:
    """Calls per tool, from the steps of each run once."""
    steps = table(spark, d, "agent_runs", "run_id", "steps").dropDuplicates(["run_id"]).select(F.explode("steps").alias("s")).where("s.action IS NOT NULL")
    return steps.groupBy(F.col("s.action").alias("tool")).agg(
        F.count("*").alias("calls"), F.sum(F.coalesce("s.tokens_used", F.lit(0))).alias("tokens"), F.sum(F.when(F.col("s.observation").isNotNull(), 1).otherwise(0)).cast("bigint").alias("observed")
    )


@query(f"SELECT CAST(query_id AS BIGINT) AS query_id, CAST(i AS INTEGER) AS rank, 'Result ' || (i + 1) || ' for: ' || query AS title, round(1 - 0.1 * i, 6)::DOUBLE AS relevance FROM {_values(ASKED, 'query_id, query')}, range(5) t(i)")
def search_simulator(spark: SparkSession, d: str) -> DataFrame:
    return tools.simulated_search(_asked(spark))
