"""DuckDB SQL for the pN_ queries that SQL can express."""

P6 = """
SELECT query_id, chunk_id, score, rank FROM (
  SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
  FROM (SELECT query_id, chunk_id, max(score + 0.0) AS score FROM retrieval_results
        WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY query_id, chunk_id)
) WHERE rank <= 10"""



def _near(source: str, key: str, text: str) -> str:
    return rf"""
SELECT '{source}' AS source, id_a, id_b FROM (
  WITH w AS (SELECT {key} AS id, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+') AS w FROM {source} WHERE {text} IS NOT NULL),
  t AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
  n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
  c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
  SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 2 * c >= x.n + y.n - c)"""


def _nearest(source: str, rows: str, by: str) -> str:
    return f"""
SELECT '{source}' AS source, vec_id, neighbor_id, place FROM (
  WITH v AS (SELECT part, id, CAST(vec AS DOUBLE[]) AS v FROM ({rows}) WHERE vec IS NOT NULL AND len(vec) = {by}
    AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
  u AS (SELECT part, id, v, sqrt(list_inner_product(v, v)) AS n FROM v),
  r AS (SELECT a.id AS vec_id, b.id AS neighbor_id, row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product(a.v, b.v) / (a.n * b.n), 9) DESC, b.id) AS i
    FROM u a JOIN u b ON a.part = b.part AND a.id <> b.id)
  SELECT vec_id, neighbor_id, CAST(i AS INTEGER) AS place FROM r WHERE i <= 5)"""


_CALLS = "SELECT model AS part, CASE WHEN model = (SELECT model FROM embed_results WHERE dimensions = 96 LIMIT 1) THEN 96 ELSE 64 END AS dim, unnest(vec_ids) AS id, unnest(embeddings) AS vec FROM embed_results"

def _grouped(source: str, key: str, text: str) -> str:
    """Classes of equal sets of triples, links between them, and groups as what a recursion reaches."""
    return rf"""
SELECT '{source}' AS source, id, class_id, group_id, links FROM (
  WITH RECURSIVE w AS (SELECT {key} AS id, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+') AS w FROM {source} WHERE {text} IS NOT NULL),
  s AS MATERIALIZED (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM w WHERE len(w) >= 3),
  k AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY s) AS class_id FROM s),
  t AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS g FROM s WHERE id IN (SELECT class_id FROM k)),
  e AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM t a JOIN t b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING 2 * count(*) >= a.n + b.n - count(*)),
  r AS (SELECT class_id AS u, class_id AS v FROM k UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
  SELECT k.id, k.class_id, g.group_id, coalesce(l.links, 0) AS links FROM k JOIN (SELECT u, min(v) AS group_id FROM r GROUP BY u) g ON g.u = k.class_id
  LEFT JOIN (SELECT u, count(*) AS links FROM e GROUP BY u) l ON l.u = k.class_id)"""


_RANK = "list_sort(list(value))[CAST(ceil({q}::DOUBLE * (count(*) - 1) + 0.5) AS BIGINT)] AS {name}"
# Nearest-rank percentiles: what summaries answer, with half a rank of error, while no group has more values than a
# summary keeps (2,000), as at the size that the twins are compared at.
_PERCENTILES = f"""
WITH once AS (SELECT DISTINCT request_id, lower(trim(provider)) AS provider, model, start_time, latency_ms, cost FROM request_metrics),
x AS (SELECT provider, model, 'latency_ms' AS metric, latency_ms AS value FROM once WHERE latency_ms >= 0 AND NOT isnan(latency_ms) UNION ALL SELECT provider, model, 'cost', cost FROM once WHERE cost IS NOT NULL AND NOT isnan(cost))
SELECT provider, model, metric, count(*) AS n, 0.5::DOUBLE AS rank_error, {", ".join(_RANK.format(q=q, name=name) for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))} FROM x GROUP BY ALL"""

_NEAREST = " UNION ALL ".join(
    [
        _nearest("text_chunks", "SELECT 0 AS part, chunk_id AS id, embedding AS vec FROM text_chunks", "64"),
        _nearest("memory_entries", "SELECT 0 AS part, memory_id AS id, embedding AS vec FROM memory_entries", "64"),
        _nearest("embed_results", _CALLS, "dim"),
    ]
)
# A day's values of a group are fewer than a summary keeps at that size, so its tuples are the values with their ranks.
_DAILY = """
WITH once AS (SELECT DISTINCT request_id, lower(trim(provider)) AS provider, model, start_time, latency_ms, cost FROM request_metrics),
x AS (SELECT CAST(start_time AS DATE) AS day, provider, model, 'latency_ms' AS metric, latency_ms AS value FROM once WHERE latency_ms >= 0 AND NOT isnan(latency_ms) UNION ALL SELECT CAST(start_time AS DATE), provider, model, 'cost', cost FROM once WHERE cost IS NOT NULL AND NOT isnan(cost)),
g AS (SELECT day, provider, model, metric, count(*) AS n, list_sort(list(value)) AS value FROM x GROUP BY ALL),
r AS (SELECT *, list_transform(range(1, n + 1), lambda i: i::DOUBLE) AS rmin FROM g)
SELECT day, provider, model, metric, n, 0.5::DOUBLE AS err, value, rmin, rmin AS rmax FROM r"""

ORACLE = {
    "p5_percentiles": _PERCENTILES,
    "p5_bounded": f"SELECT provider, model, metric, n, true AS bounded, true AS tight FROM ({_PERCENTILES})",
    "p1_found": _near("text_chunks", "chunk_id", "text") + " UNION ALL " + _near("cache_entries", "entry_id", "key"),
    "p1_groups": _grouped("text_chunks", "chunk_id", "text") + " UNION ALL " + _grouped("cache_entries", "entry_id", "key"),
    "p3_neighbours": _NEAREST,
    "p3_found": f"SELECT source, vec_id, neighbor_id FROM ({_NEAREST})",
    "p4_rebuilt": "SELECT chunk_id, text, 0::BIGINT AS too_long FROM text_chunks WHERE length(text) > 1200",
    "p9_checks": "SELECT count(*) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS misplaced, 0::BIGINT AS cut, 0::BIGINT AS lost FROM documents",
    "p5_daily": _DAILY,
    "p4_found": """
SELECT chunk_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}。！？]'), lambda x: length(x))) > 1200
  THEN 'forced' ELSE 'natural' END AS cut
FROM text_chunks WHERE length(text) > 1200""",
    "p7_distinct": "SELECT unnest(['address', 'domain', 'family', 'given', 'id_number', 'phone', 'user']) AS kind, 0::BIGINT AS shared, 0::BIGINT AS real",
    "p6_topn": P6,
    "p6_found": f"SELECT query_id, chunk_id FROM ({P6})",
    **dict.fromkeys(("p8_decoded", "p8_decoded_joined"), "SELECT doc_id, coalesce(text, '') AS text FROM documents"),
}
