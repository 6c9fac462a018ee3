"""Queries on texts (chunks, scores, parsed replies, files) and the DuckDB twins that need recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators import chunking, embedding, scoring, tools
from tidewright.plans import catalog as C
from tidewright.plans.catalog import ORACLE, query
from tidewright.session import scratch, table
from tidewright.sources import readers

# ------------------------------------------------------------------ chunking

_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_LINE = "chr(10)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _sum(x: str, size: str) -> str:
    return f"coalesce(list_sum(list_transform({x}, lambda y: {size.replace("@", 'y')})), 0)"


#: Sizes as SQL: characters, or words between white space.
_CHARS, _WORDS = "length(@)", f"len(list_filter(regexp_split_to_array(@, '{_WS}+'), lambda w: w <> ''))"


def _sentence_ctes(p: str, src: str, limit: int, size: str = _CHARS) -> str:
    """{p}chunks(k, o, text, start_char, end_char) from {src}(k, t): one step of a recursion takes every text's next part."""
    return rf"""
{p}l AS (SELECT k, list_filter(list_transform(string_split(regexp_replace(t, '([.!?。！？\n]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_strip("x")}), lambda x: x <> '') AS l FROM {src}),
{p}p AS MATERIALIZED (SELECT k, CAST(generate_subscripts(l, 1) AS BIGINT) AS i, unnest(l) AS p FROM {p}l),
{p}n AS (SELECT k, len(l) AS n FROM {p}l WHERE len(l) > 0),
{p}m AS (SELECT k, 0::BIGINT AS i, '' AS buf, NULL::VARCHAR AS done FROM {p}n
  UNION ALL SELECT m.k, m.i + 1, CASE WHEN length(buf) + length(p) < 20 THEN buf || ' ' || p ELSE p END, CASE WHEN length(buf) + length(p) < 20 THEN NULL ELSE buf END FROM {p}m m JOIN {p}p p ON p.k = m.k AND p.i = m.i + 1),
{p}a AS (SELECT k, i, {_strip("done")} AS s FROM {p}m WHERE done IS NOT NULL UNION ALL SELECT m.k, i + 1, {_strip("buf")} FROM {p}m m JOIN {p}n n ON n.k = m.k AND n.n = m.i),
{p}s AS MATERIALIZED (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS j, s, {size.replace("@", "s")} AS z FROM {p}a WHERE s <> ''),
{p}c AS (SELECT k, 0::BIGINT AS j, []::VARCHAR[] AS own, 0::BIGINT AS seen, NULL::VARCHAR[] AS done, 0::BIGINT AS upto FROM {p}n
  UNION ALL SELECT c.k, c.j + 1, CASE WHEN full_ THEN list_append(own[-greatest(1, len(own) // 5):], s) ELSE list_append(own, s) END, seen + length(s), CASE WHEN full_ THEN own END, seen
  FROM (SELECT c.*, s.s, len(own) > 0 AND {_sum("own", size)} + s.z > {limit} AS full_ FROM {p}c c JOIN {p}s s ON s.k = c.k AND s.j = c.j + 1) c),
{p}e AS (SELECT k, j, done AS own, upto FROM {p}c WHERE done IS NOT NULL UNION ALL SELECT c.k, c.j + 1, own, seen FROM {p}c c JOIN (SELECT k, max(j) AS n FROM {p}s GROUP BY k) n ON n.k = c.k AND n.n = c.j),
{p}chunks AS (SELECT k, j AS o, array_to_string(own, ' ') AS text, upto - length(array_to_string(own, ' ')) AS start_char, upto AS end_char FROM {p}e)"""


def _paragraph_ctes(p: str, src: str, limit: int, size: str = _CHARS) -> str:
    """{p}chunks(k, o, text, start_char, end_char), o being a list that orders them."""
    return rf"""
{p}pl AS (SELECT k, list_filter(list_transform(string_split(regexp_replace(t, '\n{_WS}*\n', chr(1), 'g'), chr(1)), lambda x: {_strip("x")}), lambda x: x <> '') AS l FROM {src}),
{p}pp AS MATERIALIZED (SELECT k, CAST(generate_subscripts(l, 1) AS BIGINT) AS i, unnest(l) AS p FROM {p}pl),
{p}pn AS (SELECT k, len(l) AS n FROM {p}pl WHERE len(l) > 0),
{p}pc AS (SELECT k, 0::BIGINT AS i, []::VARCHAR[] AS own, 0::BIGINT AS seen, NULL::VARCHAR[] AS done, 0::BIGINT AS upto FROM {p}pn
  UNION ALL SELECT k, i + 1, CASE WHEN large THEN [] WHEN full_ THEN [p] ELSE list_append(own, p) END, seen + length(p), CASE WHEN (large OR full_) AND len(own) > 0 THEN own END, seen
  FROM (SELECT c.*, p.p, {size.replace("@", "p.p")} > {limit} AS large, {_sum("own", size)} + {size.replace("@", "p.p")} > {limit} AS full_ FROM {p}pc c JOIN {p}pp p ON p.k = c.k AND p.i = c.i + 1)),
{p}pe AS (SELECT k, i, done AS own, upto FROM {p}pc WHERE done IS NOT NULL UNION ALL SELECT c.k, c.i + 1, own, seen FROM {p}pc c JOIN {p}pn n ON n.k = c.k AND n.n = c.i WHERE len(own) > 0),
{p}big AS (SELECT {{'k': k, 'i': i}} AS k, p AS t FROM {p}pp WHERE {size.replace("@", "p")} > {limit}),
{_sentence_ctes(p + "q", p + "big", limit, size)},
{p}chunks AS (SELECT k, [i, 0, 0] AS o, array_to_string(own, chr(10) || chr(10)) AS text, upto - length(array_to_string(own, chr(10) || chr(10))) AS start_char, upto AS end_char FROM {p}pe
  UNION ALL SELECT k.k, [k.i, 1, o], text, start_char, end_char FROM {p}qchunks)"""


_DOCS = "src AS (SELECT doc_id AS k, text AS t FROM documents WHERE text IS NOT NULL AND text <> '')"


def _numbered(chunks: str, size: str = _CHARS, more: str = "") -> str:
    return f"SELECT k AS id, CAST(row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS INTEGER) AS chunk_index, text, CAST(start_char AS INTEGER) AS start_char, CAST(end_char AS INTEGER) AS end_char, CAST({size.replace("@", 'text')} AS INTEGER) AS token_count{more} FROM {chunks}"


def _last(sep: str) -> str:
    return f"length(regexp_extract(seg, '(?s)^(.*){sep}', 1))"


def _fixed_sql(size: int, overlap: int) -> str:
    stop = f"CASE WHEN a + {size} >= n THEN n WHEN {_last('[.] ')} > {size // 2} THEN a + {_last('[.] ')} + 2 WHEN {_last(chr(92) + 'n')} > {size // 2} THEN a + {_last(chr(92) + 'n')} + 1 WHEN {_last(' ')} > {size // 2} THEN a + {_last(' ')} + 1 ELSE a + {size} END"
    return f"""WITH RECURSIVE {_DOCS},
c AS (SELECT k, t, n, a, CAST({stop} AS BIGINT) AS z FROM (SELECT k, t, length(t) AS n, 0::BIGINT AS a, substring(t, 1, {size}) AS seg FROM src)
  UNION ALL SELECT k, t, n, a, CAST({stop} AS BIGINT) FROM (SELECT k, t, n, z - {overlap} AS a, substring(t, z - {overlap} + 1, {size}) AS seg FROM c WHERE z < n)),
chunks AS (SELECT k, a AS o, {_strip("substring(t, a + 1, z - a)")} AS text, a AS start_char, z AS end_char FROM c)
{_numbered("(SELECT * FROM chunks WHERE text <> '')")}"""


def _markdown_sql(limit: int) -> str:
    return rf"""WITH RECURSIVE {_DOCS},
cut AS (SELECT k, t, string_split(regexp_replace(t, '(?m)^(#{{1,6}}{_WS}+.+)$', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS l FROM src),
sec AS (SELECT k, i, CASE WHEN i = 1 THEN '' ELSE split_part(x, chr(2), 1) END AS title, CASE WHEN i > 1 THEN {_strip("split_part(x, chr(2), 2)")} WHEN n = 1 THEN x ELSE {_strip("x")} END AS body
  FROM (SELECT k, len(l) AS n, CAST(generate_subscripts(l, 1) AS BIGINT) AS i, unnest(l) AS x FROM cut)),
kept AS (SELECT k, i, title, body, CASE WHEN title = '' THEN body ELSE title || chr(10) || body END AS shown FROM sec WHERE i > 1 OR {_strip("body")} <> ''),
placed AS (SELECT *, coalesce(sum(CASE WHEN length(body) <= {limit} THEN length(shown) ELSE length(body) END) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM kept),
large AS (SELECT {{'k': k, 'i': i, 'title': title}} AS k, body AS t FROM kept WHERE length(body) > {limit}),
{_paragraph_ctes("m", "large", limit)},
chunks AS (SELECT k, [i, 0, 0, 0] AS o, {_strip("shown")} AS text, a AS start_char, a + length(shown) AS end_char, title AS section FROM placed WHERE length(body) <= {limit}
  UNION ALL SELECT k.k, list_concat([k.i], o), CASE WHEN k.title = '' THEN text ELSE k.title || chr(10) || text END, start_char, end_char, k.title FROM mchunks)
{_numbered("chunks", more=", section")}"""


def _plan_sql(sep: str, size: int, overlap: int) -> str:
    """What the parts between one separator are merged into, in order: pieces (m) and parts to be split again (r)."""
    join = lambda x: f"array_to_string({x}, {sep})"
    full = f"len(a.own) > 0 AND {_sum('a.own', _CHARS)} + length(p) > {size}"
    tail = f"a.own[coalesce(list_filter(range(1, len(a.own)), lambda i: length({join('a.own[i:]')}) <= {overlap})[1], len(a.own)):]"
    own, out = f"CASE WHEN {full} THEN {tail} ELSE a.own END", f"CASE WHEN {full} THEN list_append(a.out, {{'k': 'm', 't': {join('a.own')}}}) ELSE a.out END"
    large = f"list_concat({out}, CASE WHEN len({own}) > 0 THEN [{{'k': 'm', 't': {join(own)}}}, {{'k': 'r', 't': p}}] ELSE [{{'k': 'r', 't': p}}] END)"
    step = f"CASE WHEN length(p) > {size} THEN {{'own': []::VARCHAR[], 'out': {large}}} ELSE {{'own': list_append({own}, p), 'out': {out}}} END"
    folded = f"list_reduce(string_split(t, {sep}), lambda a, p: {step}, {{'own': []::VARCHAR[], 'out': []::STRUCT(k VARCHAR, t VARCHAR)[]}})"
    return f"list_transform([{folded}], lambda z: CASE WHEN len(z.own) > 0 THEN list_append(z.out, {{'k': 'm', 't': {join('z.own')}}}) ELSE z.out END)[1]"


def _recursive_sql(size: int, overlap: int) -> str:
    seps = ["chr(10) || chr(10)", "chr(10)", "'. '", "'。'", "' '"]
    plans = ", ".join(f"CASE WHEN k = 'r' AND length(t) > {size} AND contains(t, {x}) THEN {_plan_sql(x, size, overlap)} END AS p{i}" for i, x in enumerate(seps))
    steps = f"list_transform(list_filter(range(0, length(t), {size - overlap}), lambda i: {_strip(f'substring(t, i + 1, {size})')} <> ''), lambda i: {{'k': 'm', 't': substring(t, i + 1, {size})}})"
    chosen = "CASE " + " ".join(f"WHEN len(p{i}) > 1 THEN p{i}" for i in range(len(seps))) + f" ELSE {steps} END"
    return f"""WITH RECURSIVE {_DOCS},
w AS (SELECT k AS id, 0::BIGINT AS i, 0::BIGINT AS seen, [{{'k': 'r', 't': t}}]::STRUCT(k VARCHAR, t VARCHAR)[] AS todo, NULL::VARCHAR AS done FROM src
  UNION ALL SELECT id, i + 1, seen + CASE WHEN done IS NULL THEN 0 ELSE length(done) END, CASE WHEN k = 'm' OR length(t) <= {size} THEN rest ELSE list_concat({chosen}, rest) END, done
  FROM (SELECT *, CASE WHEN k = 'm' OR (length(t) <= {size} AND {_strip("t")} <> '') THEN t END AS done, {plans} FROM (SELECT id, i, seen, todo[1].k AS k, todo[1].t AS t, todo[2:] AS rest FROM w WHERE len(todo) > 0))),
chunks AS (SELECT id AS k, i AS o, done AS text, seen - length(done) AS start_char, seen AS end_char FROM w WHERE done IS NOT NULL)
{_numbered("chunks")}"""


ORACLE["chunk_recursive"] = _recursive_sql(600, 60)
ORACLE["chunk_fixed_size"] = _fixed_sql(600, 60)
ORACLE["chunk_sentence"] = f"WITH RECURSIVE {_DOCS}, {_sentence_ctes('s', 'src', 600)} {_numbered('schunks')}"
ORACLE["chunk_paragraph"] = f"WITH RECURSIVE {_DOCS}, {_paragraph_ctes('p', 'src', 600)} {_numbered('pchunks')}"
ORACLE["chunk_markdown"] = _markdown_sql(600)


@query(f"WITH RECURSIVE {_DOCS}, {_sentence_ctes('s', 'src', 90, _WORDS)} {_numbered('schunks', _WORDS)}")
def chunk_sentence_words(spark: SparkSession, d: str) -> DataFrame:
    """Sizes told by another counter than characters."""
    return chunking.chunk(C._docs(spark, d), "doc_id", "text", "sentence", chunking.words, size=90).drop("section")


@query(f"WITH RECURSIVE {_DOCS}, {_paragraph_ctes('p', 'src', 90, _WORDS)} {_numbered('pchunks', _WORDS)}")
def chunk_paragraph_words(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(C._docs(spark, d), "doc_id", "text", "paragraph", chunking.words, size=90).drop("section")


# ------------------------------------------------------------------ scoring

# Longest common subsequence: each step of the recursion takes the next word of every candidate and makes a new row of the table.
_LCS = f"""{C._PAIRS},
lcs AS (SELECT pair_id, c, r, 0::BIGINT AS i, list_transform(range(0, len(r) + 1), lambda x: 0::BIGINT) AS row FROM tok
  UNION ALL SELECT pair_id, c, r, i + 1, list_prepend(0::BIGINT, list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda q: greatest(row[q + 1], CASE WHEN r[q] = c[i + 1] THEN row[q] + 1 ELSE 0 END)))))
  FROM lcs WHERE i < len(c)),
rl AS (SELECT pair_id, row[len(r) + 1] AS hit FROM lcs WHERE i = len(c))"""
_RL = C._f_sql("rl.hit / greatest(len(c), 1)", "rl.hit / greatest(len(r), 1)")
ORACLE["rouge_l"] = f"WITH RECURSIVE {_LCS} SELECT pair_id, round({_RL}, 6) AS rouge_l FROM tok JOIN rl USING (pair_id)"


def _own(name: str) -> str:
    """The twin of one metric as a table."""
    return f"({ORACLE[name]})"


_ALL = f"""WITH RECURSIVE {_LCS},
every AS (SELECT pair_id, bleu, rouge1, rouge2, round({_RL}, 6) AS rouge_l, semantic, exact_match, token_f1 AS f1 FROM tok JOIN rl USING (pair_id)
  JOIN {_own("bleu")} USING (pair_id) JOIN {_own("rouge1")} USING (pair_id) JOIN {_own("rouge2")} USING (pair_id) JOIN {_own("semantic_score")} USING (pair_id) JOIN {_own("exact_match")} USING (pair_id) JOIN {_own("token_f1")} USING (pair_id))"""


def _rounded(spark: SparkSession, d: str) -> DataFrame:
    """All metrics to six digits, so that what is made of them is made of the same numbers on both sides."""
    return scoring.score(C._pairs(spark, d)).select("pair_id", *[F.round(m, 6).alias(m) for m in scoring.METRICS])


@query(f"{_ALL} SELECT *, round((bleu + rouge1 + rouge2 + rouge_l + semantic + exact_match + f1) / 7, 5) AS avg_score FROM every")
def score_all(spark: SparkSession, d: str) -> DataFrame:
    rounded = _rounded(spark, d)
    return rounded.withColumn("avg_score", F.round(sum((F.col(m) for m in scoring.METRICS), F.lit(0.0)) / len(scoring.METRICS), 5))


@query(
    f"{_ALL} SELECT metric, round(avg(x), 5) AS mean, round(min(x), 5) AS low, round(max(x), 5) AS high, round(coalesce(stddev_samp(x), 0), 4) AS std, count(x) AS n "
    "FROM (UNPIVOT (SELECT * EXCLUDE (pair_id) FROM every) ON bleu, rouge1, rouge2, rouge_l, semantic, exact_match, f1 INTO NAME metric VALUE x) GROUP BY metric"
)
def score_aggregate(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.aggregate(_rounded(spark, d))
    return out.select("metric", *[F.round(c, 5).alias(c) for c in ("mean", "low", "high")], F.round("std", 4).alias("std"), "n")


@query(
    """WITH s AS (SELECT run_id, list_transform(steps, lambda s: coalesce(s.thought, '')) AS c, list_filter(list_transform(steps, lambda s: s.observation), lambda x: x IS NOT NULL) AS r
  FROM (SELECT run_id, any_value(steps) AS steps FROM agent_runs WHERE steps IS NOT NULL GROUP BY run_id)),
p AS (SELECT run_id, unnest(range(1, least(len(c), len(r)) + 1)) AS i, c, r FROM s)
SELECT run_id, CAST(i - 1 AS INTEGER) AS position, c[i] AS candidate, r[i] AS reference FROM p"""
)
def positional_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidates and references in two lists are paired by position, up to the shorter one."""
    runs = table(spark, d, "agent_runs", "run_id", "steps").where("steps IS NOT NULL").dropDuplicates(["run_id"])
    lists = runs.select("run_id", F.transform("steps", lambda s: F.coalesce(s["thought"], F.lit(""))).alias("c"), F.filter(F.transform("steps", lambda s: s["observation"]), lambda x: x.isNotNull()).alias("r"))
    return scoring.zipped(lists, "run_id", "c", "r")


# ------------------------------------------------------------------ functions


@query(r"SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS kinds FROM (SELECT doc_id, string_split(replace(text, ' ', ''), '') AS t FROM documents WHERE lower(lang) = 'ja' AND replace(text, ' ', '') <> '')")
def char_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of a script without word breaks: signs without spaces."""
    rows = table(spark, d, "documents", "doc_id", "text", "lang").where(F.lower("lang") == "ja").select("doc_id", T.char_tokens("text").alias("t")).where("size(t) > 0")
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n"), F.size(F.array_distinct("t")).cast("bigint").alias("kinds"))


@query(
    """SELECT DISTINCT completion_id, array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), ' ') AS plain, array_to_string(list_transform(messages, lambda m: coalesce(m.content, '') || ' ' || m.role), ' ') AS parts
FROM chat_completions WHERE messages IS NOT NULL AND len(list_filter(messages, lambda m: m.role IS NULL)) = 0"""
)
def extract_text(spark: SparkSession, d: str) -> DataFrame:
    """Contents that are strings, and contents that are lists of parts with a text."""
    rows = table(spark, d, "chat_completions", "completion_id", "messages").where("messages IS NOT NULL AND NOT exists(messages, m -> m.role IS NULL)")
    parts = F.transform("messages", lambda m: F.array(F.struct(F.lit("text").alias("type"), F.coalesce(m["content"], F.lit("")).alias("text")), F.struct(F.lit("text").alias("type"), m["role"].alias("text"))))
    return rows.select("completion_id", T.message_text("messages").alias("plain"), T.parts_text(parts).alias("parts")).distinct()


_KEYED = "SELECT chunk_id, text, md5('hash:' || text) AS key FROM text_chunks"


@query(
    f"""WITH e AS ({C._embed_sql(r"regexp_extract_all(lower(text), '(\S+)', 1)", 128)}) SELECT k.chunk_id AS id, k.key, count(slot) AS slots, round(coalesce(sum(x * x), 0), 6) AS squares
FROM ({_KEYED}) k LEFT JOIN e USING (chunk_id) GROUP BY ALL"""
)
def embed_cached(spark: SparkSession, d: str) -> DataFrame:
    """Vectors through a cache that already has every other text; each distinct text is embedded once."""
    rows = table(spark, d, "text_chunks", "chunk_id", "text")
    known = embedding.embed_cached(rows.where("chunk_id % 2 = 0"), "chunk_id", "text", embedding.hash_words)[1]
    out = embedding.embed_cached(rows, "chunk_id", "text", embedding.hash_words, known=known)[0]
    v = F.coalesce("embedding", F.array().cast("array<double>"))
    return out.select("id", "key", F.size(F.filter(v, lambda x: x != 0)).cast("bigint").alias("slots"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 6).alias("squares"))


@query(
    f"""WITH seen AS (SELECT DISTINCT key FROM ({_KEYED} WHERE chunk_id % 2 = 0)) SELECT key, count(*) AS n FROM ({_KEYED} WHERE text IS NOT NULL) WHERE key NOT IN (SELECT key FROM seen WHERE key IS NOT NULL) GROUP BY key"""
)
def embed_unseen(spark: SparkSession, d: str) -> DataFrame:
    """The texts that a cache lacks: what is left without those it has."""
    rows = table(spark, d, "text_chunks", "chunk_id", "text").select("chunk_id", embedding.cache_key("hash", F.col("text")).alias("key")).where("key IS NOT NULL")
    return embedding.unseen(rows, rows.where("chunk_id % 2 = 0"), "key").groupBy("key").agg(F.count("*").alias("n"))


@query(
    """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, list_inner_product(q, v) AS p, sqrt(list_inner_product(q, q)) AS a, sqrt(list_inner_product(v, v)) AS b FROM e, q)
SELECT vec_id, round(p / (CASE WHEN a = 0 THEN 1 ELSE a END * CASE WHEN b = 0 THEN 1 ELSE b END), 6) AS similarity FROM n"""
)
def batch_similarity(spark: SparkSession, d: str) -> DataFrame:
    """One query vector against all rows of a batch."""
    rows = table(spark, d, "embeddings", "vec_id", C.V.doubles(F.col("embedding")).alias("v"))
    one = rows.orderBy("vec_id").limit(1).select(F.col("v").alias("q"))
    return rows.crossJoin(F.broadcast(one)).select("vec_id", F.round(embedding.batch_similarity(F.col("q"), F.col("v")), 6).alias("similarity"))  # one row


# ------------------------------------------------------------------ agents' replies and arithmetic

_REPLY = """'Thought: ' || coalesce(s.thought, '') || chr(10) || CASE WHEN s.step_number % 3 = 2 THEN 'Final Answer: ' || coalesce(s.observation, '') ELSE 'Action: ' || coalesce(s.action, '') || chr(10) || 'Action Input: {"input": "' || s.step_number || '"}' || chr(10) || 'Observation: ' || coalesce(s.observation, '') END"""


def _part_sql(pattern: str) -> str:
    return f"nullif(trim(regexp_extract(r, '{pattern}', 1)), '')"


@query(
    rf"""WITH u AS (SELECT DISTINCT run_id, unnest(steps) AS s FROM agent_runs), x AS (SELECT DISTINCT run_id, s.step_number AS step_number, {_REPLY} AS r FROM u)
SELECT run_id, step_number, {_part_sql(r'(?s)Thought:\s*(.*?)(?:\nAction:|\nFinal Answer:|$)')} AS thought, {_part_sql(r'Action:[ \t]*([^\n]*)')} AS action,
{_part_sql(r'(?s)Action Input:\s*(.*?)(?:\nObservation:|\nThought:|\nFinal Answer:|$)')} AS action_input, {_part_sql(r'(?s)Final Answer:\s*(.*)')} AS final_answer FROM x"""
)
def react_parse(spark: SparkSession, d: str) -> DataFrame:
    """Replies of both kinds: an action with its input, or a final answer."""
    steps = table(spark, d, "agent_runs", "run_id", F.explode("steps").alias("s"))
    say = lambda label, x: F.concat(F.lit(label), F.coalesce(x, F.lit("")))
    act = F.concat(say("Action: ", F.col("s.action")), F.lit('\nAction Input: {"input": "'), F.col("s.step_number").cast("string"), F.lit('"}'), say("\nObservation: ", F.col("s.observation")))
    reply = F.concat(say("Thought: ", F.col("s.thought")), F.lit("\n"), F.when(F.col("s.step_number") % 3 == 2, say("Final Answer: ", F.col("s.observation"))).otherwise(act))
    return steps.select("run_id", "s.step_number", tools.react(reply).alias("p")).select("run_id", "step_number", "p.*").distinct()


@query(
    """WITH x AS (SELECT DISTINCT query_id AS a, chunk_id AS b FROM retrieval_results),
e AS (SELECT a::VARCHAR || ' * 2 + ' || b AS expression, (a * 2 + b)::VARCHAR AS value FROM x UNION SELECT '(' || a || ' + ' || b || ') * (3 - 1)', ((a + b) * 2)::VARCHAR FROM x
UNION SELECT 'max(' || a || ', ' || b || ') - min(' || a || ', ' || b || ')', (greatest(a, b) - least(a, b))::VARCHAR FROM x UNION SELECT 'abs(-' || a || ')', a::VARCHAR FROM x UNION SELECT a || ' // 0', 'Error: integer division or modulo by zero' FROM x
UNION SELECT 'open(' || a || ')', 'Error: unsupported expression' FROM x UNION SELECT 'floor(' || a || '.5)', a::VARCHAR FROM x)
SELECT * FROM e"""
)
def calculator(spark: SparkSession, d: str) -> DataFrame:
    """Precedence, parentheses, functions and errors."""
    a, b = F.col("query_id").cast("string"), F.col("chunk_id").cast("string")
    forms = [
        F.concat(a, F.lit(" * 2 + "), b), F.concat(F.lit("("), a, F.lit(" + "), b, F.lit(") * (3 - 1)")), F.concat(F.lit("max("), a, F.lit(", "), b, F.lit(") - min("), a, F.lit(", "), b, F.lit(")")),
        F.concat(F.lit("abs(-"), a, F.lit(")")), F.concat(a, F.lit(" // 0")), F.concat(F.lit("open("), a, F.lit(")")), F.concat(F.lit("floor("), a, F.lit(".5)")),
    ]
    rows = table(spark, d, "retrieval_results", "query_id", "chunk_id").select(F.explode(F.array(*forms)).alias("expression")).distinct()
    return rows.select("expression", tools.calculator("expression").alias("value"))


@query("SELECT CAST(h AS INTEGER) AS hours, strftime(TIMESTAMP '2025-03-02 00:00:00' + to_hours(CAST(h AS INTEGER)), '%Y-%m-%dT%H:%M:%S+00:00') AS time FROM range(-12, 15) t(h)")
def current_time(spark: SparkSession, d: str) -> DataFrame:
    """A time with an offset of hours; the label stays that of UTC."""
    hours = spark.range(-12, 15).select(F.col("id").cast("int").alias("hours"))
    return hours.select("hours", tools.current_time(F.col("hours"), F.lit(C.AS_OF).cast("timestamp")).alias("time"))


@query(
    """WITH r AS (SELECT DISTINCT request_id, tags, retry_count, strategy FROM request_metrics),
e AS (SELECT request_id, list_filter([CASE WHEN tags['tenant'] IS NULL THEN 'missing: tenant' END, CASE WHEN TRY_CAST(retry_count::VARCHAR AS DOUBLE) IS NULL THEN 'missing: retries' END,
  CASE WHEN strategy IS NOT NULL AND strategy NOT IN ('cost', 'latency', 'round_robin') THEN 'not one of: strategy' END, CASE WHEN tags['tenant'] IS NOT NULL AND TRY_CAST(tags['tenant'] AS DOUBLE) IS NULL THEN 'no number: tenant' END], lambda x: x IS NOT NULL) AS errors FROM r)
SELECT request_id, array_to_string(errors, '; ') AS errors FROM e"""
)
def tool_validate(spark: SparkSession, d: str) -> DataFrame:
    """Arguments of calls against a tool's parameters: required ones, numbers, and values of a list."""
    rows = table(spark, d, "request_metrics", "request_id", "tags", "retry_count", "strategy").select("request_id", F.element_at("tags", F.lit("tenant")).alias("tenant"), F.col("retry_count").cast("string").alias("retries"), "strategy").distinct()
    args = F.map_from_arrays(F.array(F.lit("tenant"), F.lit("retries"), F.lit("strategy")), F.array("tenant", "retries", "strategy"))
    rules = [tools.Param("tenant", required=True), tools.Param("retries", required=True, number=True), tools.Param("strategy", one_of=("cost", "latency", "round_robin")), tools.Param("tenant", number=True)]
    return rows.select("request_id", F.array_join(tools.argument_errors(args, rules), "; ").alias("errors"))


# ------------------------------------------------------------------ files


def _files(spark: SparkSession, d: str) -> str:
    """A folder with a text file for each nation."""
    path = scratch(spark)
    table(spark, d, "nation", "n_nationkey", "n_name").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    return path


@query("SELECT n_name || chr(10) AS text FROM nation")
def text_folder(spark: SparkSession, d: str) -> DataFrame:
    """Every text file below a folder, one row a file."""
    return readers.text_folder(spark, _files(spark, d)).select("text")


@query("SELECT n_name || chr(10) AS text FROM nation WHERE n_nationkey < 7")
def text_folder_first(spark: SparkSession, d: str) -> DataFrame:
    """The first files by path."""
    folder = _files(spark, d)
    one = [readers.text_file(spark, f"{folder}/n_nationkey={i}").select("text") for i in range(7)]
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out


@query("SELECT memory_id, key, value, importance, ttl, CAST(epoch_us(created_at) AS BIGINT) AS created, array_to_string(tags, ',') AS tags FROM memory_entries")
def memory_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Memories written as JSON lines and read again."""
    rows, path = table(spark, d, "memory_entries"), scratch(spark)
    readers.export_memories(rows, path)
    back = readers.import_memories(spark, path, rows.schema)
    return back.select("memory_id", "key", "value", "importance", "ttl", F.unix_micros("created_at").alias("created"), F.array_join("tags", ",").alias("tags"))
