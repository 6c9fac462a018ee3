"""Small tools as functions: parsing agent replies, safe arithmetic, search over a tool list, function registry."""

from __future__ import annotations

import ast
import math
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.text import search_tokens

_OPS = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow,
    ast.USub: operator.neg, ast.UAdd: operator.pos,
}
_NAMES = {n: getattr(math, n) for n in "sqrt sin cos tan log log10 exp pi e floor ceil".split()} | {"abs": abs, "round": round, "min": min, "max": max, "pow": pow}


def _value(node: ast.AST):
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return node.value
    if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
        a, b = _value(node.left), _value(node.right)
        if isinstance(node.op, ast.Pow) and abs(b) > 1000:
            raise ValueError("exponent too large")
        return _OPS[type(node.op)](a, b)
    if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
        return _OPS[type(node.op)](_value(node.operand))
    if isinstance(node, ast.Name) and node.id in _NAMES:
        return _NAMES[node.id]
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and callable(_NAMES.get(node.func.id)) and not node.keywords:
        return _NAMES[node.func.id](*map(_value, node.args))
    raise ValueError("unsupported expression")


def calculate(expression: str | None) -> str | None:
    """Arithmetic on numbers and a few functions, read as a syntax tree; anything else gives ``Error: ...``."""
    if expression is None:
        return None
    try:
        return str(_value(ast.parse(expression, mode="eval").body))
    except Exception as e:  # noqa: BLE001 - the tool's answer is the error
        return f"Error: {e}"


@F.pandas_udf(T.StringType())
def calculator(expression: pd.Series) -> pd.Series:
    return expression.map(calculate)


def react(reply: Column) -> Column:
    """thought, action, action_input and final_answer of an agent's reply; null where a part is missing."""
    part = lambda p: F.nullif(F.trim(F.regexp_extract(reply, p, 1)), F.lit(""))
    return F.struct(
        part(r"(?s)Thought:\s*(.*?)(?:\nAction:|\nFinal Answer:|\z)").alias("thought"),
        part(r"Action:[ \t]*([^\n]*)").alias("action"),
        part(r"(?s)Action Input:\s*(.*?)(?:\nObservation:|\nThought:|\nFinal Answer:|\z)").alias("action_input"),
        part(r"(?s)Final Answer:\s*(.*)").alias("final_answer"),
    )


def simulated_search(queries: DataFrame, n: int = 5) -> DataFrame:
    """query_id, rank, title, relevance: what a web search would give, made up: n results that lose a tenth of relevance each."""
    each = queries.select("query_id", F.coalesce("query", F.lit("")).alias("query"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rank"))
    title = F.concat(F.lit("Result "), (F.col("rank") + 1).cast("string"), F.lit(" for: "), F.col("query"))
    return each.select("query_id", "rank", title.alias("title"), F.round(F.greatest(F.lit(0.0), 1 - 0.1 * F.col("rank")), 6).alias("relevance"))


def current_time(hours: Column, as_of: Column | None = None) -> Column:
    """Now (or ``as_of``) plus some hours, in ISO form; the label stays that of UTC."""
    now = F.current_timestamp() if as_of is None else as_of
    return F.date_format(F.timestamp_micros(F.unix_micros(now) + hours.cast("bigint") * 3_600_000_000), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


@dataclass(frozen=True)
class Param:
    """What a tool asks of one argument."""

    name: str
    required: bool = False
    number: bool = False
    one_of: tuple[str, ...] = ()


def argument_errors(args: Column, params: list[Param]) -> Column:
    """What is wrong with a call's arguments (a map of strings), in the order of the parameters; nothing for a sound call.

    Numbers may come as strings; arguments that no parameter names are let through.
    """
    out = []
    for p in params:
        x = F.try_element_at(args, F.lit(p.name))
        wrong = F.when(x.isNull(), F.lit(f"missing: {p.name}") if p.required else F.lit(None))
        if p.number:
            wrong = wrong.when(x.isNotNull() & x.try_cast("double").isNull(), F.lit(f"no number: {p.name}"))
        if p.one_of:
            wrong = wrong.when(x.isNotNull() & ~x.isin(*p.one_of), F.lit(f"not one of: {p.name}"))
        out.append(wrong)
    return F.filter(F.array(*out), lambda e: e.isNotNull())


def execution_stats(calls: DataFrame, by: str) -> DataFrame:
    """Calls, successes and failures (column ``ok``) of each tool, and two rates.

    ``counted_rate`` is over calls as they are counted, which is on success only; ``success_rate`` over all.
    """
    good = F.sum(F.when(F.col("ok"), 1).otherwise(0)).cast("bigint")
    return calls.groupBy(by).agg(F.count("*").alias("calls"), good.alias("successes"), (F.count("*") - good).alias("failures")).select(
        "*", F.when(F.col("successes") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("counted_rate"), F.round(F.col("successes") / F.col("calls"), 6).alias("success_rate")
    )


def search_tools(tools: DataFrame, text: str | None = None, tag: str | None = None, category: str | None = None) -> DataFrame:
    """Tools whose name or description has the text (in any case), that carry the tag and are of the category."""
    out = tools
    if text:
        out = out.where(F.lower("name").contains(text.lower()) | F.lower("description").contains(text.lower()))
    if tag:
        out = out.where(F.array_contains("tags", tag))
    return out.where(F.col("category") == category) if category else out


def best_agent(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """task_id, agent, shared: the agent whose description shares most words with the task, the first of equals; null without any.

    ``agents`` (position, agent, description) is a short list.
    """
    words = tasks.select("task_id", F.explode_outer(F.array_distinct(search_tokens("task"))).alias("word"))
    own = agents.select("position", "agent", F.explode(F.array_distinct(search_tokens("description"))).alias("word"))
    hits = words.join(own, "word").groupBy("task_id", "agent", "position").agg(F.count("*").alias("shared"))
    w = Window.partitionBy("task_id").orderBy(F.col("shared").desc(), "position")
    first = hits.withColumn("n", F.row_number().over(w)).where("n = 1").select("task_id", "agent", "shared")
    return tasks.select("task_id").join(first, "task_id", "left").select("task_id", "agent", F.coalesce("shared", F.lit(0)).alias("shared"))


def step_totals(runs: DataFrame) -> DataFrame:
    """Per run: number of steps, tokens of all steps, actions taken; zeros for a run without steps."""
    steps = F.coalesce("steps", F.array().cast(dict(runs.dtypes)["steps"]))
    return runs.select(
        "run_id", F.size(steps).alias("n_steps"), F.aggregate(F.transform(steps, lambda s: F.coalesce(s["tokens_used"], F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("tokens"),
        F.size(F.filter(steps, lambda s: s["action"].isNotNull())).alias("actions"),
    )


_FUNCTIONS: dict[str, tuple[Callable, str]] = {"calculator": (calculate, "string")}
_TYPES = {"string": "string", "number": "double", "integer": "bigint", "boolean": "boolean", "array": "array<string>", "object": "map<string,string>"}


def tool(name: str, returns: str = "string") -> Callable[[Callable], Callable]:
    """Decorator: keep a Python function under a name, with the JSON type of its result."""
    if returns not in _TYPES:
        raise ValueError(f"unknown type: {returns}")

    def keep(f: Callable) -> Callable:
        _FUNCTIONS[name] = (f, _TYPES[returns])
        return f

    return keep


def register_all(spark: SparkSession) -> list[str]:
    """Make the kept functions callable from SQL, batched by Arrow."""
    for name, (f, kind) in _FUNCTIONS.items():
        spark.udf.register(name, F.pandas_udf(lambda x, f=f: x.map(f), kind))
    return sorted(_FUNCTIONS)


def apply_batched(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The seam for models and services: a function of one pandas batch, such as an embedder or a cross-encoder."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield f(pdf)

    return df.mapInPandas(run, schema)
