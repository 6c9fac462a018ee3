"""Sources and sinks beside parquet: texts in folders, JSON lines, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_folder(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """path and text of every ``*.txt`` file below a folder, one row a file; ``first`` keeps the first by path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    rows = files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.orderBy("path").limit(first) if first else rows


def text_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema, so that reading takes one pass."""
    return spark.read.schema(schema).json(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_memories(memories: DataFrame, path: str) -> None:
    """Memories as JSON lines; vectors, times and lifetimes included, so that an import gives them back."""
    memories.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def import_memories(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


# ------------------------------------------------------------------ documents and reports

_TARGET = "provider string, model string, request_count bigint, success_rate double, avg_latency_ms double, p95_latency_ms double, total_cost double, throughput double"
_METRICS = f"global struct<total_requests:bigint,total_successes:bigint,total_errors:bigint,success_rate:double,total_cost:double>, aggregations array<struct<{_TARGET.replace(' ', ':').replace(',:', ',')}>>, exported_at string"
_LATENCY = ("low", "mean", "median", "p90", "p95", "p99", "high", "stddev")
_LATENCY_NAMES = ("min_ms", "mean_ms", "median_ms", "p90_ms", "p95_ms", "p99_ms", "max_ms", "stddev_ms")
_RESULT = f"config struct<name:string,num_requests:bigint>, results struct<total_requests:bigint,successful:bigint,failed:bigint,success_rate:double,throughput_rps:double,latency:struct<{','.join(f'{n}:double' for n in _LATENCY_NAMES)}>,cost_per_request:double,tokens_per_request:double,errors_count:bigint>"


def metrics_document(by_target: DataFrame, exported_at: Column) -> DataFrame:
    """One row, ``json``: totals, the figures of every target (a row a target) and the time of the export."""
    names = dict(zip([f.split()[0] for f in _TARGET.split(", ")], ("provider", "model", "requests", "success_rate", "avg_latency", "p95", "cost", "throughput")))
    each = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
    n, ok = F.sum("requests"), F.sum("succeeded")
    whole = F.struct(
        n.alias("total_requests"), ok.alias("total_successes"), (n - ok).alias("total_errors"), F.when(n > 0, ok / n).otherwise(F.lit(0.0)).alias("success_rate"), F.round(F.sum("cost"), 6).alias("total_cost")
    )
    doc = by_target.agg(whole.alias("global"), F.sort_array(F.collect_list(each)).alias("aggregations")).withColumn("exported_at", exported_at)
    return as_json(doc)


def read_metrics_document(doc: DataFrame) -> DataFrame:
    """A row a target with the document's totals and time."""
    x = doc.select(F.from_json("json", _METRICS).alias("x")).select("x.*").select("global", "exported_at", F.explode("aggregations").alias("a"))
    return x.select(
        "a.provider", "a.model", "a.request_count", "a.success_rate", "a.avg_latency_ms", "a.p95_latency_ms", "a.total_cost", "global.total_requests", "global.total_successes", F.col("global.total_cost").alias("global_cost"), "exported_at"
    )


def benchmark_documents(summary: DataFrame, latency: DataFrame, by: str) -> DataFrame:
    """A JSON document a configuration: its name and size, its counts, rates, latencies, cost and tokens."""
    both = summary.join(latency.withColumnRenamed("n", "measured"), by, "left")
    stats = F.struct(*[F.col(c).alias(n) for c, n in zip(_LATENCY, _LATENCY_NAMES)]).alias("latency")
    bad = F.col("requests") - F.col("succeeded")
    results = F.struct(
        F.col("requests").alias("total_requests"), F.col("succeeded").alias("successful"), bad.alias("failed"), "success_rate", F.col("rps").alias("throughput_rps"), stats, F.col("cost_per_success").alias("cost_per_request"),
        F.col("tokens_per_success").alias("tokens_per_request"), bad.alias("errors_count"),
    )
    return as_json(both.select(F.struct(F.col(by).alias("name"), F.col("requests").alias("num_requests")).alias("config"), results.alias("results")))


def read_benchmark_documents(docs: DataFrame) -> DataFrame:
    x = docs.select(F.from_json("json", _RESULT).alias("x")).select("x.*")
    r = [F.col(f"results.{c}") for c in ("total_requests", "successful", "failed", "success_rate", "throughput_rps", "latency.mean_ms", "latency.p95_ms", "cost_per_request", "errors_count")]
    return x.select("config.name", *r)


def compare_report(summary: DataFrame, latency: DataFrame, by: str) -> DataFrame:
    """A text report, a head and a line a configuration, in their order: line_no, line. Configurations are few."""
    rows = summary.join(latency.withColumnRenamed("n", "measured"), by)
    cell = lambda c, places: F.round(c + 1e-9, places)
    line = F.format_string("%-20s %7.1f%% %9.0fms %9.0fms %7.1f", by, cell(F.col("success_rate") * 100, 1), cell(F.col("mean"), 0), cell(F.col("p95"), 0), cell(F.col("rps"), 1))
    body = rows.select(F.row_number().over(Window.orderBy(by)).alias("line_no"), line.alias("line"))  # a row a configuration
    head = rows.sparkSession.range(1).select(F.lit(0).alias("line_no"), F.format_string("%-20s %8s %11s %11s %7s", *map(F.lit, ("Name", "Success", "Mean Lat", "P95 Lat", "RPS"))).alias("line"))
    return head.unionByName(body)
