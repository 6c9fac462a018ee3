"""Session, tables and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(master: str = "local[8]", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session for tests and the bench, with a checkpoint folder of this machine. On a cluster the caller's own session is used."""
    return (
        SparkSession.builder.master(master)
        .appName("tidewright")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", os.environ.get("CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="tidewright-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one parquet table; naming columns keeps the scan's schema narrow."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the session is one machine's, as
    in tests, a local folder is made; on a cluster a missing setting is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidewright-"))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new path for files of a run, in the folder that all executors share (see :func:`durable`)."""
    durable(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"


def few(df: DataFrame, rows: int = 1_000_000) -> bool:
    """Whether a side has at most so many rows, counted: then it may be broadcast; a larger one is left to the planner."""
    return df.limit(rows + 1).count() <= rows


def widen(scan: DataFrame) -> DataFrame:
    """A scan for stages whose CPU work is large next to their bytes: split as it is read, spread only where it has fewer splits than cores.

    So large tables never shuffle their texts; their splits follow ``spark.sql.files.maxPartitionBytes``.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan._jdf.queryExecution().toRdd().getNumPartitions()  # planned, not run
    return scan if splits >= cores else scan.repartition(cores)


def first(rows: DataFrame, by: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in an order, numbered from 0.

    The number is compared as the window gives it, so that the optimizer cuts groups before and after the shuffle
    (WindowGroupLimit) instead of sorting all their rows.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).withColumn(rank, F.col(rank) - 1)


def tidy(name: str | Column) -> Column:
    """A double with -0.0 folded into 0.0; NaN and null become null."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(~F.isnan(c), c.cast("double") + F.lit(0.0))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context: workers import the functions that tasks call."""
    context = spark.sparkContext
    if getattr(context, "_tidewright_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidewright-"), f"{package.name}.zip")  # the driver serves it from here
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tidewright_shipped = True
