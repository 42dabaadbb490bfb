"""Session defaults and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in (DEFAULTS | more).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task where joins and groups hold a task's rows in memory.
TASK_ROWS = 250_000


def parts_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks that the rows of a table are dealt to, so that a task's memory does not grow with the table.

    Adaptive execution joins shuffled parts up to 64 MB as they are compressed, which are many times that in a task. The
    rows are counted from the files' footers.
    """
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // TASK_ROWS))
