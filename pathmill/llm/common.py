"""What the operators of this subpackage share: shared storage, lineage cuts, columns."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathmill.lineage import cut, new_dir, remove  # noqa: F401

#: Fixed values of the contracts: ASCII white space that separates words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that tasks can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_pathmill_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="pathmill-"), "pathmill.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("pathmill", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._pathmill_shipped = True


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null; without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(rows: DataFrame, order: list[Column], name: str, value: Column | None = None) -> DataFrame:
    """The rows with `name`: what the rows before them in `order` add up to (their number, without a value).

    The order must be total but for rows that are equal throughout. Rows are range-sorted and added up per task; the
    tasks' totals, a row each, are added up in turn. No task sees more than its range.
    """
    value = F.lit(1).cast("long") if value is None else value
    keys = [f"_order{k}" for k in range(len(order))]
    keyed = rows.select("*", *[c.alias(k) for c, k in zip(order, keys)], value.alias("_value"))
    ordered = cut(keyed.repartitionByRange(*keys).withColumn("_task", F.spark_partition_id()))
    tasks = Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    before = ordered.groupBy("_task").agg(F.sum("_value").alias("_sum")).select("_task", F.coalesce(F.sum("_sum").over(tasks), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_task").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    added = ordered.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(F.broadcast(before), "_task")
    return added.withColumn(name, F.col("_before") + F.col("_inside")).drop("_task", "_value", "_inside", "_before", *keys)
