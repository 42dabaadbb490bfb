"""Sinks: CSV with fixed columns, JSON, flattened exports, document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_postings_csv(rows: DataFrame, path: str, columns: list[str], append: bool = False, separator: str = "|") -> None:
    """Columns in a fixed order; arrays are joined by the separator."""
    arrays = {name for name, kind in rows.dtypes if kind.startswith("array")}
    flat = rows.select(*[F.array_join(c, separator).alias(c) if c in arrays else F.col(c) for c in columns])
    flat.write.mode("append" if append else "overwrite").csv(path, header=True, escape='"')


def write_postings_json(rows: DataFrame, path: str) -> None:
    """Whole nested records, timestamps in ISO form."""
    rows.write.mode("overwrite").json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def flattened(rows: DataFrame, extra: str = "extra", keep: list[str] | None = None, separator: str = ", ") -> DataFrame:
    """Fields of the nested column lifted to the top (only those to keep), arrays joined."""
    names = rows.schema[extra].dataType.names
    lifted = [F.col(f"{extra}.{n}").alias(n) for n in names if keep is None or n in keep]
    top = [F.array_join(n, separator).alias(n) if kind.startswith("array") else F.col(n) for n, kind in rows.dtypes if n != extra]
    return rows.select(*top, *lifted)


def write_documents(rows: DataFrame, path: str) -> None:
    """doc_path, text, partitioned by doc_type."""
    rows.select("doc_type", "doc_path", "text").write.mode("overwrite").partitionBy("doc_type").parquet(path)
