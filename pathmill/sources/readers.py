"""Scans: JSON arrays, CSV, text folders, XML feeds, snapshots, catalogs with checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def read_json_arrays(spark: SparkSession, paths: str | Sequence[str], schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Records of files that hold an array of objects each, and (path, text) of the files that do not."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    parsed = files.withColumn("records", F.when(F.ltrim("text").startswith("["), F.from_json("text", ArrayType(schema), {"mode": "PERMISSIVE"})))
    good = parsed.where("records is not null").select(F.explode("records").alias("r")).select("r.*")
    return good, parsed.where("records is null").select("path", "text")


def matching_files(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """The files that patterns and plain paths name, each once, sorted; patterns may overlap, and one may match nothing."""
    from pyspark.errors import AnalysisException

    found: set[str] = set()
    for pattern in patterns:
        try:
            found.update(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).inputFiles())
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return sorted(found)


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType) -> DataFrame:
    """CSV with a header, quoted line ends allowed; a byte order mark before the first name does not matter."""
    return spark.read.schema(schema).csv(paths, header=True, multiLine=True, escape='"', enforceSchema=True)


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """path, name, text: one row per file of a folder tree, without byte order marks."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.regexp_replace("value", "^﻿", "").alias("text"))


def list_documents(spark: SparkSession, path: str, keyword: str | None = None, folders: dict[str, Sequence[str]] | None = None, pattern: str = "*.txt") -> DataFrame:
    """name, size, changed and the folder columns (as in doc_type=...) of the files of a folder tree, none of them opened.

    `keyword` is contained in the name; `folders` names the values that a folder column may have. Both reach the file
    listing: other folders and files are no part of the scan.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    found = files.select(F.col("_metadata.file_name").alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"), *[c for c in files.columns if c not in ("path", "modificationTime", "length", "content")])
    return _asked(found, "name", keyword, folders)


def read_documents(spark: SparkSession, path: str, keyword: str | None = None, folders: dict[str, Sequence[str]] | None = None, fields: Sequence[str] | None = None, page: int = 0, page_size: int | None = None, pattern: str = "*.txt") -> DataFrame:
    """The documents of a folder tree as name, text and folder columns, or the `fields` of these, in order of names.

    Only files whose folder and name are asked for are opened. With `page_size` the page is cut out of the listing first,
    so that no more than its files are opened: the listing, not the texts, is sorted.
    """
    texts = spark.read.text(path, wholetext=True, pathGlobFilter=pattern)
    rows = texts.select(F.col("_metadata.file_name").alias("name"), F.regexp_replace("value", "^\ufeff", "").alias("text"), *[c for c in texts.columns if c != "value"])
    asked = _asked(rows, "name", keyword, folders)
    if page_size is not None:
        listed = list_documents(spark, path, keyword, folders, pattern).select("name").orderBy("name").offset(page * page_size).limit(page_size)
        names = [r["name"] for r in listed.collect()]  # one page
        asked = asked.where(F.col("name").isin(names)) if names else asked.limit(0)
    return asked.select(*(fields or asked.columns)) if page_size is None else asked.orderBy("name").select(*(fields or asked.columns))


def _asked(rows: DataFrame, name: str, keyword: str | None, folders: dict[str, Sequence[str]] | None) -> DataFrame:
    for column, values in (folders or {}).items():
        rows = rows.where(F.col(column).isin(list(values)))
    return rows if keyword is None else rows.where(F.contains(F.col(name), F.lit(keyword)))


def read_job_feed(spark: SparkSession, path: str, schema: StructType, keyword: str, row_tag: str = "job", other: str = "기타") -> DataFrame:
    """Postings of an XML feed: id from the job code, else from the id; without either left out; category "other" becomes the keyword."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    identifier = F.coalesce(F.nullif(F.trim("job_code"), F.lit("")), F.nullif(F.trim("id"), F.lit("")))
    named = rows.withColumn("source_id", identifier).where("source_id is not null")
    return named.withColumn("category", F.when(F.coalesce("category", F.lit(other)) == other, F.lit(keyword)).otherwise(F.col("category")))


def latest_snapshot(rows: DataFrame, at: str) -> DataFrame:
    """Rows of the newest snapshot; on a table partitioned by `at` only its files are read."""
    newest = rows.agg(F.max(at)).first()[0]
    return rows.where(F.col(at) == F.lit(newest)) if newest is not None else rows.limit(0)


def checked(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with `broken`, the names of the rules they break."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    judged = rows.withColumn("broken", broken)
    return judged.where(F.size("broken") == 0).drop("broken"), judged.where(F.size("broken") > 0)


def with_vectors(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """rows with `meta_vector` by key, empty where there is none."""
    return rows.join(vectors.select(key, "meta_vector"), key, "left").withColumn("meta_vector", F.coalesce("meta_vector", F.array().cast("array<double>")))
