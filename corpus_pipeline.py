"""From documents to packed training sequences: five stages, each a table that the next one reads.

All stages decide row by row, whatever the ids are: null ids, repeated ids and rows that are the same throughout. They read
the columns of documents alone, so other columns, whatever their names, are ignored. An empty table gives an empty result.
Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmill.llm.common import new_dir
from pathmill.llm.exact_dedup import exact_duplicates
from pathmill.llm.language_id import fit, identify_languages
from pathmill.llm.mixing import mix_sources
from pathmill.llm.ngram_join import near_duplicates
from pathmill.llm.packing import pack_documents

#: The columns of documents, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays when the words of one language make up this share of it at least.
MIN_LANGUAGE_SHARE = 0.5


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with `row`, a 64-bit hash of the values of all columns; ids may be null or repeated.

    Only rows that are the same in every column share it, so whichever of them stays, the result is the same. That no
    other two rows share it is checked by a second hash; where they do, the next seed is taken.
    """
    values = [*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]]  # a hash passes over nulls
    for seed in range(16):
        rows = docs.select(*COLUMNS, F.xxhash64(F.lit(seed), *values).alias("row"))
        second = rows.select("row", F.xxhash64(F.lit(-1 - seed), *values).alias("second"))
        if second.groupBy("row").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).where("lo <> hi").isEmpty():
            return rows
    raise RuntimeError("no seed gives different rows different hashes")


def _first(rows: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Of each group of groups (row, group) one document, the one with the smallest id, null last, ties by `row`."""
    ids = rows.select("row", "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    least = groups.distinct().join(ids, "row").groupBy(group).agg(F.min(order).alias("least")).select(F.col("least.row").alias("row"))
    return rows.dropDuplicates(["row"]).join(least, "row", "left_semi").select(*COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null texts too) and those in no language for the most part.

    A share of exactly MIN_LANGUAGE_SHARE stays; rows that are the same stay or go together; labels are only trained on,
    and where no row has one all documents go.
    """
    rows = _keyed(docs)
    found = identify_languages(rows, model=fit(rows), id_col="row").where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return rows.join(found.select("row"), "row", "left_semi").select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the smallest id.

    A null id counts as the largest; ties of one id go by a hash of the row; null and empty texts are equal.
    """
    rows = _keyed(docs)
    return _first(rows, exact_duplicates(rows, keep="min", id_col="row").select("row", "keep_id"), "keep_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Ids and ties as in drop_exact_copies; texts without words are near copies of nothing but equal texts.
    """
    rows = _keyed(docs)
    return _first(rows, near_duplicates(rows, id_col="row").select("row", "class_id"), "class_id")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number: from none to three times.

    Halves are rounded up. Rows that are the same come as often as they are due together; a null source is a source;
    texts without words are never taken.
    """
    rows = _keyed(docs)
    taken = mix_sources(rows, carry=("row",)).select("row", F.expr("cast(floor(try_divide(taken, size) + 0.5) as int)").alias("copies")).where("copies > 0")
    copies = taken.groupBy("row").agg(F.sum("copies").alias("copies"))
    return rows.dropDuplicates(["row"]).join(copies, "row").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed training sequences: one row per piece of a document, and of each of its copies; a null text is its end mark."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language id", keep_languages),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: The stages use tokenisation and a trained model, which SQL cannot express; tests hold them against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
