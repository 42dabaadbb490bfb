"""Lines that many documents share: explode, hash, count documents, drop, reassemble."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmill.llm.common import SPACE, cut


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def _hashed(key: Column) -> Column:
    """128 bits of the key: two 64-bit hashes of different seeds."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_lines, n_dropped, kept_text.

    A key of at least `min_chars` code points found in at least `min_docs` rows loses its lines everywhere; a key
    counts once per row. Null and empty texts are one empty line. Keys are exploded, hashed to 128 bits and counted
    with partial aggregation, so a line that every document holds costs one row per task; only the positions of frequent
    keys go on to be collected per document, and a document is put together again from what stands between them. Rows
    that repeat an id are separate documents. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the text's hash tells rows apart that repeat an id; rows that are the same throughout have the same positions
    named = docs.select(F.col(id_col).alias("id"), text.alias("body"), F.xxhash64(text).alias("hash"))
    hashed = F.transform(F.transform(F.split("body", "\n", -1), line_key), lambda k: F.when(F.length(k) >= min_chars, _hashed(k)))
    keys = named.select(F.explode(F.array_distinct(F.filter(hashed, lambda k: k.isNotNull()))).alias("key")).select("key.a", "key.b")
    # kept as a table, so that both sides of the join below are shuffles of their own and a hot line's rows can be split
    frequent = cut(keys.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("a", "b"))
    lines = named.select("id", "hash", F.posexplode(hashed).alias("pos", "key")).where("key is not null").select("id", "hash", "pos", "key.a", "key.b")
    drops = lines.join(frequent, ["a", "b"], "left_semi").groupBy("id", "hash").agg(F.array_sort(F.collect_set("pos")).alias("drops"))
    found = named.join(drops.toDF("_id", "_hash", "drops"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    # lines from after each dropped one up to the next; positions are from 0, slices from 1
    none = F.array().cast("array<int>")
    dropped = F.coalesce("drops", none)
    begins = F.concat(F.array(F.lit(1)), F.transform(dropped, lambda p: p + 2))
    ends = F.concat(dropped, F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(F.col("lines"), b, F.greatest(e - b + 1, F.lit(0)))))
    return found.withColumn("lines", F.split("body", "\n", -1)).select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(dropped).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept_text"),
    )
