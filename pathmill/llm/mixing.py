"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathmill.llm.common import cut, n_words, running

#: A source's documents are dealt into 16 shards, 256, ... so that a shard has about so many documents at most.
SHARD_ROWS = 1024
MOST_DIGITS = 8


def apportion(parties: DataFrame, keys: list[str], votes: str, seats: Column, name: str = "quota") -> DataFrame:
    """Sainte-Lague seats per row of `parties` within each group of `keys` (an empty list: one group).

    `seats` is the group's number of seats. Highest quotients votes / (2k + 1) win; ties go to the smaller `party`.
    Rounding votes times seats over all votes gives a start that is off by e seats in all. With another divisor each of
    the n parties moves by its share of the change, give or take one, so a party's seats are within share * (|e| + n) + 1
    of its start; only these quotients are ranked, about 3n of them.
    """
    if keys:
        sums = parties.groupBy(*keys).agg(F.sum(F.col(votes).cast("decimal(38,6)")).cast("double").alias("_total"), F.count(F.lit(1)).alias("_n"), F.max(seats).alias("_seats"))
    else:
        sums = parties.agg(F.sum(F.col(votes).cast("decimal(38,6)")).cast("double").alias("_total"), F.count(F.lit(1)).alias("_n"), F.max(seats).alias("_seats"))
        one = sums.first()  # three numbers
        sums = None
    if sums is None:
        started = parties.withColumns({"_total": F.lit(one["_total"]).cast("double"), "_n": F.lit(one["_n"]), "_seats": F.lit(one["_seats"]).cast("long")})
    else:
        started = parties.join(sums, keys)
    share = F.coalesce(F.try_divide(F.col(votes), F.col("_total")), F.lit(0.0))
    started = cut(started.withColumn("_share", share).withColumn("_start", F.floor(F.col("_share") * F.col("_seats") + F.lit(0.5)).cast("long")))

    def with_rest(rows: DataFrame, column: str, rest: str) -> DataFrame:
        """What the seats leave after the sum of a column, per group."""
        if keys:
            return rows.join(rows.groupBy(*keys).agg((F.max("_seats") - F.sum(column)).alias(rest)), keys)
        return rows.withColumn(rest, F.lit(rows.agg((F.max("_seats") - F.sum(column)).alias("rest")).first()["rest"]).cast("long"))

    off = with_rest(started, "_start", "_e")
    reach = F.floor(F.col("_share") * (F.abs("_e") + F.col("_n"))).cast("long") + 1
    based = off.withColumn("_reach", reach).withColumn("_base", F.when(F.col("_e") < 0, F.greatest(F.lit(0).cast("long"), F.col("_start") - F.col("_reach"))).otherwise(F.col("_start")))
    # seats below the base are safe; the rest of the seats go by rank among the quotients next to it
    rest = cut(with_rest(based, "_base", "_rest"))
    open_seats = rest.where(F.col(votes) > 0).select(*keys, "party", "_rest", votes, F.explode(F.sequence(F.col("_base"), F.col("_base") + F.col("_reach"))).alias("_k"))
    open_seats = open_seats.withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
    placed = running(open_seats, [*map(F.col, keys), -F.col("_q"), F.col("party"), F.col("_k")], "_place")
    if keys:
        # places are counted over all groups; a group's begin with its least
        placed = cut(placed)
        placed = placed.join(placed.groupBy(*keys).agg(F.min("_place").alias("_first")), keys).withColumn("_place", F.col("_place") - F.col("_first"))
    won = placed
    names = [*keys, "party"]
    extra = won.where(F.col("_place") < F.col("_rest")).groupBy(*names).agg(F.count(F.lit(1)).alias("_extra"))
    return rest.join(extra, names, "left").select(*parties.columns, (F.col("_base") + F.coalesce("_extra", F.lit(0))).alias(name))


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """source, rank, source_size, source_rows, target of sources with `size`: weights 1, 2, 3, repeating by code point, null last.

    Sources share the sum of all sizes by weight; a target stops at `cap` times its source's size and the excess is
    shared again by weight until none is above. Each round stops the sources above; only sums come to the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    ranked = cut(running(sources, [F.col("source").isNull(), F.col("source")], "rank").withColumn("weight", F.col("rank") % 3 + 1).withColumn("most", F.col("source_size") * F.lit(cap)))
    level = 0.0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("most")
        sums = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("most")).otherwise(0.0)).alias("stopped"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weights")).first()
        # the level only rises, so what is above it stays above
        found = (sums["all"] - sums["stopped"]) / sums["weights"] if sums["weights"] else level
        if found <= level:
            break
        level = found
    return ranked.select("source", "rank", "source_size", "source_rows", F.least("most", F.col("weight") * F.lit(level)).cast("double").alias("target"))


def shard_digits(rows: Column) -> Column:
    """Hexadecimal digits of the hash that name a shard, by the source's number of documents."""
    digits = F.lit(MOST_DIGITS)
    for d in range(MOST_DIGITS - 1, 0, -1):
        digits = F.when(rows <= SHARD_ROWS * 16**d, F.lit(d)).otherwise(digits)
    return digits


def mix_sources(docs: DataFrame, seed: int = 17, block_words: int = 32, cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id_col, size, source_size, target, taken, and the columns that `carry` names.

    Words are dealt in blocks of `block_words`. Sainte-Lague gives each source its number of blocks from the targets,
    then each shard of a source (by a seeded MD5 of id and text, so rows with null ids or one id are spread; the more documents, the more shards) its number of blocks
    from the shard's words. Inside a shard the documents stand in seeded order, repeated as often as needed, and are cut
    into blocks; the shard's quota of blocks is taken in this seeded order, so a document's take is its words per full
    pass plus its overlap with the last, partial pass. No document exceeds `cap` times its size. Everything is a function
    of the rows, so reruns agree. Null ids and rows that repeat an id are documents of their own, ordered by size after
    the hash; a null source is a source, the last. Among those of one size the columns of `carry` decide, so that a
    caller who carries a row's identity has the take of each row. Texts without words take 0. An empty table gives an
    empty result; other columns are ignored.
    """
    carried = [f"_carry{k}" for k in range(len(carry))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("hash"), *[F.col(c).alias(name) for c, name in zip(carry, carried)])
    rows = cut(rows.withColumn("hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("null")), "hash"))))
    targets = cut(source_targets(rows, float(cap)).withColumn("party", F.col("rank")))
    whole = targets.agg(F.sum("source_size")).first()[0] or 0
    by_source = cut(apportion(targets, [], "target", F.lit(whole // block_words), "blocks"))
    named = by_source.select(F.col("source").alias("_source"), "rank", "source_size", "target", "blocks", shard_digits(F.col("source_rows")).alias("_digits"))
    placed = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.expr("substring(hash, 1, _digits)")).drop("_source", "_digits")
    shards = placed.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks")).withColumn("party", F.col("shard"))
    quotas = apportion(shards, ["rank"], "shard_size", F.col("blocks"), "quota")
    quotas = quotas.select("rank", "shard", "shard_size", F.least(F.col("quota") * block_words, F.col("shard_size") * cap).alias("words"))
    stream = Window.partitionBy("rank", "shard").orderBy("hash", "id", "size", *carried).rowsBetween(Window.unboundedPreceding, -1)
    started = placed.join(quotas, ["rank", "shard"]).withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    full = F.coalesce(F.floor(F.try_divide(F.col("words"), F.col("shard_size"))), F.lit(0))
    last = F.col("words") - F.col("full") * F.col("shard_size")
    taken = F.col("full") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), last - F.col("start")))
    return started.withColumn("full", full).select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(name).alias(c) for c, name in zip(carry, carried)])
