"""Quality rules whose thresholds come from mergeable quantile sketches per language and source; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathmill.llm.common import SPACE, cut

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Relative width of a sketch bucket: a quantile is known to within this factor.
GAMMA = 1.05
#: Features and the fence of each: a threshold stands so many inter-quartile ranges above the median, counted in buckets
#: and so on a log scale. A feature is a rate, one event added to both of its counts: zeros then differ by the text's
#: length, so quartiles of a rare event do not coincide, and one event in a short text is nothing unusual.
FENCES = {"symbols": 3, "dup_lines": 5, "repeats": 5, "word_length": 4}
COUNTS = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
#: How many rows the merged sketch counts for beside a group's own: of all rows beside a language, of it beside a source.
PRIOR_ROWS = 100


def base_counts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """id and per-text counts: n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words.

    All inside the row: words are split once, 3-word windows become 64-bit hashes, and only texts whose windows are not
    all different sort them to find the words covered by repeated ones. Null texts count 0 everywhere.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    split = docs.select(
        F.col(id_col).alias("id"),
        *more,
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).alias("words"),
    )
    n = F.size("words")
    pairs = F.zip_with("words", F.slice("words", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    triples = F.zip_with(pairs, F.slice("words", 3, F.greatest(n - 2, F.lit(0))), lambda h, c: F.xxhash64(h, c))
    hashed = split.select(
        "id",
        *more,
        "word_chars",
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.slice(triples, 1, F.greatest(n - 2, F.lit(0))).alias("triples"),
    )
    repeated = F.size("triples") > F.size(F.array_distinct("triples"))
    placed = hashed.withColumn("placed", F.when(repeated, F.array_sort(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    cover = F.zip_with(
        "placed",
        F.slice("placed", 2, F.greatest(F.size("placed") - 1, F.lit(0))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(*[x["i"] + k for x in (a, b) for k in range(3)])),
    )
    return placed.withColumn("n_repeat_words", F.when(F.col("placed").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(F.filter(cover, lambda x: x.isNotNull()))))).cast("long")).drop("triples", "placed")


def bucket(part: str, whole: str) -> Column:
    """Log bucket of the rate per million, one added to both counts."""
    rate = F.floor(F.lit(1_000_000) * (F.col(part) + 1) / (F.col(whole) + 1))
    return F.floor(F.log(F.greatest(rate, F.lit(1)).cast("double")) / F.lit(math.log(GAMMA))).cast("int")


def sketches(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket counts per group and feature. Two sketches merge by adding counts, so any partial sums give the same sketch."""
    each = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(name).alias("bucket")) for name in FENCES])
    return counts.select(*keys, F.explode(each).alias("x")).groupBy(*keys, "x.feature", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group `rows` and a struct `limits` with each feature's highest bucket that stays.

    It is the median's bucket plus the fence times the distance of the quartiles, which is a bucket at least, as the
    sketch knows no less. A quantile is the first bucket that has its share of the rows.
    """
    group = Window.partitionBy(*keys, "feature")
    ranked = sketch.withColumn("below", F.sum("n").over(group.orderBy("bucket"))).withColumn("rows", F.sum("n").over(group))
    quartile = {k: F.min(F.when(4 * F.col("below") >= k * F.col("rows"), F.col("bucket"))) for k in (1, 2, 3)}
    stands = ranked.groupBy(*keys, "feature", "rows").agg(quartile[2].alias("mid"), F.greatest(F.lit(1), quartile[3] - quartile[1]).alias("spread"))
    limits = F.struct(*[F.max(F.when(F.col("feature") == name, F.col("mid") + fence * F.col("spread"))).alias(name) for name, fence in FENCES.items()])
    return stands.groupBy(*keys).agg(F.max("rows").alias("rows"), limits.alias("limits"))


def thresholds(sketch: DataFrame, lang: str, source: str) -> DataFrame:
    """lang, source, limits: each group's limits, drawn towards those of its language, and these towards those of all.

    A limit is the mean of the group's and the merged sketch's, in whole buckets, the group's weighted by its rows and the
    other by PRIOR_ROWS: a group of few rows has nearly its language's limit, one of many its own, without a step between.
    """

    def drawn(rows: str, own: str, prior: str) -> Column:
        mean = lambda name: F.expr(f"cast(({rows} * {own}.{name} + {PRIOR_ROWS} * {prior}.{name}) div ({rows} + {PRIOR_ROWS}) as int)").alias(name)
        return F.struct(*[mean(name) for name in FENCES])

    own = fences(sketch, [lang, source])
    first = fences(merged(sketch, []), []).select("limits.*").first()  # a number per feature
    everything = F.struct(*[F.lit(first[name]).cast("int").alias(name) for name in FENCES])
    by_lang = fences(merged(sketch, [lang]), [lang]).withColumn("all", everything)
    by_lang = by_lang.select(F.col(lang).alias("_lang"), drawn("rows", "limits", "all").alias("_limits"))
    joined = own.join(by_lang, F.col(lang).eqNullSafe(F.col("_lang")))
    return joined.select(lang, source, drawn("rows", "limits", "_limits").alias("limits"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    base_failed: fewer than 50 words, or over half of the words inside repeated 3-word windows. Of the others a row is
    kept if its symbols, duplicate lines, repeated words and characters per word are all within its group's thresholds;
    a row at a threshold stays. A group is a language and source, null being a group as any other. No cutoff is fixed:
    each threshold comes from the sketch of the group's rows that pass the base rules, drawn towards that of its language
    the more the fewer they are. Sketches grow with the range of values and not with the rows. Windows
    and lines of a text are compared by 64-bit hash and by value. Null and empty texts have no words and fail; rows that
    repeat an id are judged each for itself; an empty table gives an empty result; other columns are ignored.
    """
    named = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body"), F.col(lang_col).alias("lang_key"), F.col(source_col).alias("source_key"))
    keys = ["lang_key", "source_key"]
    counts = base_counts(named, "row_id", "body", *keys)
    counts = counts.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    counts = cut(counts.withColumns({name: bucket(part, whole) for name, (part, whole) in COUNTS.items()}))
    limits = thresholds(cut(sketches(counts.where(~F.col("base_failed")), keys)), *keys)
    on = counts["lang_key"].eqNullSafe(limits["lang_key"]) & counts["source_key"].eqNullSafe(limits["source_key"])
    within = F.lit(True)
    for name in FENCES:
        within = within & (F.col(name) <= F.col(f"limits.{name}"))
    return counts.join(limits, on, "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept")
    )
