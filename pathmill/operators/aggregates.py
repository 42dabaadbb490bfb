"""Aggregations over postings, courses and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathmill.lineage import cut


def top_tokens(rows: DataFrame, group: str, item: str, token: str, main: int, more: int) -> DataFrame:
    """group, token, n, rn, slot: tokens by the number of items that hold them; the first `main`, then `more` as fallback."""
    counts = rows.groupBy(group, token).agg(F.count_distinct(item).alias("n"))
    ranked = counts.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), token)))
    return ranked.where(F.col("rn") <= main + more).withColumn("slot", F.when(F.col("rn") <= main, "main").otherwise("fallback"))


def ordered_list(value: Column, *order: Column | str) -> Column:
    """Values of a group in a stated order, not in that of their arrival."""
    names = [f"o{k}" for k in range(len(order))]
    rows = F.collect_list(F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(n) for o, n in zip(order, names, strict=True)], value.alias("v")))
    return F.transform(F.array_sort(rows), lambda x: x["v"])


def latest_per_key(rows: DataFrame, key: str, at: str, ordinal: str) -> DataFrame:
    """Per key the row with the greatest `at`, the first of equals; rows without key are dropped."""
    best = Window.partitionBy(key).orderBy(F.desc(at), ordinal)
    return rows.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def first_by_content(rows: DataFrame, content: Column, ordinal: str) -> DataFrame:
    """The first row of each content; rows whose stripped content is empty all stay. Groups are found by digest, so no text is sorted."""
    key = F.regexp_replace(content, r"^\s+|\s+$", "")
    keyed = rows.withColumn("_key", F.when(key == "", F.concat(F.lit("row "), F.col(ordinal).cast("string"))).otherwise(F.sha2(key, 256)))
    first = keyed.groupBy("_key").agg(F.min(ordinal).alias(ordinal))
    return keyed.join(first, ["_key", ordinal], "left_semi").drop("_key")


def duplicate_groups(rows: DataFrame, text: Column, rank: Column, name: Column) -> DataFrame:
    """hash, keep, n, duplicates: groups of two or more rows with one text after folding white space."""
    folded = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")
    members = rows.select(F.sha2(folded, 256).alias("hash"), F.struct(rank.alias("rank"), name.alias("name")).alias("member"))
    groups = members.groupBy("hash").agg(F.array_sort(F.collect_list("member")).alias("members")).where(F.size("members") > 1)
    names = F.transform("members", lambda m: m["name"])
    return groups.select("hash", names[0].alias("keep"), F.size("members").alias("n"), F.slice(names, 2, F.size("members")).alias("duplicates"))


def tag_frequency(rows: DataFrame, job: str, posting: str, tag: str) -> DataFrame:
    """job, tag, n, postings: occurrences of each tag, beside the job's number of postings."""
    totals = rows.groupBy(job).agg(F.count_distinct(posting).alias("postings"))
    return rows.groupBy(job, tag).agg(F.count(F.lit(1)).alias("n")).join(totals, job)


def any_of_count(rows: DataFrame, parts: DataFrame, job: str, posting: str, tag: str) -> DataFrame:
    """job, name, n: postings with at least one tag of a compound; `parts` has name and part."""
    return rows.join(parts, rows[tag] == parts["part"]).groupBy(job, "name").agg(F.count_distinct(posting).alias("n"))


def merge_curated(curated: DataFrame, parts: DataFrame, rows: DataFrame, job: str, posting: str, tag: str, importance: dict[str, int]) -> DataFrame:
    """job, name, type, importance, n, rate, place: curated skills with their counts, then other observed tags as extra."""
    low = cut(rows.select(job, posting, tag).withColumn("_low", F.lower(tag)))  # read four times
    totals = low.groupBy(job).agg(F.count_distinct(posting).alias("postings"))
    plain = curated.join(parts.select("name").distinct(), "name", "left_anti").select("name", F.lower("name").alias("part")).distinct()
    one = low.join(plain, F.col("_low") == F.col("part")).groupBy(job, "name").agg(F.count(F.lit(1)).alias("n"))
    several = any_of_count(low, parts.select("name", F.lower("part").alias("part")), job, posting, "_low")
    counts = one.unionByName(several)
    listed = curated.join(counts, [job, "name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    taken = curated.select(job, F.lower("name").alias("_low")).unionByName(curated.join(parts, "name").select(job, F.lower("part").alias("_low"))).distinct()
    extra = low.join(taken, [job, "_low"], "left_anti").groupBy(job, F.col(tag).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    both = listed.select(job, "name", "type", "importance", "n").unionByName(extra.select(job, "name", F.lit("extra").alias("type"), F.lit(None).cast("string").alias("importance"), "n"))
    rank = F.coalesce(F.try_element_at(F.create_map(*[v for k, o in importance.items() for v in (F.lit(k), F.lit(o))]), "importance"), F.lit(len(importance)))
    rated = both.join(totals, job).withColumn("rate", F.bround(F.col("n") / F.col("postings"), 4))
    return rated.withColumn("place", F.row_number().over(Window.partitionBy(job).orderBy(rank, F.desc("n"), "name"))).drop("postings")


def group_evidence(rows: DataFrame, group: str, item: str, token: str) -> DataFrame:
    """group, token, items, n, rate: sorted distinct items that hold the token, their number and share of the group's."""
    totals = rows.groupBy(group).agg(F.count_distinct(item).alias("of"))
    found = rows.groupBy(group, token).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return found.join(totals, group).select(group, token, "items", F.size("items").alias("n"), F.bround(F.size("items") / F.col("of"), 4).alias("rate"))


def roll_up_hits(hits: DataFrame, k: int, least_tags: int = 5) -> DataFrame:
    """Hits per job: hit_ord, job_id, score, name, text, main, fallback, tags -> one row per job, best k jobs first.

    Score is the greatest, name and text those of the first best hit; main lists are united in first-seen order; tags of
    the hits by number of hits, then by first sight, without those in the main list; fewer than `least_tags` are filled
    up from the fallback lists.
    """
    lists = hits.groupBy("job_id").agg(
        F.max("score").alias("score"),
        F.min(F.struct((-F.col("score")).alias("s"), F.col("hit_ord"), "name", "text")).alias("best"),
        F.array_distinct(F.flatten(ordered_list(F.col("main"), "hit_ord"))).alias("tech_stacks"),
        F.array_distinct(F.flatten(ordered_list(F.col("fallback"), "hit_ord"))).alias("fill"),
        F.count(F.lit(1)).alias("posting_count"),
        F.min("hit_ord").alias("first"),
    )
    each = hits.select("job_id", "hit_ord", F.posexplode(F.array_distinct("tags")).alias("pos", "tag"))
    counted = each.groupBy("job_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("hit_ord", "pos")).alias("seen"))
    ranked = counted.groupBy("job_id").agg(ordered_list(F.col("tag"), -F.col("n"), "seen").alias("observed"))
    rows = lists.join(ranked, "job_id", "left")
    has = lambda list_, x: F.exists(list_, lambda y: F.lower(y) == F.lower(x))
    tags = F.filter(F.coalesce("observed", F.array().cast("array<string>")), lambda t: ~has(F.col("tech_stacks"), t))
    rows = rows.withColumn("tags", tags)
    more = F.filter("fill", lambda t: ~has(F.col("tech_stacks"), t) & ~has(F.col("tags"), t))
    filled = F.concat("tags", F.slice(more, 1, F.greatest(F.lit(0), F.lit(least_tags) - F.size("tags"))))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "first"))  # over jobs, a dimension table
    return rows.select("job_id", F.col("best.name").alias("name"), "score", F.col("best.text").alias("text"), "tech_stacks", filled.alias("competency_tags"), "posting_count", place.alias("place")).where(F.col("place") <= k)


def change_in_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    a, b = before.groupBy(key).agg(F.count(F.lit(1)).alias("n_before")), after.groupBy(key).agg(F.count(F.lit(1)).alias("n_after"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, key, "full").select(key, zero("n_before").alias("n_before"), zero("n_after").alias("n_after"), (zero("n_after") - zero("n_before")).alias("delta"))


def merge_courses(rows: DataFrame, stages: list[str]) -> DataFrame:
    """course_id, name, credits, type, tracks, grades, semesters, stage from one row per course, track and listing (`ord`)."""
    all_grades, all_semesters = F.array(*map(F.lit, range(1, 5))), F.array(*map(F.lit, range(1, 9)))
    merged = rows.groupBy("course_id").agg(
        F.min(F.struct("ord", "course_name", "credits", "course_type")).alias("first"),
        F.array_distinct(ordered_list(F.col("track_id"), "ord")).alias("track_ids"),
        F.array_sort(F.collect_set("grade")).alias("g"),
        F.array_sort(F.collect_set("semester")).alias("s"),
    )
    grades = F.when(F.size("g") > 0, F.col("g")).otherwise(all_grades)
    stage = F.element_at(F.array(*map(F.lit, stages)), F.greatest(F.lit(1), F.least(F.lit(len(stages)), grades[0])))
    return merged.select("course_id", "first.course_name", "first.credits", "first.course_type", "track_ids", grades.alias("grades"), F.when(F.size("s") > 0, F.col("s")).otherwise(all_semesters).alias("semesters"), stage.alias("stage"))


def token_index(rows: DataFrame, name: str, tokens: str, ordinal: str) -> DataFrame:
    """key, tokens: tokens by trimmed lower-case name, united in first-seen order; no empty keys."""
    keyed = rows.withColumn("key", F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))).where("key <> ''")
    return keyed.groupBy("key").agg(F.array_distinct(F.flatten(ordered_list(F.col(tokens), ordinal))).alias("tokens")).where(F.size("tokens") > 0)


def union_per_item(catalog: DataFrame, found: DataFrame, key: str, token: str) -> DataFrame:
    """Every item of the catalog with the sorted set of its tokens, empty where none was found."""
    sets = found.groupBy(key).agg(F.array_sort(F.collect_set(token)).alias("tokens"))
    return catalog.join(sets, key, "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def centred_means(vectors: DataFrame, group: str, vector: str, digits: int = 6, least: float = 1e-12) -> DataFrame:
    """group, vector: the group's mean vector, scaled to length 1, less the mean of all groups, scaled again."""
    dims = vectors.select(group, F.posexplode(vector).alias("dim", "x"))
    means = dims.groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    def scaled(rows):
        lengths = rows.groupBy(group).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
        return rows.join(lengths, group).select(group, "dim", (F.col("x") / F.greatest("length", F.lit(least))).alias("x"))
    units = scaled(means)
    centre = units.groupBy("dim").agg(F.avg("x").alias("centre"))
    return scaled(units.join(centre, "dim").select(group, "dim", (F.col("x") - F.col("centre")).alias("x"))).groupBy(group).agg(ordered_list(F.round("x", digits), "dim").alias("vector"))


def first_known(rows: DataFrame, key: str, value: str, ordinal: str, unknown: str = "null") -> DataFrame:
    """Per key the first value in order that is not the unknown mark, else the first."""
    return rows.groupBy(key).agg(F.min(F.struct((F.col(value) == unknown).alias("u"), F.col(ordinal), F.col(value).alias("v")))["v"].alias(value))


def joined_text(rows: DataFrame, key: str, text: str, ordinal: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_join(ordered_list(F.col(text), ordinal), "\n").alias(text))


def unique_names(rows: DataFrame, name: str, suffix: str, ordinal: str) -> DataFrame:
    """new_name: the name alone when unique; with its suffix when suffixes differ; else also numbered from 2."""
    counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(suffix).alias("_d"))
    number = F.row_number().over(Window.partitionBy(name, suffix).orderBy(ordinal))
    numbered = rows.join(counts, name).withColumn("_k", number)
    new = F.when(F.col("_n") == 1, F.col(name)).when((F.col("_n") == F.col("_d")) | (F.col("_k") == 1), F.concat_ws("_", name, suffix)).otherwise(F.concat(F.concat_ws("_", name, suffix), F.col("_k").cast("string")))
    return numbered.withColumn("new_name", new).drop("_n", "_d", "_k")


def coverage_distribution(shares: DataFrame, by: list[str], share: str) -> DataFrame:
    x = F.col(share)
    return shares.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.count_if(x > 0) / F.count(F.lit(1))).alias("positive"), F.avg(x).alias("mean"), F.max(x).alias("greatest"), F.stddev_pop(x).alias("deviation"))


def dominant_value(rows: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """Most frequent value per key; of equals the one that is first in `order`."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), order))).where("_rn = 1").drop("_rn")
