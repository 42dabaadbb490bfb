"""Lookups and merges of catalogs, postings and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathmill.operators.aggregates import ordered_list


def not_collected(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(old.select(*keys), keys, "left_anti")


def map_or_keep(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """The mapped value of a column, or the value itself where the mapping (source, target) has none."""
    return rows.join(mapping, F.col(column) == F.col("source"), "left").withColumn(column, F.coalesce("target", column)).drop("source", "target")


def by_id_else_name(rows: DataFrame, features: DataFrame, id_col: str, name_col: str, value: str) -> DataFrame:
    """rows with `value` by id, else by name, and how it was found."""
    by_id = features.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(value).alias("_v1"))
    by_name = features.where(F.col(name_col).isNotNull()).groupBy(name_col).agg(F.min(value).alias("_v2"))
    joined = rows.join(by_id, id_col, "left").join(by_name, name_col, "left")
    return joined.withColumn(value, F.coalesce("_v1", "_v2")).withColumn("found_by", F.when(F.col("_v1").isNotNull(), "id").when(F.col("_v2").isNotNull(), "name").otherwise("none")).drop("_v1", "_v2")


def resolve_names(courses: DataFrame, wanted: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Edges (course_id, needs, ord) and misses (course_id, name) of prerequisite names.

    courses: course_id, course_name, track_ids, ord; wanted: course_id, name, ord. Of the courses with the name's key, not
    the course itself, the one that shares most tracks is taken, the first in the catalog of equals. Courses of one key
    and the same tracks are a class: its first two stand for it, as the course itself may be the first. Classes meet
    classes, and each course asks its own class for the two best, so courses of a frequent name never meet one by one.
    """
    first_two = lambda rows, by, *order: rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn <= 2").drop("_rn")
    tracks = F.array_sort(F.array_distinct("track_ids"))
    keyed = courses.select(key("course_name").alias("key"), tracks.alias("t2"), F.col("course_id").alias("needs"), F.col("ord").alias("at")).groupBy("key", "t2", "needs").agg(F.min("at").alias("at"))
    classes = first_two(keyed, ["key", "t2"], "at", "needs")
    own = courses.select("course_id", F.coalesce(tracks, F.array().cast(courses.schema["track_ids"].dataType)).alias("t1"))
    rows = wanted.withColumn("key", key("name")).join(own, "course_id").select("course_id", "ord", "key", "t1")
    met = rows.select("key", "t1").distinct().join(classes, "key").withColumn("shared", F.size(F.array_intersect("t1", "t2")))
    two = first_two(met, ["key", "t1"], F.desc("shared"), "at", "needs").select("key", "t1", "needs", "shared", "at")
    best = rows.join(two, ["key", "t1"]).where("needs <> course_id").withColumn("_rn", F.row_number().over(Window.partitionBy("course_id", "ord").orderBy(F.desc("shared"), "at", "needs"))).where("_rn = 1")
    edges = best.groupBy("course_id", "needs").agg(F.min("ord").alias("ord"))
    return edges, wanted.join(best.select("course_id", "ord"), ["course_id", "ord"], "left_anti").select("course_id", "name")


def official_or_alias(wanted: DataFrame, official: DataFrame, aliases: DataFrame, catalog: DataFrame) -> DataFrame:
    """course, needs: sorted official names of what each course of the catalog needs, empty where nothing is known.

    wanted: course, raw; official: key, name; aliases: key, target (null: known, without target).
    """
    rows = wanted.join(official, F.col("raw") == official["key"], "left").join(aliases.select(F.col("key").alias("_key"), "target"), F.col("raw") == F.col("_key"), "left")
    named = rows.select("course", F.coalesce("name", "target").alias("needs")).where("needs is not null and needs <> course")
    lists = named.groupBy("course").agg(F.array_sort(F.collect_set("needs")).alias("needs"))
    return catalog.join(lists, "course", "left").withColumn("needs", F.coalesce("needs", F.array().cast("array<string>")))


def in_request_order(requests: DataFrame, cards: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """request_id, place, cards' columns: cards of the requested keys in order; repeated keys once, unknown ones not.

    A list names a key where it stands first, so that nothing is grouped; `parts` tasks, if given, share the rows of each step.
    """
    dealt = lambda df, by: df.repartition(parts, by) if parts else df
    first = requests.select("request_id", F.explode(F.array_distinct("wanted")).alias(key), "wanted").withColumn("pos", F.array_position("wanted", F.col(key)) - 1).drop("wanted")
    return dealt(dealt(first, key).join(cards, key), "request_id").withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("pos", "card"))).drop("pos")


def token_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, token: str) -> DataFrame:
    """left_id, right_id, shared: number of common tokens of each pair that has any."""
    a, b = left.select(left_id, token).distinct(), right.select(right_id, token).distinct()
    return a.join(b, token).groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("shared"))


def merge_membership(rows: DataFrame, members: DataFrame, key: str, tag: str) -> DataFrame:
    """Every key of either side with the sorted tags of both, joined by a bar; rows has tags as an array."""
    tagged = members.groupBy(key).agg(F.collect_set(tag).alias("_m"))
    none = F.array().cast("array<string>")
    return rows.join(tagged, key, "full").select(key, F.array_join(F.array_sort(F.array_union(F.coalesce("tags", none), F.coalesce("_m", none))), "|").alias("tags"))


def bind_texts(pairs: DataFrame, texts: DataFrame, key: str, composed: Column) -> DataFrame:
    """pairs with `text`: the first text given under the pair's key (of texts in one place the least), else a composed sentence; unknown keys are dropped."""
    first = texts.groupBy(key).agg(F.min(F.struct("ord", "text"))["text"].alias("text"))
    return pairs.join(first, key, "left").withColumn("text", F.coalesce("text", composed))


def tokens_of_names(rows: DataFrame, index: DataFrame, owner: str, name: str, ordinal: str) -> DataFrame:
    """owner, tokens: tokens of an owner's names in order, each once; index has key and tokens, unknown names add none."""
    keyed = rows.withColumn("key", F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))).join(index, "key", "left")
    none = F.array().cast("array<string>")
    return keyed.groupBy(owner).agg(F.array_distinct(F.flatten(ordered_list(F.coalesce("tokens", none), ordinal))).alias("tokens"))


def first_n_per_list(rows: DataFrame, key: str, ordinal: str, n: int) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(ordinal))).where(F.col("_rn") <= n).drop("_rn")


def contained_ids(names: DataFrame, ids: DataFrame) -> DataFrame:
    """name, id: every id that stands anywhere in a distinct name, by equality joins.

    The lengths that ids have, few as they are, are worked out first; a name gives its pieces of these lengths, and a
    piece that is an id is a hit. Names are short, so pieces are no more than lengths times characters. Empty ids are in
    no name.
    """
    own = ids.select("id").where("id <> ''").distinct()
    longest = names.agg(F.max(F.length("name"))).first()[0] or 0
    lengths = sorted(r[0] for r in own.select(F.length("id").alias("n")).where(F.col("n") <= longest).distinct().collect())  # `longest` at most
    none = F.array().cast("array<string>")

    def of_length(n: int) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substring(F.col("name"), i, F.lit(n)))
        return F.when(F.length("name") >= n, pieces).otherwise(none)

    pieces = [of_length(n) for n in lengths]
    if not pieces:
        return names.select("name", F.col("name").alias("id")).limit(0)
    cut = names.select("name").distinct().select("name", F.explode(F.array_distinct(F.concat(*pieces))).alias("id"))
    return cut.join(own, "id", "left_semi").select("name", "id")


def documents_of_courses(docs: DataFrame, courses: DataFrame) -> DataFrame:
    """doc, course_id: by an id that the file's name contains, else by the exact course name, in either case the first in
    the catalog; documents without either are left out.

    docs: doc, file, name; courses: course_id, course_name, ord.
    """
    first = F.min(F.struct("ord", "course_id"))["course_id"]
    ids = courses.select(F.col("course_id").alias("id"), "ord", "course_id")
    named = contained_ids(docs.select(F.col("file").alias("name")).where("file is not null"), ids)
    by_id = named.join(ids, "id").groupBy(F.col("name").alias("file")).agg(first.alias("_by_id"))
    by_name = courses.groupBy(F.col("course_name").alias("name")).agg(first.alias("_by_name"))
    return docs.join(by_id, "file", "left").join(by_name, "name", "left").select("doc", F.coalesce("_by_id", "_by_name").alias("course_id")).where("course_id is not null")
