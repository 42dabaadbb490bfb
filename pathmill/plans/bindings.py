"""The given tables as colleges, departments, tracks, courses, postings and students; in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmill.session import parts_of, table

TRACK_ID = "'T' || lpad(cast({0} as varchar), 6, '0')"
COURSE_ID = "'P' || lpad(cast({0} as varchar), 7, '0')"


def coded(letter: str, width: int, column: str):
    return F.concat(F.lit(letter), F.lpad(F.col(column).cast("string"), width, "0"))


def taught(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (track_id, course_id, brand), one per order line: which courses a track lists, and with which tokens."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(coded("T", 6, "l_suppkey").alias("track_id"), coded("P", 7, "l_partkey").alias("course_id"), F.lower("p_brand").alias("brand"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, college_id, department_id, course_ids, tech: supplier, region, nation, parts sold, brands of over a twentieth of its lines."""
    rows = taught(spark, sf_dir)
    courses_of = rows.groupBy("track_id").agg(F.array_sort(F.collect_set("course_id")).alias("course_ids"), F.count(F.lit(1)).alias("total"))
    brands = rows.groupBy("track_id", "brand").agg(F.count(F.lit(1)).alias("n")).groupBy("track_id").agg(F.collect_list(F.struct("brand", "n")).alias("brands"))
    tech = F.array_sort(F.transform(F.filter("brands", lambda b: 20 * b["n"] > F.col("total")), lambda b: b["brand"]))
    lists = courses_of.join(brands, "track_id").select("track_id", "course_ids", tech.alias("tech"))
    base = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    base = base.select(coded("T", 6, "s_suppkey").alias("track_id"), F.concat(F.lit("C"), "n_regionkey").alias("college_id"), coded("D", 2, "n_nationkey").alias("department_id"))
    empty = F.array().cast("array<string>")
    return base.join(lists, "track_id", "left").select("track_id", "college_id", "department_id", F.coalesce("course_ids", empty).alias("course_ids"), F.coalesce("tech", empty).alias("tech"))


TAUGHT_SQL = f"""
    taught AS (
        SELECT {TRACK_ID.format("l_suppkey")} AS track_id, {COURSE_ID.format("l_partkey")} AS course_id, lower(p_brand) AS brand
        FROM lineitem JOIN part ON l_partkey = p_partkey
    )"""
TRACKS_SQL = f"""{TAUGHT_SQL},
    sold AS (SELECT track_id, brand, count(*) AS n FROM taught GROUP BY ALL),
    tracks AS (
        SELECT b.*, coalesce(course_ids, CAST([] AS VARCHAR[])) AS course_ids, coalesce(tech, CAST([] AS VARCHAR[])) AS tech
        FROM (SELECT {TRACK_ID.format("s_suppkey")} AS track_id, 'C' || n_regionkey AS college_id,
                     'D' || lpad(cast(n_nationkey AS varchar), 2, '0') AS department_id
              FROM supplier JOIN nation ON s_nationkey = n_nationkey) b
        LEFT JOIN (SELECT track_id, list_sort(list(DISTINCT course_id)) AS course_ids FROM taught GROUP BY track_id) USING (track_id)
        LEFT JOIN (SELECT track_id, list_sort(list(brand)) AS tech FROM sold JOIN (SELECT track_id, sum(n) AS total FROM sold GROUP BY 1) USING (track_id) WHERE 20 * n > total GROUP BY track_id) USING (track_id)
    )"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posting_id, category, token: distinct brand tokens of an order's lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("token"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    n = parts_of(spark, sf_dir, "lineitem")
    return (
        lines.repartition(n, "l_partkey")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .repartition(n, "l_orderkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_orderkey").alias("posting_id"), F.col("o_orderpriority").alias("category"), "token")
        .distinct()
    )


POSTINGS_SQL = """
    postings AS (
        SELECT DISTINCT o_orderkey AS posting_id, o_orderpriority AS category, lower(p_brand) AS token
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    )"""
JOBS_SQL = f"""{POSTINGS_SQL},
    ranked AS (
        SELECT category, token, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, token) AS rn
        FROM (SELECT category, token, count(*) AS n FROM postings GROUP BY ALL)
    ),
    jobs AS (SELECT category AS job_id, list_sort(list(token)) AS job_keys FROM ranked WHERE rn <= 8 GROUP BY category)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, job_keys: the eight most frequent tokens of each order class."""
    from pathmill.operators.aggregates import top_tokens

    top = top_tokens(postings(spark, sf_dir), "category", "posting_id", "token", 8, 0)
    return top.where("slot = 'main'").groupBy("category").agg(F.array_sort(F.collect_list("token")).alias("job_keys")).withColumnRenamed("category", "job_id")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per region and order class: user_id, college_id, department_id, current_tracks, job_keys."""
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("C"), "r_regionkey").alias("college_id"), F.lit(1).alias("one"))
    wanted = jobs(spark, sf_dir).withColumn("one", F.lit(1))
    return regions.join(wanted, "one").select(
        F.concat_ws("|", "college_id", "job_id").alias("user_id"), "college_id", F.lit("").alias("department_id"), F.array().cast("array<string>").alias("current_tracks"), "job_keys"
    )


REQUESTS_SQL = f"""{TRACKS_SQL}, {JOBS_SQL.lstrip()},
    requests AS (SELECT 'C' || r_regionkey || '|' || job_id AS user_id, 'C' || r_regionkey AS college_id, job_keys FROM region, jobs)"""


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """course_id, course_name, credits, course_type, grades, tokens of each part."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        coded("P", 7, "p_partkey").alias("course_id"),
        F.col("p_name").alias("course_name"),
        (2 + size % 2).cast("int").alias("credits"),
        F.when(F.col("p_type").isin("ECONOMY", "SMALL", "STANDARD"), "required").otherwise("elective").alias("course_type"),
        F.array_sort(F.array_distinct(F.array((size % 4 + 1), ((size + 1) % 4 + 1)).cast("array<int>"))).alias("grades"),
        F.array_sort(F.array_distinct(F.concat(F.array(F.lower("p_brand")), F.split(F.lower("p_name"), " ")))).alias("tokens"),
    )


COURSES_SQL = f"""
    courses AS (
        SELECT {COURSE_ID.format("p_partkey")} AS course_id, p_name AS course_name, 2 + p_size % 2 AS credits,
               CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'STANDARD') THEN 'required' ELSE 'elective' END AS course_type,
               list_sort(list_distinct([p_size % 4 + 1, (p_size + 1) % 4 + 1])) AS grades,
               list_sort(list_distinct(list_concat([lower(p_brand)], string_split(lower(p_name), ' ')))) AS tokens
        FROM part
    )"""
