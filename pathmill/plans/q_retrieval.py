"""Registered queries: scored search and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathmill.operators import retrieval as R
from pathmill.operators.aggregates import ordered_list
from pathmill.plans.bindings import JOBS_SQL, jobs
from pathmill.registry import query
from pathmill.session import parts_of, table


@query("r01_hybrid_search", r"""
    WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS terms FROM documents),
    d AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, terms FROM embeddings JOIN t ON doc_id = vec_id),
    q AS (SELECT doc_id AS query_id, v AS vq, terms AS tq FROM d WHERE doc_id % 50 = 0),
    s AS (SELECT query_id, doc_id, 0.3::DOUBLE * list_cosine_similarity(vq, v) + (1 - 0.3::DOUBLE) * (len(list_intersect(tq, terms)) / len(list_distinct(list_concat(tq, terms)))::DOUBLE) AS score FROM q, d)
    SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score >= 0.2 QUALIFY place <= 100
""")
def r01(spark, d):
    terms = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    docs = table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id")).select("doc_id", F.col("embedding").alias("vector"), terms.alias("terms"))
    return R.hybrid_search(docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), docs).withColumn("score", F.round("score", 6))


MATCH_SQL = """
    hits AS (SELECT o_custkey AS user_id, o_orderpriority AS job_id, max(round(o_totalprice / 5000000, 4)) AS score FROM orders GROUP BY ALL),
    mapping(category, ord, rank, job_id, job_name) AS (VALUES ('BUILDING', 1, 2, 'b', 'Builder'), ('BUILDING', 2, NULL, 'c', NULL), ('BUILDING', 3, 1, '', 'No id'), ('BUILDING', 4, 3, 'd', ''), ('MACHINERY', 5, 1, 'm', 'Machinist'), ('FURNITURE', 6, NULL, 'f', 'Joiner')),
    fallback AS (SELECT user_id, job_id, coalesce(nullif(job_name, ''), job_id) AS job_name, place FROM (
        SELECT c_custkey AS user_id, job_id, job_name, row_number() OVER (PARTITION BY c_custkey ORDER BY coalesce(rank, 999), ord) AS place FROM customer JOIN mapping ON c_mktsegment = category) WHERE place <= 3 AND job_id <> '')"""


def _users(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.array("c_mktsegment").alias("interests"))


def _mapping(spark):
    rows = [("BUILDING", 1, 2, "b", "Builder"), ("BUILDING", 2, None, "c", None), ("BUILDING", 3, 1, "", "No id"), ("BUILDING", 4, 3, "d", ""), ("MACHINERY", 5, 1, "m", "Machinist"), ("FURNITURE", 6, None, "f", "Joiner")]
    return spark.createDataFrame(rows, "category string, ord int, rank int, job_id string, job_name string")


def _hits(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_totalprice").repartition(parts_of(spark, d, "orders"), "o_custkey")
    return orders.groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("job_id")).agg(F.max(F.round(F.col("o_totalprice") / 5000000, 4)).alias("score"))


@query("r02_hits_or_fallback", f"""
    WITH {MATCH_SQL}, good AS (SELECT user_id FROM hits GROUP BY 1 HAVING max(score) >= 0.08)
    SELECT user_id, job_id, score, false AS fallback_used FROM hits WHERE user_id IN (SELECT user_id FROM good)
    UNION ALL SELECT user_id, job_id, 0.0, true FROM fallback WHERE user_id NOT IN (SELECT user_id FROM good)
""")
def r02(spark, d):
    users = _users(spark, d)
    return R.hits_or_fallback(users, _hits(spark, d), R.fallback_jobs(users, _mapping(spark), 3), 0.08)


@query("r03_fallback_jobs", f"WITH {MATCH_SQL} SELECT user_id, job_id, job_name, place FROM fallback")
def r03(spark, d):
    return R.fallback_jobs(_users(spark, d), _mapping(spark), 3)


@query("r04_boost_by_completed", f"""
    WITH {JOBS_SQL}, {MATCH_SQL.lstrip().split("mapping(")[0].rstrip().rstrip(",")},
    known AS (SELECT DISTINCT o_custkey AS user_id, lower(p_brand) AS key FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F'),
    t AS (SELECT job_id, unnest(job_keys) AS key FROM jobs), n AS (SELECT user_id, job_id, count(*) AS known FROM known JOIN t USING (key) GROUP BY ALL),
    b AS (SELECT h.*, least(1.0::DOUBLE, score + 0.15::DOUBLE * (coalesce(known, 0) / 8::DOUBLE)) AS match_score FROM hits h LEFT JOIN n USING (user_id, job_id))
    SELECT user_id, job_id, round(match_score, 6) AS match_score, row_number() OVER (PARTITION BY user_id ORDER BY match_score DESC, score DESC, job_id) AS place FROM b
""")
def r04(spark, d):
    tokens = jobs(spark, d).select("job_id", F.explode("job_keys").alias("key"))
    n = parts_of(spark, d, "lineitem")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").repartition(n, "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    known = lines.repartition(n, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.lower("p_brand").alias("key")).repartition(n, "user_id").distinct()
    hits = _hits(spark, d).withColumn("ord", F.struct((-F.col("score")).alias("s"), "job_id"))
    return R.boost_by_completed(hits, tokens, known).select("user_id", "job_id", F.round("match_score", 6).alias("match_score"), "place")


@query("r30_routed_documents", r"""
    WITH docs AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'track_intro' WHEN doc_id % 3 = 1 THEN 'curriculum' ELSE 'syllabus' END AS doc_type, 'C' || doc_id % 5 AS college, source AS track, lang AS grades, text FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
    r AS (SELECT conv_id AS request_id, 'C' || conv_id % 5 AS college, 'src' || conv_id % 20 AS track, ['en', 'de', 'fr'][1 + conv_id % 3] AS grade_text, ['catalog', 'curriculum', 'syllabus', 'intro', 'none', 'keywords'][1 + conv_id % 6] AS branch, string_split_regex(lower(any_value(text) FILTER (WHERE turn = 0)), '\s+')[1:2] AS words FROM conversations GROUP BY conv_id),
    w AS (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '\s+'))) AS word FROM docs),
    f AS (SELECT request_id, branch, doc_id FROM r JOIN docs USING (college) WHERE branch = 'catalog' AND doc_type = 'track_intro'
        UNION SELECT request_id, branch, doc_id FROM r JOIN docs USING (track) WHERE (branch = 'curriculum' AND doc_type = 'curriculum') OR (branch = 'intro' AND doc_type = 'track_intro')
        UNION SELECT request_id, branch, doc_id FROM r JOIN docs ON contains(grades, grade_text) WHERE branch = 'syllabus' AND doc_type = 'syllabus'
        UNION SELECT request_id, branch, doc_id FROM (SELECT request_id, branch, unnest(words) AS word FROM r WHERE branch = 'keywords') JOIN w USING (word))
    SELECT request_id, branch, doc_id, row_number() OVER (PARTITION BY request_id ORDER BY doc_id) AS place FROM f QUALIFY place <= CASE branch WHEN 'catalog' THEN 70 WHEN 'curriculum' THEN 20 ELSE 10 END
""")
def r30(spark, d):
    k = F.col("doc_id") % 3
    docs = table(spark, d, "documents").select("doc_id", F.when(k == 0, "track_intro").when(k == 1, "curriculum").otherwise("syllabus").alias("doc_type"), F.concat(F.lit("C"), F.col("doc_id") % 5).alias("college"), F.col("source").alias("track"), F.col("lang").alias("grades"), "text")
    c = F.col("conv_id")
    first = table(spark, d, "conversations").where("turn = 0").groupBy("conv_id").agg(F.min("text").alias("text"))
    every = table(spark, d, "conversations").select("conv_id").distinct().join(first, "conv_id", "left")
    kind = (c % 6).cast("int")
    intent = F.when(kind == 0, "track_question").when(kind.isin(1, 2), "course_question").when(kind.isin(3, 5), "job_question").otherwise("general_advice")
    words = F.slice(F.split(F.lower("text"), r"\s+"), 1, 2)
    requests = every.select(
        c.alias("request_id"), F.concat(F.lit("C"), c % 5).alias("college"), F.array(F.concat(F.lit("src"), c % 20)).alias("tracks"), F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), (c % 3 + 1).cast("int")).alias("grade_text"),
        F.when(kind == 5, words).otherwise(F.array().cast("array<string>")).alias("keywords"), intent.alias("intent"), (kind == 0).alias("catalog"), kind.isin(1, 3).alias("has_tracks"), F.when(kind == 2, 1).alias("grade"),
    )
    branch = R.branch_of(F.col("intent"), F.col("catalog"), F.size("keywords"), F.col("has_tracks"), F.col("grade"))
    return R.routed_documents(requests.withColumn("branch", branch), docs)


@query("r31_notice_flags", f"""
    WITH {MATCH_SQL}, good AS (SELECT user_id FROM hits GROUP BY 1 HAVING max(score) >= 0.08)
    SELECT c_custkey AS user_id, c_custkey NOT IN (SELECT user_id FROM good) AND c_custkey IN (SELECT user_id FROM fallback) AS caveat, c_custkey NOT IN (SELECT user_id FROM good) AND c_custkey NOT IN (SELECT user_id FROM fallback) AS no_jobs FROM customer
""")
def r31(spark, d):
    found = r02(spark, d).groupBy("user_id").agg(F.bool_or("fallback_used").alias("caveat"))
    rows = _users(spark, d).join(found, "user_id", "left")
    return rows.select("user_id", F.coalesce("caveat", F.lit(False)).alias("caveat"), F.col("caveat").isNull().alias("no_jobs"))


@query("s13_filtered_read", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND contains(source, '1') ORDER BY n_chars DESC, doc_id LIMIT 100")
def s13(spark, d):
    return table(spark, d, "documents").where((F.col("lang") == "en") & F.contains("source", F.lit("1"))).select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)


@query("s14_reassembled_documents", r"SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> '' GROUP BY 1")
def s14(spark, d):
    rows = table(spark, d, "conversations").where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return rows.groupBy("conv_id").agg(F.array_join(ordered_list(F.col("text"), "turn"), "\n").alias("text"))
