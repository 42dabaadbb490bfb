"""Registered queries: coverage of job demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathmill.lineage import cut
from pathmill.operators import coverage as C
from pathmill.operators.aggregates import top_tokens
from pathmill.plans.bindings import COURSES_SQL, POSTINGS_SQL, coded, courses, postings
from pathmill.plans.q_planning import course_lists, done
from pathmill.registry import query
from pathmill.session import parts_of, table

CAP = 6
COVERAGE_SQL = f"""{COURSES_SQL}, {POSTINGS_SQL.lstrip()},
    brands AS (SELECT category, token, row_number() OVER (PARTITION BY category ORDER BY n DESC, token) AS rn FROM (SELECT category, token, count(*) AS n FROM postings GROUP BY ALL)),
    job_tokens AS (SELECT category AS job_id, token AS key, upper(token) AS display FROM brands WHERE rn <= 14 UNION ALL SELECT DISTINCT category, w, upper(w) FROM brands, (VALUES ('red'), ('bolt'), ('zinc')) v(w)),
    jobs AS (SELECT 'S' || lpad(c_custkey::VARCHAR, 7, '0') AS student_id, job_id, (c_custkey * 7 + CAST(substr(job_id, 1, 1) AS INT) * 13) % 10 AS score, CAST(substr(job_id, 1, 1) AS INT) AS ord FROM customer, (SELECT DISTINCT job_id FROM job_tokens)),
    done AS (SELECT DISTINCT 'S' || lpad(o_custkey::VARCHAR, 7, '0') AS student_id, 'P' || lpad(l_partkey::VARCHAR, 7, '0') AS course_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'),
    planned AS (SELECT DISTINCT 'S' || lpad(o_custkey::VARCHAR, 7, '0') AS student_id, 'P' || lpad(l_partkey::VARCHAR, 7, '0') AS course_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'),
    course_tokens AS (SELECT course_id, unnest(tokens) AS key FROM courses),
    anchors AS (SELECT student_id, job_id FROM jobs QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY score DESC, ord) = 1),
    reach AS (SELECT student_id, key, bool_or(done) AS done, count(*) AS freq FROM (SELECT *, true AS done FROM done UNION SELECT *, false FROM planned) JOIN course_tokens USING (course_id) GROUP BY ALL),
    targets AS (SELECT * FROM (SELECT student_id, job_id, key, done, freq, row_number() OVER (PARTITION BY student_id ORDER BY done DESC, freq DESC, key) AS rn, sum(CASE WHEN done THEN 1 ELSE 0 END) OVER (PARTITION BY student_id) AS nd
        FROM anchors JOIN job_tokens USING (job_id) JOIN reach USING (student_id, key)) WHERE rn <= greatest({CAP}, nd)),
    need AS (SELECT student_id, count(*) AS required FROM targets GROUP BY 1),
    contributed AS (SELECT student_id, course_id, added, ratio, row_number() OVER (PARTITION BY student_id ORDER BY ratio DESC, course_id) AS place FROM (
        SELECT p.student_id, p.course_id, count(t.key) AS added, coalesce(count(t.key) / any_value(required)::DOUBLE, 0) AS ratio FROM planned p LEFT JOIN course_tokens c USING (course_id) LEFT JOIN targets t ON t.student_id = p.student_id AND t.key = c.key AND NOT t.done LEFT JOIN need n ON n.student_id = p.student_id GROUP BY ALL))"""


def offers(spark, d):
    """The jobs' tokens, and every student's jobs."""
    top = cut(top_tokens(postings(spark, d), "category", "posting_id", "token", 14, 0))
    words = top.select("category").distinct().withColumn("token", F.explode(F.array(*map(F.lit, ("red", "bolt", "zinc")))))
    job_tokens = top.select("category", "token").unionByName(words).select(F.col("category").alias("job_id"), F.col("token").alias("key"), F.upper("token").alias("display"))
    number = F.substring("job_id", 1, 1).cast("int")
    jobs = table(spark, d, "customer").select("c_custkey").join(job_tokens.select("job_id").distinct())
    jobs = jobs.select(coded("S", 7, "c_custkey").alias("student_id"), "job_id", ((F.col("c_custkey") * 7 + number * 13) % 10).alias("score"), number.alias("ord"))
    return jobs, job_tokens


def parts(spark, d):
    jobs, job_tokens = offers(spark, d)
    planned = course_lists(spark, d, "O")
    course_tokens = courses(spark, d).select("course_id", F.explode("tokens").alias("key"))
    n = parts_of(spark, d, "lineitem")
    reach = cut(C.reachable_tokens(done(spark, d), planned, course_tokens, n))
    anchors = C.anchor_jobs(jobs, parts=n)
    return {"parts": n, "jobs": jobs, "job_tokens": job_tokens, "planned": planned, "course_tokens": course_tokens, "reach": reach, "anchors": anchors, "targets": C.target_tokens(anchors, job_tokens, reach, CAP, n)}


@query("r20_anchor_job", f"WITH {COVERAGE_SQL} SELECT student_id, job_id FROM anchors")
def r20(spark, d):
    return C.anchor_jobs(offers(spark, d)[0], parts=parts_of(spark, d, "lineitem"))


@query("r21_target_tokens", f"WITH {COVERAGE_SQL} SELECT student_id, key, done, freq FROM targets")
def r21(spark, d):
    return parts(spark, d)["targets"].select("student_id", "key", "done", "freq")


@query("r22_coverage_ratios", f"WITH {COVERAGE_SQL}, n AS (SELECT student_id, sum(CASE WHEN done THEN 1 ELSE 0 END)::BIGINT AS current FROM targets GROUP BY 1) SELECT student_id, job_id, coalesce(required, 0) AS required, coalesce(current, 0) AS current, coalesce(required, 0) AS expected, round(coalesce(current / required::DOUBLE, 0), 6) AS current_ratio, CASE WHEN required > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS expected_ratio FROM anchors LEFT JOIN need USING (student_id) LEFT JOIN n USING (student_id)")
def r22(spark, d):
    p = parts(spark, d)
    return C.coverage_ratios(p["anchors"], p["targets"]).withColumn("current_ratio", F.round("current_ratio", 6))


@query("r23_job_coverage", f"""
    WITH {COVERAGE_SQL}, c AS (SELECT j.student_id, j.job_id, count(*) AS required, sum(CASE WHEN done THEN 1 ELSE 0 END)::BIGINT AS current, count(freq) AS expected, coalesce(string_agg(CASE WHEN freq IS NULL THEN display END, '|' ORDER BY display), '') AS missing
        FROM jobs j JOIN job_tokens t USING (job_id) LEFT JOIN reach r ON r.student_id = j.student_id AND r.key = t.key GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY current / required::DOUBLE DESC, job_id) AS place FROM c
""")
def r23(spark, d):
    p = parts(spark, d)
    return C.job_coverage(p["jobs"], p["job_tokens"], p["reach"], p["parts"]).withColumn("missing", F.array_join("missing", "|"))


@query("r24_contributions", f"WITH {COVERAGE_SQL} SELECT student_id, course_id, added, round(ratio, 6) AS ratio, place FROM contributed")
def r24(spark, d):
    p = parts(spark, d)
    return C.contributions(p["planned"], p["course_tokens"], p["targets"], p["parts"]).withColumn("ratio", F.round("ratio", 6))


@query("r24_next_actions", f"""
    WITH {COVERAGE_SQL}, first AS (SELECT * FROM contributed WHERE place <= 3 AND ratio > 0),
    covered AS (SELECT student_id, count(*) AS covered FROM (SELECT student_id, key FROM targets WHERE done UNION SELECT f.student_id, t.key FROM first f JOIN course_tokens c USING (course_id) JOIN targets t ON t.student_id = f.student_id AND t.key = c.key) GROUP BY 1)
    SELECT student_id, coalesce(covered, 0) AS covered, round(coalesce(covered, 0) / required::DOUBLE, 6) AS ratio FROM need LEFT JOIN covered USING (student_id)
""")
def r24_actions(spark, d):
    p = parts(spark, d)
    return C.next_actions(C.contributions(p["planned"], p["course_tokens"], p["targets"], p["parts"]), p["course_tokens"], p["targets"])[1].withColumn("ratio", F.round("ratio", 6))


@query("r25_gap_tokens", f"WITH {COVERAGE_SQL} SELECT student_id, string_agg(display, '|' ORDER BY display) AS tokens FROM anchors JOIN job_tokens USING (job_id) ANTI JOIN reach USING (student_id, key) GROUP BY 1")
def r25(spark, d):
    p = parts(spark, d)
    return C.gap_tokens(p["anchors"], p["job_tokens"], p["reach"]).withColumn("tokens", F.array_join("tokens", "|"))
