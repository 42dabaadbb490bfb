"""Registered queries: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathmill.operators import aggregates as A
from pathmill.plans.bindings import COURSES_SQL, JOBS_SQL, POSTINGS_SQL, TAUGHT_SQL, TRACKS_SQL, courses, postings, taught, tracks
from pathmill.registry import query
from pathmill.session import table


def joined(c, sep="|"):
    return F.array_join(c, sep)


@query("a01_latest_per_key", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def a01(spark, d):
    return A.latest_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


@query("a02_first_by_content", r"""
    SELECT doc_id FROM documents QUALIFY regexp_replace(text, '^\s+|\s+$', '', 'g') = '' OR row_number() OVER (PARTITION BY regexp_replace(text, '^\s+|\s+$', '', 'g') ORDER BY doc_id) = 1
""")
def a02(spark, d):
    return A.first_by_content(table(spark, d, "documents").select("doc_id", "text"), F.col("text"), "doc_id").select("doc_id")


@query("a03_duplicate_groups", r"""
    WITH h AS (SELECT doc_id, source, sha256(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS hash FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY source, doc_id) AS rn FROM h)
    SELECT hash, max(CASE WHEN rn = 1 THEN doc_id END) AS keep, count(*) AS n, string_agg(CASE WHEN rn > 1 THEN doc_id::VARCHAR END, '|' ORDER BY rn) AS duplicates FROM r GROUP BY hash HAVING count(*) > 1
""")
def a03(spark, d):
    groups = A.duplicate_groups(table(spark, d, "documents"), F.col("text"), F.col("source"), F.col("doc_id"))
    return groups.withColumn("duplicates", joined(F.transform("duplicates", lambda x: x.cast("string")))).withColumn("n", F.col("n").cast("long"))


@query("a04_tag_frequency", f"WITH {POSTINGS_SQL} SELECT category, token, count(*) AS n, postings FROM postings JOIN (SELECT category, count(DISTINCT posting_id) AS postings FROM postings GROUP BY 1) USING (category) GROUP BY ALL")
def a04(spark, d):
    return A.tag_frequency(postings(spark, d), "category", "posting_id", "token")


COMPOUNDS = {"low": ["Brand#1", "Brand#2"], "high": ["Brand#20", "Brand#21", "Brand#22"]}
_compound_sql = "VALUES " + ", ".join(f"('{n}', '{p.lower()}')" for n, ps in COMPOUNDS.items() for p in ps)


def _parts(spark):
    return spark.createDataFrame([(n, p.lower()) for n, ps in COMPOUNDS.items() for p in ps], "name string, part string")


@query("a05_any_of_count", f"WITH {POSTINGS_SQL}, c(name, part) AS ({_compound_sql}) SELECT category, name, count(DISTINCT posting_id) AS n FROM postings JOIN c ON token = part GROUP BY ALL")
def a05(spark, d):
    return A.any_of_count(postings(spark, d), _parts(spark), "category", "posting_id", "token")


@query("a06_merge_curated", f"""
    WITH {POSTINGS_SQL}, parts(name, part) AS ({_compound_sql}),
    cats AS (SELECT DISTINCT category FROM postings),
    curated AS (SELECT category, name, 'tool' AS type, importance FROM cats, (VALUES ('low', 'must'), ('high', 'may'), ('brand#5', 'may'), ('absent', NULL)) v(name, importance)),
    counts AS (SELECT category, name, count(DISTINCT posting_id) AS n FROM postings JOIN parts ON token = part GROUP BY ALL
               UNION ALL SELECT category, 'brand#5', count(*) FROM postings WHERE token = 'brand#5' GROUP BY ALL),
    listed AS (SELECT category, name, type, importance, coalesce(n, 0) AS n FROM curated LEFT JOIN counts USING (category, name)),
    extra AS (SELECT category, token AS name, 'extra' AS type, NULL AS importance, count(*) AS n FROM postings WHERE token NOT IN (SELECT part FROM parts) AND token NOT IN ('low', 'high', 'brand#5', 'absent') GROUP BY category, token),
    totals AS (SELECT category, count(DISTINCT posting_id) AS postings FROM postings GROUP BY 1)
    SELECT category, name, type, importance, n, round_even(n / postings::DOUBLE, 4) AS rate,
           row_number() OVER (PARTITION BY category ORDER BY CASE importance WHEN 'must' THEN 0 WHEN 'may' THEN 1 ELSE 2 END, n DESC, name) AS place
    FROM (SELECT * FROM listed UNION ALL SELECT * FROM extra) JOIN totals USING (category)
""")
def a06(spark, d):
    rows = postings(spark, d)
    listed = spark.createDataFrame([("low", "tool", "must"), ("high", "tool", "may"), ("brand#5", "tool", "may"), ("absent", "tool", None)], "name string, type string, importance string")
    curated = rows.select("category").distinct().join(F.broadcast(listed))  # four fixed rows
    return A.merge_curated(curated, _parts(spark), rows, "category", "posting_id", "token", {"must": 0, "may": 1})


@query("a07_group_evidence", f"""
    WITH {TAUGHT_SQL}, totals AS (SELECT track_id, count(DISTINCT course_id) AS of_track FROM taught GROUP BY 1)
    SELECT track_id, brand, string_agg(DISTINCT course_id, '|' ORDER BY course_id) AS items, count(DISTINCT course_id) AS n, round_even(count(DISTINCT course_id) / any_value(of_track)::DOUBLE, 4) AS rate
    FROM taught JOIN totals USING (track_id) GROUP BY track_id, brand
""")
def a07(spark, d):
    return A.group_evidence(taught(spark, d), "track_id", "course_id", "brand").withColumn("items", joined("items")).withColumn("n", F.col("n").cast("long"))


@query("a08_top_tokens", f"WITH {JOBS_SQL} SELECT category, token, n, rn, CASE WHEN rn <= 8 THEN 'main' ELSE 'fallback' END AS slot FROM ranked WHERE rn <= 20")
def a08(spark, d):
    return A.top_tokens(postings(spark, d), "category", "posting_id", "token", 8, 12)


HITS_SQL = """
    hits AS (
        SELECT o_orderkey AS hit_ord, o_orderpriority AS job_id, round(o_totalprice / 1000, 0) AS score, o_orderstatus AS name, o_orderdate::VARCHAR AS text,
               CASE o_orderstatus WHEN 'F' THEN ['brand#1', 'brand#2'] WHEN 'O' THEN ['brand#2', 'brand#3'] ELSE [] END AS main,
               CASE o_orderstatus WHEN 'F' THEN ['brand#1', 'x1', 'x2'] ELSE ['x3'] END AS fallback, tags
        FROM orders JOIN (SELECT l_orderkey, list(p_brand ORDER BY l_linenumber, p_brand) AS tags FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_orderkey = o_orderkey
    )"""


def _hits(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    tags = lines.groupBy("l_orderkey").agg(A.ordered_list(F.col("p_brand"), "l_linenumber", "p_brand").alias("tags"))
    orders = table(spark, d, "orders").join(tags, F.col("o_orderkey") == F.col("l_orderkey"))
    status = F.col("o_orderstatus")
    lists = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    return orders.select(
        F.col("o_orderkey").alias("hit_ord"), F.col("o_orderpriority").alias("job_id"), F.round(F.col("o_totalprice") / 1000, 0).alias("score"), status.alias("name"), F.col("o_orderdate").cast("string").alias("text"),
        F.when(status == "F", lists("brand#1", "brand#2")).when(status == "O", lists("brand#2", "brand#3")).otherwise(lists()).alias("main"),
        F.when(status == "F", lists("brand#1", "x1", "x2")).otherwise(lists("x3")).alias("fallback"), "tags",
    )


@query("a09_roll_up_hits", f"""
    WITH {HITS_SQL},
    best AS (SELECT job_id, name, score FROM hits QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY score DESC, hit_ord) = 1),
    mains AS (SELECT job_id, m, min((hit_ord, pos)) AS seen FROM (SELECT job_id, hit_ord, unnest(main) AS m, generate_subscripts(main, 1) AS pos FROM hits) GROUP BY ALL),
    tech AS (SELECT job_id, string_agg(m, '|' ORDER BY seen) AS tech_stacks FROM mains GROUP BY 1),
    totals AS (SELECT job_id, count(*) AS posting_count, min(hit_ord) AS first FROM hits GROUP BY 1)
    SELECT job_id, name, score, tech_stacks, posting_count, row_number() OVER (ORDER BY score DESC, first) AS place FROM best JOIN tech USING (job_id) JOIN totals USING (job_id) QUALIFY place <= 4
""")
def a09(spark, d):
    return A.roll_up_hits(_hits(spark, d), 4).select("job_id", "name", "score", joined("tech_stacks").alias("tech_stacks"), "posting_count", "place")


TAGS_SQL = f"""{HITS_SQL},
    each AS (SELECT DISTINCT ON (job_id, hit_ord, tag) job_id, hit_ord, tag, pos FROM (SELECT job_id, hit_ord, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM hits) ORDER BY job_id, hit_ord, tag, pos),
    counted AS (SELECT job_id, tag, count(*) AS n, min((hit_ord, pos)) AS seen FROM each GROUP BY ALL),
    mains AS (SELECT DISTINCT job_id, unnest(main) AS m FROM hits),
    observed AS (SELECT job_id, list(tag ORDER BY n DESC, seen) AS tags FROM counted c WHERE NOT EXISTS (SELECT 1 FROM mains WHERE mains.job_id = c.job_id AND lower(m) = lower(tag)) GROUP BY 1)"""


@query("a10_frequency_ranking", f"WITH {TAGS_SQL} SELECT job_id, array_to_string(tags, '|') AS tags FROM observed")
def a10(spark, d):
    return A.roll_up_hits(_hits(spark, d), 1_000_000, 0).select("job_id", joined("competency_tags").alias("tags"))


@query("a11_backfill", f"""
    WITH {TAGS_SQL},
    fills AS (SELECT job_id, f, min((hit_ord, pos)) AS seen FROM (SELECT job_id, hit_ord, unnest(fallback) AS f, generate_subscripts(fallback, 1) AS pos FROM hits) GROUP BY ALL),
    more AS (SELECT job_id, list(f ORDER BY seen) AS fill FROM fills WHERE NOT EXISTS (SELECT 1 FROM mains WHERE mains.job_id = fills.job_id AND lower(m) = lower(f)) GROUP BY 1)
    SELECT job_id, array_to_string(list_concat(tags, fill[1:greatest(0, 26 - len(tags))]), '|') AS tags FROM observed JOIN more USING (job_id)
""")
def a11(spark, d):
    return A.roll_up_hits(_hits(spark, d), 1_000_000, 26).select("job_id", joined("competency_tags").alias("tags"))


@query("a12_change_in_counts", "SELECT coalesce(a.lang, b.lang) AS lang, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after, coalesce(n_after, 0) - coalesce(n_before, 0) AS delta FROM (SELECT lang, count(*) AS n_before FROM documents GROUP BY 1) a FULL JOIN (SELECT lang, count(*) AS n_after FROM documents WHERE n_chars >= 1000 GROUP BY 1) b ON a.lang = b.lang")
def a12(spark, d):
    docs = table(spark, d, "documents").select("lang", "n_chars")
    return A.change_in_counts(docs, docs.where("n_chars >= 1000"), "lang")


@query("a13_merge_courses", """
    WITH r AS (SELECT l_partkey AS course_id, l_suppkey AS track_id, (l_orderkey * 100 + l_linenumber) * 1000000 + l_suppkey AS ord, p_name AS course_name, 2 + p_size % 2 AS credits, p_type AS course_type,
                      CASE WHEN l_returnflag = 'R' THEN l_linenumber % 5 END AS grade, CASE WHEN l_returnflag = 'A' THEN l_linenumber END AS semester FROM lineitem JOIN part ON l_partkey = p_partkey),
    t AS (SELECT course_id, track_id, min(ord) AS ord FROM r GROUP BY ALL), tl AS (SELECT course_id, string_agg(track_id::VARCHAR, '|' ORDER BY ord) AS track_ids FROM t GROUP BY 1),
    g AS (SELECT course_id, any_value(course_name) AS course_name, any_value(credits) AS credits, any_value(course_type) AS course_type,
                 coalesce(list_sort(list(DISTINCT grade) FILTER (WHERE grade IS NOT NULL)), [1, 2, 3, 4]) AS grades, coalesce(list_sort(list(DISTINCT semester) FILTER (WHERE semester IS NOT NULL)), [1, 2, 3, 4, 5, 6, 7, 8]) AS semesters FROM r GROUP BY 1)
    SELECT course_id, course_name, credits, course_type, track_ids, array_to_string(grades, '|') AS grades, array_to_string(semesters, '|') AS semesters,
           ['foundation', 'core', 'application', 'industry'][greatest(1, least(4, grades[1]))] AS stage FROM g JOIN tl USING (course_id)
""")
def a13(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(
        F.col("l_partkey").alias("course_id"), F.col("l_suppkey").alias("track_id"), ((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 1000000 + F.col("l_suppkey")).alias("ord"), F.col("p_name").alias("course_name"), (2 + F.col("p_size") % 2).alias("credits"),
        F.col("p_type").alias("course_type"), F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") % 5).alias("grade"), F.when(F.col("l_returnflag") == "A", F.col("l_linenumber")).alias("semester"),
    )
    text = lambda c: joined(F.transform(c, lambda x: x.cast("string")))
    merged = A.merge_courses(rows, ["foundation", "core", "application", "industry"])
    return merged.withColumns({c: text(c) for c in ("track_ids", "grades", "semesters")})


@query("a15_token_index", f"""
    WITH {COURSES_SQL}, t AS (SELECT lower(course_name) AS key, t AS token, min((course_id, pos)) AS seen FROM (SELECT course_id, course_name, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS pos FROM courses) GROUP BY ALL)
    SELECT key, string_agg(token, '|' ORDER BY seen) AS tokens FROM t GROUP BY key
""")
def a15(spark, d):
    return A.token_index(courses(spark, d), "course_name", "tokens", "course_id").withColumn("tokens", joined("tokens"))


@query("a16_union_per_item", f"""
    WITH {COURSES_SQL}, f AS (SELECT 'P' || lpad(l_partkey::VARCHAR, 7, '0') AS course_id, lower(l_shipmode) AS token FROM (SELECT l_partkey, l_linestatus || l_returnflag AS l_shipmode FROM lineitem))
    SELECT course_id, coalesce(string_agg(DISTINCT token, '|' ORDER BY token), '') AS tokens FROM courses LEFT JOIN f USING (course_id) GROUP BY course_id
""")
def a16(spark, d):
    found = table(spark, d, "lineitem").select(F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")).alias("course_id"), F.lower(F.concat("l_linestatus", "l_returnflag")).alias("token"))
    return A.union_per_item(courses(spark, d).select("course_id"), found, "course_id", "token").withColumn("tokens", joined("tokens"))


@query("a17_track_tokens", f"WITH {TRACKS_SQL}, {COURSES_SQL.lstrip()} SELECT track_id, coalesce(string_agg(DISTINCT token, '|' ORDER BY token), '') AS tokens FROM (SELECT track_id, unnest(course_ids) AS course_id FROM tracks) JOIN (SELECT course_id, unnest(tokens) AS token FROM courses) USING (course_id) RIGHT JOIN (SELECT track_id FROM tracks) USING (track_id) GROUP BY track_id")
def a17(spark, d):
    listed = tracks(spark, d).select("track_id", F.explode("course_ids").alias("course_id"))
    tokens = courses(spark, d).select("course_id", F.explode("tokens").alias("token"))
    return A.union_per_item(tracks(spark, d).select("track_id"), listed.join(tokens, "course_id"), "track_id", "token").withColumn("tokens", joined("tokens"))


@query("a18_centred_means", """
    WITH d AS (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, dim, avg(x) AS x FROM d GROUP BY ALL),
    u AS (SELECT label, dim, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-12) AS x FROM m), c AS (SELECT label, dim, x - avg(x) OVER (PARTITION BY dim) AS x FROM u)
    SELECT label, dim - 1 AS dim, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-12), 6) AS x FROM c
""")
def a18(spark, d):
    return A.centred_means(table(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("vector").alias("dim", "x"))


@query("a19_first_known", "SELECT p_name, arg_min(v, (u, p_partkey)) AS v FROM (SELECT p_name, p_partkey, CASE WHEN p_size > 40 THEN p_type ELSE 'null' END AS v, NOT p_size > 40 AS u FROM part) GROUP BY p_name")
def a19(spark, d):
    rows = table(spark, d, "part").select("p_name", "p_partkey", F.when(F.col("p_size") > 40, F.col("p_type")).otherwise("null").alias("v"))
    return A.first_known(rows, "p_name", "v", "p_partkey")


@query("a20_joined_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def a20(spark, d):
    return A.joined_text(table(spark, d, "conversations"), "conv_id", "text", "turn")


@query("a21_unique_names", """
    WITH r AS (SELECT p_partkey, p_name AS name, lower(p_type) AS suffix, count(*) OVER (PARTITION BY p_name) AS n, row_number() OVER (PARTITION BY p_name, p_type ORDER BY p_partkey) AS k FROM part),
    c AS (SELECT name, count(DISTINCT suffix) AS nd FROM r GROUP BY 1)
    SELECT p_partkey, CASE WHEN n = 1 THEN name WHEN n = nd OR k = 1 THEN name || '_' || suffix ELSE name || '_' || suffix || k END AS new_name FROM r JOIN c USING (name)
""")
def a21(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.lower("p_type").alias("suffix"))
    return A.unique_names(rows, "name", "suffix", "p_partkey").select("p_partkey", "new_name")


@query("a22_catalog_gaps", "SELECT s_suppkey, CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey * 3 = s_suppkey) THEN 'not sold' ELSE 'college left out' END AS reason FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0 OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey * 3 = s_suppkey)")
def a22(spark, d):
    """Lines name every third supplier, so that the others count as not sold."""
    listed = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    sold = table(spark, d, "lineitem").select((F.col("l_suppkey") * 3).alias("s_suppkey"), F.lit(True).alias("sold")).distinct()
    rows = listed.join(sold, "s_suppkey", "left").where("n_regionkey = 0 or sold is null")
    return rows.select("s_suppkey", F.when(F.col("sold").isNull(), "not sold").otherwise("college left out").alias("reason"))


@query("a23_relation_report", "SELECT l_returnflag AS predicate, count(*) AS n, count(DISTINCT l_suppkey) AS subjects, sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END)::BIGINT AS confident FROM lineitem GROUP BY 1")
def a23(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("predicate"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("subjects"), F.count_if(F.col("l_discount") >= 0.05).alias("confident"))


@query("a24_coverage_distribution", """
    SELECT l_returnflag, count(*) AS n, round(sum(CASE WHEN l_discount > 0 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS positive, round(avg(l_discount), 6) AS mean, max(l_discount) AS greatest, round(stddev_pop(l_discount), 6) AS deviation FROM lineitem GROUP BY 1
""")
def a24(spark, d):
    found = A.coverage_distribution(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount")
    return found.withColumns({c: F.round(c, 6) for c in ("positive", "mean", "deviation")})


@query("a25_counts_by_type", "SELECT source, lang, count(*) AS n, sum(CASE WHEN n_chars < 300 THEN 1 ELSE 0 END)::BIGINT AS skipped FROM documents GROUP BY ALL")
def a25(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") < 300).alias("skipped"))


@query("a26_dominant_value", "SELECT l_suppkey, l_returnflag, n FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) = 1")
def a26(spark, d):
    order = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return A.dominant_value(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", order)


@query("a27_turns_per_thread", "SELECT conv_id, count(*) AS n, arg_max(text, turn) AS last_text FROM conversations GROUP BY 1")
def a27(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("text", "turn").alias("last_text"))
