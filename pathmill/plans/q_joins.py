"""Registered queries: lookups, merges, set operations, windows over histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathmill.operators import joins as J
from pathmill.operators.tokens import first_seen
from pathmill.plans.bindings import JOBS_SQL, TRACKS_SQL, courses, jobs, tracks
from pathmill.registry import query
from pathmill.session import parts_of, table


@query("j01_not_collected", "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error' AND (user_id, event_type) NOT IN (SELECT (user_id, 'click') FROM events WHERE value > 60)")
def j01(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    old = events.where("value > 60").select("user_id", F.lit("click").alias("event_type"))
    return J.not_collected(events.where("event_type <> 'error'"), old, ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


MAPPING = [("1-URGENT", "U"), ("2-HIGH", "H"), ("5-LOW", "L")]
_mapping_sql = "m(source, target) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in MAPPING) + ")"


@query("j02_mapped_only", f"WITH {_mapping_sql} SELECT o_orderkey, target AS job_id FROM orders JOIN m ON o_orderpriority = source")
def j02(spark, d):
    mapping = spark.createDataFrame(MAPPING, "source string, target string")
    return table(spark, d, "orders").join(mapping, F.col("o_orderpriority") == F.col("source")).select("o_orderkey", F.col("target").alias("job_id"))


@query("j03_mapped_or_kept", f"WITH {_mapping_sql} SELECT o_orderkey, coalesce(target, o_orderpriority) AS o_orderpriority FROM orders LEFT JOIN m ON o_orderpriority = source")
def j03(spark, d):
    return J.map_or_keep(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), spark.createDataFrame(MAPPING, "source string, target string"), "o_orderpriority")


@query("j04_name_keyed_join", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON lower(replace(s_name, 'Supplier#', '')) = lower(replace(c_name, 'Customer#', '')) WHERE s_acctbal > 0")
def j04(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey", F.lower(F.regexp_replace("s_name", "^Supplier#", "")).alias("key"))
    c = table(spark, d, "customer").select("c_custkey", F.lower(F.regexp_replace("c_name", "^Customer#", "")).alias("key"))
    return s.join(c, "key").select("s_suppkey", "c_custkey")


@query("j05_join_with_misses", "SELECT p_partkey, count(l_partkey) AS n, count(l_partkey) = 0 AS missed FROM part LEFT JOIN lineitem ON l_partkey + 300 = p_partkey GROUP BY 1")
def j05(spark, d):
    sold = table(spark, d, "lineitem").select((F.col("l_partkey") + 300).alias("l_partkey"))  # the first 300 parts are missed
    rows = table(spark, d, "part").select("p_partkey").join(sold, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("p_partkey").agg(F.count("l_partkey").alias("n"))
    return rows.withColumn("missed", F.col("n") == 0)


@query("j07_membership_select", f"WITH {TRACKS_SQL}, wanted AS (SELECT DISTINCT unnest(course_ids) AS course_id FROM tracks WHERE college_id = 'C1') SELECT p_partkey FROM part WHERE 'P' || lpad(p_partkey::VARCHAR, 7, '0') IN (SELECT course_id FROM wanted)")
def j07(spark, d):
    wanted = tracks(spark, d).where("college_id = 'C1'").select(F.explode("course_ids").alias("course_id"))
    return courses(spark, d).join(wanted, "course_id", "left_semi").select(F.substring("course_id", 2, 9).cast("long").alias("p_partkey"))


@query("j08_resolved_names", """
    WITH c AS (SELECT p_partkey AS course_id, p_name AS name, [p_size % 5, p_partkey % 3 + 10] AS tracks FROM part),
    w AS (SELECT course_id, tracks, (SELECT p_name FROM part p WHERE p.p_partkey = c.course_id // 2) AS wanted FROM c),
    m AS (SELECT w.course_id, c.course_id AS needs, row_number() OVER (PARTITION BY w.course_id ORDER BY len(list_intersect(w.tracks, c.tracks)) DESC, c.course_id) AS rn FROM w JOIN c ON lower(replace(w.wanted, ' ', '')) = lower(replace(c.name, ' ', '')) AND w.course_id <> c.course_id)
    SELECT course_id, needs FROM m WHERE rn = 1
""")
def j08(spark, d):
    part = table(spark, d, "part")
    catalog = part.select(F.col("p_partkey").alias("course_id"), F.col("p_name").alias("course_name"), F.array((F.col("p_size") % 5).cast("long"), F.col("p_partkey") % 3 + 10).alias("track_ids"), F.col("p_partkey").alias("ord"))
    names = part.select(F.col("p_partkey").alias("half"), F.initcap("p_name").alias("name"))
    wanted = part.select(F.col("p_partkey").alias("course_id"), F.floor(F.col("p_partkey") / 2).cast("long").alias("half")).join(names, "half").select("course_id", "name", F.lit(0).alias("ord"))
    key = lambda c: F.lower(F.regexp_replace(c, r"[()（）\s]", ""))
    return J.resolve_names(catalog, wanted, key)[0].select("course_id", "needs")


@query("j09_official_or_alias", """
    WITH w AS (SELECT p_name AS course, unnest([p_brand, p_type, 'none', p_name]) AS raw FROM part),
    r AS (SELECT course, CASE WHEN raw IN ('Brand#1', 'Brand#2') THEN upper(raw) WHEN raw = 'SMALL' THEN 'tiny' WHEN raw LIKE '% ring' THEN raw END AS needs FROM w)
    SELECT course, coalesce(string_agg(DISTINCT needs, '|' ORDER BY needs) FILTER (WHERE needs <> course), '') AS needs FROM r GROUP BY 1
""")
def j09(spark, d):
    part = table(spark, d, "part")
    wanted = part.select(F.col("p_name").alias("course"), F.explode(F.array("p_brand", "p_type", F.lit("none"), "p_name")).alias("raw"))
    rings = part.where("p_name like '% ring'").select(F.col("p_name").alias("key"), F.col("p_name").alias("name")).distinct()
    official = rings.unionByName(spark.createDataFrame([("Brand#1", "BRAND#1"), ("Brand#2", "BRAND#2")], "key string, name string"))
    aliases = spark.createDataFrame([("SMALL", "tiny"), ("none", None)], "key string, target string")
    return J.official_or_alias(wanted, official, aliases, part.select(F.col("p_name").alias("course")).distinct()).withColumn("needs", F.array_join("needs", "|"))


@query("j11_by_id_else_name", """
    WITH f AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END AS id, 'Supplier#' || lpad((l_suppkey + 1)::VARCHAR, 9, '0') AS name, max(l_quantity) AS value FROM lineitem GROUP BY l_suppkey),
    n AS (SELECT name, min(value) AS value FROM f GROUP BY 1)
    SELECT s_suppkey, coalesce(i.value, n.value) AS value, CASE WHEN i.value IS NOT NULL THEN 'id' WHEN n.value IS NOT NULL THEN 'name' ELSE 'none' END AS found_by FROM supplier LEFT JOIN f i ON i.id = s_suppkey LEFT JOIN n ON n.name = s_name
""")
def j11(spark, d):
    k = F.col("l_suppkey")
    features = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_quantity").alias("value"))
    features = features.select(F.when(k % 2 == 0, k).alias("s_suppkey"), F.concat(F.lit("Supplier#"), F.lpad((k + 1).cast("string"), 9, "0")).alias("s_name"), "value")
    return J.by_id_else_name(table(spark, d, "supplier").select("s_suppkey", "s_name"), features, "s_suppkey", "s_name", "value").select("s_suppkey", "value", "found_by")


@query("j12_label_join", "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j12(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("j13_ordered_lookup", """
    WITH e AS (SELECT l_orderkey AS request_id, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey ELSE -l_partkey END AS wanted FROM lineitem),
    r AS (SELECT request_id, wanted, min((l_linenumber, wanted)) AS pos FROM e GROUP BY ALL)
    SELECT request_id, p_partkey, p_size AS card, row_number() OVER (PARTITION BY request_id ORDER BY pos, p_size) AS place FROM r JOIN part ON wanted = p_partkey
""")
def j13(spark, d):
    wanted = F.when(F.col("l_linenumber") % 2 == 1, F.col("l_partkey")).otherwise(-F.col("l_partkey"))  # every second id is unknown
    n = parts_of(spark, d, "lineitem")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition(n, "l_orderkey").groupBy(F.col("l_orderkey").alias("request_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", wanted.alias("id")))), lambda x: x["id"]).alias("wanted"))
    return J.in_request_order(lines, table(spark, d, "part").select("p_partkey", F.col("p_size").alias("card")), "p_partkey", n)


@query("j14_token_overlap", f"WITH {TRACKS_SQL}, {JOBS_SQL.lstrip()} SELECT track_id, job_id, len(list_intersect(tech, job_keys)) AS shared FROM tracks, jobs WHERE len(list_intersect(tech, job_keys)) > 0")
def j14(spark, d):
    left = tracks(spark, d).select("track_id", F.explode("tech").alias("token"))
    return J.token_overlap(left, jobs(spark, d).select("job_id", F.explode("job_keys").alias("token")), "track_id", "job_id", "token")


@query("j15_merged_membership", "WITH r AS (SELECT p_partkey AS key, lower(p_type) AS tag FROM part UNION SELECT l_partkey, l_returnflag FROM lineitem) SELECT key, string_agg(tag, '|' ORDER BY tag) AS tags FROM r GROUP BY 1")
def j15(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.array(F.lower("p_type")).alias("tags"))
    members = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("tag"))
    return J.merge_membership(rows, members, "key", "tag")


@query("j16_bound_texts", "WITH f AS (SELECT l_partkey, arg_min(l_shipdate::VARCHAR, (l_orderkey, l_linenumber, l_shipdate)) AS text FROM lineitem GROUP BY 1) SELECT p_partkey, coalesce(text, p_name || ' of ' || p_brand) AS text FROM part LEFT JOIN f ON l_partkey = p_partkey")
def j16(spark, d):
    texts = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.struct("l_orderkey", "l_linenumber").alias("ord"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("text"))
    return J.bind_texts(table(spark, d, "part"), texts, "p_partkey", F.concat("p_name", F.lit(" of "), "p_brand")).select("p_partkey", "text")


@query("j17_tokens_of_names", """
    WITH i AS (SELECT lower(p_name) AS key, list_sort(list(DISTINCT lower(p_brand))) AS tokens FROM part GROUP BY 1),
    r AS (SELECT l_orderkey, l_linenumber * 1000000 + p_partkey AS seq, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey JOIN i ON key = lower(p_name)),
    f AS (SELECT l_orderkey, t, min((seq, pos)) AS seen FROM r GROUP BY ALL)
    SELECT l_orderkey, string_agg(t, '|' ORDER BY seen) AS tokens FROM f GROUP BY 1
""")
def j17(spark, d):
    part = table(spark, d, "part")
    index = part.groupBy(F.lower("p_name").alias("key")).agg(F.array_sort(F.collect_set(F.lower("p_brand"))).alias("tokens"))
    rows = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("p_partkey")).alias("seq"), F.concat(F.lit(" "), F.upper("p_name"), F.lit("\t")).alias("name"))
    return J.tokens_of_names(rows, index, "l_orderkey", "name", "seq").withColumn("tokens", F.array_join("tokens", "|")).where("tokens <> ''")


@query("w02_recent_history", """
    SELECT conv_id, turn, coalesce(string_agg('[' || role || '] ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '(none)') AS history FROM conversations
""")
def w02(spark, d):
    frame = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-10, -1)
    line = F.concat(F.lit("["), "role", F.lit("] "), "text")
    history = F.array_join(F.collect_list(line).over(frame), "\n")
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1, "(none)").otherwise(history).alias("history"))


@query("w05_first_n_per_list", "SELECT DISTINCT user_id FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= 200 AND user_id NOT IN (SELECT user_id FROM events WHERE value > 100)")
def w05(spark, d):
    events = table(spark, d, "events")
    seen = J.first_n_per_list(events.select("event_id", "user_id", "event_type"), "event_type", "event_id", 200).select("user_id").distinct()
    return J.not_collected(seen, events.where("value > 100").select("user_id"), ["user_id"])


@query("x01_tagged_union", "SELECT 'order' AS source, o_orderkey AS id, o_orderpriority AS tag FROM orders UNION ALL SELECT 'event', event_id, event_type FROM events")
def x01(spark, d):
    a = table(spark, d, "orders").select(F.lit("order").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tag"))
    return a.unionByName(table(spark, d, "events").select(F.lit("event").alias("source"), F.col("event_id").alias("id"), F.col("event_type").alias("tag")))


@query("x02_first_triple", "SELECT l_suppkey, l_returnflag, l_partkey, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def x02(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_partkey", "l_orderkey", "l_linenumber")
    return first_seen(rows, ["l_suppkey", "l_returnflag", "l_partkey"], ["l_orderkey", "l_linenumber"]).drop("l_linenumber")


@query("x04_name_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey * 2 FROM lineitem")
def x04(spark, d):
    return table(spark, d, "part").select("p_partkey").subtract(table(spark, d, "lineitem").select(F.col("l_partkey") * 2))


@query("j18_documents_of_courses", """
    WITH c AS (SELECT 'P' || p_partkey AS id, p_name, -p_partkey AS ord FROM part),
    d AS (SELECT p_partkey AS doc, p_name, CASE p_size % 3 WHEN 0 THEN 'v1_P' || p_partkey || '_2026.txt' WHEN 1 THEN 'P' || p_partkey || 'P' || (p_partkey + 7) || '.txt' ELSE 'notes_' || p_size || '.txt' END AS file FROM part),
    pieces AS (SELECT DISTINCT file, substr(file, i, n) AS id FROM d, unnest(generate_series(2, 12)) a(n), unnest(generate_series(1, length(file))) b(i)),
    by_id AS (SELECT file, arg_min(id, ord) AS id FROM pieces JOIN c USING (id) GROUP BY file),
    by_name AS (SELECT p_name, arg_min(id, ord) AS id FROM c GROUP BY 1)
    SELECT doc, coalesce(by_id.id, by_name.id) AS course_id FROM d LEFT JOIN by_id USING (file) LEFT JOIN by_name USING (p_name)
""")
def j18(spark, d):
    """Names with an id amid other characters, with two ids side by side, and with none; ids are prefixes of others."""
    part, k = table(spark, d, "part"), F.col("p_partkey")
    kind = F.col("p_size") % 3
    one, two = F.concat(F.lit("v1_P"), k, F.lit("_2026.txt")), F.concat(F.lit("P"), k, F.lit("P"), k + 7, F.lit(".txt"))
    docs = part.select(k.alias("doc"), F.when(kind == 0, one).when(kind == 1, two).otherwise(F.concat(F.lit("notes_"), "p_size", F.lit(".txt"))).alias("file"), F.col("p_name").alias("name"))
    catalog = part.select(F.concat(F.lit("P"), k).alias("course_id"), F.col("p_name").alias("course_name"), (-k).alias("ord"))
    return J.documents_of_courses(docs, catalog)
