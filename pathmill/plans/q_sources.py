"""Registered queries: scans, exports and the batch twins of incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pathmill.functions import text as X
from pathmill.lineage import new_dir
from pathmill.operators.joins import not_collected
from pathmill.plans.bindings import TRACKS_SQL, tracks
from pathmill.registry import query
from pathmill.session import table
from pathmill.sources import readers, writers
from pathmill.streaming import ingest


@query("s06_latest_snapshot", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def s06(spark, d):
    return readers.latest_snapshot(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("s09_flattened_export", "SELECT p_partkey, replace(p_name, ' ', ', ') AS tags, p_brand AS brand, p_size AS size FROM part")
def s09(spark, d):
    nested = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("tags"), F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("type")).alias("extra"))
    return writers.flattened(nested, keep=["brand", "size"])


@query("s11_checked_catalog", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size < 5 THEN 'size' END, CASE WHEN p_retailprice >= 1500 THEN 'price' END], lambda x: x IS NOT NULL), '|') AS broken FROM part WHERE p_size < 5 OR p_retailprice >= 1500")
def s11(spark, d):
    _, bad = readers.checked(table(spark, d, "part"), {"size": F.col("p_size") >= 5, "price": F.col("p_retailprice") < 1500})
    return bad.select("p_partkey", F.array_join("broken", "|").alias("broken"))


@query("s12_vector_side_table", f"WITH {TRACKS_SQL} SELECT track_id, coalesce(len(embedding), 0) AS dims, round(coalesce(embedding[1], 0)::DOUBLE, 6) AS first FROM tracks LEFT JOIN embeddings ON CAST(substr(track_id, 2) AS BIGINT) * 7 = vec_id")
def s12(spark, d):
    """Every seventh vector is a track's; the others have no track."""
    number = F.when(F.col("vec_id") % 7 == 0, F.lpad((F.col("vec_id") / 7).cast("long").cast("string"), 6, "0")).otherwise(F.col("vec_id").cast("string"))
    vectors = table(spark, d, "embeddings").select(F.concat(F.when(F.col("vec_id") % 7 == 0, "T").otherwise("V"), number).alias("track_id"), F.col("embedding").cast("array<double>").alias("meta_vector"))
    rows = readers.with_vectors(tracks(spark, d).select("track_id"), vectors, "track_id")
    return rows.select("track_id", F.size("meta_vector").cast("long").alias("dims"), F.round(F.coalesce(F.get("meta_vector", 0), F.lit(0.0)), 6).alias("first"))


#: Events come in four deliveries by their number; each is a file of the stream's folder.
DELIVERY_SQL = "(event_id * 4) // (SELECT max(event_id) + 1 FROM events)"
EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string"


def _deliveries(spark, d):
    """A stream over the events, delivery by delivery."""
    events = table(spark, d, "events").select(F.col("event_id").cast("long"), F.col("ts").cast("timestamp"), F.col("user_id").cast("long"), "event_type")
    last = events.agg(F.max("event_id")).first()[0] or 0
    path = new_dir(events, "deliveries")
    for k in range(4):
        events.where(F.floor(F.col("event_id") * 4 / (last + 1)) == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)


def _collected(spark, d):
    """The keys (user, type) of the deliveries, each the first time it comes; every fiftieth user has no id."""
    path = new_dir(table(spark, d, "region"), "unseen")
    stream = _deliveries(spark, d).withColumn("source_id", F.when(F.col("user_id") % 50 != 0, F.col("user_id"))).select("source_id", "event_type")
    ingest.wait(*ingest.collect_new(stream, path, f"{path}/checkpoint", ["source_id", "event_type"], F.lit(False)))
    return path


@query("i01_incremental_dedupe", "SELECT DISTINCT user_id::BIGINT AS source_id, event_type FROM events WHERE user_id % 50 <> 0")
def i01(spark, d):
    return ingest.rows_of(spark, _collected(spark, d))


@query("i01_ingest_counts", f"""
    WITH e AS (SELECT {DELIVERY_SQL} AS batch, user_id, event_type, nullif(user_id % 50, 0) IS NULL AS failed FROM events),
    f AS (SELECT user_id, event_type, min(batch) AS batch FROM e WHERE NOT failed GROUP BY ALL),
    n AS (SELECT batch, count(*) AS collected FROM f GROUP BY 1)
    SELECT batch, count(*) AS read, coalesce(any_value(collected), 0) AS collected, count(*) - coalesce(any_value(collected), 0) - count(*) FILTER (WHERE failed) AS skipped, count(*) FILTER (WHERE failed) AS failed
    FROM e LEFT JOIN n USING (batch) GROUP BY batch
""")
def i01_counts(spark, d):
    """How many rows of each delivery were collected, skipped as seen before, or failed for want of an id."""
    return ingest.counts(spark, _collected(spark, d))


@query("i02_progress", f"""
    WITH n AS (SELECT event_type, {DELIVERY_SQL} AS b, count(*) AS n FROM events GROUP BY ALL),
    c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY event_type) AS whole FROM n)
    SELECT event_type, least(1200, any_value(whole))::BIGINT AS collected, (CASE WHEN any_value(whole) >= 1200 THEN sum(n) FILTER (WHERE before < 1200) ELSE 2 * any_value(whole) END)::BIGINT AS found,
           1200 AS target, CASE WHEN any_value(whole) >= 1200 THEN 'done' ELSE 'open' END AS status FROM c GROUP BY 1
""")
def i02(spark, d):
    """Deliveries are appended until a type has its 1,200 rows; a second run over the same deliveries adds nothing."""
    stream = _deliveries(spark, d)
    path = new_dir(table(spark, d, "region"), "collected")
    for k in range(2):
        ingest.append_quota(stream, path, f"{path}/checkpoint-{k}", ["event_id"], "event_type", 1200).awaitTermination()
    return ingest.last_progress(spark, path)


@query("i02_collected_rows", f"""
    WITH e AS (SELECT event_id, event_type, {DELIVERY_SQL} AS b FROM events)
    SELECT event_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY b, event_id) <= 1200
""")
def i02_rows(spark, d):
    path = new_dir(table(spark, d, "region"), "collected")
    ingest.append_quota(_deliveries(spark, d), path, f"{path}/checkpoint", ["event_id"], "event_type", 1200).awaitTermination()
    return ingest.rows_of(spark, path).select("event_id", "event_type")


@query("i03_newest_version", "SELECT user_id::BIGINT AS user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def i03(spark, d):
    stream = _deliveries(spark, d).select("user_id", "event_id", "ts")
    path = new_dir(table(spark, d, "region"), "newest")
    ingest.upsert_newest(stream, path, f"{path}/checkpoint", "user_id", "ts", "event_id").awaitTermination()
    return ingest.newest_rows(spark, path)


@query("s10_document_table", "SELECT lang AS doc_type, lang || '_' || source || '_' || doc_id || '.txt' AS doc_path, md5(text) AS digest FROM documents WHERE lang IS NOT NULL")
def s10(spark, d):
    """Documents written as a table by type and read back."""
    path_of = F.concat(F.col("lang"), F.lit("_"), X.safe_name(F.col("source")), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = table(spark, d, "documents").where("lang is not null").select(F.col("lang").alias("doc_type"), path_of.alias("doc_path"), "text")
    path = new_dir(rows, "documents")
    writers.write_documents(rows, path)
    return spark.read.parquet(path).select("doc_type", "doc_path", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("j01_against_earlier_batch", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-10')")
def j01_batch(spark, d):
    events = table(spark, d, "events")
    cut = F.to_timestamp(F.lit("2024-01-10"))
    return not_collected(events.where(F.col("ts") >= cut), events.where(F.col("ts") < cut), ["user_id"]).select("event_id")


def _order_arrays(spark, d):
    """Folder of files that hold an array of orders each, one folder per block, and one file that holds none."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    path = new_dir(orders, "arrays")
    block = F.floor(F.col("o_orderkey") / 5000)
    arrays = orders.groupBy(block.alias("block")).agg(F.to_json(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("value"))
    arrays.unionByName(spark.createDataFrame([(-1, '{"not": "an array"}')], "block bigint, value string")).write.partitionBy("block").text(path)
    return path


ORDER = StructType().add("o_orderkey", "long").add("o_orderpriority", "string")


@query("s01_json_arrays", "SELECT o_orderkey, o_orderpriority FROM orders")
def s01(spark, d):
    """Orders written as files that each hold one array of objects, and read back."""
    return readers.read_json_arrays(spark, _order_arrays(spark, d), ORDER)[0]


@query("s04_job_feed", """
    SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'J' || o_orderkey ELSE o_orderkey::VARCHAR END AS source_id, CASE WHEN o_orderkey % 4 = 0 THEN 'any' ELSE o_orderpriority END AS category, o_clerk AS title
    FROM (SELECT *, 'order ' || o_custkey AS o_clerk FROM orders) WHERE o_orderkey % 5 <> 0
""")
def s04(spark, d):
    """Orders written as an XML feed; each fifth has no id, each third a job code, each fourth the category "other"."""
    k = F.col("o_orderkey")
    field = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    number, code = F.when(k % 5 != 0, k.cast("string")).otherwise(" "), F.when((k % 5 != 0) & (k % 3 == 0), F.concat(F.lit("J"), k.cast("string"))).otherwise("")
    category = F.when(k % 4 == 0, "기타").otherwise(F.col("o_orderpriority"))
    xml = F.concat(F.lit("<job>"), field("id", number), field("job_code", code), field("category", category), field("title", F.concat(F.lit("order "), F.col("o_custkey").cast("string"))), F.lit("</job>"))
    orders = table(spark, d, "orders")
    path = new_dir(orders, "feed")
    feeds = orders.groupBy(F.floor(k / 5000).alias("block")).agg(F.concat(F.lit("<jobs>"), F.array_join(F.collect_list(xml), "\n"), F.lit("</jobs>")).alias("value"))
    feeds.write.partitionBy("block").text(path)
    feed = StructType().add("id", "string").add("job_code", "string").add("category", "string").add("title", "string")
    return readers.read_job_feed(spark, path, feed, "any").select("source_id", "category", "title")


@query("s05_overlapping_patterns", "SELECT o_orderkey, o_orderpriority FROM orders")
def s05(spark, d):
    """Patterns that overlap, a folder and one that matches nothing: each file is read once."""
    path = _order_arrays(spark, d)
    files = readers.matching_files(spark, [f"{path}/block=[0-4]*", f"{path}/block=*", path, f"{path}/none-*"])
    return readers.read_json_arrays(spark, files, ORDER)[0]


@query("s02_csv_scan", "SELECT p_partkey, p_name || chr(10) || '\"q\", ' || p_brand AS label FROM part")
def s02(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit('\n"q", '), "p_brand").alias("label"))
    path = new_dir(rows, "csv")
    writers.write_postings_csv(rows, path, ["p_partkey", "label"])
    return readers.read_csv(spark, path, rows.schema)


@query("s03_text_scan", "SELECT count(*) AS files, sum(n)::BIGINT AS rows FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def s03(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.concat("p_name", F.lit(".")).alias("value")).repartition("p_brand")
    path = new_dir(rows, "texts")
    rows.write.partitionBy("p_brand").text(path)
    texts = readers.read_texts(spark, path)
    return texts.agg(F.count_distinct(F.regexp_extract("path", "p_brand=([^/]*)", 1)).alias("files"), F.sum(F.regexp_count("text", F.lit(r"\."))).alias("rows"))


@query("s07_csv_sink", "SELECT p_partkey, replace(p_name, ' ', '|') AS tags FROM part")
def s07(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("tags"))
    path = new_dir(rows, "postings")
    writers.write_postings_csv(rows, path, ["p_partkey", "tags"])
    return spark.read.schema("p_partkey bigint, tags string").csv(path, header=True)


@query("s08_json_sink", "SELECT p_partkey, string_split(p_name, ' ')[2] AS second, p_brand FROM part")
def s08(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("tags"), F.struct("p_brand").alias("extra"))
    path = new_dir(rows, "records")
    writers.write_postings_json(rows, path)
    back = spark.read.schema("p_partkey bigint, tags array<string>, extra struct<p_brand: string>").json(path)
    return back.select("p_partkey", F.col("tags")[1].alias("second"), "extra.p_brand")
