"""Incremental ingest: ids once seen are skipped and counted, quotas per category, newest version per id in buckets.

Every sink is a folder of versions. A batch writes its version's files whole, then commits the version by one row that
names run and batch; a batch that is run again after a failure takes the number it had, so it overwrites what it left and
adds nothing twice. Readers follow committed versions alone.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from pathmill.lineage import exists, remove
from pathmill.operators.aggregates import latest_per_key

#: Key stores and newest-version tables are dealt into so many buckets; a batch reads and writes those that it touches.
BUCKETS = 64


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none yet."""
    return spark.read.parquet(path) if exists(spark, path) else None


class Versions:
    """The committed versions below a path: rows (version, run, batch), one per batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path}/versions"

    def committed(self) -> list[tuple[int, str, int]]:
        found = existing(self.spark, self.path)
        return sorted(tuple(r) for r in found.select("version", "run", "batch").distinct().collect()) if found is not None else []

    def number(self, run: str, batch: int) -> tuple[int, list[int]]:
        """The version of a batch, and the versions before it."""
        known = self.committed()
        own = next((v for v, r, b in known if (r, b) == (run, batch)), max((v for v, _, _ in known), default=-1) + 1)
        return own, [v for v, _, _ in known if v < own]

    def commit(self, version: int, run: str, batch: int) -> None:
        if (version, run, batch) not in self.committed():
            self.spark.createDataFrame([(version, run, batch)], "version long, run string, batch long").coalesce(1).write.mode("append").parquet(self.path)


def _part(path: str, name: str, version: int) -> str:
    return f"{path}/{name}/version={version}"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class KeyStore:
    """Keys seen so far, in buckets of every version; a lookup reads the buckets that its rows touch."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, f"{path}/keys", keys, buckets

    def unseen(self, rows: DataFrame, before: list[int]) -> DataFrame:
        if not before:
            return rows
        touched = [r["b"] for r in rows.select(_bucket(self.keys, self.buckets).alias("b")).distinct().collect()]  # `buckets` at most
        known = self.spark.read.parquet(self.path).where(F.col("version").isin(before) & F.col("bucket").isin(touched))
        return rows.join(known.select(*self.keys), self.keys, "left_anti")

    def add(self, rows: DataFrame, version: int) -> None:
        keyed = rows.select(*self.keys, _bucket(self.keys, self.buckets).alias("bucket"))
        keyed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={version}")


class Arrivals(StreamingQueryListener):
    """Keeps what a query observes of each batch: a row (batch, read, failed) per batch in a table, written as it comes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.id, self.over = spark, path, None, threading.Event()

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        seen = event.progress.observedMetrics.get("arrivals")
        if str(event.progress.id) == self.id and seen is not None and seen["read"]:
            row = [(event.progress.batchId, seen["read"], seen["failed"])]
            self.spark.createDataFrame(row, "batch long, read long, failed long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/arrivals/batch={event.progress.batchId}")

    def onQueryTerminated(self, event):  # noqa: N802
        if str(event.id) == self.id:
            self.over.set()


def collect_new(stream: DataFrame, path: str, checkpoint: str, keys: list[str], failed: Column, within: str = "1 hour") -> tuple[StreamingQuery, Arrivals]:
    """A query that keeps the rows whose keys never came before, and its listener; `failed` rows, as those with a null key, are not kept.

    The stream's own state holds the keys of the last `within` of arrivals alone, so it is bounded, and takes out what
    comes again soon. What passes it is looked up in the key store, which holds all keys by bucket. Arrival is the time of
    the batch, so no row comes late. After wait(), `counts` has the numbers of each batch.
    """
    spark = stream.sparkSession
    bad = failed
    for key in keys:
        bad = bad | F.col(key).isNull()
    arrived = stream.withColumn("_failed", F.coalesce(bad, F.lit(True))).withColumn("_at", F.current_timestamp())
    arrived = arrived.observe("arrivals", F.count(F.lit(1)).alias("read"), F.coalesce(F.sum(F.col("_failed").cast("long")), F.lit(0)).alias("failed"))
    fresh = arrived.where("not _failed").withWatermark("_at", within).dropDuplicatesWithinWatermark(keys).drop("_failed", "_at")

    def write(batch: DataFrame, batch_id: int) -> None:
        own, versions = batch.sparkSession, Versions(batch.sparkSession, path)
        version, before = versions.number(checkpoint, batch_id)
        store = KeyStore(own, path, keys)
        store.unseen(batch, before).write.mode("overwrite").parquet(_part(path, "rows", version))
        written = own.read.parquet(_part(path, "rows", version))
        store.add(written, version)
        row = [(version, batch_id, written.count())]
        own.createDataFrame(row, "version long, batch long, collected long").coalesce(1).write.mode("overwrite").parquet(f"{path}/collected/version={version}")
        versions.commit(version, checkpoint, batch_id)

    listener = Arrivals(spark, path)
    spark.streams.addListener(listener)
    query = fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    listener.id = str(query.id)
    return query, listener


def wait(query: StreamingQuery, listener: Arrivals, seconds: int = 600) -> None:
    """Until the query has ended and its last numbers are written."""
    query.awaitTermination(seconds)
    listener.over.wait(60)
    # a batch that was over before the listener knew the query is in its progress
    for progress in query.recentProgress:
        if (seen := progress.observedMetrics.get("arrivals")) is not None and seen["read"]:
            row = [(progress.batchId, seen["read"], seen["failed"])]
            listener.spark.createDataFrame(row, "batch long, read long, failed long").coalesce(1).write.mode("overwrite").parquet(f"{listener.path}/arrivals/batch={progress.batchId}")
    listener.spark.streams.removeListener(listener)


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed versions."""
    known = [v for v, _, _ in Versions(spark, path).committed()]
    return spark.read.parquet(f"{path}/rows").where(F.col("version").isin(known)).drop("version")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """batch, read, collected, skipped, failed of every batch of one run."""
    arrivals = spark.read.parquet(f"{path}/arrivals").select("batch", "read", "failed")
    collected = spark.read.parquet(f"{path}/collected").select("batch", "collected")
    joined = arrivals.join(collected, "batch")
    return joined.select("batch", "read", "collected", (F.col("read") - F.col("collected") - F.col("failed")).alias("skipped"), "failed")


def append_quota(stream: DataFrame, path: str, checkpoint: str, keys: list[str], category: str, target: int, order: list[str] | None = None) -> StreamingQuery:
    """A query that appends unseen rows until each category has `target`, with a progress table for every batch.

    What a batch knows of the past is the last progress table, a row per category, and the buckets of the key store that
    its rows touch; the sink is never read. Of rows with the same keys the first by `order` is taken, and of a category as
    many as it still lacks, in that order; a category that is done is passed over. A row's category is part of it: null is
    a category. A second query with another checkpoint goes on from the progress that it finds.
    """
    order = order or keys
    first = Window.partitionBy(*keys).orderBy(*order)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = Versions(spark, path)
        version, before = versions.number(checkpoint, batch_id)
        store = KeyStore(spark, path, keys)
        known = spark.read.parquet(_part(path, "progress", before[-1])) if before else None
        open_ = batch
        if known is not None:
            done = known.where("status = 'done'").select(F.col(category).alias("_category"))
            open_ = batch.join(done, F.col(category).eqNullSafe(F.col("_category")), "left_anti")
        once = open_.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
        fresh = store.unseen(once, before)
        ranked = fresh.withColumn("_place", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("_place") <= target)
        if known is not None:
            had = known.select(F.col(category).alias("_category"), "collected")
            ranked = ranked.join(had, F.col(category).eqNullSafe(F.col("_category")), "left").where(F.col("_place") <= target - F.coalesce("collected", F.lit(0))).drop("_category", "collected")
        ranked.drop("_place").write.mode("overwrite").parquet(_part(path, "rows", version))
        added = spark.read.parquet(_part(path, "rows", version))
        store.add(added, version)
        news = open_.groupBy(category).agg(F.lit(0).cast("long").alias("collected"), F.count(F.lit(1)).alias("found"))
        news = news.unionByName(added.groupBy(category).agg(F.count(F.lit(1)).alias("collected"), F.lit(0).cast("long").alias("found")))
        if known is not None:
            news = news.unionByName(known.select(category, "collected", "found"))
        progress(news, category, target).coalesce(1).write.mode("overwrite").parquet(_part(path, "progress", version))
        versions.commit(version, checkpoint, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(news: DataFrame, category: str, target: int) -> DataFrame:
    """category, collected, found, target, status from partial numbers."""
    sums = news.groupBy(category).agg(F.sum("collected").alias("collected"), F.sum("found").alias("found"))
    return sums.withColumn("target", F.lit(target)).withColumn("status", F.when(F.col("collected") >= target, "done").otherwise("open"))


def last_progress(spark: SparkSession, path: str) -> DataFrame:
    newest = Versions(spark, path).committed()[-1][0]
    return spark.read.parquet(_part(path, "progress", newest))


def upsert_newest(stream: DataFrame, path: str, checkpoint: str, key: str, at: str, ordinal: str, buckets: int = BUCKETS, keep: int = 2) -> StreamingQuery:
    """A query that keeps the newest row per key, ties by the ordinal, in a table of buckets of keys.

    A batch reads and rewrites the buckets that its keys fall in; a manifest, a row per bucket, names the version that
    holds each. A rewritten bucket is one file, so nothing piles up. The last `keep` versions can be read; buckets that only
    older ones name are removed. Rows without a key are dropped.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = Versions(spark, path)
        version, before = versions.number(checkpoint, batch_id)
        rows = batch.where(F.col(key).isNotNull()).withColumn("bucket", _bucket([key], buckets))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # `buckets` at most
        held = _manifest(spark, path, before[-1]) if before else {}
        old = _buckets(spark, path, {b: v for b, v in held.items() if b in touched})
        merged = rows if old is None else old.select(*rows.columns).unionByName(rows)
        newest = latest_per_key(merged, key, at, ordinal)
        newest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v{version}")
        now = held | {b: version for b in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, held long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{version}")
        versions.commit(version, checkpoint, batch_id)
        _sweep(spark, path, [*before, version], keep)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    return {r["bucket"]: r["held"] for r in spark.read.parquet(f"{path}/manifest/v{version}").collect()}  # a row per bucket


def _buckets(spark: SparkSession, path: str, held: dict[int, int]) -> DataFrame | None:
    """The buckets, each from the version that holds it."""
    found = None
    for version in sorted(set(held.values())):
        own = spark.read.parquet(f"{path}/data/v{version}").where(F.col("bucket").isin([b for b, v in held.items() if v == version]))
        found = own if found is None else found.unionByName(own)
    return found


def _sweep(spark: SparkSession, path: str, versions: list[int], keep: int) -> None:
    """Remove the buckets that the version before the last `keep` names and these no longer do, and its manifest."""
    if len(versions) <= keep:
        return
    gone = versions[-keep - 1]
    current = {(b, v) for kept in versions[-keep:] for b, v in _manifest(spark, path, kept).items()}
    old = existing(spark, f"{path}/manifest/v{gone}")
    if old is None:  # swept before
        return
    for b, v in _manifest(spark, path, gone).items():
        if (b, v) not in current:
            remove(spark, f"{path}/data/v{v}/bucket={b}")
    remove(spark, f"{path}/manifest/v{gone}")


def newest_rows(spark: SparkSession, path: str) -> DataFrame:
    """The newest row per key as of the last committed version."""
    last = Versions(spark, path).committed()[-1][0]
    found = _buckets(spark, path, _manifest(spark, path, last))
    return found.drop("bucket") if found is not None else spark.read.parquet(f"{path}/data/v{last}")
