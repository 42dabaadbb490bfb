"""Streams: what is collected, counted, capped and kept, across batches, restarts and reruns."""

import os

import pytest
from pyspark.sql import functions as F

from pathmill.streaming import ingest

SCHEMA = "source_id string, category string, at timestamp, ord int"


@pytest.fixture
def deliver(spark, tmp_path):
    """Adds a delivery; each is a file of the stream's folder."""

    def add(rows):
        spark.createDataFrame(rows, "source_id string, category string, at string, ord int").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return add


def rows(*ids, category="a", day=1):
    return [(i, category, f"2024-01-{day:02d} 00:00:00", k) for k, i in enumerate(ids)]


def test_new_rows_and_counts_per_batch(spark, tmp_path, deliver):
    path, check = str(tmp_path / "new"), str(tmp_path / "ck")
    for k, part in enumerate((rows("1", "1", "2", None), rows("2", "3", "bad"), rows("1", "2", "3"))):
        stream = deliver(part)
        query = ingest.collect_new(stream, path, check, ["source_id"], F.col("source_id") == "bad", within="1 second")
        ingest.wait(*query)
        # between them there may be batches without rows, which clear the state
        assert [r[1:] for r in ingest.counts(spark, path).orderBy("batch").collect()] == [(4, 2, 1, 1), (3, 1, 1, 1), (3, 0, 3, 0)][: k + 1]
    assert sorted(r["source_id"] for r in ingest.rows_of(spark, path).collect()) == ["1", "2", "3"]


def test_a_new_checkpoint_finds_what_is_there(spark, tmp_path, deliver):
    stream = deliver(rows("1", "2"))
    for k in range(2):
        ingest.wait(*ingest.collect_new(stream, str(tmp_path / "new"), str(tmp_path / f"ck{k}"), ["source_id"], F.lit(False)))
    assert ingest.rows_of(spark, str(tmp_path / "new")).count() == 2


def test_a_batch_that_failed_before_its_commit_adds_nothing_twice(spark, tmp_path, deliver, monkeypatch):
    path, stream = str(tmp_path / "quota"), deliver(rows("1", "2", "3"))
    real = ingest.Versions.commit
    monkeypatch.setattr(ingest.Versions, "commit", lambda *a: 1 / 0)
    query = ingest.append_quota(stream, path, str(tmp_path / "ck"), ["source_id"], "category", 9)
    with pytest.raises(Exception, match="division"):
        query.awaitTermination(60)
    assert ingest.Versions(spark, path).committed() == []
    monkeypatch.setattr(ingest.Versions, "commit", real)
    ingest.append_quota(stream, path, str(tmp_path / "ck"), ["source_id"], "category", 9).awaitTermination(60)
    assert ingest.rows_of(spark, path).count() == 3
    assert ingest.last_progress(spark, path).first()["collected"] == 3


def test_quota_is_never_exceeded_and_the_sink_is_not_read(spark, tmp_path, deliver):
    path = str(tmp_path / "quota")
    parts = [rows("1", "2", "2", "3") + rows("x", category="b"), rows("3", "4", "5", "6", day=2) + rows("y", category=None), rows("7", "8", day=3) + rows("x", "z", category="b", day=3)]
    for k, part in enumerate(parts):
        ingest.append_quota(deliver(part), path, str(tmp_path / "ck"), ["source_id"], "category", 5, ["ord", "source_id"]).awaitTermination(60)
        for folder in (tmp_path / "quota" / "rows").iterdir():  # a batch needs no row of another
            if not folder.name.endswith(f"={k}"):
                os.rename(folder, tmp_path / f"hidden-{folder.name}")
    assert {r["category"]: (r["collected"], r["found"], r["status"]) for r in ingest.last_progress(spark, path).collect()} == {"a": (5, 8, "done"), "b": (2, 3, "open"), None: (1, 1, "open")}
    for folder in tmp_path.glob("hidden-*"):
        os.rename(folder, tmp_path / "quota" / "rows" / folder.name.removeprefix("hidden-"))
    kept = ingest.rows_of(spark, path)
    assert sorted(r["source_id"] for r in kept.where("category = 'a'").collect()) == ["1", "2", "3", "4", "5"] and kept.count() == 8
    before = kept.count()
    ingest.append_quota(deliver(rows("1")), path, str(tmp_path / "other"), ["source_id"], "category", 5).awaitTermination(60)
    assert ingest.rows_of(spark, path).count() == before


def test_newest_rows_rewrite_touched_buckets_alone(spark, tmp_path, deliver):
    path = str(tmp_path / "newest")
    parts = [rows(*map(str, range(40))) + rows(None), rows("7", day=2), rows("7", "8", day=1), rows("9", day=4)]
    for k, part in enumerate(parts):
        ingest.upsert_newest(deliver(part), path, str(tmp_path / "ck"), "source_id", "at", "ord", buckets=16).awaitTermination(60)
        written = [p for p in os.listdir(f"{path}/data/v{k}") if p.startswith("bucket=")]
        assert len(written) == (1 if k in (1, 3) else len({*written})) and (k == 0 or len(written) <= 2)
    found = {r["source_id"]: r["at"].day for r in ingest.newest_rows(spark, path).collect()}
    assert found == {str(k): 1 for k in range(40)} | {"7": 2, "9": 4}
    assert sorted(os.listdir(f"{path}/manifest"))[-1] == "v3" and len(os.listdir(f"{path}/manifest")) == 2
    held = ingest._manifest(spark, path, 3)
    first = {int(p.split("=")[1]) for p in os.listdir(f"{path}/data/v0") if p.startswith("bucket=")}
    assert first == {b for v in (2, 3) for b, at in ingest._manifest(spark, path, v).items() if at == 0} and set(held.values()) >= {0, 3}
