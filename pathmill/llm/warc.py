"""Deterministic sharded WARC archives: written by tasks under temporary names, committed by manifest, read back."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmill.llm.common import new_dir, running, ship

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard long, part long, temporary string, name string, bytes long, sha256 string, records long"
#: Shards grow with the input beyond so many, so that their bounds stay a small array.
MOST_SHARDS = 20_000


def open_store(uri: str):
    """File system and path of a folder that all executors reach: file, hdfs, s3 and what else pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def fs_selector(path: str):
    from pyarrow import fs

    return fs.FileSelector(path)


def record_id(page_id: int | None, digest: str, turn: int) -> str:
    """Of the `turn`-th record of this page and payload."""
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}:{digest}:{turn}'.encode(), usedforsecurity=False).hexdigest())}>"


def record(page_id: int | None, turn: int, url: str | None, payload: bytes, digest: str, original: int | None, date: str) -> bytes:
    """One record as a gzip member of its own. A revisit has the HTTP head alone and names the record it repeats."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if original is not None else head + payload
    fields = [("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest, turn)), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~-._"))]
    if page_id is not None:
        fields += [("WARC-Page-ID", str(page_id))]
    if original is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(original, digest, 0)), ("WARC-Refers-To-Page-ID", str(original))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


class _Roller:
    """The archive that a task is writing: rolled by compressed size, temporary until the manifest names it."""

    def __init__(self, uri: str, roll_bytes: int):
        self.store, self.path = open_store(uri)
        self.roll_bytes, self.attempt, self.out = roll_bytes, uuid.uuid4().hex, None

    def write(self, shard: int, data: bytes) -> Iterator[tuple]:
        if self.out is not None and (shard != self.shard or self.size + len(data) > self.roll_bytes):
            part = self.part + 1 if shard == self.shard else 0
            yield self.close()
            self.part = part
        elif self.out is None:
            self.part = 0
        if self.out is None:
            self.shard, self.size, self.records, self.sha = shard, 0, 0, hashlib.sha256()
            self.name = f"part-{shard:06d}-{self.part:06d}.warc.gz"
            self.temporary = f"{self.name}.{self.attempt}.tmp"
            self.out = self.store.open_output_stream(f"{self.path}/{self.temporary}", compression=None)
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        return self.shard, self.part, self.temporary, self.name, self.size, self.sha.hexdigest(), self.records


def shard_bounds(pages: DataFrame, shard_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first record of each shard, as null mark (0 for null ids), id and tie, from running totals of the bytes in record order."""
    sizes = pages.groupBy("id", "tie").agg(F.sum(F.coalesce(F.octet_length("body"), F.lit(0)) + 400).alias("n"))
    placed = running(sizes, [F.col("id").isNotNull(), F.coalesce("id", F.lit(0)), F.col("tie")], "before", F.col("n"))
    total = pages.agg(F.sum(F.coalesce(F.octet_length("body"), F.lit(0)) + 400)).first()[0] or 0
    shard = F.floor(F.col("before") / max(shard_bytes, -(-total // MOST_SHARDS)))
    least = F.min(F.struct(F.col("id").isNotNull().cast("int").alias("known"), F.coalesce("id", F.lit(0)).alias("id"), F.col("tie").alias("tie")))
    first = sorted(tuple(r["least"]) for r in placed.groupBy(shard.alias("shard")).agg(least.alias("least")).collect()) or [(0, 0, 0)]  # MOST_SHARDS at most
    return tuple(np.array(x, np.int64) for x in zip(*first, strict=True))


def shard_of(bounds: tuple[np.ndarray, np.ndarray, np.ndarray], ids: pd.Series, ties: np.ndarray) -> np.ndarray:
    """The last shard whose first record is not after the record; what is before the first belongs to it."""
    known, values = ids.notna().to_numpy().astype(np.int64), ids.fillna(0).to_numpy(np.int64)
    # one binary search per record, all at once: how many bounds are not after it
    low, high = np.zeros(len(values), np.int64), np.full(len(values), len(bounds[0]))
    while (open_ := low < high).any():
        middle = np.minimum((low + high) // 2, len(bounds[0]) - 1)
        b0, b1, b2 = (b[middle] for b in bounds)
        upto = (b0 < known) | (b0 == known) & ((b1 < values) | (b1 == values) & (b2 <= ties))
        low, high = np.where(open_ & upto, middle + 1, low), np.where(open_ & ~upto, middle, high)
    return np.maximum(low - 1, 0)


def write_archives(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = 8 << 20, roll_bytes: int = 4 << 20, min_revisit: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row below `uri` and return the committed manifest.

    Shards are ranges of the records in order of id (null first), then of a hash of payload and address, with about
    `shard_bytes` each, cut by running totals of the rows' bytes, so the archives are the same bytes whatever the
    partitioning; rows that are equal throughout share a shard. Of equal payloads of at
    least `min_revisit` bytes, the rows with the smallest id are responses and the others revisit it. First the few
    columns that decide this are aggregated; the revisits found travel as marker rows of the same range sort, so the
    payloads are shuffled once. Tasks write temporary names that carry the attempt; the manifest of the successful
    attempts is written, then a second job renames what it names, which may be repeated, and the final manifest follows;
    temporary files of failed attempts are removed last.
    A null payload is empty; rows with a null id come first and never are the first of their payload unless all are;
    rows that repeat an id get records of their own. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("body")).withColumn("tie", F.xxhash64("body", "url"))
    bounds = shard_bounds(rows, shard_bytes)
    shared = spark.sparkContext.broadcast(bounds)  # MOST_SHARDS rows of three numbers at most

    @F.pandas_udf("long")
    def shard(ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(shard_of(shared.value, ids, ties.to_numpy(np.int64)))

    light = rows.select("id", "tie", F.octet_length("body").alias("n"), F.sha2(F.col("body").cast("binary"), 256).alias("digest")).where(F.col("n") >= min_revisit)
    repeated = light.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and first is not null")
    markers = light.join(repeated, "digest").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "tie", "digest", "first")
    nothing = F.lit(None)
    merged = markers.select("id", "tie", F.lit(0).alias("kind"), nothing.cast("string").alias("url"), nothing.cast("string").alias("body"), "digest", "first").unionByName(
        rows.select("id", "tie", F.lit(1).alias("kind"), "url", "body", nothing.cast("string").alias("digest"), nothing.cast("long").alias("first"))
    )
    ordered = merged.withColumn("shard", shard("id", "tie")).repartitionByRange(len(bounds[0]), "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "tie", "kind", "digest", "url", "body")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a page's records of one payload are numbered; the marker of a payload stands before its records
        roller, last, turns, revisits = _Roller(uri, roll_bytes), object(), {}, {}
        columns = [c.split()[0] for c in MANIFEST.split(", ")]
        for pdf in batches:
            done: list[tuple] = []
            for key, kind, url, body, digest, original, at in zip(*(pdf[c] for c in ("id", "kind", "url", "body", "digest", "first", "shard")), strict=True):
                page_id = None if pd.isna(key) else int(key)
                if page_id != last:
                    last, turns, revisits = page_id, {}, {}
                if kind == 0:
                    revisits[digest] = int(original)
                    continue
                payload = (body or "").encode("utf-8", "surrogatepass")
                found = hashlib.sha256(payload).hexdigest()
                turn = turns.get(found, 0)
                turns[found] = turn + 1
                done += roller.write(int(at), record(page_id, turn, url, payload, found, revisits.get(found), date))
            if done:
                yield pd.DataFrame(done, columns=columns)
        if roller.out is not None:
            yield pd.DataFrame([roller.close()], columns=columns)

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = open_store(uri)
        for pdf in batches:
            for temporary, name, size in zip(pdf["temporary"], pdf["name"], pdf["bytes"], strict=True):
                at = store.get_file_info(f"{path}/{name}")
                if not (at.is_file and at.size == size):
                    store.move(f"{path}/{temporary}", f"{path}/{name}")
            yield pdf

    open_store(uri)[0].create_dir(open_store(uri)[1], recursive=True)
    ordered.mapInPandas(write, MANIFEST).write.parquet(f"{uri}/_pending")
    spark.read.parquet(f"{uri}/_pending").mapInPandas(commit, MANIFEST).write.parquet(f"{uri}/_manifest")
    store, path = open_store(uri)
    for left in store.get_file_info(fs_selector(path)):
        if left.base_name.endswith(".tmp"):
            store.delete_file(left.path)
    return spark.read.parquet(f"{uri}/_manifest")


def _members(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    data = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            data = data or stream.read(block)
            if not data:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
        yield b"".join(parts)


def parse_record(raw: bytes) -> tuple[int | None, int, str, str, int | None, str, bytes]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of a record; digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != VERSION or hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")).split()[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("WARC-Page-ID"), size, digest, kind, number("WARC-Refers-To-Page-ID"), fields["WARC-Target-URI"], payload


def read_archives(spark: SparkSession, uri: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives that the manifest below `uri` names."""
    ship(spark)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: 7 if with_payload else 6]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = open_store(uri)
        for pdf in batches:
            for name in pdf["name"]:
                rows: list[tuple] = []
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for raw in _members(stream):
                        rows.append(parse_record(raw)[: len(names)])
                        if len(rows) >= 1000:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows = []
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    manifest = spark.read.parquet(f"{uri}/_manifest")
    spread = manifest.select("name").repartition(max(1, min(manifest.count(), 10_000)), "name")
    return spread.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the rows as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    uri = new_dir(spark, "warc")
    write_archives(pages, uri, id_col, url_col, html_col)
    return read_archives(spark, uri)
