"""Exact duplicates by a log-structured merge index of digests, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmill.llm.common import cut, new_dir, remove

#: Bits of a filter block (what one bitmap of the SQL functions holds), bits set per digest, and digests a block is made for.
BLOCK_BITS = 32768
PROBES = 4
PER_BLOCK = BLOCK_BITS // 10
#: A group with over this share of all rows is spread; there are fewer than 1 / share such groups.
HOT_SHARE = 0.001
#: Rows of a memtable, and memtables of any table that is not empty.
MEMTABLE_ROWS = 20_000_000
FEWEST = 4


def digest_of(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, lower-case hex; null counts as the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


@dataclass
class Run:
    """A sorted table of digests and its filter, a bitmap per block of digests."""

    number: int
    path: str

    @property
    def filter_path(self) -> str:
        return f"{self.path}-filter"


class DigestIndex:
    """A log-structured merge index: digest -> identifier to keep and number of rows.

    Each batch is a memtable: it is aggregated by digest, looked up in the older runs and flushed as a sorted run with a
    blocked Bloom filter. A digest belongs to one block and sets PROBES bits in the block's bitmap, so a lookup meets
    the filters of all runs in one join on the block, and only runs that may hold one of the digests are read, for these
    digests alone. When `fan_in` runs of a level exist, they are compacted into one run of the next level; of equal
    digests the smallest (keep="min") or the largest (keep="max") identifier survives and the counts are added, and
    the runs merged are removed. Runs live in the shared folder; each is written before it is used, so a lost executor costs at most the run being written.
    """

    def __init__(self, spark: SparkSession, expected: int, fan_in: int = 3, keep: str = "min", path: str | None = None):
        if keep not in ("min", "max"):
            raise ValueError("keep is min or max")
        self.spark, self.fan_in, self.best = spark, fan_in, F.min if keep == "min" else F.max
        self.path = path or new_dir(spark, "digests")
        self.blocks = max(1, -(-expected // PER_BLOCK))
        self.levels: list[list[Run]] = [[]]
        self.written = 0
        #: Numbers of the runs that lookups had to read, and that filters let them skip.
        self.read: list[int] = []
        self.skipped: list[int] = []

    def _block(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.blocks))

    def _bits(self) -> Column:
        return F.array(*[F.pmod(F.xxhash64("digest", F.lit(k)), F.lit(BLOCK_BITS)) for k in range(PROBES)])

    def _flush(self, rows: DataFrame) -> Run:
        run = Run(self.written, f"{self.path}/run-{self.written:05d}")
        self.written += 1
        rows.sortWithinPartitions("digest").write.parquet(run.path)
        bits = self.spark.read.parquet(run.path).select(self._block().alias("block"), F.explode(self._bits()).alias("bit"))
        bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap")).write.parquet(run.filter_path)
        return run

    def _place(self, run: Run, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def lookup(self, digests: DataFrame) -> DataFrame:
        """Those of the digests that a run holds."""
        runs = self.runs()
        if not runs:
            return digests.limit(0)
        each = [self.spark.read.parquet(r.filter_path).select("block", F.struct(F.lit(r.number).alias("run"), "bitmap").alias("filter")) for r in runs]
        filters = each[0]
        for more in each[1:]:
            filters = filters.unionByName(more)
        filters = filters.groupBy("block").agg(F.collect_list("filter").alias("filters"))  # as many as there are runs

        def holds(bitmap: Column, bit: Column) -> Column:
            byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, (bit % 8).cast("int")) == 1

        asked = digests.withColumn("block", self._block()).withColumn("bits", self._bits()).join(filters, "block")
        may = F.filter("filters", lambda f: F.forall("bits", lambda b: holds(f["bitmap"], b)))
        maybe = cut(asked.select("digest", F.explode(F.transform(may, lambda f: f["run"])).alias("run")))
        wanted = {r["run"] for r in maybe.select("run").distinct().collect()}  # as many as there are runs
        self.read += sorted(wanted)
        self.skipped += [r.number for r in runs if r.number not in wanted]
        hits = digests.limit(0)
        for run in runs:
            if run.number in wanted:
                asked_here = maybe.where(F.col("run") == run.number).select("digest")
                hits = hits.unionByName(self.spark.read.parquet(run.path).select("digest").join(asked_here, "digest", "left_semi"))
        return hits

    def ingest(self, rows: DataFrame) -> DataFrame:
        """Take in one batch of (id, digest); returns the digests that it repeats, in itself or from earlier batches."""
        run = self._flush(rows.groupBy("digest").agg(self.best("id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
        memtable = self.spark.read.parquet(run.path)
        hits = cut(memtable.where("n > 1").select("digest").unionByName(self.lookup(memtable.where("n = 1").select("digest"))))
        self._place(run, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan_in:
            runs, self.levels[level] = self.levels[level], []
            self._place(self._flush(self._merge(runs)), level + 1)
            for old in runs:  # what they held is in the run just written
                remove(self.spark, old.path)
                remove(self.spark, old.filter_path)
            level += 1
        return hits

    def _merge(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.parquet(*[r.path for r in runs]).groupBy("digest").agg(self.best("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def entries(self) -> DataFrame:
        """digest, keep_id, n over all runs."""
        return self._merge(self.runs())


def exact_duplicates(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. The texts are read twice. First their digests go into
    the index in memtables of about `memtable_rows` rows, four at least, which tells the digests that occur again. Then the rows of these alone are
    verified byte by byte: they are grouped by the whole text, after a group with over a thousandth of all rows has been
    dealt into parts. Rows whose texts differ under one digest get groups of their own. Of rows that repeat an id, each
    counts; all rows with the kept id are kept. A null id is never kept where its group has another. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    total = docs.select(id_col).count()
    batches = max(FEWEST, -(-total // memtable_rows))
    light = new_dir(spark, "light")
    docs.select(F.col(id_col).alias("id"), digest_of(F.col(text_col)).alias("digest"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches)).alias("batch")).write.partitionBy("batch").parquet(light)
    rows = spark.read.schema(f"id {docs.schema[id_col].dataType.simpleString()}, digest string, batch int").parquet(light)
    index = DigestIndex(spark, total, keep=keep)
    hits = rows.select("digest").limit(0)
    for k in range(batches):
        hits = hits.unionByName(index.ingest(rows.where(F.col("batch") == k).select("id", "digest")))
    again = cut(hits.distinct())

    groups = cut(index.entries().join(again, "digest", "left_semi"))
    hot = groups.where(F.col("n") > HOT_SHARE * total).select("digest", F.ceil(F.col("n") / (HOT_SHARE * max(total, 1))).alias("parts"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).withColumn("digest", digest_of(F.col("body")))
    # fewer than 1 / HOT_SHARE rows are broadcast
    salted = texts.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", F.spark_partition_id()), F.col("parts")), F.lit(0)))
    wanted = groups.join(F.broadcast(hot), "digest", "left").select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("salt"))
    parts = salted.join(wanted, ["digest", "salt"], "left_semi").groupBy("digest", "body", "salt").agg(index.best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # one row per digest and text; the text itself is needed on only where a digest has several
    same = parts.groupBy("digest", "body").agg(index.best("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    checked = cut(same.select("digest", F.xxhash64("body").alias("body_hash"), "keep_id", "n"))
    collided = checked.groupBy("digest").count().where("count > 1").select("digest")

    def answer(found: DataFrame) -> DataFrame:
        # a row without a group is alone
        keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
        return found.select(
            F.col("id").alias(id_col),
            keep_id.alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("id") == keep_id, keep_id.isNull()).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )

    light_rows = rows.select("id", "digest")
    if collided.isEmpty():
        return answer(light_rows.join(checked.select("digest", "keep_id", "n"), "digest", "left"))
    by_text = same.join(collided, "digest", "left_semi")
    plain = checked.join(collided, "digest", "left_anti").select("digest", "keep_id", "n")
    return answer(light_rows.join(collided, "digest", "left_anti").join(plain, "digest", "left")).unionByName(answer(texts.select("id", "body", "digest").join(by_text, ["digest", "body"])))
