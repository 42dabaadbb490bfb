"""Spelling variants: words one code point apart, found by comparing tiles of padded code-point matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmill.llm.common import cut, ship

#: Fixed values of the contract: letters of a word and what is lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Buckets of at most this many words are compared along diagonals, all at once; larger ones in square tiles of SIDE.
SMALL, SIDE = 48, 512
BUCKET = ["longer", "low", "high", "key"]


def words_of(docs: DataFrame, min_chars: int = 7, min_count: int = 2, damage: int | None = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters of whole texts, A-Z lower-cased, of min_chars code points and min_count occurrences at least.

    With `damage`, a run loses a code point where that number divides the CRC-32 of `<id>:<run>`, at the CRC modulo its
    length. A null id is the empty string there. Null and empty texts have no words; repeated rows count each.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))).alias("run"))
    word = F.translate("run", UPPER, LOWER)
    runs = runs.select("id", word.alias("word"))
    if damage:
        runs = runs.withColumn("crc", F.crc32(F.concat_ws(":", "id", "word").cast("binary")))
        place = (F.col("crc") % F.length("word")).cast("int")
        cut_word = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.length("word")))
        runs = runs.select(F.when(F.col("crc") % damage == 0, cut_word).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _key(longer: Column, low: Column, high: Column) -> Column:
    """A hash of what words of a bucket share: the code points before `low`, and those after `high`, counted from the end."""
    after = longer - high
    return F.xxhash64(F.substring("word", F.lit(1), low), F.substring("word", F.length("word") - after + 1, after))


def bucketed(words: DataFrame, most: int) -> DataFrame:
    """word, n, longer, low, high, key: words that may be near share a bucket of `most` words at most, if one can.

    Of two near words the longer has `longer` code points, and their common prefix has a length from 0 to longer - 1.
    The pair belongs to the range [low, high) that holds this length: both then share the first `low` code points and the
    last longer - high. A word enters the ranges for its own length and for the next. A bucket with too many words halves
    its range; at a range of one place all words of a bucket are near one another, and no more than there are letters.
    """
    middle = (F.col("longer") / 2).cast("int")
    rows = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longer"))

    def ranged(df: DataFrame, low: Column, between: Column, high: Column) -> DataFrame:
        ranges = F.explode(F.array(F.struct(low.alias("low"), between.alias("high")), F.struct(between.alias("low"), high.alias("high"))))
        df = df.select("word", "n", "longer", ranges.alias("range")).select("word", "n", "longer", "range.*")
        return df.withColumn("key", _key(F.col("longer"), F.col("low"), F.col("high")))

    rows = cut(ranged(rows, F.lit(0), middle, F.col("longer")))
    while True:
        full = cut(rows.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("size")).where((F.col("size") > most) & (F.col("high") - F.col("low") > 1)).select(*BUCKET))
        if full.isEmpty():
            return rows
        halved = ranged(rows.join(full, BUCKET, "left_semi"), F.col("low"), ((F.col("low") + F.col("high")) / 2).cast("int"), F.col("high"))
        rows = cut(rows.join(full, BUCKET, "left_anti").select(*halved.columns).unionByName(halved))


class Tiles:
    """The near pairs of sorted rows with one `longer`, as (row, row); rows of a bucket follow each other."""

    def __init__(self, words: list[str], longer: int, low: np.ndarray, high: np.ndarray, bucket: np.ndarray):
        self.longer, self.low, self.high = longer, low, high
        self.full = np.fromiter(map(len, words), np.int64, len(words)) == longer
        points = np.array(words, f"U{longer}").view(np.uint32).reshape(len(words), longer)
        points = points.astype(np.uint8) if points.max(initial=0) < 256 else points
        #: Columns of the code points from the left, and from the right; 0 fills a word of one less.
        self.left = np.ascontiguousarray(points.T)
        self.right = np.ascontiguousarray(np.where(self.full[:, None], points, np.roll(points, 1, axis=1)).T[::-1])
        self.begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        self.end = np.r_[self.begin[1:], len(words)]

    def _near(self, i: np.ndarray | slice, j: np.ndarray | slice, square: bool) -> np.ndarray:
        def common(columns: np.ndarray) -> np.ndarray:
            alive, length = True, 0
            for c in range(self.longer):
                a, b = columns[c, i], columns[c, j]
                alive = alive & ((a[:, None] == b[None, :]) if square else (a == b))
                length = length + alive.view(np.uint8) if self.longer < 128 else length + alive.astype(np.int64)
                if not c % 8 and not alive.any():
                    break
            return length

        prefix, suffix = common(self.left), common(self.right)
        one_full = (self.full[i][:, None] | self.full[j][None, :]) if square else (self.full[i] | self.full[j])
        low, high = (self.low[i][:, None], self.high[i][:, None]) if square else (self.low[i], self.high[i])
        return one_full & (prefix + suffix >= self.longer - 1) & (prefix >= low) & (prefix < high)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = self.end - self.begin
        small = size <= SMALL
        last = np.zeros(len(self.full), np.int64)
        for b, e in zip(self.begin[small], self.end[small]):
            last[b:e] = e
        rows, apart = np.arange(len(last)), 1
        while len(rows := rows[rows + apart < last[rows]]):
            found = rows[self._near(rows, rows + apart, False)]
            yield found, found + apart
            apart += 1
        for b, e in zip(self.begin[~small].tolist(), self.end[~small].tolist()):
            for x in range(b, e, SIDE):
                for y in range(x, e, SIDE):
                    i, j = np.nonzero(self._near(slice(x, min(x + SIDE, e)), slice(y, min(y + SIDE, e)), True))
                    once = (i + x) < (j + y)
                    yield i[once] + x, j[once] + y


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per row with a near word in its bucket: the number of them and the first of them by n, ties by the word."""

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for longer, own in rows.groupby("longer", sort=False):
            words, n = own["word"].tolist(), own["n"].to_numpy()
            low, high, key = (own[c].to_numpy() for c in ("low", "high", "key"))
            bucket = np.cumsum(np.r_[0, (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (key[1:] != key[:-1])])
            found = list(Tiles(words, int(longer), low, high, bucket).pairs())
            i, j = (np.concatenate([np.concatenate([p[k], p[1 - k]]) for p in found] or [np.zeros(0, np.int64)]).astype(np.int64) for k in (0, 1))
            order = np.lexsort((j, -n[j], i))  # the rows of a bucket come in the order of their words
            i, j = i[order], j[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
            count = np.diff(np.r_[first, len(i)])
            out.append(pd.DataFrame({"word": [words[k] for k in i[first]], "n_near": count, "form": [words[k] for k in j[first]], "form_n": n[j[first]]}, dtype=object))
        return pd.concat(out).astype({"n_near": "int64", "form_n": "int64"})

    held: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        # the last bucket may go on in the next batch
        same = (rows[BUCKET] == rows[BUCKET].iloc[-1]).all(axis=1).to_numpy()
        held, done = rows[same], rows[~same]
        if len(done):
            yield compared(done)
    if held is not None and len(held):
        yield compared(held)


def near_words(words: DataFrame, factor: int = 10, most: int = 500) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of (word, n), words being distinct.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. `form` is the near word of
    largest n, ties by the smallest in code-point order, if its n is `factor` times the word's at least; `root` follows
    forms to the last one. Pairs are counted where they are found and never leave the task: a bucket hands on a row per
    word at most. Words of any length and alphabet; an empty table gives an empty result.
    """
    ship(words.sparkSession)
    words = cut(words.select("word", "n"))
    dealt = bucketed(words, most).repartition(*BUCKET).sortWithinPartitions(*BUCKET, "word")
    partial = dealt.mapInPandas(_compare, "word string, n_near long, form string, form_n long")
    first = F.min(F.struct((-F.col("form_n")).alias("minus"), F.col("form").alias("word")))
    near = partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    enough = -F.col("first.minus") >= factor * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("first.word")).alias("form"), F.when(enough, -F.col("first.minus")).alias("form_n")
    )
    found = cut(found)
    # each step multiplies n, so chains are as long as the largest n has digits at most; each round doubles what is followed
    up = found.where("form is not null").select("word", F.col("form").alias("root"))
    largest, reach, followed = found.agg(F.max("n")).first()[0] or 0, 0, 1
    while factor ** (reach + 1) <= largest:
        reach += 1
    while followed < reach:
        beyond = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = cut(up.join(beyond, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        followed *= 2
    return found.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_chars: int = 7, min_count: int = 2, damage: int | None = 31, factor: int = 10, most: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of whole texts, grouped by their frequent near forms: see words_of and near_words."""
    return near_words(words_of(docs, min_chars, min_count, damage, id_col, text_col), factor, most)
