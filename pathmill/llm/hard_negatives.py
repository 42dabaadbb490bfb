"""Hard negatives of anchors: rotated one-bit codes bound every inner product, integers score what the bounds leave."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathmill.llm.common import cut, new_dir, ship

#: Larger components count as this, so that no inner product of 2 ** 14 components leaves 64 bits.
LARGEST = 1 << 24
#: What the bounds are widened by, as a part of the product of two lengths: far above the error of a sum of doubles.
SLACK = 1e-9
#: Pairs whose bounds are worked out at once: anchors by rows.
TILE = (256, 1024)
NONE = np.iinfo(np.int64).min


def rotation(dims: int, bits: int, seed: int) -> np.ndarray:
    """bits x dims, orthonormal columns: a rotation of the vector filled up with zeros."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dims)))[0]


@dataclass
class Codes:
    """One bit for each rotated coordinate. A vector x is length * (align * u + the rest), u the code's direction in the space of vectors.

    `shrink` is the length of the code's unit vector in that space, so that its inner product with a rotated vector
    divided by it is the inner product with u.
    """

    words: np.ndarray
    length: np.ndarray
    align: np.ndarray
    shrink: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, turn: np.ndarray) -> "Codes":
        bits = len(turn)
        up = x @ turn.T >= 0
        back = (np.where(up, 1.0, -1.0) / np.sqrt(bits)) @ turn
        shrink, length = np.linalg.norm(back, axis=1), np.linalg.norm(x, axis=1)
        align = np.einsum("ij,ij->i", x, back) / np.maximum(length * shrink, 1e-300)
        words = np.packbits(up, axis=1, bitorder="little").view("<u8")
        return cls(words, length, np.clip(align, 0, 1), np.maximum(shrink, 1e-300))

    def __getitem__(self, k: slice | np.ndarray) -> "Codes":
        return Codes(self.words[k], self.length[k], self.align[k], self.shrink[k])


class Asked:
    """Anchors, rotated and rounded to PLANES bits a coordinate, each a bit plane to be met with codes by popcount."""

    PLANES = 6

    def __init__(self, y: np.ndarray, turn: np.ndarray):
        turned = y @ turn.T
        self.bits = len(turn)
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << self.PLANES) - 1), 1e-300)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.error = np.linalg.norm(turned - (self.low[:, None] + level * self.step[:, None]), axis=1)
        planes = [np.packbits((level >> j) & 1, axis=1, bitorder="little").view("<u8") for j in range(self.PLANES)]
        self.planes = np.stack(planes, axis=1)
        self.levels = level.sum(axis=1, dtype=np.int64)
        self.length = np.linalg.norm(y, axis=1)

    def bounds(self, k: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest inner product that the anchors k can have with each coded vector.

        Popcounts give the inner product of code and rounded anchor; rounding moves it by the error's length at most.
        What is left of the anchor beside the code's direction meets what is left of the vector, at most the product of
        their lengths.
        """
        met = np.zeros((len(k), len(codes.words)), np.int32)
        for j in range(self.PLANES):
            count = np.zeros(met.shape, np.int32)
            for w in range(codes.words.shape[1]):
                count += np.bitwise_count(self.planes[k, j, w][:, None] & codes.words[:, w][None, :])
            met += count << j
        ones = np.bitwise_count(codes.words).sum(axis=1, dtype=np.int64)
        inner = (self.low[k][:, None] * (2 * ones - self.bits)[None, :] + self.step[k][:, None] * (2 * met - self.levels[k][:, None])) / np.sqrt(self.bits)
        own = self.length[k][:, None]
        least = np.clip((inner - self.error[k][:, None]) / codes.shrink, -own, own)
        most = np.clip((inner + self.error[k][:, None]) / codes.shrink, -own, own)
        rest = np.sqrt(1 - codes.align**2)
        top, bottom = np.clip(codes.align * own, least, most), np.clip(-codes.align * own, least, most)
        wide = SLACK * own
        high = codes.length * (codes.align * top + rest * np.sqrt(np.maximum(own**2 - top**2, 0)) + wide)
        low = codes.length * (codes.align * bottom - rest * np.sqrt(np.maximum(own**2 - bottom**2, 0)) - wide)
        return low, high


class Best:
    """The first `n` (score, id) of each slot: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, n: int):
        self.n = n
        self.scores = np.full((slots, n), NONE, np.int64)
        self.ids = np.zeros((slots, n), np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(slot)
        kept = self.scores[touched] != NONE
        slot = np.concatenate([slot, np.repeat(touched, kept.sum(axis=1))])
        score, ids = np.concatenate([score, self.scores[touched][kept]]), np.concatenate([ids, self.ids[touched][kept]])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.r_[True, slot[1:] != slot[:-1]][: len(slot)]
        place = np.arange(len(slot)) - np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))
        keep = place < self.n
        self.scores[touched] = NONE
        self.scores[slot[keep], place[keep]], self.ids[slot[keep], place[keep]] = score[keep], ids[keep]

    def rows(self) -> pd.DataFrame:
        slot, place = np.nonzero(self.scores != NONE)
        return pd.DataFrame({"slot": slot, "id": self.ids[slot, place], "score": self.scores[slot, place]})


@dataclass
class Page:
    """A bounded number of anchors, sent to every task; positives: their scores, NONE where there are fewer."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    bits: int
    seed: int
    n: int
    low: int
    high: int
    positives: np.ndarray | None = None

    def search(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = rotation(self.vectors.shape[1], self.bits, self.seed)
        asked = Asked(self.vectors.astype(np.float64), turn)
        found = Best(len(self.ids) * (1 if self.positives is None else self.positives.shape[1]), self.n)
        for batch in batches:
            ids, labels = batch["id"].to_numpy(np.int64), batch["label"].to_numpy(np.int64)
            vectors = np.frombuffer(b"".join(batch["vector"]), "<i4").reshape(len(batch), -1).astype(np.int64)
            words = np.frombuffer(b"".join(batch["code"]), "<u8").reshape(len(batch), -1)
            codes = Codes(words, *[batch[c].to_numpy(np.float64) for c in ("length", "align", "shrink")])
            for a in range(0, len(self.ids), TILE[0]):
                here = np.arange(a, min(a + TILE[0], len(self.ids)))
                for label in np.unique(self.labels[here]):
                    k = here[self.labels[here] == label]
                    rows = np.flatnonzero((labels == label) if self.positives is None else (labels != label))
                    for b in range(0, len(rows), TILE[1]):
                        self._tile(asked, found, k, rows[b : b + TILE[1]], ids, vectors, codes)
        yield found.rows()

    def _score(self, k: np.ndarray, rows: np.ndarray, pair: tuple[np.ndarray, np.ndarray], vectors: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.vectors[k[pair[0]]], vectors[rows[pair[1]]])

    def _tile(self, asked: Asked, found: Best, k: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: Codes) -> None:
        low, high = asked.bounds(k, codes[rows])
        other = ids[rows][None, :] != self.ids[k][:, None]
        if self.positives is None:
            # the likeliest are scored first: their last score is what the others' upper bounds have to reach
            likely = np.zeros(high.shape, bool)
            np.put_along_axis(likely, np.argpartition(-high, min(self.n, len(rows) - 1), axis=1)[:, : self.n], True, axis=1)
            first = np.nonzero(likely & other & (high >= found.scores[k, -1][:, None]))
            found.add(k[first[0]], self._score(k, rows, first, vectors), ids[rows[first[1]]])
            rest = np.nonzero(other & ~likely & (high >= found.scores[k, -1][:, None]))
            found.add(k[rest[0]], self._score(k, rows, rest, vectors), ids[rows[rest[1]]])
            return
        per = self.positives.shape[1]
        slots = k[:, None] * per + np.arange(per)
        wanted = self.positives[k]
        there = wanted != NONE
        lowest = np.where(there, np.maximum(np.ceil(self.low * wanted / self.high), found.scores[slots, -1]), np.inf).min(axis=1, initial=np.inf)
        most = np.where(there, wanted, -np.inf).max(axis=1, initial=-np.inf)
        pair = np.nonzero(other & (high >= lowest[:, None] - 1) & (low <= most[:, None]))
        score, row_ids = self._score(k, rows, pair, vectors), ids[rows[pair[1]]]
        for p in range(per):
            positive = wanted[pair[0], p]
            fits = there[pair[0], p] & (self.low * positive <= self.high * score) & (score <= positive)
            found.add(slots[pair[0][fits], p], score[fits], row_ids[fits])


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, bits_per_dim: int = 8, page: int = 4096, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows for which `anchor` holds.

    A score is the inner product of floor(scale * component) vectors. An anchor's positives are the `positives` first
    other rows of its label; each gets the `negatives` first rows of other labels with low * positive <= high * score
    and score <= positive. Higher scores come first, ties by smaller id. Results are exact: a row is left out unscored
    only where its bounds exclude it.

    Rows are coded once into a table. Anchors come in pages of about `page`, whatever their number; each page is met with
    all rows where they lie, without a shuffle of rows, and a task hands on `positives` (then `positives * negatives`)
    rows an anchor at most. Each page's result is written before the next begins.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Shorter vectors are
    filled up with zeros; components beyond LARGEST count as that. Rows that share an id are never partners of each
    other; as partners of others each row counts; anchors that are equal throughout are mined once. An anchor without a
    positive, or a positive without a negative, gives no row. An empty table gives an empty result; other columns are
    ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    whole = F.transform(F.col(vector_col), lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-float(LARGEST))), F.lit(float(LARGEST))).cast("int"))
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    valid = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    valid = valid.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("whole"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    dims = max(1, valid.agg(F.max(F.size("whole"))).first()[0] or 0)
    bits = -(-bits_per_dim * dims // 64) * 64

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = rotation(dims, bits, seed)
        for batch in batches:
            x = np.zeros((len(batch), dims), np.int32)
            for k, v in enumerate(batch["whole"]):
                x[k, : len(v)] = v
            codes = Codes.of(x.astype(np.float64), turn)
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "is_anchor": batch["is_anchor"], "vector": [v.tobytes() for v in x.astype("<i4")], "code": [w.tobytes() for w in codes.words], "length": codes.length, "align": codes.align, "shrink": codes.shrink})

    coded = cut(valid.mapInPandas(code, "id long, label long, is_anchor boolean, vector binary, code binary, length double, align double, shrink double"))
    anchors = cut(coded.where("is_anchor").select("id", "label", "vector").distinct())
    pages = -(-anchors.count() // page)
    out = new_dir(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    candidates = coded.drop("is_anchor")
    for p in range(pages):
        own = anchors.where(F.pmod(F.xxhash64("id", "label", "vector"), F.lit(pages)) == p).toPandas()  # about `page` rows
        if not len(own):
            continue
        own = own.sort_values(["id", "label", "vector"], ignore_index=True)
        vectors = np.frombuffer(b"".join(own["vector"]), "<i4").reshape(len(own), -1).astype(np.int64)
        asked = Page(own["id"].to_numpy(), own["label"].to_numpy(), vectors, bits, seed, positives, low, high)
        pos = _first(candidates, asked, positives).toPandas()  # `positives` rows an anchor of the page
        pos["place"] = pos["rank"] - 1
        scores = np.full((len(own), positives), NONE, np.int64)
        scores[pos["slot"], pos["place"]] = pos["score"]
        asked.positives, asked.n = scores, negatives
        pairs = pos.assign(slot=pos["slot"] * positives + pos["place"], anchor_id=own["id"].to_numpy()[pos["slot"]])[["slot", "anchor_id", "id", "score"]]
        known = spark.createDataFrame(pairs, "slot long, anchor_id long, positive_id long, positive_score long")
        found = _first(candidates, asked, negatives).join(F.broadcast(known), "slot")  # a page's positives
        found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{out}/page={p}")
    if not pages:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, page int").parquet(out).drop("page")


def _first(rows: DataFrame, page: Page, n: int) -> DataFrame:
    """slot, id, score, rank: the first n of each slot over all tasks."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")  # n rows a task at most
    return rows.mapInPandas(page.search, "slot long, id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
