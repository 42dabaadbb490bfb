"""Packing documents into fixed-length sequences: best fit, then a swap-based local search."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmill.llm.common import cut, ship

#: Texts of these characters only are split by Python's re, with the classes written out; others by the regex module.
_SIMPLE = re.compile("[^\x00-ɏ]")
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_BLANK = "\\t-\\r \u0085 "
_FAST = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
#: A byte-level model's letter for each byte: its own where that can be seen, else the next one from 256 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = str.maketrans({b: b if b in _SEEN else 256 + sum(x not in _SEEN for x in range(b)) for b in range(256)})
_FOUR_BYTES = struct.Struct("<I").pack
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder(dict):
    """Token ids of a tokenizers file, as little-endian 32-bit bytes per pre-token, remembered between texts.

    A text's ids are the ids of its pre-tokens, one after the other; those of a pre-token come from the file's own
    model, which takes bytes as letters. They are remembered in two generations of LIMIT pre-tokens: when the younger one is full the older one goes.
    """

    LIMIT = 150_000

    def __init__(self, name: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.core = Tokenizer.from_file(public_tokenizers.path(name))
        self.older: dict[str, bytes] = {}
        self.model = self.core.model  # marks of special tokens in a text are text to it
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            letters = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
            found = b"".join([_FOUR_BYTES(t.id) for t in self.model.tokenize(letters)])
        if len(self) >= self.LIMIT:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found

    def ids(self, text: str) -> bytes:
        pieces = (self.pattern if _SIMPLE.search(text) else _FAST).findall(text)
        return b"".join([self[p] for p in pieces])


def encoder(name: str = "byte_bpe_50k.json") -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def tokenised_pieces(docs: DataFrame, length: int = 1024, end_id: int = 2, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows id, piece, start, length, ids_crc32 (and ids, little-endian bytes, on request) of every document.

    Only documents of more than `length` ids are cut: the first piece takes the remainder, the others are full.
    """

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer).ids, np.uint32(end_id).tobytes()
        columns = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
        for pdf in batches:
            out: list[tuple] = []
            for key, text in zip(pdf["id"], pdf["body"], strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                at = [0, *range(n % length or length, n, length), n] if n > length else [0, n]
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    part = ids[4 * a : 4 * b]
                    out.append((key, k, a, b - a, zlib.crc32(part), *([part] if with_ids else [])))
            yield pd.DataFrame(out, columns=columns).astype({"id": "Int64"})

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return rows.mapInPandas(cut_up, "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: item numbers of each bin. Open bins are found by their gap through a bit set of gaps."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = open_gaps >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps &= ~(1 << gap)
            bins[b].append(item)
        else:
            gap, b = capacity, len(bins)
            bins.append([item])
        gap -= size
        if gap:
            by_gap[gap].append(b)
            open_gaps |= 1 << gap
    return bins


class LocalSearch:
    """Moves and exchanges between underfull bins, each raising the sum of squared fills, until none is left.

    A giver's item moves into a gap that holds it, or it is exchanged for one or for two smaller items of a taker, so
    that the taker grows by at most its gap and ends fuller than the giver began. All underfull bins are givers, from
    the emptiest on, and all others are takers. An index holds, for each size that a bin can give back (0, one item or
    two) and each gap, the bins that have both; of the exchanges of a giver the one that raises the sum most is made.
    The search ends when a pass over all bins finds no exchange, or when no packing could have fewer bins.
    """

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes.tolist(), capacity
        self.fill = [sum(self.sizes[x] for x in b) for b in bins]
        self.left = sum(1 for b in bins if b)
        self.least = -(-sum(self.fill) // capacity)
        #: Bins by size given back and gap, their numbers, and per size the least gap from each gap on that is there.
        self.found: dict[int, dict[int, None]] = {}
        self.offers: list[list[int]] = [[] for _ in bins]
        self.count = np.zeros((capacity + 1, capacity + 1), np.int32)
        self.none = 4 * capacity
        self.next_gap = np.full((capacity + 1, capacity + 1), self.none, np.int32)

    def _refresh(self, rows: list[int]) -> None:
        gaps = np.where(self.count[rows] > 0, np.arange(self.capacity + 1, dtype=np.int32), np.int32(self.none))
        self.next_gap[rows] = np.minimum.accumulate(gaps[:, ::-1], axis=1)[:, ::-1]

    def _enter(self, b: int) -> list[int]:
        """Put an underfull bin into the index; the sizes whose rows have changed."""
        gap = self.capacity - self.fill[b]
        if not gap or not self.bins[b]:
            return []
        own = [self.sizes[x] for x in self.bins[b]]
        distinct = sorted(set(own))
        sums = {0, *distinct, *(u + v for i, u in enumerate(distinct) for v in distinct[i + 1 :])}
        if len(distinct) < len(own):
            seen: set[int] = set()
            sums.update(2 * u for u in own if u in seen or seen.add(u))
        self.offers[b] = list(sums)
        for s in self.offers[b]:
            self.found.setdefault(s * (self.capacity + 1) + gap, {})[b] = None
        self.count[self.offers[b], gap] += 1
        return self.offers[b]

    def _leave(self, b: int) -> list[int]:
        gap, rows = self.capacity - self.fill[b], self.offers[b]
        if not rows:
            return []
        for s in rows:
            del self.found[s * (self.capacity + 1) + gap][b]
        self.count[rows, gap] -= 1
        self.offers[b] = []
        return rows

    def _pick(self, b: int, total: int) -> list[int]:
        """The items of a bin, at most two, whose sizes add up to `total`."""
        if not total:
            return []
        at: dict[int, int] = {}
        for x in self.bins[b]:
            if self.sizes[x] == total:
                return [x]
        for x in self.bins[b]:
            if total - self.sizes[x] in at:
                return [at[total - self.sizes[x]], x]
            at[self.sizes[x]] = x
        raise AssertionError("the index names items that the bin does not have")

    def _best(self, giver: int) -> tuple[int, int, int] | None:
        """Item, size given back and taker's gap of the exchange that raises the sum of squares most."""
        room = self.capacity - self.fill[giver]
        items = {self.sizes[x]: x for x in self.bins[giver]}
        sizes = np.fromiter(items, np.int64, len(items))[:, None]
        back = np.arange(int(sizes.max()))[None, :]
        grown = sizes - back
        gaps = self.next_gap[back, np.maximum(grown, 0)]
        # the taker's fill plus what it grows by, less the giver's fill
        gain = np.where(grown > 0, grown * (room - gaps + grown), 0)
        k, s = divmod(int(gain.argmax()), back.shape[1])
        return (items[int(sizes[k, 0])], s, int(gaps[k, s])) if gain[k, s] > 0 else None

    def _shift(self, giver: int, taker: int, item: int, back: list[int]) -> None:
        self.bins[giver].remove(item)
        for x in back:
            self.bins[taker].remove(x)
        self.bins[giver] += back
        self.bins[taker].append(item)
        d = self.sizes[item] - sum(self.sizes[x] for x in back)
        self.fill[giver] -= d
        self.fill[taker] += d
        self.left -= not self.bins[giver]

    def run(self) -> list[list[int]]:
        if self.left > self.least:
            for b in range(len(self.bins)):
                self._enter(b)
            self._refresh(list(range(self.capacity + 1)))
        gained = True
        while gained and self.left > self.least:
            gained = False
            for giver in sorted((b for b in range(len(self.bins)) if self.offers[b]), key=lambda b: (self.fill[b], b)):
                if self.left == self.least or not self.offers[giver]:
                    continue
                self._refresh(self._leave(giver))
                while self.bins[giver] and (best := self._best(giver)):
                    item, total, gap = best
                    taker = next(iter(self.found[total * (self.capacity + 1) + gap]))
                    changed = self._leave(taker)
                    self._shift(giver, taker, item, self._pick(taker, total))
                    self._refresh(list({*changed, *self._enter(taker)}))
                    gained = True
                self._refresh(self._enter(giver))
        return [b for b in self.bins if b]


def pack_documents(docs: DataFrame, length: int = 1024, end_id: int = 2, tokenizer: str = "byte_bpe_50k.json", shard_items: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are tokenised once, whole and however long, and the table of piece lengths is kept. Full pieces are
    sequences of their own. The others, one per document at most, are dealt by a hash of their values into shards of
    about `shard_items`, so a shard fits one task at any input size, and each shard is packed for itself: best-fit
    decreasing, then the local search; it leaves at most a few underfull sequences per shard. Pieces that are the same
    throughout are counted and numbered, so that the packing does not depend on partitioning and reruns agree. A null
    text is empty and has the end id alone; rows that repeat an id are packed each; an empty table gives an empty
    result; other columns are ignored.
    """
    columns = ["id", "piece", "start", "length", "ids_crc32"]
    pieces = tokenised_pieces(docs, length, end_id, tokenizer, id_col, text_col)
    pieces = cut(pieces.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")))
    each = pieces.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    open_ = each.where(F.col("length") < length)
    shards = max(1, -(-(pieces.where(F.col("length") < length).agg(F.sum("copies")).first()[0] or 0) // shard_items))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*columns, "copy"], ignore_index=True)
        sizes = pdf["length"].to_numpy()
        bins = LocalSearch(best_fit(sizes, length), sizes, length).run()
        sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
        for k, items in enumerate(bins):
            sequence[items] = k
            offset[items] = np.cumsum([0, *sizes[items][:-1]])
        shard = int(pdf["shard"].iloc[0]) if len(pdf) else 0
        return pdf.assign(sequence_id=(shard << 32) + sequence, offset=offset).drop(columns=["copy", "shard"])

    sharded = open_.withColumn("shard", F.pmod(F.xxhash64(*columns, "copy"), F.lit(shards)))
    packed = sharded.groupBy("shard").applyInPandas(pack, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    full = each.where(F.col("length") == length).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full).withColumnRenamed("id", id_col)
