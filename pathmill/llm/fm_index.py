"""A compressed full-text index over words, and repeated word sequences with it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from pathmill.llm.repeats import Rule, erase_repeats


class BitRank:
    """A bit vector in blocks of 128 bits with counts before each; blocks all of one bit are stored once."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 128) * 128, np.uint8)
        padded[: len(bits)] = bits
        words = np.packbits(padded, bitorder="little").view("<u8").reshape(-1, 2)
        counts = np.bitwise_count(words).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint32)
        mixed = (counts > 0) & (counts < 128)
        self.blocks = np.concatenate([np.array([[0, 0], [2**64 - 1, 2**64 - 1]], np.uint64), words[mixed]])
        self.slot = np.where(mixed, np.cumsum(mixed) + 1, counts == 128).astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        block = at >> 7
        slot = self.slot[block]
        second = (at & 64) > 0
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        inside = np.bitwise_count(self.blocks[slot, second.astype(np.int64)] & mask).astype(np.int64)
        return self.before[block] + inside + np.where(second, np.bitwise_count(self.blocks[slot, 0]), 0)

    def nbytes(self) -> int:
        return self.before.nbytes + self.blocks.nbytes + self.slot.nbytes


class WaveletTree:
    """A sequence of symbols, level by level from the highest bit, zeros before ones on each level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        self.bits = bits
        for shift in range(bits - 1, -1, -1):
            level = ((symbols >> shift) & 1).astype(np.uint8)
            self.levels.append((shift, BitRank(level), int(len(level) - level.sum())))
            symbols = np.concatenate([symbols[level == 0], symbols[level == 1]])
        every = np.arange(1 << bits)
        self.first = self._walk(every, np.zeros_like(every))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, ones, zeros in self.levels:
            up = ((symbol >> shift) & 1).astype(bool)
            before = ones.rank(at)
            at = np.where(up, zeros + before, at - before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._walk(symbol, at) - self.first[symbol]

    def nbytes(self) -> int:
        return self.first.nbytes + sum(ones.nbytes() for _, ones, _ in self.levels)


class FMIndex:
    """Backward search over the runs of a text's transform; the text and its suffix order are not kept.

    Suffixes are ordered by their first `depth` symbols, so matches are followed up to `depth`. The transform is stored
    by its runs: a wavelet tree over the runs' symbols, their starts, and for each symbol the running total of its runs'
    lengths. Beside it stand how many symbols neighbouring suffixes share (a byte each), which gives the interval of a
    shortened match, and for each interval of matches of `depth` symbols the least owner.
    """

    def __init__(self, text: np.ndarray, depth: int, owners: np.ndarray | None = None):
        rank, length = text.astype(np.int64), 1
        while length < depth:
            later = np.zeros_like(rank)
            later[: max(0, len(rank) - length)] = rank[length:] + 1
            rank = np.unique(rank * (int(later.max()) + 1) + later, return_inverse=True)[1].astype(np.int64)
            length *= 2
        order = np.argsort(rank, kind="stable")
        self.size, self.depth = len(text), depth
        symbols = int(text.max()) + 1
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        transform = text[order - 1]
        self.starts = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]]))
        lengths = np.diff(np.append(self.starts, len(text)))
        self.heads = transform[self.starts].astype(np.uint32)
        self.tree = WaveletTree(transform[self.starts], max(1, (symbols - 1).bit_length()))
        by_symbol = np.argsort(self.heads, kind="stable")
        self.totals = np.concatenate([[0], np.cumsum(lengths[by_symbol])])
        self.first_run = np.searchsorted(self.heads[by_symbol], np.arange(symbols))
        padded = np.concatenate([text, np.full(depth, -1)])
        self.shared = np.zeros(len(text), np.uint8)
        alive = np.arange(1, len(text))
        for d in range(depth):
            alive = alive[padded[order[alive] + d] == padded[order[alive - 1] + d]]
            self.shared[alive] = d + 1
        self._edges: dict[int, np.ndarray] = {}
        self.least = np.minimum.reduceat(owners[order], self.edges(depth)) if owners is not None else None

    def edges(self, length: int) -> np.ndarray:
        """Where the intervals of matches of this length begin."""
        if length not in self._edges:
            self._edges[length] = np.flatnonzero(self.shared < length if length else np.arange(self.size) == 0).astype(np.uint32)
        return self._edges[length]

    def before(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each place."""
        run = np.searchsorted(self.starts, at)  # runs that begin before it; the last may reach beyond
        first = self.first_run[symbol]
        whole = self.totals[first + self.tree.rank(symbol, run)] - self.totals[first]
        last = np.maximum(run - 1, 0)
        end = np.append(self.starts[1:], self.size)[last]
        return whole - np.where((run > 0) & (self.heads[last] == symbol), end - at, 0)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with a symbol put before them."""
        known = symbol < len(self.first_run)
        symbol = np.where(known, symbol, 0)
        both = self.before(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.smaller[symbol]
        return base + both[: len(low)], np.where(known, base + both[len(low) :], 0)

    def shorten(self, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first `length` symbols of the matches at `low`."""
        edges = self.edges(length)
        at = np.searchsorted(edges, low, side="right")
        return edges[at - 1].astype(np.int64), np.append(edges, self.size)[at].astype(np.int64)

    def matching_statistics(self, patterns: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the patterns (one after the other, `ends` after each): the length of the longest match that
        begins there, at most `depth`, and the low end of its interval.

        All patterns are streamed at once from their ends: a match takes in the symbol before it and gives up symbols at
        its end, one when it has `depth`, else as many as keep it from growing.
        """
        length, place = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        sizes = np.diff(np.concatenate([[0], ends]))
        order = np.argsort(-sizes, kind="stable")
        sizes, last = sizes[order], ends[order] - 1
        low, high, have = np.zeros(len(ends), np.int64), np.full(len(ends), self.size), np.zeros(len(ends), np.int64)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -step, side="left"))  # patterns with more symbols than steps so far
            at = last[:n] - step
            full = np.flatnonzero(have[:n] == self.depth)
            low[full], high[full] = self.shorten(low[full], self.depth - 1)
            have[full] -= 1
            todo = np.arange(n)
            while len(todo):
                a, b = self.extend(patterns[at[todo]], low[todo], high[todo])
                grown = b > a
                done = todo[grown]
                low[done], high[done] = a[grown], b[grown]
                have[done] += 1
                todo = todo[~grown]
                ended = todo[have[todo] == 0]
                low[ended], high[ended] = 0, self.size
                todo = todo[have[todo] > 0]
                had = have[todo]
                for d in np.unique(had).tolist():
                    low[todo[had == d]], high[todo[had == d]] = self.shorten(low[todo[had == d]], d - 1)
                have[todo] -= 1
            length[at], place[at] = have[:n], low[:n]
        return length, place

    def least_owner(self, place: np.ndarray) -> np.ndarray:
        """The least owner of the interval of `depth` symbols that begins at each place."""
        return self.least[np.searchsorted(self.edges(self.depth), place)]

    def nbytes(self) -> int:
        kept = [self.smaller, self.starts, self.heads, self.totals, self.first_run, self.shared, self.least, *self._edges.values()]
        return self.tree.nbytes() + sum(x.nbytes for x in kept if x is not None)


def smallest_owners(segments: list[bytes], ids: np.ndarray, width: int) -> list[np.ndarray]:
    """For each segment and each of its windows of `width` words, the least id of a segment that holds the window.

    The segments are indexed together; then each is streamed through the index, and the places where the match has
    `width` words report the least id of their interval. Nothing else decides.
    """
    numbers: dict[bytes, int] = {}
    words = [[numbers.setdefault(w, len(numbers) + 1) for w in s.split(b" ")] for s in segments]
    sizes = np.array([len(w) for w in words])
    text = np.concatenate([np.array([*w, 0]) for w in words])
    index = FMIndex(text, width, np.repeat(ids, sizes + 1))
    ends = np.cumsum(sizes)
    length, place = index.matching_statistics(text[text > 0], ends)
    found = np.full(len(length), np.iinfo(np.int64).max)
    whole = np.flatnonzero(length == width)
    found[whole] = index.least_owner(place[whole])
    return [found[b - n : b - width + 1] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def erase_repeated_words(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a `width`-word window that also starts in a document with a smaller id.

    Words are runs of anything but ASCII white space. Returns id_col, n, removed, spans, kept (bytes: the remaining
    words joined by one space) per row. Null texts have no words; null ids count as the largest; rows with one id never
    remove from each other; ties and repeated rows are judged each; very long texts are searched in segments of at most
    64 windows; an empty table gives an empty result; other columns are ignored (see erase_repeats).
    """
    return erase_repeats(docs, Rule("words", width, min(6, width), smallest_owners), id_col, text_col)
