"""Byte-level BPE: pre-tokens from class arrays and a scan of transition functions, cached pair merging, decoding by offsets."""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmill.llm.common import ship

#: The white space of the pattern and its contractions, as the letters after the apostrophe.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT = "stmd"
LONG = ["re", "ve", "ll"]

#: Classes of a code point in its place. Blank: a space before something else than white space; last: other white space
#: before such; white: white space before more of it or at the end; short, long: an apostrophe before one or two letters
#: of a contraction. FIRST is added at the first code point of a text.
LETTER, NUMBER, OTHER, BLANK, LAST, INNER, SHORT_MARK, LONG_MARK = range(8)
FIRST = 8
#: States after a code point: nothing open, a run of letters, numbers or others, a blank waiting for a run, a run of white
#: space, one or two letters of a contraction still to come.
NOTHING, LETTERS, NUMBERS, OTHERS, WAITING, SPACES, ONE_MORE, TWO_MORE = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point of a class, and whether a pre-token starts there."""
    if kind >= FIRST:
        return _step(NOTHING, kind - FIRST)
    if kind == LETTER and state in (ONE_MORE, TWO_MORE):
        return (NOTHING if state == ONE_MORE else ONE_MORE), False
    if kind in (LETTER, NUMBER, OTHER):
        run = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS}[kind]
        return run, state not in (run, WAITING)
    if kind in (SHORT_MARK, LONG_MARK):
        if state in (OTHERS, WAITING):  # inside a run of others an apostrophe is one of them
            return OTHERS, False
        return (ONE_MORE if kind == SHORT_MARK else TWO_MORE), True
    if kind == INNER:
        return SPACES, state != SPACES
    return (WAITING if kind == BLANK else NOTHING), True


class Scanner:
    """Start flags of pre-tokens for many texts at once, without a regular expression.

    Each code point is a function from state to state. Functions compose associatively and all that arise from the
    sixteen classes are a small closed set, so a function is a number and composing is a look-up. Code points are laid out
    in rows; all rows are scanned side by side, the rows' totals are scanned in the same way, and the state before a row
    gives the states inside it.
    """

    ROW = 128

    def __init__(self) -> None:
        each = [tuple(_step(s, kind)[0] for s in range(8)) for kind in range(16)]
        number = {f: k for k, f in enumerate(dict.fromkeys([tuple(range(8)), *each]))}
        todo = list(number)
        while todo:
            f = todo.pop()
            for g in each:
                if (h := tuple(g[s] for s in f)) not in number:
                    number[h] = len(number)
                    todo.append(h)
        functions = list(number)
        self.size = len(functions)
        self.of_kind = np.array([number[f] for f in each], np.uint16)
        self.then = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16).ravel()
        self.applied = np.array(functions, np.uint8).ravel()
        self.starts = np.array([[_step(s, kind)[1] for kind in range(16)] for s in range(8)], bool).ravel()
        self.classes = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for point in range(sys.maxunicode + 1):
            group = unicodedata.category(chr(point))[0]
            if group in "LN":
                self.classes[point] = LETTER if group == "L" else NUMBER
        self.classes[WHITE] = INNER

    def kinds(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The class of every code point; first marks where texts begin and has one place more, set."""
        kinds = self.classes[points]
        white = np.flatnonzero(kinds == INNER)
        ends = first[white + 1]
        before = white[~ends & (kinds[np.minimum(white + 1, len(kinds) - 1)] != INNER)]
        kinds[before] = np.where(points[before] == 0x20, BLANK, LAST)
        marks = np.flatnonzero(points == 0x27)
        marks = marks[~first[marks + 1]]
        one = points[np.minimum(marks + 1, len(points) - 1)]
        kinds[marks[np.isin(one, [ord(c) for c in SHORT])]] = SHORT_MARK
        more = ~first[np.minimum(marks + 2, len(points))]
        two = points[np.minimum(marks + 2, len(points) - 1)]
        for a, b in LONG:
            kinds[marks[more & (one == ord(a)) & (two == ord(b))]] = LONG_MARK
        kinds[first[:-1]] += FIRST
        return kinds

    def _inclusive(self, functions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Functions composed from the start of their row on, column by column, and those of all rows before each row."""
        rows = -(-len(functions) // self.ROW)
        laid = np.zeros(rows * self.ROW, np.int64)  # 0 is the function that changes nothing
        laid[: len(functions)] = functions
        columns = laid.reshape(rows, self.ROW).T.copy()
        for k in range(1, self.ROW):
            columns[k] = self.then[columns[k - 1] * self.size + columns[k]]
        before = np.zeros(rows, np.int64)
        if rows > 1:
            inner, outer = self._inclusive(columns[-1])
            whole = self.then[np.repeat(outer, self.ROW)[:rows] * self.size + inner.T.ravel()[:rows]]
            before[1:] = whole[:-1]
        return columns, before

    def boundaries(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: a flag for each code point."""
        if not len(points):
            return np.zeros(0, bool)
        kinds = self.kinds(points, first)
        columns, before = self._inclusive(self.of_kind[kinds])
        entered = self.applied[before * 8 + NOTHING]
        after = self.applied[columns * 8 + entered].T.ravel()[: len(points)]
        state = np.empty(len(points), np.int64)
        state[0] = NOTHING
        state[1:] = after[:-1]
        return self.starts[state * 16 + kinds]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank is merged, leftmost first, until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, a, a + 2) for a in range(n - 1) if (r := ranks.get(piece[a : a + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, c = heapq.heappop(heap)
        b = end[a]
        if not b or b >= n or end[b] != c:  # one of the two has been merged since
            continue
        end[a], end[b] = c, 0
        if c < n:
            before[c] = a
            if (r := ranks.get(piece[a : end[c]])) is not None:
                heapq.heappush(heap, (r, a, end[c]))
        if a and (r := ranks.get(piece[before[a] : c])) is not None:
            heapq.heappush(heap, (r, before[a], c))
    out, a = [], 0
    while a < n:
        out.append(ranks[piece[a : end[a]]])
        a = end[a]
    return out


class Merges(dict):
    """Ids of pre-tokens as little-endian bytes, remembered in two generations of KEPT each; the older one is dropped."""

    KEPT = 150_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.older = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = np.array(merged(piece.encode(), self.ranks), "<u4").tobytes()
        if len(self) >= self.KEPT:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


class Vocabulary:
    """Encoder and decoder of a rank file; one for each file and task process."""

    #: Code points (or bytes of ids) that a task takes at once; a longer text goes alone.
    BLOCK = 400_000
    _known: dict[str, "Vocabulary"] = {}

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.scanner = Scanner()
        self.merges = Merges(self.ranks)

    @classmethod
    def load(cls, name: str) -> "Vocabulary":
        if name not in cls._known:
            import public_tokenizers

            cls._known[name] = cls(public_tokenizers.path(name))
        return cls._known[name]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, in order; all texts are scanned at once."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at = np.cumsum([0, *map(len, texts)])
        first = np.zeros(len(points) + 1, bool)
        first[at] = True
        starts = np.flatnonzero(self.scanner.boundaries(points, first))
        cuts = np.searchsorted(starts, at).tolist()
        edges = [*starts.tolist(), len(joined)]
        found = []
        for a, b in zip(cuts, cuts[1:]):
            pieces = [self.merges[joined[i:j]] for i, j in zip(edges[a:b], edges[a + 1 : b + 1])]
            found.append(np.frombuffer(b"".join(pieces), "<u4"))
        return found

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each id's token ends in its text."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray, ends: np.ndarray, start: int = 0, stop: int | None = None) -> bytes:
        """The bytes from start to stop of a text, from the tokens that its offsets place there alone."""
        if not len(ids):
            return b""
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        if stop <= start:
            return b""
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        ids, lengths = ids[a:b], self.lengths[ids[a:b]]
        begin = int(ends[a]) - int(lengths[0])
        placed = ends[a:b].astype(np.int64) - lengths - begin
        found = self.bytes[np.repeat(self.begins[ids] - placed, lengths) + np.arange(int(lengths.sum()))]
        return found[start - begin : stop - begin].tobytes()


def _in_blocks(sizes: list[int], most: int) -> Iterator[slice]:
    """Neighbouring rows of `most` together, or a row alone."""
    at = held = 0
    for k, size in enumerate(sizes):
        if k > at and held + size > most:
            yield slice(at, k)
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield slice(at, len(sizes))


def encode_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, ids and ends, both unsigned 32-bit little-endian numbers in binary.

    `ends` has the byte at which each token ends in the text's UTF-8. Whole texts, however long; null counts as empty and
    has no ids; rows are encoded each, whatever their ids are; an empty table gives an empty result; other columns are
    ignored. There is no shuffle; a task holds the rows of an Arrow batch and the arrays of a block of texts.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.load(vocabulary)
        for batch in batches:
            key, body = batch.column(0), batch.column(1)
            for k in _in_blocks(pc.fill_null(pc.utf8_length(body), 0).to_pylist(), Vocabulary.BLOCK):
                ids = vocab.encode(pc.fill_null(body[k], "").to_pylist())
                ends = [vocab.offsets(x).astype("<u4").tobytes() for x in ids]
                yield pa.record_batch([key[k], pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(ends, pa.binary())], names=["id", "ids", "ends"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(encode, f"id {kind}, ids binary, ends binary").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", start: int = 0, stop: int | None = None) -> DataFrame:
    """The rows of encode_documents with `decoded`: the bytes of each text, or those from start to stop."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.load(vocabulary)
        for batch in batches:
            for k in _in_blocks(pc.binary_length(batch.column("ids")).to_pylist(), Vocabulary.BLOCK):
                part = batch[k]
                both = zip(part.column("ids"), part.column("ends"), strict=True)
                texts = [vocab.decode(np.frombuffer(i.as_buffer(), "<u4"), np.frombuffer(e.as_buffer(), "<u4"), start, stop) for i, e in both]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    ship(encoded.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(decode, f"{kinds}, decoded binary")
