"""Pairs of queries and documents scored where the documents lie: a page of queries goes to them, and only hits come back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Documents of a tile: a task scores so many with all queries of the page at once.
TILE = 256
#: Shared terms of a tile that are counted at once, new hits that a task holds before it drops those beyond the k first.
COUNTED, HELD = 1 << 20, 1 << 18
#: What a pair has to be under `least` to be left out before its exact score is known: far above the error of a sum of doubles.
SLACK = 1e-9


def dense(column: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors filled up with zeros, and their lengths; nulls have -1, and so have those beyond `dims`, which stay zero."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.maximum(size, 0)
    row, at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    fits = size[row] <= dims
    x = np.zeros((len(n), dims))
    x[row[fits], at[fits]] = column.flatten().to_numpy(zero_copy_only=False)[fits]
    return x, np.where(size <= dims, size, -1)


def inner(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of x with rows j of y, added up from the first component on, as a fold does."""
    total = np.zeros(len(i))
    for a, b in zip(x.T, y.T):
        total += a[i] * b[j]
    return total


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def norms(x: np.ndarray) -> np.ndarray:
    every = np.arange(len(x))
    return np.sqrt(inner(x, x, every, every))


@dataclass
class Page:
    """A bounded number of queries, sent to every task: ids, vectors, and for each of their terms the queries that hold it."""

    ids: pa.Array
    vectors: np.ndarray
    dims: np.ndarray
    sizes: np.ndarray
    terms: pa.Array
    starts: np.ndarray
    holders: np.ndarray
    weight: float
    least: float
    k: int

    @classmethod
    def of(cls, rows: pa.Table, weight: float, least: float, k: int) -> "Page":
        """rows, one at least: query_id, vector (null: none), terms (distinct)."""
        column = lambda name: pa.concat_arrays(rows[name].chunks)
        vector, terms = column("vector"), column("terms")
        vectors, dims = dense(vector, max(1, pc.max(pc.list_value_length(vector)).as_py() or 0))
        sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = terms.flatten().dictionary_encode(null_encoding="encode")
        code = coded.indices.to_numpy(zero_copy_only=False)
        holders = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(code, kind="stable")]
        starts = np.r_[0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))]
        return cls(column("query_id"), vectors, dims, sizes, coded.dictionary, starts, holders, weight, least, k)

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """query_id, doc_id, score: of a task's documents (doc_id, vector, terms) the k first hits of each query, ties by doc_id."""
        held, new, kind = [], 0, None
        for batch in batches:
            kind = batch.column("doc_id").type
            for at in range(0, batch.num_rows, TILE):
                held.append(self._tile(batch.slice(at, TILE)))
                new += len(held[-1])
                if new > HELD:
                    held, new = [self._first(held)], 0
        if kind is None:
            return
        hits = self._first(held)
        for at in range(0, len(hits), 1 << 16):
            own = hits.iloc[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(own["slot"].to_numpy())), pa.array(own["id"].to_numpy(), kind), pa.array(own["score"].to_numpy())], ["query_id", "doc_id", "score"])

    def _first(self, held: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(held, ignore_index=True).sort_values(["slot", "score", "id"], ascending=[True, False, True]).groupby("slot").head(self.k)

    def _shared(self, terms: pa.ListArray, size: np.ndarray) -> np.ndarray:
        """queries x documents: how many terms they share, counted from the queries that hold each of a document's terms."""
        queries, shared = len(self.sizes), np.zeros((len(size), len(self.sizes)), np.int64)
        code = pc.fill_null(pc.index_in(terms.flatten(), value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)[code >= 0]
        code = code[code >= 0]
        many = self.starts[code + 1] - self.starts[code]
        until = np.cumsum(many)
        low = 0
        while low < len(code):
            high = max(low + 1, int(np.searchsorted(until, (until[low - 1] if low else 0) + COUNTED, side="right")))
            m = many[low:high]
            place = np.repeat(self.starts[code[low:high]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            first, last = row[low], row[high - 1] + 1
            cell = np.repeat((row[low:high] - first) * queries, m) + self.holders[place]
            shared[first:last] += np.bincount(cell, minlength=(last - first) * queries).reshape(last - first, queries)
            low = high
        return shared.T

    def _tile(self, tile: pa.RecordBatch) -> pd.DataFrame:
        x, dims = dense(tile.column("vector"), self.vectors.shape[1])
        size = pc.list_value_length(tile.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
        both = self._shared(tile.column("terms"), size)
        union = self.sizes[:, None] + size[None, :] - both
        alike = both / np.maximum(union, 1)
        about = self.weight * (unit(self.vectors) @ unit(x).T) * (self.dims[:, None] == dims[None, :])
        q, d = np.nonzero(about + (1 - self.weight) * alike >= self.least - SLACK)
        whole = norms(self.vectors)[q] * norms(x)[d]
        ok = (whole > 0) & (self.dims[q] == dims[d])
        cosine = np.divide(inner(self.vectors, x, q, d), whole, out=np.zeros(len(q)), where=ok)
        score = self.weight * cosine + (1 - self.weight) * alike[q, d]
        hit = score >= self.least
        return pd.DataFrame({"slot": q[hit], "id": tile.column("doc_id").to_pandas().to_numpy()[d[hit]], "score": score[hit]})
