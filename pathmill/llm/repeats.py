"""Passages of a fixed length that repeat across documents: routing by minimisers, exact search per shard.

A window is a run of `width` symbols (bytes, or words) of one document. Each window's route is the least hash among its
`gram`-symbol substrings, so equal windows have equal routes wherever they stand, and neighbouring windows mostly share
one. A job in four steps follows, each a shuffle of little:

1. bundle: documents are packed into rows of a few MB, compressed, and kept in the shared folder;
2. announce: every bundle sends its distinct routes to shards by route; a shard answers which occur in two documents or
   more. A route counts once per bundle, however many of its documents hold it, so hot passages shrink before the shuffle;
3. search: bundles send the segments (maximal runs of windows of one repeated route) to the shards, equal segments once
   with their smallest document; each shard searches its segments exactly and answers for every window the smallest
   document that holds it. A route that very many bundles hold is replaced by a hash of each whole window, which spreads
   its segments over all shards;
4. erase: bundles mark what their windows' answers cover and return the documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmill.llm.common import cut, ship

#: Stands for a null id, which counts as larger than all others.
NO_ID = np.iinfo(np.int64).max
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPLIT = b"\n"


def pack_arrays(*parts: np.ndarray | bytes) -> bytes:
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
    return zstandard.compress(head + b"".join(raw), 3)


def unpack_arrays(blob: bytes, *kinds: str) -> list:
    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds) + 1)[1:]
    at, out = 8 * (len(kinds) + 1), []
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        part = raw[at : at + size]
        out.append(part if kind == "bytes" else np.frombuffer(part, kind))
        at += size
    return out


def pack_sorted(values: np.ndarray) -> bytes:
    """Rising numbers as their differences, byte plane by byte plane, compressed."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` symbols from each place on, by doubling; the last size - 1 places are cut off."""
    out, done, have, length = None, 0, symbols, 1
    while True:
        if size & length:
            if out is None:
                out, done = have, length
            else:
                shift = np.uint64(pow(int(_ODD), length, 1 << 64))
                n = len(symbols) - done - length + 1
                out, done = out[:n] * shift + have[done : done + n], done + length
        length *= 2
        if length > size:
            return out
        n = len(have) - length // 2
        if n <= 0:
            return np.zeros(0, np.uint64)
        have = have[:n] * np.uint64(pow(int(_ODD), length // 2, 1 << 64)) + have[length // 2 : length // 2 + n]


def window_minima(h: np.ndarray, size: int) -> np.ndarray:
    length = 1
    while 2 * length <= size:
        h = np.minimum(h[:-length], h[length:])
        length *= 2
    return np.minimum(h[: len(h) - (size - length)], h[size - length :]) if size > length else h


@dataclass(frozen=True)
class Rule:
    """What is searched: the window's width and the gram that routes it, in words or bytes, and the exact search."""

    unit: str
    width: int
    gram: int
    search: Callable[[list[bytes], np.ndarray, int], list[np.ndarray]]
    bundle_bytes: int = 4 << 20
    shard_bytes: int = 24 << 20
    hot_bundles: int = 2000
    search_bytes: int = 4 << 20  # a shard is searched in parts of about this size, whole routes each
    windows: int = 64  # a segment has at most so many windows, so that long runs of one route are equal pieces
    lone: bool = True  # whether segments that are alone on their route are searched too, or answered as their least id


class Bundle:
    """The documents of a bundle: ids, one text with the documents one after the other, and their symbols."""

    def __init__(self, rule: Rule, blob: bytes):
        self.rule = rule
        self.ids, self.null, sizes, self.text = unpack_arrays(blob, "<i8", "|u1", "<i8", "bytes")
        self.raw = np.frombuffer(self.text, np.uint8)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if rule.unit == "bytes":
            self.starts, self.ends, self.docs = None, None, offsets
        else:
            blank = (self.raw == 32) | (self.raw == 10)
            edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
            self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            self.docs = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.docs)

    def symbols(self) -> np.ndarray:
        if self.starts is None:
            return self.raw
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        jumps = np.zeros(len(self.raw), np.int64)
        jumps[self.starts] = np.diff(np.concatenate([[0], self.starts]))
        inside = np.arange(len(self.raw)) - np.cumsum(jumps)
        powers = np.cumprod(np.full(int(lengths.max()) + 1, _ODD))
        values = (self.raw.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(inside, len(powers) - 1)]
        values[(self.raw == 32) | (self.raw == 10)] = 0
        return mixed(np.add.reduceat(values, self.starts))

    def routes(self, whole: np.ndarray | None = None, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """Route of each window start (its low bit is free), and whether a window starts there.

        whole: routes to be replaced by a hash of the whole window.
        """
        width, gram = self.rule.width, self.rule.gram
        symbols = self.symbols()
        n = len(symbols)
        route = np.zeros(n, np.uint64)
        for a in range(0, max(0, n - width + 1), block):
            part = symbols[a : a + block + width - 1].astype(np.uint64)
            least = _route(window_minima(mixed(gram_hashes(part, gram)), width - gram + 1))
            if whole is not None and len(whole) and (hot := np.isin(least, whole)).any():
                least = np.where(hot, _route(mixed(gram_hashes(part, width) ^ _MIX)), least)
            route[a : a + len(least)] = least
        valid = np.zeros(n, bool)
        for a, b in zip(self.docs.tolist(), self.docs[1:].tolist()):
            valid[a : max(a, b - width + 1)] = True
        return route, valid

    def runs(self, route: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each run of one route. Documents are apart, as width > 1."""
        joined = np.zeros(len(valid) + 1, bool)
        joined[1:-1] = valid[1:] & valid[:-1] & (route[1:] == route[:-1])
        starts = np.flatnonzero(valid & ~joined[:-1])
        sizes = np.flatnonzero(valid & ~joined[1:]) + 1 - starts
        if len(sizes) and int(sizes.max()) > self.rule.windows:
            pieces = -(-sizes // self.rule.windows)
            nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts, left = np.repeat(starts, pieces) + nth * self.rule.windows, np.repeat(sizes, pieces) - nth * self.rule.windows
            sizes = np.minimum(left, self.rule.windows)
        return starts, sizes

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The documents of these symbols."""
        return np.searchsorted(self.docs, at, side="right") - 1

    def place(self, a: int, b: int) -> tuple[int, int]:
        """Byte range of the symbols a to b."""
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))


def _route(h: np.ndarray) -> np.ndarray:
    """48 bits, the lowest of them free for a flag; routes only bring candidates together, the search is exact."""
    return (h >> np.uint64(16)) & ~np.uint64(1)


def bundles(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """bundle, symbols, blob: documents in the order in which the scan meets them."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, ids, null, texts, size = itertools.count(TaskContext.get().partitionId() << 32), [], [], [], 0

        def flush() -> pd.DataFrame:
            if rule.unit == "words":
                joined = [b" ".join(t.split()) + _SPLIT for t in texts]
            else:
                joined = texts
            blob = pack_arrays(np.array(ids, np.int64), np.array(null, np.uint8), np.array([len(t) for t in joined], np.int64), b"".join(joined))
            return pd.DataFrame({"bundle": [next(made)], "size": [size], "blob": [blob]})

        for pdf in batches:
            for key, text in zip(pdf["id"], pdf["body"], strict=True):
                data = (text or "").encode()
                ids.append(NO_ID if pd.isna(key) else int(key))
                null.append(bool(pd.isna(key)))
                texts.append(data)
                size += len(data)
                if size >= rule.bundle_bytes:
                    yield flush()
                    ids, null, texts, size = [], [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).mapInPandas(pack, "bundle long, size long, blob binary")


def _by_shard(routes: np.ndarray, shards: int) -> np.ndarray:
    return ((routes >> np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def _announce(rule: Rule, shards: int) -> Callable:
    def announce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, blob in zip(pdf["bundle"], pdf["blob"], strict=True):
                bundle = Bundle(rule, blob)
                route, valid = bundle.routes()
                starts, _ = bundle.runs(route, valid)
                own, ids = route[starts], bundle.ids[bundle.owner(starts)]
                order = np.lexsort((ids, own))
                own, ids = own[order], ids[order]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
                several = np.maximum.reduceat(ids, first) != np.minimum.reduceat(ids, first) if len(own) else np.zeros(0, bool)
                flagged = own[first] | several.astype(np.uint64)
                shard = _by_shard(flagged, shards)
                order = np.argsort(shard, kind="stable")
                edges = np.searchsorted(shard[order], np.arange(shards + 1))
                rows = [(s, key, pack_sorted(flagged[order[a:b]])) for s, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                yield pd.DataFrame(rows, columns=["shard", "bundle", "blob"])

    return announce


def _answer(rule: Rule) -> Callable:
    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_sorted(b) for b in pdf["blob"]]
        flagged, source = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        route = flagged & ~np.uint64(1)
        order = np.argsort(route, kind="stable")
        route, flagged, source = route[order], flagged[order], source[order]
        first = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(route)]]))
        repeated = (sizes > 1) | (np.maximum.reduceat(flagged & np.uint64(1), first) > 0)
        keep = np.repeat(repeated, sizes)
        route, source = route[keep] | np.repeat(sizes > rule.hot_bundles, sizes)[keep].astype(np.uint64), source[keep]
        order = np.argsort(source, kind="stable")
        edges = np.searchsorted(source[order], np.arange(len(parts) + 1))
        rows = [(key, 0, int(s), pack_sorted(route[order[a:b]])) for key, s, a, b in zip(pdf["bundle"], pdf["shard"], edges, edges[1:], strict=False) if b > a]
        return pd.DataFrame(rows, columns=["bundle", "kind", "shard", "blob"])

    return answer


def _segments(bundle: Bundle, routes: list[bytes], shards: int) -> tuple[dict[int, dict[tuple[int, bytes], list[int]]], list[tuple[int, int]]]:
    """Per shard the bundle's distinct segments with the numbers of their occurrences; of these, start and windows."""
    flagged = np.sort(np.concatenate([unpack_sorted(b) for b in routes]))
    known, is_hot = flagged & ~np.uint64(1), (flagged & np.uint64(1)) > 0
    route, valid = bundle.routes()
    starts, sizes = bundle.runs(route, valid)
    at = np.minimum(np.searchsorted(known, route[starts]), len(known) - 1)
    wanted = known[at] == route[starts]
    hot = wanted & is_hot[at]
    if hot.any():
        # each window of a hot run is a segment of its own, routed by its hash
        windows = np.concatenate([np.arange(a, a + n) for a, n in zip(starts[hot].tolist(), sizes[hot].tolist(), strict=True)])
        by_window, _ = bundle.routes(known[is_hot])
        starts, sizes = np.concatenate([starts[wanted & ~hot], windows]), np.concatenate([sizes[wanted & ~hot], np.ones(len(windows), np.int64)])
        route = by_window
    else:
        starts, sizes = starts[wanted], sizes[wanted]
    found: dict[int, dict[tuple[int, bytes], list[int]]] = {}
    places = list(zip(starts.tolist(), sizes.tolist(), strict=True))
    for k, ((a, n), r, s) in enumerate(zip(places, route[starts].tolist(), _by_shard(route[starts], shards).tolist(), strict=True)):
        x, y = bundle.place(a, a + n + bundle.rule.width - 1)
        found.setdefault(s, {}).setdefault((r, bundle.text[x:y]), []).append(k)
    return found, places


def _send(rule: Rule, shards: int) -> Callable:
    def send(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            bundle = Bundle(rule, left["blob"].iloc[0])
            found, places = _segments(bundle, list(right["blob"]), shards)
            ids = bundle.ids[bundle.owner(np.array([a for a, _ in places], np.int64))].tolist()
            for s, segments in found.items():
                least = [min([ids[k] for k in at]) for at in segments.values()]
                texts = [t for _, t in segments]
                rows.append((s, key[0], pack_arrays(np.array([r for r, _ in segments], np.uint64), np.array(least, np.int64), np.array([len(t) for t in texts], np.int64), b"".join(texts))))
        return pd.DataFrame(rows, columns=["shard", "bundle", "blob"])

    return send


def _search(rule: Rule) -> Callable:
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        numbers: dict[bytes, int] = {}
        least: list[int] = []
        route_of: list[int] = []
        wanted: list[list[int]] = []
        for blob in pdf["blob"]:
            routes, ids, sizes, text = unpack_arrays(blob, "<u8", "<i8", "<i8", "bytes")
            at, own = 0, []
            for r, d, n in zip(routes.tolist(), ids.tolist(), sizes.tolist(), strict=True):
                segment = text[at : at + n]
                at += n
                k = numbers.setdefault(segment, len(least))
                if k == len(least):
                    least.append(d)
                    route_of.append(r)
                elif d < least[k]:
                    least[k] = d
                own.append(k)
            wanted.append(own)
        texts, ids = list(numbers), np.array(least, np.int64)
        # the segments of a route are searched together
        _, group, sizes = np.unique(np.array(route_of, np.uint64), return_inverse=True, return_counts=True)
        order = np.argsort(group, kind="stable")
        if not rule.lone:
            order = order[sizes[group[order]] > 1]
        answers: dict[int, np.ndarray] = {}
        part: list[int] = []
        held = 0
        for k, last in zip(order.tolist(), np.append(group[order][1:] != group[order][:-1], True).tolist() if len(order) else []):
            part.append(k)
            held += len(texts[k])
            if last and held >= rule.search_bytes:
                answers |= zip(part, rule.search([texts[x] for x in part], ids[part], rule.width), strict=True)
                part, held = [], 0
        if part:
            answers |= zip(part, rule.search([texts[x] for x in part], ids[part], rule.width), strict=True)
        rows = []
        for key, own in zip(pdf["bundle"], wanted, strict=True):
            # one number for a segment that is answered alike throughout, else one per window
            flat = [answers[k] if k in answers else ids[k : k + 1] for k in own]
            flat = [x if len(x) == 1 or (x != x[0]).any() else x[:1] for x in flat]
            rows.append((key, 1, int(pdf["shard"].iloc[0]), pack_arrays(np.array([len(x) for x in flat], np.int64), np.concatenate(flat))))
        return pd.DataFrame(rows, columns=["bundle", "kind", "shard", "blob"])

    return search


def _erase(rule: Rule, shards: int) -> Callable:
    def erase(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c: [] for c in ("id", "n", "removed", "spans", "kept")})
        bundle = Bundle(rule, left["blob"].iloc[0])
        total = int(bundle.docs[-1])
        cover = np.zeros(total + 1, np.int32)
        routes = right[right["kind"] == 0]
        if len(routes):
            found, places = _segments(bundle, list(routes["blob"]), shards)
            ids = bundle.ids[bundle.owner(np.array([a for a, _ in places], np.int64))].tolist()
            for s, blob in right.loc[right["kind"] == 1, ["shard", "blob"]].itertuples(index=False):
                counts, values = unpack_arrays(blob, "<i8", "<i8")
                at = 0
                whole = values.tolist()
                for occurrences, n in zip(found[s].values(), counts.tolist(), strict=True):
                    answer, least = values[at : at + n], whole[at]
                    at += n
                    for k in occurrences:
                        start, windows = places[k]
                        own = ids[k]
                        if n == 1:
                            if least < own:
                                cover[start] += 1
                                cover[start + windows + rule.width - 1] -= 1
                        else:
                            for w in np.flatnonzero(answer < own).tolist():
                                cover[start + w] += 1
                                cover[start + w + rule.width] -= 1
        gone = np.cumsum(cover[:total]) > 0
        rows = []
        for d, (a, b) in enumerate(zip(bundle.docs.tolist(), bundle.docs[1:].tolist())):
            edge = np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))
            cuts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            if rule.unit == "bytes":
                kept = bundle.text[a:b] if not len(cuts) else bundle.raw[a:b][~gone[a:b]].tobytes()
            elif b == a:
                kept = b""
            else:
                x, y = bundle.place(a, b)
                kept = bundle.text[x:y] if not len(cuts) else b" ".join([bundle.text[p:q] for p, q in zip(bundle.starts[a:b][~gone[a:b]].tolist(), bundle.ends[a:b][~gone[a:b]].tolist())])
            rows.append((None if bundle.null[d] else int(bundle.ids[d]), b - a, int((ends - cuts).sum()), np.stack([cuts, ends], 1).ravel().tolist(), kept))
        return pd.DataFrame(rows, columns=["id", "n", "removed", "spans", "kept"]).astype({"id": "Int64"})

    return erase


def erase_repeats(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n (symbols), removed, spans (start, end, start, end, ...), kept (bytes).

    A symbol is removed when a window that covers it also starts in a row with a smaller id. Null ids count as the
    largest, and rows with one id never remove from each other. Null texts are empty. Extra columns are ignored and an
    empty table gives an empty result.
    """
    ship(docs.sparkSession)
    packed = cut(bundles(docs, rule, id_col, text_col))
    size = packed.agg(F.sum("size")).first()[0] or 0
    shards = max(8, -(-size // rule.shard_bytes))
    answers = cut(packed.mapInPandas(_announce(rule, shards), "shard long, bundle long, blob binary").groupBy("shard").applyInPandas(_answer(rule), "bundle long, kind int, shard long, blob binary"))
    whole = packed.select("bundle", "blob")
    sent = whole.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInPandas(_send(rule, shards), "shard long, bundle long, blob binary")
    found = sent.groupBy("shard").applyInPandas(_search(rule), "bundle long, kind int, shard long, blob binary")
    marked = whole.groupBy("bundle").cogroup(answers.unionByName(found).groupBy("bundle")).applyInPandas(_erase(rule, shards), "id long, n long, removed long, spans array<long>, kept binary")
    return marked.withColumnRenamed("id", id_col)
