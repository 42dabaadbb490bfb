"""Suffix arrays by linear grouping, and repeated byte strings with them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from pathmill.llm.repeats import Rule, erase_repeats, gram_hashes, mixed


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes of `text` in order; its last symbol must be the least and occur once.

    First phase: suffixes start in groups by first symbol and groups are taken from the highest down. When a group is
    taken its suffixes share their Lyndon prefix for good. Each finds its previous smaller suffix: the nearest one to the
    left whose group is lower, by way of the pointers already known. Such a previous suffix has the taken prefix
    appended to its own, as often as it was found, so for every count it moves up into a new group right after its old.
    Second phase: in rising order, each suffix emits those whose Lyndon prefix ends where it begins, into the next free
    place of their group.
    """
    n = len(text)
    order = np.argsort(np.asarray(text), kind="stable").tolist()
    group, where, sizes = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for k, s in enumerate(order):
        if text[s] != text[order[start]]:
            start = k
        group[s], where[s] = start, k
        sizes[start] += 1
    unknown = -2
    before = [unknown] * n
    end = n - 1
    while end >= 0:
        g = group[order[end]]
        hits: dict[int, int] = {}
        for s in order[g : end + 1]:
            chain = []
            while before[s] == unknown:
                p = s - 1
                while p >= 0 and group[p] > g:
                    p = before[p]
                if p >= 0 and group[p] == g and before[p] == unknown:
                    chain.append(s)
                    s = p
                    continue
                p = before[p] if p >= 0 and group[p] == g else p
                before[s] = p
                if p >= 0:
                    hits[p] = hits.get(p, 0) + 1
                if chain:
                    s = chain.pop()
        moving = list(hits)
        while moving:
            moved: dict[int, list[int]] = {}
            for p in moving:
                moved.setdefault(group[p], []).append(p)
            for low, members in moved.items():
                size = sizes[low]
                if len(members) == size:
                    continue
                at = low + size
                new = at - len(members)
                for p in members:
                    at -= 1
                    other, here = order[at], where[p]
                    order[here], where[other] = other, here
                    order[at], where[p] = p, at
                for p in members:
                    group[p] = new
                sizes[low], sizes[new] = size - len(members), len(members)
            again = []
            for p in moving:
                hits[p] -= 1
                if hits[p]:
                    again.append(p)
            moving = again
        end = g - 1
    free = list(range(n))
    done = [-1] * n
    emitted = [False] * n
    done[0] = n - 1
    emitted[n - 1] = True
    for k in range(n):
        s = done[k] - 1
        while s >= 0 and not emitted[s]:
            g = group[s]
            done[free[g]] = s
            free[g] += 1
            emitted[s] = True
            s = before[s]
    return done


def _joined(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments with a byte after each, their starts and sizes, and each byte's segment."""
    sizes = np.array([len(s) for s in segments])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    return np.frombuffer(b"\0".join(segments) + b"\0", np.uint8), starts, sizes, np.repeat(np.arange(len(segments)), sizes + 1)


def least_by_order(parts: list[bytes], ids: np.ndarray, width: int) -> list[np.ndarray]:
    """For each part and each of its windows, the least id of a part that holds the window, by the parts' suffix array."""
    joined, starts, sizes, owner = _joined(parts)
    symbols = joined.astype(np.int64) + 2
    symbols[starts + sizes] = 1
    is_window = np.arange(len(joined)) - starts[owner] + width <= sizes[owner]
    ordered = np.array(suffix_array([*symbols.tolist(), 0]))
    ordered = ordered[ordered < len(joined)]
    ordered = ordered[is_window[ordered]]
    new = np.ones(len(ordered), bool)
    window = np.lib.stride_tricks.sliding_window_view(joined, width)
    for a in range(1, len(ordered), 1 << 16):
        b = min(a + (1 << 16), len(ordered))
        new[a:b] = (window[ordered[a:b]] != window[ordered[a - 1 : b - 1]]).any(1)
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(ids[owner[ordered]], first)
    answers = np.zeros(len(joined), np.int64)
    answers[ordered] = np.repeat(least, np.diff(np.concatenate([first, [len(ordered)]])))
    return [answers[a : a + n - width + 1] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def smallest_owners(segments: list[bytes], ids: np.ndarray, width: int) -> list[np.ndarray]:
    """For each segment and each of its windows of `width` bytes, the least id of a segment that holds the window.

    A window whose hash stands alone is its own; runs of the other windows are ordered exactly, equal runs once.
    """
    joined, starts, sizes, owner = _joined(segments)
    answers = ids[owner]
    hashes = mixed(gram_hashes(joined.astype(np.uint64), width))
    is_window = (np.arange(len(joined)) - starts[owner] + width <= sizes[owner])[: len(hashes)]
    at = np.flatnonzero(is_window)
    order = np.argsort(hashes[at], kind="stable")
    equal = hashes[at][order][1:] == hashes[at][order][:-1]
    shared = np.zeros(len(joined) + 1, bool)
    shared[at[order[1:][equal]]] = shared[at[order[:-1][equal]]] = True
    edge = np.diff(np.concatenate([[0], shared.astype(np.int8)]))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begins):
        return [answers[a : a + n - width + 1] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    raw = joined.tobytes()
    numbers: dict[bytes, int] = {}
    runs = [(a, b, numbers.setdefault(raw[a : b + width - 1], len(numbers))) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
    least = np.full(len(numbers), np.iinfo(np.int64).max)
    np.minimum.at(least, np.array([k for _, _, k in runs]), ids[owner[begins]])
    found = least_by_order(list(numbers), least, width)
    for a, b, k in runs:
        answers[a:b] = found[k]
    return [answers[a : a + n - width + 1] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def erase_repeated_bytes(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a `width`-byte string that also starts in a document with a smaller id.

    Returns id_col, n, removed, spans, kept (bytes) per row. Null texts are empty; null ids count as the largest; rows
    with one id never remove from each other; ties and repeated rows are judged each; very long texts are searched in
    segments of at most 64 windows; an empty table gives an empty result; other columns are ignored (see erase_repeats).
    """
    return erase_repeats(docs, Rule("bytes", width, min(20, width), smallest_owners, bundle_bytes=2 << 20, search_bytes=1 << 19, lone=False), id_col, text_col)
