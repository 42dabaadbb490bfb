"""Language identification by a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathmill.llm.common import cut, ship

BITS = 18
#: Weights of a model at most: with many languages, features share buckets instead (2 ** 24 four-byte weights are 64 MB).
MOST_WEIGHTS = 1 << 24
#: A text of more words is labelled in windows of so many, each seen with some words around it.
LONGEST = 50_000
AROUND = 200
NGRAMS = (1, 2, 3, 4, 5)
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letters(token: str) -> str:
    """The token's letters in lower case."""
    token = _NOT_LETTERS.sub("", token.lower())
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def bucket_bits(labels: int) -> int:
    bits = BITS
    while bits > 8 and (2 << bits) * labels > MOST_WEIGHTS:
        bits -= 1
    return bits


def features(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words' features, one after the other, and where each word's begin.

    A word is framed by marks, so its n-grams at the frame are its prefixes and suffixes; the word as a whole is its
    entry in the lexicon. Buckets come from hashes of the UTF-8 bytes.
    """
    raw = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode(), dtype=np.uint8)
    ends = np.flatnonzero(raw == 3) + 1
    starts = np.concatenate([[0], ends[:-1]])
    lengths = ends - starts
    owner = np.repeat(np.arange(len(words)), lengths)
    inside = np.arange(len(raw)) - starts[owner]
    buckets, owners = [], []
    rolling = np.zeros(len(raw), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        # after this step rolling[i] is a hash of the n bytes from i on
        shifted = np.concatenate([raw[n - 1 :], np.zeros(n - 1, np.uint8)]).astype(np.uint64)
        rolling = (rolling + shifted + np.uint64(n)) * _MULTIPLIER
        rolling ^= rolling >> np.uint64(29)
        if n in NGRAMS:
            ok = inside + n <= lengths[owner]
            buckets.append((rolling[ok] >> np.uint64(64 - bits)).astype(np.int32))
            owners.append(owner[ok])
    position = np.uint64(31) ** np.minimum(inside, 63).astype(np.uint64)
    whole = np.add.reduceat((raw.astype(np.uint64) + np.uint64(7)) * position, starts) * _MULTIPLIER
    buckets.append(((whole >> np.uint64(64 - bits)).astype(np.int32)) + (1 << bits))
    owners.append(np.arange(len(words)))
    every, of = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return every[order], np.searchsorted(of[order], np.arange(len(words)))


def forward_backward(emissions: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of padded sequences, sorted by falling length; also the last step's scaled messages for training.

    emissions is (sequences, steps, labels), positive; counts are the sequences' lengths; transitions (labels, labels),
    positive. Returns marginals, forward messages and backward messages, each scaled per step.
    """
    sequences, steps, labels = emissions.shape
    alive = np.searchsorted(-counts, -np.arange(steps), side="left")  # sequences longer than t
    forward, backward = np.zeros_like(emissions), np.ones_like(emissions)
    for t in range(steps):
        n = alive[t]
        if n == 0:
            break
        message = emissions[:n, t] if t == 0 else (forward[:n, t - 1] @ transitions) * emissions[:n, t]
        forward[:n, t] = message / message.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        n = alive[t + 1]
        if n:
            message = (backward[:n, t + 1] * emissions[:n, t + 1]) @ transitions.T
            backward[:n, t] = message / message.sum(1, keepdims=True)
    marginals = forward * backward
    total = marginals.sum(2, keepdims=True)
    return marginals / np.where(total > 0, total, 1), forward, backward


@dataclass
class LanguageModel:
    """A trained field: label names, feature weights (buckets, labels), transition scores (labels, labels)."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of words, scaled to a greatest of 1; in parts, as a word has dozens of features."""
        out = np.ones((len(words), len(self.labels)), np.float32)
        for a in range(0, len(words), 10_000):
            buckets, starts = features(words[a : a + 10_000], (len(self.weights) // 2).bit_length() - 1)
            scores = np.add.reduceat(self.weights[buckets], starts, axis=0)
            out[a : a + 10_000] = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -30))
        return out


def train(texts: list[str], langs: list[str], sequences: int = 5000, steps: int = 40, rounds: int = 40, seed: int = 5) -> LanguageModel:
    """Fit the field by gradient ascent on the conditional likelihood.

    Training sequences are code-switched: runs of words from different texts, so the transitions learn how long a
    language lasts; each word's label is its text's language. Adagrad with a quadratic penalty, all sequences a round.
    """
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = []
    for text, lang in zip(texts, langs, strict=True):
        words = [w for w in map(letters, text.split()) if w]
        if words:
            docs.append((np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]), labels.index(lang)))
    k = len(labels)
    bits = bucket_bits(k)
    model = LanguageModel(labels, np.zeros((2 << bits, k), np.float32), np.zeros((k, k)))
    if not docs:
        return model
    by_label = [[d for d, x in docs if x == y] for y in range(k)]
    present = [y for y in range(k) if by_label[y]]
    types, truth = np.zeros((sequences, steps), np.int64), np.zeros((sequences, steps), np.int64)
    for s in range(sequences):
        t = 0
        while t < steps:
            y = present[rng.integers(len(present))]
            doc = by_label[y][rng.integers(len(by_label[y]))]
            at = rng.integers(len(doc))
            run = doc[at : at + min(int(rng.geometric(0.06)), steps - t)]
            types[s, t : t + len(run)], truth[s, t : t + len(run)] = run, y
            t += len(run)
    used, types = np.unique(types, return_inverse=True)
    types = types.reshape(sequences, steps)
    every = list(vocabulary)
    words = [every[i] for i in used.tolist()]
    buckets, starts = features(words, bits)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.diff([*starts, len(buckets)]))
    counts = np.full(sequences, steps)
    gold = np.zeros((len(words), k))
    np.add.at(gold, (types.ravel(), truth.ravel()), 1)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
    total = sequences * steps
    seen_w, seen_t = np.full(model.weights.shape, 1e-8, np.float32), np.full((k, k), 1e-8)
    for _ in range(rounds):
        scores = np.stack([np.bincount(owner, model.weights[buckets, y], len(words)) for y in range(k)], 1)
        emit = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -30))[types]
        link = np.exp(model.transitions)
        marginals, forward, backward = forward_backward(emit, counts, link)
        expected = np.stack([np.bincount(types.ravel(), marginals[:, :, y].ravel(), len(words)) for y in range(k)], 1)
        ahead = (emit * backward)[:, 1:]
        behind = forward[:, :-1] / np.einsum("stk,kl,stl->st", forward[:, :-1], link, ahead)[:, :, None]
        both = np.einsum("stk,stl->kl", behind, ahead) * link
        error = (gold - expected) / total
        slope = np.stack([np.bincount(buckets, error[owner, y], 2 << bits) for y in range(k)], 1).astype(np.float32) - 1e-7 * model.weights
        slope_t = (pairs - both) / total - 1e-4 * model.transitions
        seen_w += slope**2
        seen_t += slope_t**2
        model.weights += 0.3 * slope / np.sqrt(seen_w)
        model.transitions += 0.3 * slope_t / np.sqrt(seen_t)
    return model


class _Words(dict):
    """Numbers of tokens; 0 for those without a letter."""

    def __init__(self, model: LanguageModel):
        self.model, self.table = model, np.ones((1, len(model.labels)), np.float32)
        self.fresh: list[str] = []
        self.next = 1

    def __missing__(self, token: str) -> int:
        word = letters(token)
        if not word:
            self[token] = 0
            return 0
        self.fresh.append(word)
        self[token] = self.next
        self.next += 1
        return self.next - 1

    def scores(self) -> np.ndarray:
        if self.fresh:
            self.table = np.concatenate([self.table, self.model.emissions(self.fresh)])
            self.fresh = []
        return self.table


def classify(texts: list[str | None], model: LanguageModel, words: _Words | None = None, cells: int = 200_000) -> tuple[list[str], np.ndarray]:
    """The language of each text by its words' mean marginals, and that mean."""
    words = words if words is not None else _Words(model)
    names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    if not model.labels:
        return names.tolist(), score
    link = np.exp(model.transitions).astype(np.float32)
    numbers = [np.fromiter(map(words.__getitem__, (t or "").split()), np.int32) for t in texts]
    numbers = [x[x > 0] for x in numbers]
    table = words.scores()
    # pieces: text, words, and which of them count; a text is one piece unless it is very long
    pieces = [(i, x[max(0, a - AROUND) : a + LONGEST + AROUND], min(a, AROUND), min(LONGEST, len(x) - a)) for i, x in enumerate(numbers) for a in range(0, len(x), LONGEST)]
    counts = np.array([len(x) for _, x, _, _ in pieces], np.int64)
    order = np.argsort(-counts, kind="stable")
    sums = np.zeros((len(texts), len(model.labels)))
    at = 0
    while at < len(order):
        size = max(1, min(cells // counts[order[at]], len(order) - at))
        group = order[at : at + size]
        at += size
        padded = np.zeros((size, counts[group[0]]), np.int32)
        padded[np.arange(padded.shape[1]) < counts[group][:, None]] = np.concatenate([pieces[i][1] for i in group])
        marginals, _, _ = forward_backward(table[padded], counts[group], link)
        inside = marginals.sum(1)
        for k, p in enumerate(group.tolist()):
            i, x, first, n = pieces[p]
            sums[i] += inside[k] if n == len(x) else marginals[k, first : first + n].sum(0)
    words_of = np.array([len(x) for x in numbers])
    some = np.flatnonzero(words_of)
    mean = sums[some] / words_of[some][:, None]
    best = mean.argmax(1)
    names[some] = np.array(model.labels, object)[best]
    score[some] = np.minimum(mean[np.arange(len(some)), best], 1.0)
    return names.tolist(), score


def held_out(doc_id: Column) -> Column:
    """Whether the document is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, sample_rows: int = 1200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Train on about `sample_rows` labelled rows that are not held out, whole texts, as many of each language.

    Of a language the first by a hash of id and text are taken, sample_rows / languages of them, or all where it has
    fewer, so a rare language is learned too; rows that are the same count once.
    """
    usable = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    hashed = usable.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    light = cut(hashed.select("l", "h").distinct())
    numbers = cut(light.groupBy("l").agg(F.count(F.lit(1)).alias("n")))
    each = max(1, sample_rows // max(1, numbers.count()))
    # hashes are even, so twice the share that is wanted leaves enough of each language, and little to sort
    low = F.col("h") / F.lit(2.0**63) < 4.0 * each / F.col("n") - 1.0
    # a row per language, as the model has
    first = light.join(F.broadcast(numbers), "l").where(low).withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("k") <= each).select("l", "h")
    # the hashes first, without the texts; then the texts of these alone: sample_rows rows, or one a language
    picked = hashed.join(F.broadcast(first), ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t"))
    rows = sorted(picked.collect(), key=lambda r: (r["h"], r["l"]))
    return train([r["t"] for r in rows], [r["l"] for r in rows])


def identify_languages(docs: DataFrame, model: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id_col, held_out, lang_pred, score.

    The model is fitted on a bounded sample of labelled rows unless one is given; prediction reads the text alone and
    all of it; a text of more than 50,000 words is labelled in windows with 200 words around each, which changes no score
    beyond rounding, so that memory stays bounded. A text that is null or has no letter is `und` with score 0, as is every text where no row has a label.
    Rows that repeat an id are judged each; a null id is not held out; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    model = model or fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = spark.sparkContext.broadcast(model)  # MOST_WEIGHTS bounds it

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words(shared.value)
        for pdf in batches:
            for part in range(0, len(pdf), 500):
                piece = pdf.iloc[part : part + 500]
                names, score = classify(piece["body"].tolist(), shared.value, words)
                yield pd.DataFrame({"id": piece["id"], "held": piece["held"], "lang_pred": names, "score": score})
                if len(words) > 300_000:
                    words = _Words(shared.value)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held"), F.col(text_col).alias("body"))
    return rows.mapInPandas(predict, "id long, held boolean, lang_pred string, score double").toDF(id_col, "held_out", "lang_pred", "score")
