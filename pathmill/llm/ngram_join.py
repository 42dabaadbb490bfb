"""Near-duplicate texts: n-gram Jaccard join by a MinHash LSH forest with exact verification."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmill.llm.common import cut, ship
from pathmill.llm.components import components
from pathmill.llm.repeats import gram_hashes, mixed

HASHES = 128
TREES = 32
#: Lengths of the prefixes that a text may match, from the whole path to the shortest.
DEPTHS = (12, 10, 8, 6)
#: Bits of each MinHash value on a path: six values are one 64-bit number, and a path is two of them.
BITS = 10
HALF = 6
#: Texts per block of the exact verification.
BLOCK = 64
#: Bytes of a text's sketch, one of a MinHash value each; texts that a task compares by them; and by how many deviations
#: of what the sketches of two linked texts agree on they may fall short (one pair of 150,000 does).
SKETCH = 256
CROWD = 256
DEVIATIONS = 4.35

_RNG = np.random.default_rng(11)
_FACTORS = _RNG.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64)
_PATHS = np.stack([_RNG.permutation(HASHES)[: DEPTHS[0]] for _ in range(TREES)])


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' runs of n words, one text after the other, and how many each text has.

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    joined = [b" ".join(t.split()) + b"\n" for t in texts]
    raw = np.frombuffer(b"".join(joined), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in joined])])
    blank = (raw == 32) | (raw == 10)
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    jumps = np.zeros(len(raw), np.int64)
    jumps[starts] = np.diff(np.concatenate([[0], starts]))
    powers = np.cumprod(np.full(int((ends - starts).max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    values = (raw.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(np.arange(len(raw)) - np.cumsum(jumps), len(powers) - 1)]
    values[blank] = 0
    words = mixed(np.add.reduceat(values, starts))
    bounds = np.searchsorted(starts, offsets)
    counts = np.diff(bounds)
    every = mixed(gram_hashes(words, n)) if len(words) >= n else np.zeros(0, np.uint64)
    inside = np.arange(len(every)) + n <= np.repeat(bounds[1:], counts)[: len(every)]
    if not ((counts > 0) & (counts < n)).any():
        return every[inside], np.maximum(counts - n + 1, 0)
    parts = [every[a : b - n + 1] if b - a >= n else mixed(gram_hashes(words[a:b], b - a)) if b > a else every[:0] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
    return np.concatenate(parts), np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values (texts, SKETCH) of texts with at least one shingle each; paths are made of the first HASHES."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.empty((len(counts), SKETCH), np.uint32)
    for k, (f, o) in enumerate(zip(_FACTORS, _OFFSETS)):
        out[:, k] = np.minimum.reduceat(((hashes * f + o) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def paths(signature: np.ndarray) -> np.ndarray:
    """The trees' paths, (texts, 2 * TREES): the first six values of each tree as one number, then the next six."""
    out = np.zeros((len(signature), TREES, 2), np.int64)
    for d in range(DEPTHS[0]):
        out[:, :, d // HALF] = (out[:, :, d // HALF] << BITS) | (signature[:, _PATHS[:, d]] & ((1 << BITS) - 1)).astype(np.int64)
    return out.reshape(len(signature), 2 * TREES)


def _sign(n: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                pdf = whole.iloc[at : at + 500]
                hashes, counts = shingles([(t or "").encode() for t in pdf["body"]], n)
                some = counts > 0
                out = pd.DataFrame({"id": pdf["id"].astype("Int64"), "digest": pdf["digest"]})
                values = signatures(hashes, counts[some]) if some.any() else np.zeros((0, SKETCH), np.uint32)
                found, sketch = paths(values), values.astype(np.uint8)
                row = np.cumsum(some) - 1
                ends = np.cumsum(counts).tolist()
                out["shingles"] = [len(np.unique(hashes[e - c : e])) for e, c in zip(ends, counts.tolist())]
                out["paths"] = [found[r] if s else None for r, s in zip(row, some)]
                out["sketch"] = [sketch[r].tobytes() if s else None for r, s in zip(row, some)]
                yield out

    return sign


def _longest_matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of the sorted tries that share a prefix with a neighbour, and the longest such prefix.

    In sorted order the longest match of a path is one of its two neighbours. The first and the last entry of a task do
    not see one of theirs and are kept with the whole path; that costs two rows a task, and counting settles them.
    """
    columns = ["tree", "high", "low", "node"]

    def matches(held: np.ndarray, before: int) -> np.ndarray:
        """Between entries; at the first place what is before them, at the last nothing yet."""
        match = np.zeros(len(held) + 1, np.int64)
        match[0] = before
        same = held[1:, 0] == held[:-1, 0]
        high, low = held[1:, 1] == held[:-1, 1], held[1:, 2] ^ held[:-1, 2]
        for d in DEPTHS:
            shared = same & high & ((low >> (BITS * (DEPTHS[0] - d))) == 0 if d > HALF else True)
            match[1:-1] = np.maximum(match[1:-1], np.where(shared, d, 0))
        return match

    carried, before = None, DEPTHS[0]
    for pdf in batches:
        if not len(pdf):
            continue
        held = pdf[columns].to_numpy(np.int64)
        if carried is not None:
            held = np.concatenate([carried, held])
        match = matches(held, before)
        longest = np.maximum(match[:-1], match[1:])
        # the last entry waits for its next neighbour
        keep = longest[:-1] > 0
        yield pd.DataFrame(held[:-1][keep], columns=columns).assign(longest=longest[:-1][keep])
        carried, before = held[-1:], int(match[-2])
    if carried is not None:
        yield pd.DataFrame(carried, columns=columns).assign(longest=DEPTHS[0])


def shorten(tree: np.ndarray, depth: np.ndarray, texts: np.ndarray, group: np.ndarray, similarity: float, target: float) -> np.ndarray:
    """Which of the entries are to be opened: for each text (`group`, from 0 on) its prefixes, shortened to the target.

    Entries are a text's prefixes in each tree with the number of texts that share them; others are shared by nobody. A
    text accepts crowds of 64 texts, which are one block to verify, then of 128, 256, ...: in each tree it takes the
    shortest prefix with no more. A text at `similarity` shares a prefix of d values with probability similarity ** d,
    so it stops as soon as a partner at the threshold would have shown itself with probability `target`. Texts in
    crowded tries thus use long prefixes there and short ones elsewhere; no crowd is cut. (To accept less at first would
    bend the choice towards prefixes without the partner: a crowd must be many for one more not to matter.)
    """
    total = int(group.max()) + 1 if len(group) else 0
    crowd = np.ones((total, TREES, len(DEPTHS)))
    place = np.searchsorted(-np.array(DEPTHS), -depth)
    crowd[group, tree, place] = texts
    meets = 1 - similarity ** np.array(DEPTHS, float)
    opened = np.zeros(crowd.shape, bool)
    todo, allowed = np.arange(total), float(BLOCK)
    while len(todo):
        fits = crowd[todo] <= allowed
        # DEPTHS fall, so the last that fits is the shortest; crowds only grow as prefixes shorten
        number = fits.sum(2)
        shortest = np.maximum(number - 1, 0)
        missed = np.where(number > 0, meets[shortest], 1.0).prod(1)
        done = (missed <= 1 - target) | (allowed >= crowd[todo].max((1, 2)))
        chosen = np.zeros(fits.shape, bool)
        np.put_along_axis(chosen, shortest[:, :, None], (number > 0)[:, :, None], 2)
        opened[todo[done]] = chosen[done]
        todo, allowed = todo[~done], allowed * 2
    return opened[group, tree, place]


def _shorten_sorted(similarity: float, target: float):
    """Keys of the prefixes that the texts open; entries come sorted by text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in itertools.chain(batches, [None]):
            if pdf is not None:
                if not len(pdf):
                    continue
                held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                ready = held[held["node"] != held["node"].iloc[-1]]
                held = held[held["node"] == held["node"].iloc[-1]]
            else:
                ready = held if held is not None else pd.DataFrame()
            for a, b in _whole_groups(ready["node"].to_numpy() if len(ready) else np.zeros(0, np.int64)):
                part = ready.iloc[a:b]
                group = np.unique(part["node"].to_numpy(), return_inverse=True)[1]
                opened = shorten(part["tree"].to_numpy(), part["depth"].to_numpy(), part["texts"].to_numpy(), group, similarity, target)
                yield part.loc[opened & (part["texts"].to_numpy() > 1), ["key"]].drop_duplicates()

    return run


def _whole_groups(sorted_keys: np.ndarray, size: int = 50_000) -> Iterator[tuple[int, int]]:
    """Ranges of about `size` rows that end with the last row of a key."""
    at = 0
    while at < len(sorted_keys):
        end = min(at + size, len(sorted_keys))
        end = int(np.searchsorted(sorted_keys, sorted_keys[end - 1], side="right"))
        yield at, end
        at = end


def _sets(n: int):
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hashes, counts = shingles([(t or "").encode() for t in pdf["body"]], n)
            ends = np.cumsum(counts)
            out = pdf[["node", "root", "copies", "block", "own", "next", "last"]].copy()
            out["shingles"] = [np.unique(hashes[e - c : e]).tobytes() for e, c in zip(ends.tolist(), counts.tolist())]
            yield out

    return sets


def intersections(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices over parts of the vocabulary."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, held = np.unique(values, return_inverse=True, return_counts=True)
    several = held > 1  # a shingle of one text is in no intersection
    renumbered = np.cumsum(several) - 1
    keep = several[number]
    number, owner = renumbered[number[keep]], owner[keep]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for a in range(0, int(several.sum()), columns):
        lo, hi = np.searchsorted(number, [a, a + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[lo:hi], number[lo:hi] - a] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def verify(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links between the two blocks of a group (within, when they are one): per text the rows it is linked with, and the
    least text of its component."""
    sets = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
    sizes = np.array([len(s) for s in sets])
    both = intersections(sets)
    linked = (both > 0) & (both + 1e-9 >= similarity * (sizes[:, None] + sizes[None, :] - both))
    np.fill_diagonal(linked, False)
    if int(pdf["lo"].iloc[0]) != int(pdf["hi"].iloc[0]):
        block = pdf["block"].to_numpy()
        linked &= block[:, None] != block[None, :]
    nodes = pdf["node"].to_numpy()
    label = nodes.copy()
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1))
        if (least == label).all():
            break
        label = least
    return pd.DataFrame({"node": nodes, "links": linked @ pdf["copies"].to_numpy(), "least": label})


def _verify_groups(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, waiting = ["root", "lo", "hi"], []
        for pdf in batches:
            for _, group in pdf.groupby(keys, sort=False):
                if waiting and (waiting[-1][keys].iloc[0] != group[keys].iloc[0]).any():
                    yield verify(pd.concat(waiting, ignore_index=True), similarity)
                    waiting = []
                waiting.append(group)
        if waiting:
            yield verify(pd.concat(waiting, ignore_index=True), similarity)

    return run


def candidate_families(texts: DataFrame, similarity: float, target_recall: float) -> DataFrame:
    """node, root: what hangs together by probable links inside the prefixes that texts open in the forest.

    texts have node, paths and sketch; a text without a probable link has no row.
    """
    tree = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(F.get("paths", 2 * t).alias("high"), F.get("paths", 2 * t + 1).alias("low"))))
    entries = texts.where("paths is not null").select("node", tree.alias("tree", "path")).select("tree", "path.high", "path.low", "node")
    order = ["tree", "high", "low", "node"]
    matched = entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_longest_matches, "tree int, high long, low long, node long, longest int")
    prefixes = matched.withColumn("depth", F.explode(F.filter(F.array(*map(F.lit, DEPTHS)), lambda d: d <= F.col("longest"))))
    rest = F.when(F.col("depth") > HALF, F.expr(f"shiftright(low, {BITS} * ({DEPTHS[0]} - depth))")).otherwise(F.lit(0).cast("long"))
    prefixes = cut(prefixes.select("node", "tree", "depth", F.xxhash64("tree", "depth", "high", rest).alias("key")))
    crowds = cut(prefixes.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"))
    counted = prefixes.join(crowds, "key").repartition("node").sortWithinPartitions("node")
    opened = counted.mapInPandas(_shorten_sorted(similarity, target_recall), "key long").distinct()
    return components(probable_links(prefixes.join(opened, "key").select("key", "node").distinct(), texts, similarity))


def agreement(similarity: float) -> int:
    """How many bytes the sketches of two texts of this similarity agree on, but for one pair of 150,000."""
    equal = similarity + (1 - similarity) / 256  # other values may have the same byte
    return math.floor(SKETCH * equal - DEVIATIONS * math.sqrt(SKETCH * equal * (1 - equal)))


def _agreeing(least: int):
    """Tasks that read whole groups (crowd, lo, hi) of texts and give each text's least partner by sketches."""

    def of_group(nodes: np.ndarray, sketches: np.ndarray, block: np.ndarray) -> np.ndarray:
        near = np.stack([(sketches == s).sum(axis=1) for s in sketches]) >= least
        if block[0] != block[-1]:  # texts of one block meet in a group of their own
            near &= block[:, None] != block[None, :]
        label = nodes.copy()
        while True:
            lower = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (lower == label).all():
                return label
            label = lower

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in itertools.chain(batches, [None]):
            rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            keys = rows[["crowd", "lo", "hi"]].to_numpy(np.int64)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
            whole = edges if batch is None else edges[:-1]  # the last group may go on
            nodes, block = rows["node"].to_numpy(np.int64), rows["block"].to_numpy(np.int64)
            sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), SKETCH)
            label = nodes.copy()
            for i, j in zip(whole, whole[1:]):
                label[i:j] = of_group(nodes[i:j], sketches[i:j], block[i:j])
            part = slice(0, whole[-1])
            joined = label[part] != nodes[part]
            yield pd.DataFrame({"a": nodes[part][joined], "b": label[part][joined]})
            held = rows.iloc[whole[-1] :]

    return run


def probable_links(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b: links between texts of one crowd (key, node) whose sketches may be those of similar texts.

    A chain of links joins all that do; they are no more than the crowd's texts, however many pairs are alike. Crowds of
    the same texts are met once. A large crowd is dealt into blocks, and each two blocks meet in a group of their own.
    """
    same = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("y"))
    crowds = same.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / CROWD).cast("int").alias("blocks"))
    # kept as a table, so that both sides of the next joins are shuffles of their own
    placed = cut(members.join(crowds, "key").select(F.col("key").alias("crowd"), "node", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")))
    others = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = others.select("crowd", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node")
    met = dealt.join(texts.select("node", "sketch"), "node").repartition("crowd", "lo", "hi").sortWithinPartitions("crowd", "lo", "hi", "block")
    return cut(met.select("crowd", "lo", "hi", "block", "node", "sketch").mapInPandas(_agreeing(agreement(similarity)), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, target_recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, class_id, n_links, kept.

    Two texts are linked when the Jaccard similarity of their sets of n-word shingles is at least `similarity`; n_links
    counts the rows a row is linked with, class_id is the least id of its connected component, and the row with that id
    is kept. Words are runs of anything but ASCII white space, as they stand.

    Equal texts are one class from the start, with their number of rows. Each distinct text has 32 paths of 12 values of
    its MinHash signature. The paths are range-sorted, a trie each, and neighbours in it give the longest prefix that a
    text shares. From there each text shortens its prefixes until the target recall (see shorten). Texts that share an
    opened prefix are compared by sketches of 256 MinHash bytes; those that may be similar, but for one linked pair of
    150,000, hang together and chains of them are a family. In a family all pairs of texts are verified on their exact
    shingle sets, in blocks of 64 by 64 texts; only blocks whose set sizes are so far apart that no pair can be similar
    are not met. So what texts have in common by a template, far from similar as they are, makes no family.

    A text of fewer than n words has all its words as its one shingle; a text without words, or null, has none and is
    linked to equal texts only (null counts as empty). Null ids and rows that repeat an id are rows of their own; a
    null id is kept only where its class has no other. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"), F.col(text_col).alias("body"))
    signed = rows.mapInPandas(_sign(n), "id long, digest string, shingles long, paths array<long>, sketch binary")
    texts = cut(
        signed.groupBy("digest")
        .agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("shingles").alias("shingles"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    families = candidate_families(texts, similarity, target_recall)

    # sets whose sizes are two classes apart cannot be similar
    step = F.floor(F.log(F.col("shingles").cast("double")) / F.lit(math.log(1 / similarity)) + F.lit(1e-9)).cast("int") if similarity < 1 else F.col("shingles").cast("int")
    members = cut(families.join(texts.select("node", "digest", "least_id", "copies", step.alias("step")), "node"))
    sizes = cut(members.groupBy("root", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    near = lambda d, name: sizes.select("root", (F.col("step") - d).alias("step"), F.col("blocks").alias(name))
    placed = members.join(near(0, "own"), ["root", "step"]).join(near(1, "next"), ["root", "step"], "left").join(near(-1, "last"), ["root", "step"], "left")
    block = F.col("step").cast("long") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("own"))
    wanted = placed.select(F.col("digest").alias("wanted_digest"), F.col("least_id").alias("wanted_id"), "node", "root", "copies", block.alias("block"), "own", F.coalesce("next", F.lit(0)).alias("next"), F.coalesce("last", F.lit(0)).alias("last"))
    bodies = rows.join(wanted, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("digest") == F.col("wanted_digest"))).select("body", "node", "root", "copies", "block", "own", "next", "last")
    sets = bodies.mapInPandas(_sets(n), "node long, root long, copies long, block long, own int, next int, last int, shingles binary").dropDuplicates(["node"])
    first = F.col("block") - F.pmod(F.col("block"), F.lit(1 << 32))
    others = lambda count, d: F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda k: first + k + F.lit(d << 32))).otherwise(F.array().cast("array<long>"))
    dealt = sets.withColumn("other", F.explode(F.concat(others("own", 0), others("next", 1), others("last", -1)))).select(
        "node", "root", "copies", "shingles", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )
    grouped = dealt.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    checked = cut(grouped.mapInPandas(_verify_groups(similarity), "node long, links long, least long"))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(checked.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    found = members.select("node", "digest", "least_id", "copies").join(links, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = found.groupBy("root").agg(F.min("least_id").alias("class_id"))
    linked = found.join(least, "root").select("digest", "class_id", "links")
    classes = texts.select("digest", "least_id", "copies").join(linked, "digest", "left").select("digest", F.coalesce("class_id", "least_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    classes = cut(classes)  # so that the join's sides are shuffles of their own and the rows of one text can be split
    return rows.select("id", "digest").join(classes, "digest").select(F.col("id").alias(id_col), "class_id", "n_links", F.coalesce(F.col("id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"))
