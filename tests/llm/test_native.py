"""Exact dedup, line dedup, quality rules and mixing against plain Python, with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest

from pathmill.llm import exact_dedup, line_dedup, mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, digest string, key string, n int, size string, hash string, body string, words string, start int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def docs_of(rows):
    return [(d, t, lang, source, 0, "i", "d", "k", 1, "s", "h", "b", "w", 2) for d, t, lang, source in rows]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "of", "é", "Zug", "and&&&", "b", "*", "ring", "ß"]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts += [" Same LINE\t\nother", "same line\nmore", "  ", "", None, "x y " * 5000, "\n\n\n", "tail\n"]
    texts += [f"same line \n {k % 3}" for k in range(12)]
    out = [(k, rng.choice(texts), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ä", "B", None])) for k in range(400)]
    return out + [(None, "null id", "en", "a"), (None, None, None, None), (7, "again", "en", "a"), (7, "again", "en", "a")]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(docs_of(rows), SCHEMA).repartition(3).cache()


def test_exact(spark, frame, rows):
    for keep, best in (("max", max), ("min", min)):
        groups = defaultdict(list)
        for d, t, _, _ in rows:
            groups[t or ""].append(d)
        want = []
        for d, t, _, _ in rows:
            ids = [x for x in groups[t or ""] if x is not None]
            k = best(ids) if ids else None
            want.append((d, k, len(groups[t or ""]), d == k, hashlib.sha256((t or "").encode()).hexdigest()))
        got = [tuple(r) for r in exact_dedup.exact_duplicates(frame, keep=keep).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_digest_collision(spark, monkeypatch):
    """Different texts under one digest keep groups of their own."""
    from pyspark.sql import functions as F

    rows = [(k, t, None, None) for k, t in enumerate(["aa", "ab", "aa", "b", "ab", "aa"])]
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(real(c, n), 1, 0))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(spark.createDataFrame(docs_of(rows), SCHEMA)).collect()}
    assert got == {0: (0, 3), 2: (0, 3), 5: (0, 3), 1: (1, 2), 4: (1, 2), 3: (3, 1)}


def test_index_levels(spark):
    """Compaction keeps the least identifiers over runs of several levels; each batch tells what it repeats."""
    index, told = exact_dedup.DigestIndex(spark, 20, fan_in=2), []
    for k in range(5):
        told.append({r[0] for r in index.ingest(spark.createDataFrame([(10 - k, "a"), (k, f"b{k % 2}")], "id long, digest string")).collect()})
    assert [len(x) for x in index.levels] == [1, 0, 1]
    assert told == [set(), {"a"}, {"a", "b0"}, {"a", "b1"}, {"a", "b0"}]
    assert {tuple(r) for r in index.entries().select("digest", "keep_id", "n").collect()} == {("a", 6, 5), ("b0", 0, 3), ("b1", 1, 2)}


def test_index_skips_runs(spark):
    """A lookup reads the runs that may hold a digest and skips the others by their filters."""
    index = exact_dedup.DigestIndex(spark, 1000, fan_in=10)
    digests = lambda k: spark.createDataFrame([(i, hashlib.sha256(f"{k}-{i}".encode()).hexdigest()) for i in range(300)], "id long, digest string")
    for k in range(3):
        index.ingest(digests(k))
    index.read, index.skipped = [], []
    assert index.lookup(digests(1).where("id = 7").select("digest")).count() == 1
    assert 1 in index.read and len(index.skipped) >= 1 and set(index.read) | set(index.skipped) == {0, 1, 2}
    index.read, index.skipped = [], []
    assert index.lookup(digests(9).where("id < 2").select("digest")).count() == 0 and len(index.skipped) >= 2
    assert index.lookup(digests(2).select("digest")).count() == 300


def test_hot_group(spark):
    """A group with a third of all rows, all of one id, is dealt into parts and comes out whole."""
    rows = [(1 if k % 3 == 0 else k, "same" if k % 3 == 0 else f"t{k % 1000}", None, None) for k in range(3000)]
    got = Counter((r["group_size"], r["keep_id"] == r["doc_id"]) for r in exact_dedup.exact_duplicates(spark.createDataFrame(docs_of(rows), SCHEMA).repartition(5)).collect())
    assert got[1000, True] == 1000 and sum(got.values()) == 3000


def test_lines(frame, rows):
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(space))
    seen = Counter(k for _, t, _, _ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    want = []
    for d, t, _, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and seen[key(x)] >= 10)]
        want.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert sorted((tuple(r) for r in line_dedup.drop_common_lines(frame).collect()), key=str) == sorted(want, key=str)


def test_quality_counts(frame, rows):
    want = []
    for d, t, _, _ in rows:
        words = WORD.findall(t or "")
        triples = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        n = Counter(triples)
        covered = {k + j for k, x in enumerate(triples) if n[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want.append((d, len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(covered), failed))
    got = quality.quality_rules(frame).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def prose(rng, n=120, tail=""):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) + tail for _ in range(rng.randint(n // 2, n)))


def test_quality_thresholds(spark):
    """Clean texts stay, odd ones of a source go, and what is usual in another source stays there."""
    rng = random.Random(6)
    rows = [(k, prose(rng), "en", "plain") for k in range(300)] + [(1000 + k, prose(rng, tail="$$"), "en", "plain") for k in range(10)]
    rows += [(2000 + k, prose(rng, tail="$$"), "en", "symbols") for k in range(150)]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(docs_of(rows), SCHEMA)).collect()}
    assert all(kept[k] for k in range(300)) and not any(kept[1000 + k] for k in range(10)) and all(kept[2000 + k] for k in range(150))


def test_quality_sketches(spark):
    """Limits are those of exact quantiles over the buckets, drawn towards the language's and these towards everyone's."""
    rng = random.Random(7)
    sizes = {("en", "a"): 150, ("en", "b"): 20, ("de", None): 30, (None, "c"): 120}
    rows = [(*g, *(rng.randint(0, 30) * k for k in range(1, 5))) for g, n in sizes.items() for _ in range(n)]
    names = list(quality.FENCES)
    frame = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{n} int" for n in names)).repartition(5)
    got = {(r["lang"], r["source"]): tuple(r["limits"][n] for n in names) for r in quality.thresholds(quality.sketches(frame, ["lang", "source"]), "lang", "source").collect()}

    def plain(some):
        out = []
        for k, name in enumerate(names):
            v = sorted(r[2 + k] for r in some)
            at = lambda q, v=v: v[-(-q * len(v) // 4) - 1]
            out.append(at(2) + quality.FENCES[name] * max(1, at(3) - at(1)))
        return tuple(out)

    def drawn(own, rows, prior):
        return tuple((rows * x + quality.PRIOR_ROWS * y) // (rows + quality.PRIOR_ROWS) for x, y in zip(own, prior))

    everyone = plain(rows)
    for g, n in sizes.items():
        of_lang = [r for r in rows if r[0] == g[0]]
        assert got[g] == drawn(plain([r for r in rows if r[:2] == g]), n, drawn(plain(of_lang), len(of_lang), everyone))
    assert len(set(got.values())) == 4
    halves = [quality.sketches(frame.where(f"symbols % 2 = {k}"), ["lang", "source"]) for k in (0, 1)]
    parts = lambda s: sorted(map(str, s.collect()))
    assert parts(quality.merged(halves[0].unionByName(halves[1]), ["lang", "source"])) == parts(quality.sketches(frame, ["lang", "source"]))


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_quality_on_given_tables(spark):
    """Texts labelled clean stay, most labelled bad go, and each source has thresholds of its own."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.quality_rules(docs).join(labels, "doc_id").where("not base_failed")
    left = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert left.get((1, False), 0) <= 0.001 * left[1, True] and left.get((0, True), 0) <= 0.1 * left[0, False]


def test_mixing(frame, rows):
    got = mixing.mix_sources(frame).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(frame.repartition(7)).collect()), key=str)
    size = lambda t: len(WORD.findall(t or ""))
    totals = Counter()
    for _, t, _, s in rows:
        totals[s] += size(t)
    order = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, target = sum(totals.values()), {}
    free = set(order)
    while True:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * totals[s]]
        if not over:
            break
        target |= {s: 3.0 * totals[s] for s in over}
        free -= set(over)
    target |= {s: level * weight[s] for s in free}
    by_size = Counter((size(t), totals[s], round(target[s], 6)) for _, t, _, s in rows)
    assert Counter((r["size"], r["source_size"], round(r["target"], 6)) for r in got) == by_size
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    taken = Counter()
    for r in got:
        taken[round(r["target"], 6)] += r["taken"]
    for goal, n in Counter(round(target[s], 6) for s in order).items():
        assert abs(taken[goal] - goal * n) <= 0.03 * goal * n + 32


def test_apportionment(spark):
    """Sainte-Lague by highest quotients, one seat at a time."""
    rng = random.Random(8)
    groups, want = [], {}
    for g in range(40):
        votes = [rng.choice([0, 1, 2, 3, 5, 100, rng.randint(1, 10_000)]) + 0.0 for _ in range(rng.randint(1, 12))]
        seats = rng.randint(0, 60) if sum(votes) else 0
        given = [0] * len(votes)
        for _ in range(seats):
            k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * given[i] + 1), -i))
            given[k] += 1
        for k, v in enumerate(votes):
            groups.append((g, k, v, seats))
            want[g, k] = given[k]
    from pyspark.sql import functions as F

    df = mixing.apportion(spark.createDataFrame(groups, "g int, party int, votes double, seats long"), ["g"], "votes", F.col("seats"))
    assert {(r["g"], r["party"]): r["quota"] for r in df.collect()} == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for f in (exact_dedup.exact_duplicates, line_dedup.drop_common_lines, quality.quality_rules, mixing.mix_sources):
        assert f(empty).collect() == []
