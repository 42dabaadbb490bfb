"""Archives, language identification, packing and the pipeline: exact round trips, held-out accuracy, plain versions."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pathmill.llm import language_id, packing, warc
from pathmill.llm.common import new_dir

PAGES = "page_id long, url string, html string, shard string, kind int, digest string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, id string, piece string"


@pytest.fixture(scope="module")
def pages():
    same, other = "<p>" + "x" * 200, "é" * 60
    rows = [(k, f"http://a/{k}", random.Random(k).choice([same, other, "short", None, "", f"<i>{k}</i>" * 40])) for k in range(300)]
    rows += [(None, None, same), (None, "b\nc d", "né"), (5, "http://again", "short"), (5, "http://again", "short"), (900, "u", "long " * 200_000)]
    return [(*r, "s", 1, "d") for r in rows]


def test_archives(spark, pages):
    uri = new_dir(spark, "warc-test")
    frame = spark.createDataFrame(pages, PAGES).repartition(3)
    manifest = warc.write_archives(frame, uri, shard_bytes=20_000, roll_bytes=3_000).collect()
    assert len({r["name"] for r in manifest}) == len(manifest) > 10 and sum(r["records"] for r in manifest) == len(pages)
    first = {}
    for p, _, html, *_ in pages:
        data = (html or "").encode()
        if len(data) >= 100 and p is not None:
            first[data] = min(p, first.get(data, p))
    want = []
    for p, _, html, *_ in pages:
        data = (html or "").encode()
        refers = first.get(data) if first.get(data) != p else None
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    got = [tuple(r)[:5] for r in warc.read_archives(spark, uri).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    again = new_dir(spark, "warc-test")
    warc.write_archives(frame.repartition(5), again, shard_bytes=20_000, roll_bytes=3_000)
    named = lambda rows: sorted((r["name"], r["sha256"]) for r in rows)
    assert named(spark.read.parquet(f"{again}/_manifest").collect()) == named(manifest)  # the same bytes
    store, path = warc.open_store(uri)
    heads = []
    for r in manifest:
        with store.open_input_stream(f"{path}/{r['name']}", compression=None) as stream:
            heads += [raw.partition(b"\r\n\r\n")[0].decode() for raw in warc._members(stream)]
    field = lambda h, name: next((x.split(": ", 1)[1] for x in h.split("\r\n") if x.startswith(f"{name}: ")), None)
    ids = {field(h, "WARC-Record-ID"): h for h in heads}
    assert len(ids) == len(pages)
    for h in heads:
        if field(h, "WARC-Refers-To"):
            named_one = ids[field(h, "WARC-Refers-To")]
            assert field(named_one, "WARC-Type") == "response" and field(named_one, "WARC-Payload-Digest") == field(h, "WARC-Payload-Digest")
    assert not [x for x in store.get_file_info(warc.fs_selector(path)) if x.base_name.endswith(".tmp")]
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, uri, with_payload=True).where("record_type = 'response' and page_id is not null").collect()}
    assert all((dict((p, h) for p, _, h, *_ in pages)[k] or "") == v for k, v in payloads.items())


def test_shards_of_skewed_ids(spark):
    """One far id, many null ids and repeated ids are dealt into shards by their bytes."""
    rows = [(k, f"u{k}", "x" * 500, "s", 1, "d") for k in range(200)] + [(10**15, "far", "y", "s", 1, "d")] + [(None, f"n{k}", f"z{k}" * 100, "s", 1, "d") for k in range(200)] + [(7, f"again{k}", f"w{k}" * 100, "s", 1, "d") for k in range(100)]
    uri = new_dir(spark, "warc-skew")
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES), uri, shard_bytes=20_000, roll_bytes=1 << 20).collect()
    per_shard = Counter()
    for r in manifest:
        per_shard[r["shard"]] += r["records"]
    assert len(per_shard) >= 15 and max(per_shard.values()) <= 60 and sum(per_shard.values()) == len(rows)


def test_archives_without_rows(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_damaged_record():
    raw = zlib.decompress(warc.record(1, 0, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "d"), 31)
    assert warc.parse_record(raw)[6] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload", b"paylord"))


def made_text(rng, lang, n):
    parts = {"aa": ["th", "ing", "er", "on"], "bb": ["eau", "oui", "é", "tre"], "cc": ["ung", "ch", "ei", "ß"]}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) + rng.choice(["", "", ",", "&&"]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(3)
    return [(k, made_text(rng, lang, rng.randint(3, 150)), lang, "s", 0, 1, "i", "p") for k, lang in enumerate(rng.choices(["aa", "bb", "cc"], k=300))]


def test_languages(spark, labelled):
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 $$ 3", "bb"), (1003, "ing " * 30_000, None), (None, "thing er", "aa"), (4, "eau oui", "aa"), (4, "eau oui", "aa")]
    frame = spark.createDataFrame(labelled + [(*x, "s", 0, 1, "i", "p") for x in odd], DOCS)
    model = language_id.fit(frame.where("doc_id < 300"))
    got = language_id.identify_languages(frame, model).collect()
    assert len(got) == len(labelled) + len(odd)
    truth = {k: lang for k, _, lang, *_ in labelled}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 4]
    assert len(held) > 50 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (1000, 1001, 1002))
    assert by_id[1003]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got)


def test_words_of_mixed_text(labelled):
    """Marginals follow the switch of language inside a text."""
    model = language_id.train([t for _, t, *_ in labelled], [x[2] for x in labelled], sequences=800)
    rng = random.Random(4)
    words = [language_id.letters(w) for w in (made_text(rng, "aa", 30) + " " + made_text(rng, "cc", 30)).split()]
    emit = model.emissions(words)[None].astype(float)
    marginals, _, _ = language_id.forward_backward(emit, np.array([60]), np.exp(model.transitions))
    labels = [model.labels[k] for k in marginals[0].argmax(1)]
    assert np.mean([x == "aa" for x in labels[:30]]) > 0.9 and np.mean([x == "cc" for x in labels[30:]]) > 0.9


def test_very_long_text(labelled, monkeypatch):
    """In windows the scores are those of the whole text."""
    model = language_id.train([t for _, t, *_ in labelled], [x[2] for x in labelled], sequences=800)
    rng = random.Random(6)
    texts = [" ".join(made_text(rng, rng.choice(["aa", "bb"]), 40) for _ in range(60)), "ing", None]
    names, whole = language_id.classify(texts, model)
    monkeypatch.setattr(language_id, "LONGEST", 500)
    again, parts = language_id.classify(texts, model)
    assert names == again and np.allclose(whole, parts, atol=1e-4)


def test_many_languages_share_buckets():
    assert language_id.bucket_bits(4) == 18 and (2 << language_id.bucket_bits(300)) * 300 <= language_id.MOST_WEIGHTS
    model = language_id.train(["thing er"] * 3 + ["eau oui"] * 3, ["aa"] * 3 + ["bb"] * 3, sequences=50)
    assert language_id.classify(["er thing", "oui"], model)[0] == ["aa", "bb"]


def test_forward_backward_by_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    emit, link = rng.random((1, 4, 3)) + 0.1, rng.random((3, 3)) + 0.1
    want = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        w = np.prod([emit[0, t, y] for t, y in enumerate(path)]) * np.prod([link[a, b] for a, b in zip(path, path[1:])])
        for t, y in enumerate(path):
            want[t, y] += w
    got, _, _ = language_id.forward_backward(emit, np.array([4]), link)
    assert np.allclose(got[0], want / want.sum(1, keepdims=True))


def test_languages_without_labels(spark):
    frame = spark.createDataFrame([(1, "word", None, "s", 0, 1, "i", "p")], DOCS)
    assert [r["lang_pred"] for r in language_id.identify_languages(frame).collect()] == ["und"]
    assert language_id.identify_languages(frame.limit(0)).collect() == []


TEXTS = ["It's a test  of 12½ things…\n\n  and\tmore", "naïve café Ünï 3²x¼ _a_b", "don't  'll ' s", "日本語 text ａｂ", " wide \xa0 no\x1cbreak\x85", "", " ", "  \n", "$$$###", "a" * 5000, "🙂🙂 é́"]


def test_ids_equal_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    rng = random.Random(2)
    alphabet = "ab éÄ'stre  \n\t12½²_.,$&\x1c\x85\xa0ª日 "
    texts = TEXTS + ["<|endoftext|> x"] + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(1500)]
    encode = packing.encoder().ids
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_ids_equal_the_tokenizers_on_given_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    encode = packing.encoder().ids
    assert all(np.frombuffer(encode(t), "<u4").tolist() == e.ids for t, e in zip(texts, reference.encode_batch(texts, add_special_tokens=False), strict=True))


def test_packing_does_not_depend_on_partitions(spark):
    rng = random.Random(10)
    rows = [(k % 150, "word " * rng.randint(1, 1500), "en", "s", 0, 1, "i", "p") for k in range(200)] + [(9, "same " * 300, "en", "s", 0, 1, "i", "p")] * 40
    frame = spark.createDataFrame(rows, DOCS)
    packed = [Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "offset")) + (r["sequence_id"] if r["sequence_id"] >= 0 else None,) for r in packing.pack_documents(frame.repartition(n)).collect()) for n in (2, 7)]
    assert packed[0] == packed[1]


def test_packing(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice(TEXTS) * rng.randint(1, 3) + " word" * rng.randint(0, 900), "en", "s", 0, 1, "i", "p") for k in range(300)]
    rows += [(500, None, "en", "s", 0, 1, "i", "p"), (501, "long one " * 4000, "en", "s", 0, 1, "i", "p"), (3, "again", "en", "s", 0, 1, "i", "p"), (3, "again", "en", "s", 0, 1, "i", "p"), (None, "no id", "en", "s", 0, 1, "i", "p")]
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    encode = packing.encoder().ids
    want = Counter()
    total = 0
    for d, t, *_ in rows:
        ids = encode(t or "") + np.uint32(2).tobytes()
        n = len(ids) // 4
        total += n
        head = n % 1024 or 1024
        at = [0, *range(head, n, 1024), n] if n > 1024 else [0, n]
        for k, (a, b) in enumerate(zip(at, at[1:])):
            want[d, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.01 * total / 1024 + 1


def test_local_search_empties_bins():
    """Two moves or swaps away from the optimum: the search gets there, and never raises the number of bins."""
    sizes = np.array([6, 3, 5, 4, 2])
    assert len(packing.LocalSearch([[0, 1], [2, 3], [4]], sizes, 10).run()) == 2
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = rng.integers(1, 100, 60)
        bins = packing.best_fit(sizes, 100)
        better = packing.LocalSearch([list(b) for b in bins], sizes, 100).run()
        assert len(better) <= len(bins) and sorted(x for b in better for x in b) == list(range(60)) and all(sizes[b].sum() <= 100 for b in better)


def test_local_search_leaves_no_exchange():
    """Where many bins are underfull all are tried: bins empty, and no move or exchange that fits raises the squares."""
    sizes = np.random.default_rng(1).integers(300, 421, 3000)
    bins = packing.best_fit(sizes, 1024)
    search = packing.LocalSearch([list(b) for b in bins], sizes, 1024)
    better = search.run()
    assert len(better) <= 0.97 * len(bins) and sorted(x for b in better for x in b) == list(range(3000)) and all(sizes[b].sum() <= 1024 for b in better)
    sizes = sizes[:200]
    better = packing.LocalSearch(packing.best_fit(sizes, 1024), sizes, 1024).run()
    for giver in better:
        for taker in better:
            if giver is not taker and sizes[taker].sum() < 1024:
                fill, gap = sizes[giver].sum(), 1024 - sizes[taker].sum()
                back = [0, *sizes[taker], *(sizes[x] + sizes[y] for k, x in enumerate(taker) for y in taker[k + 1 :])]
                assert not any(0 < sizes[x] - y <= gap and sizes[taker].sum() + sizes[x] - y > fill for x in giver for y in back if fill < 1024)


def test_packing_without_rows(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).collect() == []
