"""Dictionaries that run the patterns whose words came up, against running every pattern."""

import random

import pytest
from pyspark.sql import functions as F

from pathmill.functions import tokens as T

PATTERNS = [r"\bjava\b", r"\bjavascript\b", r"java ?script", r"\bc\+\+", r"(?<!\w)go(lang)?\b", r"react(\.?js)?", r"spring\s*boot", r"(aws|azure|gcp)", r"(aws|x?)", r"[a-z]+ql\b", r"스프링", r"node\.?js", r"kiss", r"R\b", r"mysql|sql", r"a{2}ws", r"(?:sql)+", r"im(?=g)", r"ß"]


def test_required_words():
    need = dict(zip(PATTERNS, map(T.required_literals, PATTERNS)))
    assert need[r"\bjava\b"] == {"java"} and need[r"(aws|azure|gcp)"] == {"aws", "azure", "gcp"} and need[r"(aws|x?)"] is None
    assert need[r"[a-z]+ql\b"] == {"ql"} and need[r"spring\s*boot"] == {"spring"} and need[r"스프링"] == {"스프링"} and need["ß"] is None
    assert need[r"react(\.?js)?"] == {"react"} and need[r"(?<!\w)go(lang)?\b"] == {"go"} and need[r"R\b"] is None and need["mysql|sql"] == {"mysql", "sql"}
    assert T.required_literals(r"\p{L}+java") is None and T.required_literals("(") is None


@pytest.mark.parametrize("seed", range(3))
def test_hits_are_those_of_every_pattern(spark, seed):
    rng = random.Random(seed)
    bits = ["java", "JavaScript", "script", " ", "sql", "my", "C++", "go", "lang", "REACT", ".js", "Spring", "boot", "스프", "링", "kiſſ", "Kiss", "İMG", "ımg", "a", "ws", "ß", "SS", "r", "node"]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 12))),) for _ in range(400)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "x string")
    plain = [F.coalesce(F.col("x"), F.lit("")).rlike(f"(?iu){p}") for p in PATTERNS]
    differ = df.where(T.by_patterns(F.col("x"), PATTERNS, lambda hits: F.array(*hits)) != F.array(*plain))
    assert differ.collect() == []
    names = {f"n{k}": p for k, p in enumerate(PATTERNS)}
    assert df.where(F.size(T.dictionary_keywords(F.col("x"), names)) > 0).count() > 200


def test_trie_reads_the_longest_word(spark):
    words = ["a", "ab", "abcd", "b.c", "xyz"]
    got = spark.range(1).select(F.regexp_extract_all(F.lit("abcab.cxya"), F.lit(f"(?=({T.literal_trie(words)}))"), F.lit(1))).first()[0]
    assert got == ["ab", "ab", "b.c", "a"]
