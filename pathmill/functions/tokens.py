"""Skill tokens as column expressions: splitting, canonical forms, dictionaries, labels."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from re import _parser as sre

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Aliases whose canonical form the tests name. Callers pass their own dictionary.
ALIASES = {
    "reactjs": "React",
    "react.js": "React",
    "springboot": "Spring Boot",
    "spring boot": "Spring Boot",
    "자바": "Java",
    "golang": "Go",
    "vuejs": "Vue.js",
    "nodejs": "Node.js",
    "node.js": "Node.js",
    "typescript": "TypeScript",
    "javascript": "JavaScript",
}


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv]) if pairs else F.create_map().cast("map<string,string>")


def canonical_token(tag: Column, aliases: Column) -> Column:
    """The alias map's form of a trimmed tag, found by its lower case; else the trimmed tag."""
    clean = strip(tag)
    return F.coalesce(F.try_element_at(aliases, F.lower(clean)), clean)


def atomise(tag: Column) -> Column:
    """Parts of a compound label: words in parentheses go, and a / or + that stands alone parts what is left."""
    pieces = F.split(tag, r"(?=\()|(?<=\))", -1)
    outside = F.array_join(F.filter(pieces, lambda p: ~(F.startswith(p, F.lit("(")) & F.endswith(p, F.lit(")")))), "")
    words = F.filter(F.split(outside, r"\s+"), lambda w: w != "")
    return F.filter(F.split(F.replace(F.array_join(words, " "), F.lit(" + "), F.lit(" / ")), " / "), lambda p: p != "")


def canonical_keys(tags: Column, aliases: Column) -> Column:
    """Distinct lower-case canonical keys of an array of tags, sorted."""
    atoms = F.flatten(F.transform(F.coalesce(tags, F.array().cast("array<string>")), atomise))
    return F.array_sort(F.array_distinct(F.filter(F.transform(atoms, lambda a: F.lower(canonical_token(a, aliases))), lambda k: k != "")))


def title_case(text: Column) -> Column:
    """Upper case for each letter that follows a non-letter, lower case for others."""
    parts = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 2_000_000_000)))), "")


def display_token(tag: Column, exact: dict[str, str]) -> Column:
    """Exact alias, then alias by lower case, then title case."""
    clean = strip(tag)
    return F.coalesce(F.try_element_at(literal_map(exact), clean), F.try_element_at(literal_map({k.lower(): v for k, v in exact.items()}), F.lower(clean)), title_case(clean))


def display_tokens(tags: Column, exact: dict[str, str]) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: display_token(t, exact)), lambda t: t != "")))


def required_literals(pattern: str) -> frozenset[str] | None:
    """Words of two characters or more, in lower case, one of which is in every text that the pattern is found in; or None.

    Runs of plain characters are read off the parsed pattern: what is optional, repeated from nothing, a class or a
    look-around gives none, and of alternatives each must. Of several such sets the one with the longest words is taken.
    """
    try:
        return _required(sre.parse(pattern))
    except (re.error, OverflowError):  # what only the engine's own syntax knows is always run
        return None


def _required(items) -> frozenset[str] | None:
    found: list[frozenset[str]] = []
    run = ""
    for op, value in [*items, (None, None)]:
        name = str(op)
        plain = chr(value) if name == "LITERAL" else ""
        if plain and (plain.isascii() or plain.lower() == plain.upper()):
            run += plain.lower()
            continue
        if name == "AT":  # has no width
            continue
        if len(run) > 1:
            found.append(frozenset({run}))
        run, inner = "", None
        if name == "SUBPATTERN":
            inner = _required(value[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _required(value[-1])
        elif name == "BRANCH":
            each = [_required(branch) for branch in value[1]]
            inner = frozenset().union(*each) if all(each) else None
        if inner:
            found.append(inner)
    return max(found, key=lambda words: (min(map(len, words)), -len(words)), default=None)


def literal_trie(words: Iterable[str]) -> str:
    """A pattern that finds the longest of the words from a place on, reading each character once."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        branches = [re.escape(c) + written(below) for c, below in sorted(node.items()) if c]
        if not branches:
            return ""
        return f"(?:{'|'.join(branches)})" + "?" * ("" in node)

    return written(tree)


#: Characters that a search without regard to case takes for a plain letter, and that letter.
CASE_PAIRS = ("İıſK", "iisk")


def by_patterns(text: Column, patterns: list[str], then: Callable[[list[Column]], Column]) -> Column:
    """What `then` makes of the patterns' hits in the text, a condition for each; case is not minded, null holds nothing.

    One scan finds the words of the text that patterns require, at every place the longest, which stands for the shorter
    ones that begin there too. A pattern is run only where one of its words has come up; those that require none always,
    and those that are nothing but words never, as the scan has answered them.
    """
    body = F.coalesce(text, F.lit(""))
    plain = [bool(re.fullmatch(r"[A-Za-z0-9 ]{2,}(\|[A-Za-z0-9 ]{2,})*", p)) for p in patterns]
    needs = [frozenset(p.lower().split("|")) if whole else required_literals(p) for p, whole in zip(patterns, plain, strict=True)]
    words = sorted({w for ws in needs if ws for w in ws})
    if not words:
        return then([body.rlike(f"(?iu){p}") for p in patterns])
    asked = {w: [k for k, ws in enumerate(needs) if ws and any(w.startswith(x) for x in ws)] for w in words}
    folded = F.lower(F.translate(body, *CASE_PAIRS))
    seen = F.array_distinct(F.regexp_extract_all(folded, F.lit(f"(?=({literal_trie(words)}))"), F.lit(1)))
    numbers = F.create_map(*[v for w, ks in asked.items() for v in (F.lit(w), F.array(*map(F.lit, ks)))])
    candidates = F.array_distinct(F.flatten(F.transform(seen, lambda w: F.try_element_at(numbers, w))))
    # bound by a lambda, so that the scan is made once and not for every pattern
    run = lambda c, k, p: F.array_contains(c, k) if plain[k] else (F.array_contains(c, k) if needs[k] else F.lit(True)) & body.rlike(f"(?iu){p}")
    made = F.transform(F.array(candidates), lambda c: then([run(c, k, p) for k, p in enumerate(patterns)]))
    return F.get(made, 0)


def dictionary_keywords(text: Column, patterns: dict[str, str]) -> Column:
    """Sorted names of the patterns that occur in the text; case does not matter."""
    found = by_patterns(text, list(patterns.values()), lambda hits: F.array(*[F.when(hit, F.lit(name)) for name, hit in zip(patterns, hits)]))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def first_category(title: Column, text: Column, patterns: list[tuple[str, str]], other: str) -> Column:
    """First pattern that the title holds, else first that the text holds, else `other`; an empty title is `other`."""
    names, rules = [name for name, _ in patterns], [p for _, p in patterns]

    def first(hits: list[Column], rest: Column) -> Column:
        return F.coalesce(*[F.when(hit, F.lit(name)) for name, hit in zip(names, hits)], rest)

    of_text = by_patterns(text, rules, lambda hits: first(hits, F.lit(other)))
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit(other)).otherwise(F.coalesce(by_patterns(title, rules, lambda hits: first(hits, F.lit(None).cast("string"))), of_text))


def split_compound(name: Column, parts: dict[str, list[str]]) -> Column:
    """Listed names give their parts (none for some), unlisted ones null."""
    pairs = [v for k, p in parts.items() for v in (F.lit(k), F.array(*[F.lit(x) for x in p]).cast("array<string>"))]
    return F.try_element_at(F.create_map(*pairs), name)


def topic_labels(text: Column, topics: dict[str, list[str]]) -> Column:
    """Topics in declared order of which any keyword is contained in the lower-case text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = []
    for name, words in topics.items():
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(low, F.lit(w))
        hits.append(F.when(cond, F.lit(name)))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def group_labels(tags: Column, groups: dict[str, list[str]]) -> Column:
    """Names of the groups that share a member with the tags."""
    hits = [F.when(F.arrays_overlap(tags, F.array(*map(F.lit, members))), F.lit(name)) for name, members in groups.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def merged_tags(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def tidy(tags: Column) -> Column:
    """Trimmed, without empties, each once in the order of first sight."""
    return F.array_distinct(F.filter(F.transform(tags, strip), lambda x: x != ""))


def competency_key(name: Column, generic: list[str]) -> Column:
    """Lower case, punctuation to blanks, generic words out, blanks out."""
    words = F.split(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(generic)), "")
