"""DuckDB SQL for the queries that SQL expresses on whole tables."""

from __future__ import annotations

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = f"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
    starts AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 12], ' ')) AS h FROM d, unnest(generate_series(1, len(w) - 12)) AS t(k)),
    dup AS (SELECT doc_id, k FROM starts JOIN (SELECT h, min(doc_id) AS least FROM starts GROUP BY h) USING (h) WHERE least < doc_id),
    gone AS (SELECT DISTINCT doc_id, k + j AS k FROM dup, unnest(generate_series(0, 12)) AS t(j)),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d)
    SELECT d.doc_id, any_value(len(d.w)) AS n_words, count(gone.k) AS n_removed,
           sha256(coalesce(string_agg(word, ' ' ORDER BY words.k) FILTER (WHERE gone.k IS NULL), '')) AS kept_sha256
    FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k GROUP BY d.doc_id
"""

EXACT = """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

LINES = f"""
    WITH lines AS (
        SELECT doc_id, pos, split[pos] AS line, translate(trim(split[pos], {SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS split FROM documents), unnest(generate_series(1, len(split))) AS t(pos)
    ), common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
    FROM lines LEFT JOIN common USING (key) GROUP BY doc_id
"""


SPELLING = """
    WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
    runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
             FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents) GROUP BY ALL),
    bytes AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x) - 64] END)) AS b FROM runs),
    hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
    words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
              WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    less AS (SELECT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM words, unnest(generate_series(1, length(word))) AS t(k)),
    near AS (SELECT a.word, b.word AS other FROM less a JOIN less b USING (k, rest) WHERE a.word <> b.word
             UNION SELECT rest, word FROM less UNION SELECT word, rest FROM less),
    known AS (SELECT near.word, other, o.n AS other_n FROM near JOIN words o ON other = o.word JOIN words w ON near.word = w.word),
    best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM known GROUP BY word),
    formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
    climb AS (SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM climb c JOIN formed f ON c.at = f.word WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN climb c ON f.word = c.word JOIN formed e ON c.at = e.word WHERE e.form IS NULL
"""

NEGATIVES = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
    pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER mine::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    WINDOW mine AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY rank <= 5
"""


def quality(fences: dict[str, int], counts: dict[str, tuple[str, str]], gamma: float, prior: int, symbols: str) -> str:
    pulled = ", ".join(f"'{name}'" for name in fences)
    values = ", ".join(fences)
    buckets = ", ".join(f"floor(ln(greatest(1, 1000000 * ({part} + 1) // ({whole} + 1))::DOUBLE) / ln({gamma}::DOUBLE))::INT AS {name}" for name, (part, whole) in counts.items())
    factor = " ".join(f"WHEN '{name}' THEN {fence}" for name, fence in fences.items())
    of_lang = f"((l.n * l.top + {prior} * a.top) // (l.n + {prior}))"
    chosen = f"(o.n * o.top + {prior} * {of_lang}) // (o.n + {prior})"
    limits = ", ".join(f"max(CASE WHEN feature = '{name}' THEN top END) AS max_{name}" for name in fences)
    within = " AND ".join(f"{name} <= max_{name}" for name in fences)

    def level(keys: str) -> str:
        spread = "greatest(1, quantile_disc(b, 0.75) - quantile_disc(b, 0.25))"
        return f"SELECT {keys} feature, count(*) AS n, quantile_disc(b, 0.5) + max(CASE feature {factor} END) * {spread} AS top FROM each GROUP BY ALL"

    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, {WORDS} AS w FROM documents),
    triples AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 2], ' ')) AS h FROM d, unnest(generate_series(1, len(w) - 2)) AS t(k)),
    again AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, h) AS n FROM triples) WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM again, unnest([0, 1, 2]) AS t(j) GROUP BY doc_id),
    counts AS (SELECT d.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '{symbols}', '')) AS n_symbols, coalesce(c.n, 0) AS n_repeat_words,
                      list_filter(string_split(text, chr(10)), lambda x: trim(x, {SPACE}) <> '') AS l FROM d LEFT JOIN covered c USING (doc_id)),
    base AS (SELECT *, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
    rates AS (SELECT *, {buckets} FROM base),
    each AS (SELECT lang, source, unnest([{pulled}]) AS feature, unnest([{values}]) AS b FROM rates WHERE NOT base_failed),
    own AS ({level("lang, source,")}), by_lang AS ({level("lang,")}), everything AS ({level("")}),
    tops AS (SELECT o.lang, o.source, o.feature, {chosen} AS top FROM own o JOIN by_lang l ON o.feature = l.feature AND o.lang IS NOT DISTINCT FROM l.lang JOIN everything a ON o.feature = a.feature),
    limits AS (SELECT lang, source, {limits} FROM tops GROUP BY ALL)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({within}, false) AS kept
    FROM rates r LEFT JOIN limits t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source
"""


def _apportion(name: str, table: str, key: str, votes: str, seats: str) -> str:
    """CTEs that give `name`: the table's rows with `quota`, by highest quotients within each key."""
    over = f"(PARTITION BY {key} ORDER BY party ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""
    {name}_a AS (SELECT *, coalesce(floor({votes} * {seats} / nullif(sum({votes}) OVER {over}, 0)::DOUBLE + 0.5), 0)::BIGINT AS s FROM {table}),
    {name}_b AS (SELECT *, {seats} - sum(s) OVER (PARTITION BY {key}) AS e FROM {name}_a),
    {name}_c AS (SELECT *, greatest(0, s + least(0, e)) AS b FROM {name}_b),
    {name}_d AS (SELECT *, {seats} - sum(b) OVER (PARTITION BY {key}) AS rest FROM {name}_c),
    {name}_e AS (SELECT {key} AS g, party, rest, row_number() OVER (PARTITION BY {key} ORDER BY {votes} / (2 * (b + k) + 1)::DOUBLE DESC, party) AS rn FROM {name}_d, unnest(generate_series(0, abs(e)::BIGINT)) AS t(k) WHERE {votes} > 0),
    {name}_f AS (SELECT g, party, count(*) AS extra FROM {name}_e WHERE rn <= rest GROUP BY ALL),
    {name} AS (SELECT x.*, b + coalesce(extra, 0) AS quota FROM {name}_d x LEFT JOIN {name}_f f ON f.g = {key} AND f.party = x.party)"""


def mixing(seed: int, block: int, cap: int, shard_rows: int, most_digits: int) -> str:
    digits = "CASE " + " ".join(f"WHEN source_rows <= {shard_rows * 16**d} THEN {d}" for d in range(1, most_digits)) + f" ELSE {most_digits} END"
    return f"""
    WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, md5('{seed}:' || doc_id || ':' || md5(coalesce(text, ''))) AS hash FROM documents),
    src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows FROM d GROUP BY source),
    r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS party FROM src),
    w AS (SELECT *, party % 3 + 1 AS weight, source_size * {cap}::DOUBLE AS most FROM r),
    u AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
          FROM w WINDOW before AS (ORDER BY most / weight, party ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    v AS (SELECT *, (SELECT arg_min(level, (most / weight, party)) FROM u WHERE level * weight <= most) AS free FROM u),
    t AS (SELECT source, party, source_size, source_rows, least(most, weight * coalesce(free, 0))::DOUBLE AS target, (SELECT sum(source_size) FROM src) // {block} AS seats, 0 AS everything FROM v),
    {_apportion("q1", "t", "everything", "target", "seats")},
    sh AS (SELECT q.party AS rank, substr(hash, 1, {digits}) AS party, sum(size)::BIGINT AS shard_size, any_value(q.source) AS source, any_value(source_size) AS source_size, any_value(target) AS target, any_value(quota)::BIGINT AS blocks
           FROM d JOIN q1 q ON d.source IS NOT DISTINCT FROM q.source GROUP BY q.party, substr(hash, 1, {digits})),
    {_apportion("q2", "sh", "rank", "shard_size", "blocks")},
    p AS (SELECT doc_id, size, source_size, target, shard_size, least(quota * {block}, shard_size * {cap})::BIGINT AS words, coalesce(sum(size) OVER (PARTITION BY rank, party ORDER BY hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
          FROM d JOIN q2 ON d.source IS NOT DISTINCT FROM q2.source AND starts_with(hash, party))
    SELECT doc_id, size, source_size, target, (coalesce(words // nullif(shard_size, 0), 0) * size + greatest(0, least(size, coalesce(words % nullif(shard_size, 0), 0) - start)))::BIGINT AS taken FROM p
"""
