"""Registered queries: tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathmill.functions import tokens as T
from pathmill.operators import tokens as O
from pathmill.registry import query
from pathmill.session import table

PATTERNS = {"Article": r"(^|\s)(the|les?|der|die|das|el|la)(\s|$)", "Ing": r"[a-z]ing\s", "Tion": r"tion", "Accent": r"[éèçê]", "Number": r"[0-9]{3}", "Mark": r"[#*$%&]"}
CATEGORIES = [("report", r"(report|error)"), ("fr", r"\s(les|des|une)\s"), ("de", r"\s(der|und|das)\s"), ("es", r"\s(los|que|una)\s"), ("en", r"\s(the|and)\s")]
TOPICS = {"motion": ["tion"], "thing": ["thing", "ding"], "eau": ["eau", "eux"], "ung": ["ung", "keit"]}
ALIASES = {"bolt": "Fastener", "ring": "Washer", "red": "Crimson"}
SPLITS = {"ECONOMY": ["low", "cost"], "SMALL": [], "LARGE": ["big"]}
_map_sql = lambda m: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in m.items()) + "}"
_chain = lambda col: "".join(f" WHEN regexp_matches({col}, '{p}', 'i') THEN '{n}'" for n, p in CATEGORIES)


@query("t01_dictionary_keywords", f"""
    SELECT doc_id, array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '{p}', 'i') THEN '{n}' END" for n, p in PATTERNS.items())}], lambda x: x IS NOT NULL)), '|') AS keywords FROM documents
""")
def t01(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.dictionary_keywords(F.col("text"), PATTERNS), "|").alias("keywords"))


#: A dictionary of 256 patterns: two syllables, in a word or parted, before a third.
SYLLABLES = ["an", "ar", "de", "ei", "en", "er", "es", "ion", "le", "nd", "on", "re", "st", "te", "th", "ti"]
MANY = {f"{a}-{b}": rf"{a}{b}th|{a} {b}th" for a in SYLLABLES for b in SYLLABLES}


@query("t01_many_keywords", f"""
    SELECT doc_id, array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '{p}', 'i') THEN '{n}' END" for n, p in MANY.items())}], lambda x: x IS NOT NULL)), '|') AS keywords FROM documents
""")
def t01_many(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.dictionary_keywords(F.col("text"), MANY), "|").alias("keywords"))


@query("t02_display_tokens", """
    SELECT DISTINCT p_type AS tag, CASE lower(p_type) WHEN 'economy' THEN 'Low Cost' ELSE upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) END AS display FROM part
""")
def t02(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("tag"), T.display_token(F.col("p_type"), {"Economy": "Low Cost"}).alias("display")).distinct()


@query("t03_display_token_lists", """
    SELECT p_partkey, array_to_string(list_sort(list_distinct([upper(w[1]) || w[2:] FOR w IN string_split(lower(p_name), ' ')])), '|') AS tags FROM part
""")
def t03(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.display_tokens(F.split("p_name", " "), {}), "|").alias("tags"))


@query("t04_canonical_token", f"""
    SELECT p_partkey, pos, coalesce({_map_sql(ALIASES)}[lower(word)], word) AS token
    FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part)
""")
def t04(spark, d):
    words = table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))
    return words.select("p_partkey", "pos", T.canonical_token(F.col("word"), T.literal_map(ALIASES)).alias("token"))


@query("t05_atomised_labels", """
    SELECT p_partkey, array_to_string(list_filter(string_split_regex(regexp_replace(p_brand || ' / ' || p_name || ' (of ' || p_type || ')', '\\s*\\([^)]*\\)', '', 'g'), '\\s+[/+]\\s+'), lambda x: trim(x) <> ''), '|') AS atoms FROM part
""")
def t05(spark, d):
    label = F.concat("p_brand", F.lit(" / "), "p_name", F.lit(" (of "), "p_type", F.lit(")"))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.atomise(label), "|").alias("atoms"))


@query("t06_canonical_keys", f"""
    SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(
        list_concat(string_split(p_name, ' '), [p_brand, p_type]), lambda x: lower(coalesce({_map_sql(ALIASES)}[lower(x)], x))))), '|') AS keys FROM part
""")
def t06(spark, d):
    tags = F.concat(F.split("p_name", " "), F.array("p_brand", F.concat(F.lit(" "), "p_type", F.lit(" / "), "p_brand")))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.canonical_keys(tags, T.literal_map(ALIASES)), "|").alias("keys"))


@query("t07_first_category", f"""
    SELECT doc_id, CASE WHEN title = '' THEN 'other'{_chain("title")}{_chain("text")} ELSE 'other' END AS category
    FROM (SELECT doc_id, text, string_split(text, ' ')[1] AS title FROM documents)
""")
def t07(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.first_category(F.split("text", " ")[0], F.col("text"), CATEGORIES, "other").alias("category"))


@query("t08_split_compound", """
    SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'low|cost' WHEN 'SMALL' THEN '' WHEN 'LARGE' THEN 'big' END AS parts FROM part
""")
def t08(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.split_compound(F.col("p_type"), SPLITS), "|").alias("parts"))


@query("t09_topic_labels", f"""
    SELECT doc_id, array_to_string(list_filter([{", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{n}' END" for n, ws in TOPICS.items())}], lambda x: x IS NOT NULL), '|') AS topics FROM documents
""")
def t09(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.topic_labels(F.col("text"), TOPICS), "|").alias("topics"))


@query("t10_group_labels", """
    SELECT p_partkey, array_to_string(list_filter([CASE WHEN list_has_any(w, ['red', 'blue']) THEN 'colour' END, CASE WHEN list_has_any(w, ['bolt', 'ring']) THEN 'metal' END], lambda x: x IS NOT NULL), '|') AS labels
    FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
""")
def t10(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.group_labels(F.split("p_name", " "), {"colour": ["red", "blue"], "metal": ["bolt", "ring"]}), "|").alias("labels"))


@query("t11_scoped_regex_label", """
    SELECT doc_id, lang IN ('en', 'fr') AND regexp_matches(text, '\\s(research|inthe|eaux?)\\s', 'i') AS flagged, quality FROM documents LEFT JOIN labels USING (doc_id)
""")
def t11(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    flagged = F.col("lang").isin("en", "fr") & F.col("text").rlike(r"(?iu)\s(research|inthe|eaux?)\s")
    return docs.select("doc_id", flagged.alias("flagged")).join(labels, "doc_id", "left")


@query("t12_merged_tags", """
    SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(lower(p_name), ' '), [lower(p_type), lower(p_brand)]))), '|') AS tags FROM part
""")
def t12(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.merged_tags(F.split(F.lower("p_name"), " "), F.array(F.lower("p_type"), F.lower("p_brand"))), "|").alias("tags"))


@query("t13_ordered_dedupe", """
    WITH w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)),
    f AS (SELECT doc_id, trim(word, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS word, min(pos) AS pos FROM w GROUP BY ALL HAVING trim(word, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
    g AS (SELECT doc_id, word, min(pos) AS pos FROM f GROUP BY ALL)
    SELECT d.doc_id, coalesce(string_agg(word, '|' ORDER BY pos), '') AS words FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id
""")
def t13(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tidy(F.split("text", " ")), "|").alias("words"))


@query("t14_routed_names", """
    WITH r AS (SELECT p_partkey, p_name, p_type,
        CASE WHEN p_type = 'SMALL' THEN 'skill' WHEN p_type IN ('ECONOMY', 'LARGE') THEN 'tech' WHEN lower(p_type) = 'promo' THEN 'tech'
             WHEN regexp_matches(p_type, '^std|stand', 'i') THEN 'skill' WHEN regexp_matches(p_type, '^[A-Z]+$') THEN 'tech' ELSE 'skill' END AS kind,
        CASE WHEN p_type = 'ECONOMY' THEN ['low', 'cost'] WHEN p_type = 'LARGE' THEN ['big'] WHEN lower(p_type) = 'promo' THEN ['Promotion'] ELSE [p_type] END AS names FROM part)
    SELECT kind, routed, count(*) AS n FROM (SELECT kind, unnest(names) AS routed FROM r) GROUP BY ALL
""")
def t14(spark, d):
    routed = O.route_names(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", SPLITS, {"promo": "Promotion"}, [], ["^std|stand"], "^[A-Z]+$")
    return routed.groupBy("kind", "routed").agg(F.count(F.lit(1)).alias("n"))


@query("t15_competency_key", """
    SELECT p_partkey, array_to_string(list_filter(string_split(regexp_replace(lower(p_name || '-' || p_type), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ('small', 'ring')), '') AS key FROM part
""")
def t15(spark, d):
    return table(spark, d, "part").select("p_partkey", T.competency_key(F.concat_ws("-", "p_name", "p_type"), ["small", "ring"]).alias("key"))


@query("t16_label_clusters")
def t16(spark, d):
    labels = table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name")).distinct()
    return O.cluster_labels(labels.withColumn("key", T.competency_key(F.col("name"), [])), "name", "key")


@query("t17_display_forms", f"""
    WITH w AS (SELECT p_brand, p_name, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS pos, p_partkey FROM part),
    k AS (SELECT p_partkey, pos, coalesce({_map_sql(ALIASES)}[lower(word)], word) AS display FROM w)
    SELECT p_partkey, lower(display) AS key, arg_min(display, pos) AS display FROM k GROUP BY p_partkey, lower(display)
""")
def t17(spark, d):
    return O.display_forms(table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("tags")), "p_partkey", "tags", ALIASES)
