"""Registered queries: text cleaning and parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathmill.functions import text as X
from pathmill.operators import text as O
from pathmill.registry import query
from pathmill.session import table

HEADS = {"title": ["<title>", "<TITLE>"], "heading": ["<h1>", "<h1 "], "list": ["<ul>", "<ol>"], "body": ["<p>", "<article"]}
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_html_text = lambda x: _TRIM.format(f"regexp_replace(regexp_replace({x}, '<[^>]+>', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


@query("p01_clean_bullets", r"""
    WITH r AS (SELECT conv_id, turn, replace('ㆍ' || role || '• 1. ' || text, 'ㆍ', '•') AS x FROM conversations),
    a AS (SELECT conv_id, turn, replace(replace(x, '•', chr(10) || '•'), chr(10) || chr(10) || '•', chr(10) || '•') AS x FROM r),
    b AS (SELECT conv_id, turn, regexp_replace(x, '(^|\n)•\s*', '\1- ', 'g') AS x FROM a),
    c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(x, '([^\n0-9])(\d+\. )', '\1' || chr(10) || '\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS x FROM b)
    SELECT conv_id, turn, regexp_replace(x, '^\s+|\s+$', '', 'g') AS text FROM c
""")
def p01(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.clean_bullets(F.concat(F.lit("ㆍ"), "role", F.lit("• 1. "), "text")).alias("text"))


@query("p02_blank_to_null", "SELECT lang, count(*) FILTER (WHERE length(source) % 2 = 0) AS filled, count(*) FILTER (WHERE length(source) % 2 = 1) AS blank FROM documents GROUP BY 1")
def p02(spark, d):
    value = X.blank_to_null(F.when(F.length("source") % 2 == 0, F.col("source")).otherwise(" "))
    return table(spark, d, "documents").withColumn("v", value).groupBy("lang").agg(F.count("v").alias("filled"), F.count_if(F.col("v").isNull()).alias("blank"))


@query("p03_conditional_reclassify", "SELECT o_orderkey, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority WHEN o_totalprice > 250000 THEN 'dear' WHEN o_orderstatus = 'F' THEN 'old' ELSE '4-NOT SPECIFIED' END AS category FROM orders")
def p03(spark, d):
    c = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.when(c != "4-NOT SPECIFIED", c).when(F.col("o_totalprice") > 250000, "dear").when(F.col("o_orderstatus") == "F", "old").otherwise(c).alias("category"))


_DOMAIN = r"'(^|[^A-Za-z0-9])[a-z0-9][a-z0-9-]*\.(net|com|org|io|kr)([^\p{L}\p{N}_]|$)', '\1 \3', 'g'"


@query("p04_without_contacts", rf"""
    WITH mailed AS (SELECT doc_id, regexp_replace(text, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+', ' ', 'g') AS x FROM documents),
    linked AS (SELECT doc_id, regexp_replace(x, 'https?://[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g') AS x FROM mailed)
    -- a character between two domains belongs to both, so every second one is left for the second pass
    SELECT doc_id, md5(regexp_replace(regexp_replace(x, {_DOMAIN}), {_DOMAIN})) AS digest FROM linked
""")
def p04(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.without_contacts(F.col("text")).cast("binary")).alias("digest"))


@query("p05_fold_dots", "SELECT p_partkey, replace(p_name, ' ', '·') AS name FROM part")
def p05(spark, d):
    dotted = F.concat(F.lit(" "), F.translate("p_name", " ", "ㆍ"), F.lit("\n"))
    return table(spark, d, "part").select("p_partkey", X.fold_dots(dotted).alias("name"))


@query("p06_name_key", "SELECT p_partkey, lower(replace(p_name, ' ', '') || p_brand) AS key FROM part")
def p06(spark, d):
    return table(spark, d, "part").select("p_partkey", X.name_key(F.concat("p_name", F.lit(" （"), "p_brand", F.lit(")"))).alias("key"))


@query("p07_document_name", "SELECT p_partkey, 'part_' || replace(p_name, ' ', '_') || '_' || p_brand || '.txt' AS name FROM part")
def p07(spark, d):
    return table(spark, d, "part").select("p_partkey", X.document_name("part", F.col("p_name"), F.col("p_brand")).alias("name"))


@query("p08_clean_page", r"""
    WITH l AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM documents),
    c AS (SELECT doc_id, source, CASE WHEN len(list_filter(lines, lambda x: contains(x, 'zz') OR contains(x, '###'))) = 0 THEN lines ELSE lines[1:list_position(list_transform(lines, lambda x: contains(x, 'zz') OR contains(x, '###')), true) - 1] END AS lines FROM l)
    SELECT doc_id, len(k) AS n, md5(array_to_string(k, chr(10))) AS digest FROM (SELECT doc_id, list_filter(list_transform(lines, lambda x: regexp_replace(regexp_replace(x, '^[•*▶■○·-]+\s*', ''), '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9 -]+$')) AS k FROM c)
""")
def p08(spark, d):
    lines = X.clean_page(F.col("text"), F.col("source"), ["zz", "###"], "(never a line)", ["menu"], r"^[0-9 -]+$")
    return table(spark, d, "documents").select("doc_id", lines.alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", "\n").cast("binary")).alias("digest"))


@query("p09_skip_reason", r"""
    SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'excluded' WHEN contains(text, '%%%') OR contains(text, 'http') THEN 'directory' WHEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) < 3 THEN 'short' END AS reason FROM documents
""")
def p09(spark, d):
    return table(spark, d, "documents").select("doc_id", X.skip_reason(F.col("source"), F.col("text"), X.lines_of(F.col("text")), ["src1", "src2"], ["%%%", "http"]).alias("reason"))


LINES_SQL = r"""
    split AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
    lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM split)"""


@query("p10_sections", f"""
    WITH {LINES_SQL}, h AS (SELECT *, CASE WHEN length(line) % 7 = 0 THEN 'S' || length(line) % 3 END AS header FROM lines),
    s AS (SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'intro') AS section FROM h)
    SELECT doc_id, section, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM s WHERE header IS NULL GROUP BY ALL
""")
def p10(spark, d):
    lines = O.numbered_lines(table(spark, d, "documents"), "doc_id", "text")
    n = F.length("line")
    header = F.when(n % 7 == 0, F.concat(F.lit("S"), (n % 3).cast("string")))
    marked = lines.withColumn("keep", F.col("line")).withColumn("line", F.coalesce(header, F.concat(F.lit("= "), "line")))
    found = O.sections(marked, "doc_id", {f"S{k}": f"S{k}" for k in range(3)}, "intro")
    return found.select("doc_id", "section", F.md5(F.regexp_replace("text", "(?m)^= ", "").cast("binary")).alias("digest"))


@query("p14_graded_lines", f"""
    WITH {LINES_SQL}, h AS (SELECT *, CASE WHEN length(line) % 5 = 0 THEN length(line) % 4 + 1 END AS g, CASE WHEN length(line) % 5 = 0 THEN length(line) % 2 + 1 END AS t FROM lines),
    c AS (SELECT doc_id, pos, g, last_value(g IGNORE NULLS) OVER w AS grade, last_value((g - 1) * 2 + t IGNORE NULLS) OVER w AS semester FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
    SELECT doc_id, pos, grade, semester FROM c WHERE g IS NULL
""")
def p14(spark, d):
    lines = O.numbered_lines(table(spark, d, "documents"), "doc_id", "text")
    n = F.length("line")
    headed = lines.withColumn("line", F.when(n % 5 == 0, F.concat((n % 4 + 1).cast("string"), F.lit("학년 "), (n % 2 + 1).cast("string"), F.lit("학기"))).otherwise("x"))
    return O.graded_lines(headed, "doc_id").select("doc_id", "pos", "grade", "semester")


@query("w01_carried_values", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def w01(spark, d):
    events = table(spark, d, "events").withColumn("pos", F.col("event_id"))
    return O.carried(events, "user_id", F.when(F.col("event_type") == "click", F.col("value")), "carried").select("event_id", "carried")


def _sections_sql() -> str:
    first = ", ".join(f"least({', '.join(f'nullif(instr(html, {chr(39)}{w}{chr(39)}), 0)' for w in ws)}) AS at_{k}" for k, ws in HEADS.items())
    size = lambda k, ws: "CASE at_" + k + "".join(f" WHEN instr(html, '{w}') THEN {len(w)}" for w in ws) + " END"
    each = " UNION ALL ".join(f"SELECT page_id, html, '{k}' AS section, at_{k} AS start, {size(k, ws)} AS n FROM f WHERE at_{k} IS NOT NULL" for k, ws in HEADS.items())
    return f"""
    WITH f AS (SELECT page_id, html, {first} FROM pages), e AS ({each}),
    s AS (SELECT page_id, section, substr(html, start + n, coalesce(lead(start) OVER (PARTITION BY page_id ORDER BY start), length(html) + 1) - start - n) AS body FROM e)
    SELECT page_id, section, md5(t) AS digest FROM (SELECT page_id, section, {_html_text('body')} AS t FROM s) WHERE t <> ''"""


@query("p15_html_sections", _sections_sql())
def p15(spark, d):
    found = table(spark, d, "pages").select("page_id", F.explode(X.html_sections(F.col("html"), HEADS)).alias("section", "text"))
    return found.select("page_id", "section", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("p16_first_area", f"""
    WITH a AS (SELECT page_id, {_html_text("regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)")} AS t, {_html_text("regexp_extract(html, '(?s)<main[^>]*>(.*?)</main>', 1)")} AS u, {_html_text("html")} AS w FROM pages)
    SELECT page_id, md5(coalesce(nullif(t, ''), nullif(u, ''), w)) AS digest FROM a
""")
def p16(spark, d):
    text = X.first_area(F.col("html"), [r"(?s)<article[^>]*>(.*?)</article>", r"(?s)<main[^>]*>(.*?)</main>"])
    return table(spark, d, "pages").select("page_id", F.md5(text.cast("binary")).alias("digest"))


@query("p17_canonical_url", r"SELECT page_id, regexp_replace(string_split(url, '?')[1], '/+$', '') AS url, coalesce(nullif(regexp_extract(url, '/en/([0-9]+)', 1), ''), string_split(regexp_replace(string_split(url, '?')[1], '/+$', ''), '/')[-1]) AS source_id FROM pages")
def p17(spark, d):
    return table(spark, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"), X.source_id(F.col("url"), r"/en/([0-9]+)").alias("source_id"))


@query("p24_assembled_document", "SELECT p_partkey, md5(concat_ws(chr(10), p_name, 'brand: ' || p_brand, CASE WHEN p_size > 10 THEN 'size: ' || p_size END, CASE WHEN p_type <> 'SMALL' THEN chr(10) || '[type]' || chr(10) || p_type END)) AS digest FROM part")
def p24(spark, d):
    size = F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).otherwise("")
    text = X.assembled(F.col("p_name"), {"brand": F.col("p_brand"), "size": size}, {"type": F.when(F.col("p_type") != "SMALL", F.col("p_type"))})
    return table(spark, d, "part").select("p_partkey", F.md5(text.cast("binary")).alias("digest"))


@query("p25_profile_text", "SELECT c_custkey, concat_ws('; ', 'likes ' || CASE c_mktsegment WHEN 'BUILDING' THEN 'houses' ELSE c_mktsegment END || ', ' || c_nationkey, CASE WHEN c_acctbal > 0 THEN 'has money' END) AS text FROM customer")
def p25(spark, d):
    fields = {"likes": F.array("c_mktsegment", F.col("c_nationkey").cast("string")), "has": F.when(F.col("c_acctbal") > 0, F.array(F.lit("money"))), "none": F.array().cast("array<string>")}
    text = X.profile_text(fields, {"likes": "likes {value}", "none": "no {value}", "has": "has {value}"}, {"likes": F.create_map(F.lit("BUILDING"), F.lit("houses"))}, "; ")
    return table(spark, d, "customer").select("c_custkey", text.alias("text"))


@query("p26_validated_profiles", """
    SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT 1995 + c_custkey % 40 BETWEEN 2000 AND 2030 THEN 'admission_year' END, CASE WHEN c_custkey % 3 = 1 THEN 'current_tracks' END, CASE WHEN c_acctbal < 0 THEN 'company_types' END], lambda x: x IS NOT NULL), '|') AS errors,
           CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 8 + 1 ELSE least(8, greatest(1, (2024 - (1995 + c_custkey % 40)) * 2 + 1)) END AS semester FROM customer
""")
def p26(spark, d):
    k = F.col("c_custkey")
    year, semester = (1995 + k % 40), F.when(k % 5 == 0, k % 8 + 1)
    fields = {
        "admission_year": year, "college": F.lit("c"), "department": F.lit("d"), "current_tracks": F.slice(F.array(F.lit("a"), F.lit("b")), 1, F.when(k % 3 == 0, 0).when(k % 3 == 1, 1).otherwise(2)), "current_semester": semester,
        "interests": F.array("c_mktsegment"), "dev_interests": F.array(F.lit("x")), "work_values": F.array().cast("array<string>"), "company_types": F.when(F.col("c_acctbal") < 0, F.array(F.lit("?"))).otherwise(F.array(F.lit("big"))),
    }
    errors = X.profile_errors(fields, ["growth"], ["big", "small"])
    return table(spark, d, "customer").select(k, F.array_join(errors, "|").alias("errors"), X.estimated_semester(semester, year, 2024).alias("semester"))


@query("p27_excluded_names", "SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE NOT (n_name LIKE 'A%' OR n_name LIKE 'UN%' OR s_suppkey IN (5, 17))")
def p27(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.where(~X.excluded_name(F.col("n_name"), F.col("s_suppkey").cast("string"), ["A", "UN"], ["5", "17"])).select("s_suppkey")


@query("p28_json_tags", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, 0 AS tags FROM events")
def p28(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), F.size(X.json_tags(F.col("props"))).alias("tags"))


@query("p29_clamped_score", "SELECT event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE value / 50 - 0.2::DOUBLE END)) AS score, left(event_type, 3) AS short FROM events")
def p29(spark, d):
    raw = F.when(F.col("event_type") == "error", "bad").otherwise((F.col("value") / 50 - 0.2).cast("string"))
    return table(spark, d, "events").select("event_id", X.clamped_score(raw).alias("score"), X.truncated(F.col("event_type"), 3).alias("short"))


@query("p30_without_evidence", "SELECT conv_id, turn, md5(text) AS digest FROM conversations")
def p30(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.without_evidence(F.concat("text", F.lit("\n\n [근거: "), "role", F.lit("] ")), "근거").cast("binary")).alias("digest"))


@query("p32_packed_blocks", """
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents),
    f AS (SELECT doc_id, l, 0 AS k, 0 AS used, 0 AS kept FROM w
          UNION ALL SELECT doc_id, l, k + 1, used + CASE WHEN used + length(l[k + 1]) <= 800 THEN length(l[k + 1]) ELSE 0 END, kept + CASE WHEN used + length(l[k + 1]) <= 800 THEN 1 ELSE 0 END FROM f WHERE k < len(l))
    SELECT doc_id, used, kept FROM f WHERE k = len(l)
""")
def p32(spark, d):
    blocks = F.filter(F.split("text", "\n"), lambda x: x != "")
    kept = table(spark, d, "documents").select("doc_id", X.packed_blocks(blocks, 800).alias("kept"))
    return kept.select("doc_id", F.length(F.array_join("kept", "")).alias("used"), F.size("kept").alias("kept"))


@query("t18_result_lines", """
    WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
    SELECT c_custkey, coalesce(string_agg(place || '. order ' || o_orderkey, chr(10) ORDER BY place), '(none)') AS text FROM customer LEFT JOIN (SELECT * FROM r WHERE place <= 3) ON o_custkey = c_custkey GROUP BY 1
""")
def t18(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    rows = table(spark, d, "orders").withColumn("place", place).where("place <= 3").withColumnRenamed("o_custkey", "c_custkey")
    return O.result_lines(rows, "c_custkey", "place", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "(none)", table(spark, d, "customer"))


COURSE_TYPES = {"전공기초": "전공선택", "전공필수": "전공필수", "전공선택": "전공선택"}


def _part(spark, d):
    return table(spark, d, "part")


@query("p11_syllabus_fields", "SELECT p_partkey, p_name AS name, CASE WHEN p_size > 5 THEN p_size::VARCHAR END AS credits, NULL::VARCHAR AS mail FROM part")
def p11(spark, d):
    text = F.concat(F.lit("강의\n과목명:  "), "p_name", F.when(F.col("p_size") > 5, F.concat(F.lit("\n학점: "), F.col("p_size").cast("string"))).otherwise("\n학점:"), F.lit("\n끝"))
    docs = _part(spark, d).select("p_partkey", text.alias("text"))
    return O.syllabus_fields(docs, "p_partkey", "text", {"name": "과목명", "credits": "학점", "mail": "메일"})


@query("p12_weekly_plan", "SELECT p_partkey, w AS week, CASE WHEN p_size % 2 = 0 THEN p_type || ' 계속' ELSE p_brand || ' 계속' END AS topic FROM part, (VALUES (1), (2)) v(w)")
def p12(spark, d):
    week = lambda k: F.concat(F.lit(f"\n{k}주차\n토론\n"), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\n주제:"), "p_type")).otherwise(""), F.lit("\n계속"))
    docs = _part(spark, d).select("p_partkey", F.concat(F.lit("머리"), week(1), week(2)).alias("text"))
    return O.weekly_plan(O.numbered_lines(docs, "p_partkey", "text"), "p_partkey", "주제:", ["토론"])


@query("p13_course_lines", "SELECT p_partkey, ['전공선택', '전공필수'][p_size % 3 + 1] AS course_type, p_name AS name, 'C' || lpad(p_partkey::VARCHAR, 6, '0') AS code, p_size % 4 + 1 AS credits FROM part WHERE p_size % 3 < 2")
def p13(spark, d):
    # text before and after, as in notes on a line
    line = F.expr("concat(if(p_size % 2 = 0, '  ', '※ 참고 (1) '), '- [', element_at(array('전공기초', '전공필수', '교양필수'), p_size % 3 + 1), '] ', p_name, ' (C', lpad(cast(p_partkey as string), 6, '0'), ', ', p_size % 4 + 1, if(p_size % 5 = 0, ' 학점 ) 비고 (2026)', '학점)'))")
    parsed = _part(spark, d).select("p_partkey", X.parse_course_line(line, COURSE_TYPES).alias("c")).where("c is not null")
    return parsed.select("p_partkey", "c.course_type", "c.name", "c.code", "c.credits")


@query("p18_document_metadata", "SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_name END AS title, CASE WHEN p_size % 3 = 0 THEN p_brand END AS brand FROM part")
def p18(spark, d):
    name = F.concat(F.element_at(F.array(F.lit("course"), F.lit("track"), F.lit("other")), F.col("p_size") % 3 + 1), F.lit("_"), "p_brand")
    text = F.concat(F.lit("title: "), "p_name", F.lit("\nbrand: "), "p_brand")
    fields = X.document_metadata(name, text, {"course": {"title": "title", "brand": "brand"}, "track": {"title": "title"}})
    return _part(spark, d).select("p_partkey", fields.alias("m")).select("p_partkey", F.try_element_at("m", F.lit("title")).alias("title"), F.try_element_at("m", F.lit("brand")).alias("brand"))


@query("p19_file_codes", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'C' || lpad(p_partkey::VARCHAR, 6, '0') END AS code FROM part")
def p19(spark, d):
    name = F.concat(F.lit("plan_"), F.when(F.col("p_size") % 2 == 0, "12345678901").otherwise("123"), F.lit("C"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit("A.txt"))
    return _part(spark, d).select("p_partkey", X.file_code(name).alias("code"))


@query("p20_normalised_requirement", "SELECT p_partkey, CASE WHEN p_size % 5 IN (0, 1, 4) THEN NULL WHEN p_size % 5 = 2 THEN p_name ELSE p_name || ', ' || repeat('x', 60) END AS needs FROM part")
def p20(spark, d):
    k = F.col("p_size") % 5
    raw = F.when(k == 0, "해당 없음").when(k == 1, "없습니다 다만 (참고)").when(k == 2, F.concat("p_name", F.lit("（필수）."))).when(k == 3, F.concat("p_name", F.lit(", "), F.lit("x" * 60))).otherwise("x" * 61)
    return _part(spark, d).select("p_partkey", X.normalise_requirement(raw, ["", "null", "없음", "해당없음", "무관", "n/a", "-"], ["없"]).alias("needs"))


@query("p21_missing_field", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE 'null' END AS needs, p_size % 3 = 1 AS added FROM part")
def p21(spark, d):
    k = F.col("p_size") % 3
    text = F.concat(F.lit("title: x\n"), F.when(k == 0, F.concat(F.lit("needs: "), "p_name")).when(k == 1, "none").otherwise("needs:"))
    value, added = X.field_or_null_mark(text, "needs")
    return _part(spark, d).select("p_partkey", value.alias("needs"), added.alias("added"))


@query("p22_split_requirement", "SELECT p_partkey, replace(p_name, ' ', '|') || '|' || p_brand AS names FROM part")
def p22(spark, d):
    raw = F.concat(F.lit("필수: "), F.regexp_replace("p_name", " ", "(참고) 또는 "), F.lit(" / "), "p_brand", F.lit(". , ,"))
    return _part(spark, d).select("p_partkey", F.array_join(X.split_requirement(raw), "|").alias("names"))


@query("p23_embedding_document", "SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(replace(x, 'the ', ''), '^\\s+|\\s+$', '', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 2), chr(10))) AS digest FROM documents")
def p23(spark, d):
    built = X.embedding_document(F.split("text", "\n"), ["menu"], ["the "])
    return table(spark, d, "documents").select("doc_id", F.md5(built.cast("binary")).alias("digest"))


@query("p31_focus_sections", "SELECT p_partkey, '[goal]' || chr(10) || p_name || CASE WHEN p_size % 2 = 0 THEN '' ELSE chr(10) || '[content]' || chr(10) || p_type END AS focus FROM part")
def p31(spark, d):
    text = F.concat(F.lit("[other]\nx\n[goal]\n"), "p_name", F.when(F.col("p_size") % 2 == 0, "STOP").otherwise(""), F.lit("\n[content]\n"), "p_type")
    return _part(spark, d).select("p_partkey", X.focus_sections(text, ["goal", "content"], ["STOP"]).alias("focus"))
