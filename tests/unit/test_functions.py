"""Literal cases of the token and text rules."""

import pytest
from pyspark.sql import functions as F

from pathmill.functions import text as X
from pathmill.functions import tokens as T


@pytest.fixture(scope="module")
def ev(spark):
    def run(column, *values, schema=None):
        names = "xyz"[: len(values)]
        df = spark.createDataFrame([tuple(values)], schema or ", ".join(f"{n} string" for n in names))
        return df.select(column(*[F.col(n) for n in names]).alias("v")).first()["v"]

    return run


@pytest.mark.parametrize("tag, want", [("ReactJS", "React"), ("react.js", "React"), ("SpringBoot", "Spring Boot"), ("자바", "Java"), ("golang", "Go"), ("SQL", "SQL"), ("iOS", "iOS"), ("Power BI", "Power BI"), (" \t\n", "")])
def test_canonical_token(ev, tag, want):
    assert ev(lambda x: T.canonical_token(x, T.literal_map(T.ALIASES)), tag) == want


@pytest.mark.parametrize("tags, want", [(["React", "reactjs", "SQL", "sql", "", " "], {"react", "sql"}), (["AWS / GCP"], {"aws", "gcp"}), (["Docker + Kubernetes"], {"docker", "kubernetes"}), (["dbt (data build tool)"], {"dbt"}), (["SQL (+ BigQuery / Snowflake)"], {"sql"}), (["C++", "C#", "CI/CD", "A/B 테스팅"], {"c++", "c#", "ci/cd", "a/b 테스팅"}), (None, set())])
def test_canonical_keys(ev, tags, want):
    assert set(ev(lambda x: T.canonical_keys(x, T.literal_map(T.ALIASES)), tags, schema="x array<string>")) == want


@pytest.mark.parametrize("text, want", [("ci/cd", "Ci/Cd"), ("hELLO wORLD", "Hello World"), ("o'neil 3d", "O'Neil 3D"), ("", "")])
def test_title_case(ev, text, want):
    assert ev(T.title_case, text) == want


def test_unlisted_is_null_and_listed_may_be_empty(ev):
    parts = {"A / B": ["A", "B"], "none": []}
    assert ev(lambda x: T.split_compound(x, parts), "A / B") == ["A", "B"]
    assert ev(lambda x: T.split_compound(x, parts), "none") == []
    assert ev(lambda x: T.split_compound(x, parts), "other") is None


def test_keywords_fold_case_of_all_letters(ev):
    assert ev(lambda x: T.dictionary_keywords(x, {"Sketch": r"(?<![A-Za-z])sketch", "École": "école"}), "ÉCOLE, SKETCH") == ["Sketch", "École"]


def test_first_category(ev):
    patterns = [("a", "alpha"), ("b", "beta")]
    classify = lambda x, y: T.first_category(x, y, patterns, "other")
    assert ev(classify, "beta alpha", "") == "a" and ev(classify, "x", "BETA") == "b" and ev(classify, "", "alpha") == "other" and ev(classify, "x", "y") == "other"


def test_labels(ev):
    assert ev(lambda x: T.topic_labels(x, {"web": ["html"], "data": ["sql", "etl"]}), "ETL and HTML") == ["web", "data"]
    assert ev(lambda x: T.group_labels(x, {"big": ["a"], "small": ["b"]}), ["b", "c"], schema="x array<string>") == ["small"]
    assert ev(T.tidy, [" b", "a", "b ", ""], schema="x array<string>") == ["b", "a"]
    assert ev(lambda x: T.competency_key(x, ["skill"]), "Data-Analysis skill") == "dataanalysis"


def test_clean_bullets(ev):
    assert ev(X.clean_bullets, "ㆍa•b\n•  c개선2. 시스템\n\n\n\nend ") == "- a\n- b\n- c개선\n2. 시스템\n\nend"


@pytest.mark.parametrize("text, gone", [("mail me@x.ac.kr now", "me@x.ac.kr"), ("see https://a.b/c?d now", "https://a.b/c?d"), ("at wikidocs.net now", "wikidocs.net")])
def test_contacts(ev, text, gone):
    assert gone not in ev(X.without_contacts, text) and ev(X.without_contacts, text).endswith("now")


@pytest.mark.parametrize("text", ["ASP.NET MVC", "uses .NET Core"])
def test_contacts_keep_product_names(ev, text):
    assert ev(X.without_contacts, text) == text


TYPES = {"전공기초": "전공선택", "전공필수": "전공필수", "전공선택": "전공선택", "전공선택(상호인정)": "전공선택"}


@pytest.mark.parametrize("line, want", [("  - [전공기초] 데이터리터러시 (CTE0029, 3학점)", ("CTE0029", "전공선택", 3)), ("- [전공필수] 회계 ( ACC101 ,  3 학점 )", ("ACC101", "전공필수", 3)), ("- [교양필수] 글 (A1, 2학점)", None), ("## 1학년", None), ("", None), ("- [전공필수] 코드 없음", None)])
def test_course_line(ev, line, want):
    got = ev(lambda x: X.parse_course_line(x, TYPES), line)
    assert (got and (got["code"], got["course_type"], got["credits"])) == want


NOTHING = ["", "null", "없음", "해당없음", "무관", "n/a", "-"]


@pytest.mark.parametrize("raw, want", [("", None), ("없음", None), ("없 음", None), ("무관", None), ("n/a", None), ("-", None), ("없습니다 다만", None), ("자료구조 (필수)", "자료구조"), ("자료구조.", "자료구조"), ("가" * 61, None), ("가" * 61 + ",나", "가" * 61 + ",나")])
def test_requirement(ev, raw, want):
    assert ev(lambda x: X.normalise_requirement(x, NOTHING, ["없"]), raw) == want


@pytest.mark.parametrize("raw, want", [("a, b，c/d 또는 e 및 f", ["a", "b", "c", "d", "e", "f"]), ("필수: 자료구조(필수). ", ["자료구조"]), ("", [])])
def test_requirement_split(ev, raw, want):
    assert ev(X.split_requirement, raw) == want


def test_html_sections(ev):
    got = ev(lambda x: X.html_sections(x, {"duty": ["주요업무", "담당업무"], "need": ["자격요건"], "perk": ["혜택"]}), "<h2>자격요건</h2><p>b</p><h2>담당업무</h2><p>a</p><i>자격요건 again</i>혜택")
    assert got == {"need": "b", "duty": "a\n\n자격요건 again"} or got == {"need": "b", "duty": "a\n자격요건 again"}


def test_urls(ev):
    assert ev(X.canonical_url, "https://x/wd/12//?a=1") == "https://x/wd/12"
    assert ev(X.source_id, "https://x/wd/12/?a=1") == "12" and ev(X.source_id, "https://x/y/z?a") == "z"


def test_metadata(ev):
    kinds = {"강의": {"title": "과목명", "credits": "학점"}, "트랙": {"title": "트랙명"}}
    assert ev(lambda x, y: X.document_metadata(x, y, kinds), "강의_1.txt", "머리\n과목명: 회계 \n학점: 3") == {"doc_type": "강의", "title": "회계", "credits": "3"}
    assert ev(lambda x, y: X.document_metadata(x, y, kinds), "other.txt", "") is None


def test_file_code(ev):
    assert ev(X.file_code, "강의계획서_12345678901CTA0017A.txt") == "CTA0017" and ev(X.file_code, "강의계획서_1CTA0017.txt") is None


def test_evidence_and_focus(ev):
    assert ev(X.without_evidence, "답\n\n[근거: a, b] ") == "답"
    assert ev(lambda x: X.focus_sections(x, ["목표", "내용"], ["끝표시"]), "[기타]\nx\n[목표]\na\n[내용]\nb\n끝표시 c") == "[목표]\na\n[내용]\nb\n"


def test_embedding_document(ev):
    assert ev(lambda x: X.embedding_document(x, ["메뉴"], ["최고의", "최고의 교수"]), ["메뉴", "최고의 교수 진", "a", "본문 줄"], schema="x array<string>") == "본문 줄"


def test_packed_blocks(ev):
    assert ev(lambda x: X.packed_blocks(x, 5), ["abc", "defg", "hi", "j"], schema="x array<string>") == ["abc", "hi"]


def test_json_tags_and_scores(ev):
    assert ev(X.json_tags, '["a", "b"]') == ["a", "b"] and ev(X.json_tags, "{bad") == [] and ev(X.json_tags, None) == []
    assert [ev(X.clamped_score, v) for v in ("1.5", "-1", "0.25", "bad", None)] == [1.0, 0.0, 0.25, 0.0, 0.0]


def test_names(ev):
    assert ev(X.fold_dots, " 가ㆍ나・다 ") == "가·나·다" and ev(X.name_key, "Data （빅） (x) B") == "data빅xb" and ev(X.safe_name, 'a/b: "c"') == "a_b___c_"


@pytest.mark.parametrize(("text", "want"), [
    ("see wikidocs.net.", "see  ."), ("Foo-bar.com x", "Foo-  x"), ("www.naver.com", "www. "), ("문의kim@x.kr 요", "  요"), ("a@b.c+d", " +d"), ("foo.net입니다", "foo.net입니다"),
    ("a.net b.io,c.org", "   , "), ("ASP.NET .NET Core node.js", "ASP.NET .NET Core node.js"), ("x.com_y z-1.kr", "x.com_y  "), ("(https://a.b/c?d) e", "(  e"), ("https://a\u3000b", " \u3000b"), ("a.b.com.", "a. ."), ("xhttp:// y", "xhttp:// y"),
])
def test_contact_boundaries(ev, text, want):
    assert ev(X.without_contacts, text) == want


@pytest.mark.parametrize(("line", "want"), [
    ("- [전공필수] 자료구조 (ABC1234, 3학점) 비고", ("자료구조", "ABC1234", 3)), ("※ 참고 -[전공필수]자료 (심화) (A1,2 학점 )", ("자료 (심화)", "A1", 2)), ("- [교양필수] 가 (A1, 3학점) - [전공필수] 나 (A2, 3학점)", None),
    ("- [전공필수] 가 (A-1, 3학점)", None), ("- [전공필수] 가 (A1, ３학점)", ("가", "A1", 3)), ("- [전공필수] (A1, 3학점)", ("", "A1", 3)), ("[전공필수] 가 (A1, 3학점)", None), (None, None),
])
def test_course_anywhere_in_a_line(ev, line, want):
    got = ev(lambda x: X.parse_course_line(x, {"전공필수": "전공필수"}), line)
    assert (got and (got["name"], got["code"], got["credits"])) == want
