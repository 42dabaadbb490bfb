"""Ids inside file names, and reads of documents that open the files asked for alone."""

import pytest

from pathmill.operators.joins import contained_ids, documents_of_courses
from pathmill.sources.readers import list_documents, read_documents


def test_ids_are_found_anywhere(spark):
    names = ["a_CTA0017_x.txt", "CTA0017CTA0018", "CTA001", "", "CTA0017", "xCTA00171", None]
    ids = ["CTA0017", "CTA0018", "TA", "CTA00171", "", "a name longer than any"]
    found = contained_ids(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(i,) for i in ids], "id string"))
    assert sorted(map(tuple, found.collect())) == sorted((n, i) for n in names if n is not None for i in ids if i and i in n)
    assert contained_ids(spark.createDataFrame([], "name string"), spark.createDataFrame([], "id string")).count() == 0


def test_documents_go_to_the_first_course(spark):
    docs = spark.createDataFrame([(1, "B2_A1.txt", "x"), (2, "none.txt", "same"), (3, "none.txt", "other"), (4, None, "same"), (5, "B2", None)], "doc int, file string, name string")
    courses = spark.createDataFrame([("A1", "same", 2), ("B2", "same", 1), ("C3", "x", 0)], "course_id string, course_name string, ord int")
    assert sorted(map(tuple, documents_of_courses(docs, courses).collect())) == [(1, "B2"), (2, "B2"), (4, "B2"), (5, "B2")]


@pytest.fixture
def tree(tmp_path):
    for kind, names in {"intro": ["b_one.txt", "a_one.txt", "a_two.txt"], "plan": ["c_one.txt", "skip.md"], "old": ["a_one_old.txt"]}.items():
        (tmp_path / f"doc_type={kind}").mkdir()
        for n in names:
            (tmp_path / f"doc_type={kind}" / n).write_text(f"\ufefftext of {n}\nsecond line")
    return str(tmp_path)


def opened(df):
    """How many files the scans of the plan took in, after it has run."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    plans = [leaves.apply(k) for k in range(leaves.size())]
    return sum(p.metrics().get("numFiles").get().value() for p in plans if p.metrics().contains("numFiles"))


def test_documents_are_listed_without_being_opened(spark, tree):
    found = list_documents(spark, tree, keyword="one", folders={"doc_type": ["intro", "plan"]})
    assert sorted((r["name"], r["doc_type"]) for r in found.collect()) == [("a_one.txt", "intro"), ("b_one.txt", "intro"), ("c_one.txt", "plan")]
    assert "content" not in found.columns


def test_files_that_are_not_asked_for_are_not_opened(spark, tree):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = read_documents(spark, tree, keyword="one", folders={"doc_type": ["intro"]})
        assert sorted(map(tuple, rows.collect())) == [("a_one.txt", "text of a_one.txt\nsecond line", "intro"), ("b_one.txt", "text of b_one.txt\nsecond line", "intro")]
        assert opened(read_documents(spark, tree)) == 5
        assert opened(read_documents(spark, tree, keyword="one", folders={"doc_type": ["intro"]})) == 2
        page = read_documents(spark, tree, page=1, page_size=2, fields=["name"])
        assert opened(page) == 2
        assert [r["name"] for r in page.collect()] == ["a_two.txt", "b_one.txt"] and page.columns == ["name"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert read_documents(spark, tree, page=9, page_size=2).count() == 0 and read_documents(spark, tree, keyword="nowhere").count() == 0
