"""Literal cases of the row operators."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pathmill import registry, session
from pathmill.lineage import cut
from pathmill.operators import aggregates as A
from pathmill.operators import coverage as C
from pathmill.operators import graphs as G
from pathmill.operators import joins as J
from pathmill.operators import pairs as P
from pathmill.operators import planning as L
from pathmill.operators import text as X
from pathmill.operators import tokens as O
from pathmill.plans import bindings, q_planning
from pathmill.plans.recommend import recommend
from pathmill.sources import readers, writers

TRACK = "track_id string, college_id string, department_id string, course_ids array<string>, tech array<string>"
USER = "user_id string, college_id string, department_id string, current_tracks array<string>, job_keys array<string>"


def scored(spark, a, b, jobs, courses=([], [])):
    tracks = spark.createDataFrame([("A", "C1", "D1", courses[0], a), ("B", "C1", "D1", courses[1], b)], TRACK)
    users = spark.createDataFrame([("u", "C1", "", [], jobs)], USER)
    return P.score_pairs(users, tracks, users).first()


@pytest.mark.parametrize("a, b, jobs, want", [(["py"], ["sql"], ["py", "sql"], 1.0), (["py", "sql"], ["sql", "go"], ["py", "sql", "go", "rust"], 0.5), (["x"], ["sql"], ["sql"], 0.0), (["sql"], ["sql"], ["sql"], 0.0), (["a"], ["b"], [], 0.0)])
def test_complementarity(spark, a, b, jobs, want):
    row = scored(spark, a, b, jobs)
    assert row["complementarity"] == want and 0 <= row["score"] <= 1


def test_redundancy(spark):
    assert scored(spark, [], [], [], (["1", "2"], ["2", "3"]))["redundancy"] == pytest.approx(1 / 3)
    assert scored(spark, [], [], [])["redundancy"] == 0


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(f"T{k}", f"C{k // 4}", f"D{k // 2}", [f"c{k}", f"c{k + 1}"], [f"t{k % 5}", f"t{k % 3}"]) for k in range(12)] + [("T99", "C0", "D99", [], ["t0"])]
    return spark.createDataFrame(rows, TRACK).cache()


def plain_mmr(cands, chosen, n, sim):
    picks, pool, selected = [], dict(cands), list(chosen)
    for _ in range(n):
        if not pool:
            break
        best = min(pool, key=lambda k: (-(0.6 * pool[k] - ((1 - 0.6) * max(sim(k, s) for s in selected) if selected else 0)), k))
        picks.append(best)
        selected.append(best)
        del pool[best]
    return picks


def test_recommended_pairs(spark, catalog):
    users = spark.createDataFrame([("own", "C0", "", [], ["t0", "t1", "t2"]), ("pinned", "C1", "", ["T5", "T0"], ["t0", "t3"]), ("single", "C0", "D99", [], ["t0"]), ("none", "C9", "", [], ["t0"])], USER)
    got = {u: sorted((r["rank"], r["combo_key"], r["slot"]) for r in P.recommend_pairs(users, catalog).collect() if r["user_id"] == u) for u in ("own", "pinned", "single", "none")}
    assert not got["single"] and not got["none"]
    assert [r[0] for r in got["own"]] == list(range(1, 8)) and got["pinned"][0][1:] == ("T0::T5", "primary") and [s for _, _, s in got["pinned"]].count("primary") == 1
    assert not any("T99" in k for u in got.values() for _, k, _ in u)
    rows = {r["track_id"]: r for r in catalog.collect()}
    all_scored = {r["combo_key"]: r["score"] for r in P.score_pairs(users, catalog, users).where("user_id = 'own'").collect()}

    def sim(x, y):
        (a, b), (c, d) = ([rows[t] for t in k.split("::")] for k in (x, y))
        over = lambda f: bool({a[f], b[f]} & {c[f], d[f]})
        p, q = set(a["course_ids"]) | set(b["course_ids"]), set(c["course_ids"]) | set(d["course_ids"])
        return 0.4 * over("college_id") + 0.5 * over("department_id") + 0.1 * len(p & q) / len(p | q)

    first = [k for _, k, s in got["own"] if s != "mmr"]
    rest = {k: v for k, v in all_scored.items() if k not in first}
    assert [k for _, k, s in got["own"] if s == "mmr"] == plain_mmr(rest, first, 7 - len(first), sim)


def test_plan(spark):
    courses = [("s", "c1", 3, [1, 2], ["c2"], 1), ("s", "c2", 3, [1], [], 2), ("s", "c3", 3, [1], [], 3), ("s", "c4", 18, [1], [], 4), ("s", "c5", 3, [4], ["done"], 5)]
    cands = spark.createDataFrame(courses, "student_id string, course_id string, credits int, grades array<int>, prereqs array<string>, place int")
    students = spark.createDataFrame([("s", 1)], "student_id string, current_semester int")
    done = spark.createDataFrame([("s", "done")], "student_id string, course_id string")
    rows = L.plan_semesters(cands, students, done).orderBy("semester", "position").collect()
    placed = [(r["semester"], r["course_id"]) for r in rows if r["course_id"]]
    # c1 is passed over before c2 is taken and is tried again a semester later; c4 is over the cap of the first grade
    assert placed == [(1, "c2"), (1, "c3"), (2, "c1"), (7, "c5")]
    assert [r["graduation_insufficient"] for r in rows if r["semester"] == 8] == [True] and not any(r["cap_reached"] for r in rows)
    view = {r["stage"]: r["courses"] for r in L.stage_view(spark.createDataFrame(rows, L.PLAN), spark.createDataFrame([("f", 1), ("c", 2), ("a", 3), ("i", 4)], "stage string, grade int")).collect()}
    assert view == {"f": ["c2", "c3", "c1"], "c": [], "a": [], "i": ["c5"]}


def test_coverage(spark):
    jobs = spark.createDataFrame([("s", "be", 0.9, 1), ("s", "fe", 0.6, 2)], "student_id string, job_id string, score double, ord int")
    tokens = spark.createDataFrame([("be", "mysql", "MySQL"), ("be", "docker", "Docker"), ("fe", "react", "React")], "job_id string, key string, display string")
    course = "student_id string, course_id string"
    done, plan = spark.createDataFrame([("s", "db")], course), spark.createDataFrame([("s", "ops")], course)
    teach = lambda rows: spark.createDataFrame(rows, "course_id string, key string")
    for taught, want, gap in (([("db", "mysql"), ("ops", "docker")], (2, 1, 2, 0.5, 1.0), None), ([("db", "mysql")], (1, 1, 1, 1.0, 1.0), ["Docker"])):
        reach = C.reachable_tokens(done, plan, teach(taught))
        anchors = C.anchor_jobs(jobs)
        row = C.coverage_ratios(anchors, C.target_tokens(anchors, tokens, reach)).first()
        assert row["job_id"] == "be" and (row["required"], row["current"], row["expected"], row["current_ratio"], row["expected_ratio"]) == want
        found = C.gap_tokens(anchors, tokens, reach).collect()
        assert [r["tokens"] for r in found] == ([gap] if gap else [])
    assert C.anchor_jobs(jobs, spark.createDataFrame([("s", "fe")], "student_id string, job_id string")).first()["job_id"] == "fe"
    assert C.anchor_jobs(jobs, spark.createDataFrame([("s", "gone")], "student_id string, job_id string")).first()["job_id"] == "be"


@pytest.mark.parametrize("n, done, want", [(31, 0, 30), (30, 0, 30), (40, 35, 35)])
def test_target_cap(spark, n, done, want):
    tokens = spark.createDataFrame([("j", f"k{i:02}", "x") for i in range(n)], "job_id string, key string, display string")
    reach = spark.createDataFrame([("s", f"k{i:02}", i < done, n - i) for i in range(n)], "student_id string, key string, done boolean, freq long")
    got = C.target_tokens(spark.createDataFrame([("s", "j")], "student_id string, job_id string"), tokens, reach)
    assert got.count() == want and got.where("done").count() == done


@pytest.mark.parametrize("pairs, text, depth, want", [([("java", "자바"), ("자바", "자바 프로그래밍")], "java", 8, ("자바 프로그래밍", "ok")), ([("A", "B"), ("B", "A")], "A", 8, (None, "cycle")), ([("A", "B"), ("B", "C"), ("C", "D"), ("D", "E")], "A", 3, (None, "depth")), ([("A", None)], "A", 8, (None, "null")), ([("A", "B")], "Z", 8, ("Z", "pass"))])
def test_aliases(spark, pairs, text, depth, want):
    got = G.resolve_aliases(spark.createDataFrame([(text,)], "text string"), spark.createDataFrame(pairs, "alias string, target string"), depth).first()
    assert (got["target"], got["status"]) == want


def test_long_alias_cycles(spark):
    """Chains and cycles of any length: one of 150 with a tail of 90 into it, one of two, and a chain that ends."""
    ring = [(f"{k:04d}", f"{(k + 7) % 150:04d}") for k in range(150)]
    tail = [(f"t{k:03d}", f"t{k + 1:03d}" if k < 89 else "0042") for k in range(90)]
    rows = ring + tail + [("x", "y"), ("y", "x"), ("a", "b"), ("b", None)]
    got = sorted(r["cycle"] for r in G.alias_cycles(spark.createDataFrame(rows, "alias string, target string")).collect())
    assert got == [[f"{7 * k % 150:04d}" for k in range(150)], ["x", "y"]]


@pytest.mark.parametrize("pairs, want", [([("A", "A")], [["A"]]), ([("B", "A"), ("A", "B")], [["A", "B"]]), ([("X", "A"), ("A", "B"), ("B", "A")], [["A", "B"]]), ([("A", "B")], [])])
def test_alias_cycles(spark, pairs, want):
    assert [r["cycle"] for r in G.alias_cycles(spark.createDataFrame(pairs, "alias string, target string")).collect()] == want


@pytest.mark.parametrize("edges, want", [([("a", "b"), ("b", "c")], set()), ([("a", "a")], {"self_loop"}), ([("a", "b"), ("b", "a")], {"cycle"}), ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], {"cycle", "dangling"}), ([("a", "z")], {"dangling"})])
def test_validation(spark, edges, want):
    nodes = spark.createDataFrame([(x,) for x in "abc"], "node string")
    assert {r["kind"] for r in G.validate_edges(spark.createDataFrame(edges, "node string, needs string"), nodes).collect()} == want


def test_homonyms(spark):
    courses = spark.createDataFrame([("V020014", "운영체제", ["t1"], 2), ("W080020", "운영 체제", ["t2"], 1), ("X1", "과목", ["t1"], 3)], "course_id string, course_name string, track_ids array<string>, ord int")
    key = lambda c: F.lower(F.regexp_replace(c, r"[()（）\s]", ""))
    wanted = spark.createDataFrame([("X1", "운영체제", 0), ("X1", "없는과목", 1)], "course_id string, name string, ord int")
    edges, misses = J.resolve_names(courses, wanted, key)
    assert [r["needs"] for r in edges.collect()] == ["V020014"] and [r["name"] for r in misses.collect()] == ["없는과목"]


def test_plans_from_lists_are_those_of_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "STUDENTS", 4)
    rng = random.Random(2)
    listed = [(t, f"P{n:02d}", rng.choice([0.4, 0.6]), rng.randint(2, 3), sorted(rng.sample(range(1, 5), 2)), [f"P{n // 2:02d}"] if n % 3 == 0 else []) for t in range(3) for n in sorted(rng.sample(range(60), 30))]
    people = [(f"S{k}", 0 if k < 9 else k % 3, 1 + k % 8, [f"P{n:02d}" for n in rng.sample(range(60), 9)], [f"P{n:02d}" for n in rng.sample(range(60), 6)]) for k in range(20)]
    listings = spark.createDataFrame(listed, "track int, course_id string, base double, credits int, grades array<int>, prereqs array<string>")
    students = spark.createDataFrame(people, "student_id string, track int, current_semester int, shared array<string>, done array<string>")
    rows = students.join(listings, "track").withColumn("score", F.col("base") + F.when(F.array_contains("shared", F.col("course_id")), 0.4).otherwise(0.0)).withColumns({"priority": F.lit(1), "course_type": F.lit("any")})
    done = students.select("student_id", F.explode("done").alias("course_id"))
    wanted = L.plan_semesters(L.order_candidates(rows.drop("current_semester", "done"), done, ["any"]), students.drop("done"), done)
    found = L.plan_listed(students, listings)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())) and found.count() > 20
    assert found._jdf.queryExecution().analyzed().toString().count("FlatMapCoGroupsInPandas") == 1


def test_tasks_grow_in_number_with_the_rows(spark, tmp_path, monkeypatch):
    spark.range(1000).select(F.col("id").alias("l_orderkey"), (F.col("id") % 9).alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 90).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit("low").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(9).select(F.col("id").alias("p_partkey"), F.lit("B").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    for each, tasks in ((100, 10), (25, 40)):
        monkeypatch.setattr(session, "TASK_ROWS", each)
        found = q_planning.course_lists(spark, str(tmp_path), "F")
        assert found.rdd.getNumPartitions() == bindings.postings(spark, str(tmp_path)).rdd.getNumPartitions() == tasks
        assert found.count() == 90 and bindings.postings(spark, str(tmp_path)).count() == 1000
        tokens = spark.createDataFrame([("P0000001", "a"), ("P0000001", "b"), ("P0000002", "a")], "course_id string, key string")
        reach = [sorted(map(tuple, C.reachable_tokens(found, found, tokens, n).collect())) for n in (None, tasks)]
        assert reach[0] == reach[1] and len(reach[0]) == 30


def test_names_that_many_courses_share(spark):
    rng = random.Random(5)
    rows = [(f"X{k:03d}", rng.choice(["a", "b", "c"]), rng.sample(range(4), rng.randint(0, 3)), (k * 7) % 120) for k in range(120)]
    courses = spark.createDataFrame(rows, "course_id string, course_name string, track_ids array<int>, ord int")
    asked = [(c, rng.choice(["A", "B", "none"]), at) for c, *_ in rows for at in (0, 1)]
    edges, misses = J.resolve_names(courses, spark.createDataFrame(asked, "course_id string, name string, ord int"), F.lower)
    own = {c: set(t) for c, _, t, _ in rows}
    best = lambda c, name: min(((-len(own[c] & own[x]), at, x) for x, n, _, at in rows if n == name.lower() and x != c), default=(0, 0, None))[2]
    assert {(r["course_id"], r["needs"]) for r in edges.collect()} == {(c, best(c, n)) for c, n, _ in asked if best(c, n)}
    assert sorted((r["course_id"], r["name"]) for r in misses.collect()) == sorted((c, n) for c, n, _ in asked if not best(c, n))
    # 20,000 courses of one name are 200 million pairs
    many = spark.range(20_000).select(F.col("id").alias("course_id"), F.lit("n").alias("course_name"), F.array(F.col("id") % 3).alias("track_ids"), F.col("id").alias("ord"))
    found = J.resolve_names(many, many.select("course_id", F.lit("N").alias("name"), "ord"), F.lower)[0].observe(seen := Observation(), F.count(F.lit(1)).alias("n"))
    assert found.where("needs <> if(course_id < 3, course_id + 3, course_id % 3)").count() == 0 and seen.get["n"] == 20_000


def test_texts_in_one_place(spark):
    texts = spark.createDataFrame([(1, 0, "b"), (1, 0, "a"), (1, 1, "0")], "k int, ord int, text string")
    assert J.bind_texts(spark.createDataFrame([(1,), (2,)], "k int"), texts, "k", F.lit("made")).orderBy("k").select("text").collect() == [("a",), ("made",)]
    c = duckdb.connect()
    c.execute("CREATE TABLE part AS SELECT 1 AS p_partkey, 'n' AS p_name, 'b' AS p_brand")
    for days in ((2, 1), (1, 2)):  # two lines of one number, in either order
        c.execute("CREATE OR REPLACE TABLE lineitem AS SELECT 1 AS l_partkey, 5 AS l_orderkey, 1 AS l_linenumber, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * unnest(?) AS l_shipdate", [list(days)])
        assert c.execute(registry.ORACLE_SQL["j16_bound_texts"]).fetchall() == [(1, "2024-01-02 00:00:00")]


def test_owners_share_what_a_seed_needs(spark, monkeypatch):
    seeds = spark.createDataFrame([(o, n) for o in range(60) for n in (8, 9)] + [(1, 30)], "owner long, node long")
    edges = spark.createDataFrame([(k, k // 2) for k in range(2, 20)] + [(1, 8), (30, 99)], "node long, needs long")
    known = spark.range(31).withColumnRenamed("id", "node")
    kept = []
    monkeypatch.setattr(G, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    got = G.closure(seeds, edges, known)
    assert sorted(tuple(r) for r in got.collect()) == sorted([(o, n) for o in range(60) for n in (1, 2, 4, 8, 9)] + [(1, 30)])
    assert sum(df.count() for df in kept) <= 10  # of three seeds, not of 121


def test_first_of_equals(spark):
    rows = spark.createDataFrame([("a", 1, 2), ("a", 1, 1), ("a", 0, 0), (None, 5, 3)], "k string, at int, ord int")
    assert [r["ord"] for r in A.latest_per_key(rows, "k", "at", "ord").collect()] == [1]
    ties = spark.createDataFrame([("g", "late"), ("g", "early")], "g string, v string")
    assert A.dominant_value(ties, ["g"], "v", F.when(F.col("v") == "early", 0).otherwise(1)).first()["v"] == "early"


def test_hit_roll_up(spark):
    hits = spark.createDataFrame(
        [(1, "DA", 0.3, "n1", "t1", ["SQL"], ["R", "sql", "Go"], ["x", "SQL", "x"]), (2, "DA", 0.3, "n2", "t2", ["SQL", "Py"], ["Go", "C"], ["y", "x"]), (3, "BE", 0.9, "b", "tb", [], [], [])],
        "hit_ord int, job_id string, score double, name string, text string, main array<string>, fallback array<string>, tags array<string>",
    )
    got = A.roll_up_hits(hits, 2).orderBy("place").collect()
    assert [r["job_id"] for r in got] == ["BE", "DA"] and got[0]["competency_tags"] == []
    assert (got[1]["name"], got[1]["tech_stacks"], got[1]["competency_tags"], got[1]["posting_count"]) == ("n1", ["SQL", "Py"], ["x", "y", "R", "Go", "C"], 2)


def test_parsed_documents(spark):
    docs = spark.createDataFrame([("d", "intro\n소개\nline a\n 자격 \nx\ny\n진로\nz\n")], "doc string, text string")
    found = X.sections(X.numbered_lines(docs, "doc", "text"), "doc", {"소개": "about", "자격": "cert", "진로": "path"}, "about")
    assert {r["section"]: r["text"] for r in found.collect()} == {"about": "intro\nline a", "cert": "x\ny", "path": "z"}
    assert {r["section"]: r["text"] for r in X.merged_sections(found, "doc", "path", {"cert": "자격: "}).collect()} == {"about": "intro\nline a", "path": "자격: x, y\nz"}
    plan = spark.createDataFrame([("d", "머리\n1주\n강의\n주제: 시작\n계속\n2주\n이론\n토론")], "doc string, text string")
    weeks = X.weekly_plan(X.numbered_lines(plan, "doc", "text"), "doc", "주제:", ["토론"])
    assert {r["week"]: r["topic"] for r in weeks.collect()} == {1: "시작 계속", 2: "이론"}
    graded = spark.createDataFrame([("d", "x\n## 2학년 1학기\na\n3학년 2학기\nb")], "doc string, text string")
    assert [(r["line"], r["grade"], r["semester"]) for r in X.graded_lines(X.numbered_lines(graded, "doc", "text"), "doc").orderBy("pos").collect()] == [("x", None, None), ("a", 2, 3), ("b", 3, 6)]
    fields = X.syllabus_fields(spark.createDataFrame([("d", "과목명: 회계\n목표: 돈")], "doc string, text string"), "doc", "text", {"name": "과목명", "goal": "목표", "mail": "메일"}).first()
    assert (fields["name"], fields["goal"], fields["mail"]) == ("회계", "돈", None)


def test_label_clusters(spark):
    rng = random.Random(3)
    names = ["데이터분석", "데이터 분석", "데이터분석능력", "python", "pythn", "java", "javascript", "a", "b", "machinelearning", "machinelearnin", "machine learning"]
    names += ["".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(60)]
    names = sorted(set(names))
    key = lambda n: n.replace(" ", "")
    clusters, want = [], {}
    for n in sorted(names, key=lambda n: (len(n), n)):
        scores = O.key_scores(key(n), [c[0] for c in clusters])
        best = max(range(len(scores)), key=scores.__getitem__) if scores else -1
        if best >= 0 and scores[best] >= 0.86:
            if len(key(n)) < len(clusters[best][0]):
                clusters[best][0] = key(n)
        else:
            clusters.append([key(n), n])
            best = len(clusters) - 1
        want[n] = clusters[best][1]
    rows = spark.createDataFrame([(n, key(n)) for n in names], "name string, key string")
    assert {r["name"]: r["cluster"] for r in O.cluster_labels(rows, "name", "key").collect()} == want


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "n": 2}, {"id": "2", "n": 3}]')
    (tmp_path / "b.json").write_text("{broken")
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("id", StringType()), StructField("n", LongType())])
    good, bad = readers.read_json_arrays(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], schema)
    assert sorted(r["id"] for r in good.cache().collect()) == ["1", "2"] and bad.cache().count() == 1
    (tmp_path / "c.csv").write_bytes('﻿id,n\nx,"1"\n'.encode())
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "c.csv"), schema).collect()] == [("x", 1)]
    (tmp_path / "t" / "u").mkdir(parents=True)
    (tmp_path / "t" / "u" / "d.txt").write_bytes("﻿line 1\nline 2".encode())
    assert [(r["name"], r["text"]) for r in readers.read_texts(spark, str(tmp_path / "t")).collect()] == [("d.txt", "line 1\nline 2")]
    (tmp_path / "f.xml").write_text("<r><job><id>1</id><job_code>c1</job_code><category>기타</category></job><job><id>2</id><category>x</category></job><job><category>x</category></job></r>")
    feed = StructType([StructField(c, StringType()) for c in ("id", "job_code", "category")])
    assert sorted((r["source_id"], r["category"]) for r in readers.read_job_feed(spark, str(tmp_path / "f.xml"), feed, "kw").collect()) == [("2", "x"), ("c1", "kw")]
    posts = spark.createDataFrame([("1", ["a", "b"])], "id string, tags array<string>")
    for append in (False, True):
        writers.write_postings_csv(posts, str(tmp_path / "out"), ["tags", "id"], append)
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == [("a|b", "1")] * 2
    writers.write_postings_json(posts, str(tmp_path / "outj"))
    assert spark.read.json(str(tmp_path / "outj")).first()["tags"] == ["a", "b"]
    writers.write_documents(spark.createDataFrame([("k", "p", "t")], "doc_type string, doc_path string, text string"), str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "docs")).first()["doc_type"] == "k"


def test_recommendation(spark):
    tracks = [(f"T{k}", "C1" if k < 3 else "C2", "D1" if k < 3 else "D2", [f"c{k}"], [["python"], ["sql"], ["java"], ["go"], ["sql"], ["c"], ["python"]][k]) for k in range(7)]
    profile = "user_id string, admission_year int, college string, department string, current_tracks array<string>, current_semester int, interests array<string>, dev_interests array<string>, work_values array<string>, company_types array<string>"
    users = [("ok", 2024, "C1", "D1", [], 1, ["i"], ["d"], [], ["big"]), ("bad", 1990, "C1", "D1", ["T1"], None, [], ["d"], [], ["?"])]
    courses = [(f"c{k}", 3, [1 + k % 4], "required", 1, [f"T{k % 7}"], []) for k in range(7)]
    inputs = {
        "profiles": spark.createDataFrame(users, profile),
        "hits": spark.createDataFrame([("ok", "be", 0.5)], "user_id string, job_id string, score double"),
        "fallback": spark.createDataFrame([("ok", "fb")], "user_id string, job_id string"),
        "job_tokens": spark.createDataFrame([("be", "python", "Python"), ("be", "sql", "SQL")], "job_id string, key string, display string"),
        "tracks": spark.createDataFrame(tracks, TRACK),
        "courses": spark.createDataFrame(courses, "course_id string, credits int, grades array<int>, course_type string, priority int, track_ids array<string>, prereqs array<string>"),
        "course_tokens": spark.createDataFrame([("c0", "python"), ("c1", "sql")], "course_id string, key string"),
        "completed": spark.createDataFrame([("ok", "c0")], "user_id string, course_id string"),
    }
    out = recommend(inputs, 2024, ["growth"], ["big"])
    assert [(r["user_id"], r["errors"]) for r in out["errors"].collect()] == [("bad", ["admission_year", "current_tracks", "interests", "company_types"])]
    slots = [r["slot"] for r in out["pairs"].orderBy("rank").collect()]
    assert len(slots) == 7 and slots[:2] == ["primary", "primary"]
    assert out["pairs"].where("rank = 1").first()["combo_key"] == "T0::T1"
    assert [r["course_id"] for r in out["plan"].where("course_id is not null").collect()] == ["c1"]
    row = out["coverage"].first()
    assert (row["required"], row["current"], row["current_ratio"]) == (2, 1, 0.5)
    assert list(itertools.islice(out, 6)) == ["errors", "profiles", "jobs", "pairs", "plan", "coverage"]
    trace = [tuple(r) for r in out["trace"].orderBy("place").collect()]
    assert trace == [(1, "profiles", 2, 1, 1, 1), (2, "jobs", 1, 1, 0, 1), (3, "pairs", 1, 1, 0, 7), (4, "plan", 1, 1, 0, out["plan"].count()), (5, "coverage", 1, 1, 0, 1)]
    assert {r["stage"]: r["rows"] for r in out["user_trace"].where("user_id = 'bad'").collect()} == {"input": 1}


def test_matching_files(spark, tmp_path):
    """Overlapping patterns name a file once, and one that matches nothing names none."""
    for name in ("a1.json", "a2.json", "b.json"):
        (tmp_path / name).write_text('[{"k": "%s"}]' % name)
    (tmp_path / "c.json").write_text('{"k": "no array"}')
    files = readers.matching_files(spark, [f"{tmp_path}/a*.json", f"{tmp_path}/*1.json", f"{tmp_path}/b.json", f"{tmp_path}/none*", f"{tmp_path}/c.json"])
    assert [f.rsplit("/", 1)[1] for f in files] == ["a1.json", "a2.json", "b.json", "c.json"]
    good, bad = readers.read_json_arrays(spark, files, StructType().add("k", "string"))
    assert sorted(r["k"] for r in good.collect()) == ["a1.json", "a2.json", "b.json"] and bad.count() == 1


def _one_track(spark):
    listed = [(7, f"P{n:02d}", [0.4, 0.6][n % 2], 2 + n % 2, [1 + n % 4, 1 + (n + 1) % 4], [f"P{n // 2:02d}"] if n % 3 == 0 and n else []) for n in range(30)]
    people = [(f"S{k}", 7, 1 + k % 8, [f"P{n:02d}" for n in range(k, 30, 4)], [f"P{n:02d}" for n in range(k, 30, 7)]) for k in range(6)]
    students = spark.createDataFrame(people, "student_id string, track int, current_semester int, shared array<string>, done array<string>")
    return students, spark.createDataFrame(listed, "track int, course_id string, base double, credits int, grades array<int>, prereqs array<string>")


def test_listed_candidates_are_ordered_without_a_row_in_a_shuffle(spark):
    students, listings = _one_track(spark)
    rows = students.join(listings, "track").withColumn("score", F.col("base") + F.when(F.array_contains("shared", F.col("course_id")), 0.4).otherwise(0.0)).withColumns({"priority": F.lit(1), "course_type": F.lit("any")})
    wanted = L.order_candidates(rows.drop("done"), students.select("student_id", F.explode("done").alias("course_id")), ["any"])
    found = L.listed_candidates(students, listings, 3)
    columns = ["student_id", "course_id", "credits", F.round("score", 9), "place"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, wanted.select(*columns).collect()))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "Window" not in plan and plan.count("FlatMapCoGroupsInArrow") == 1


@pytest.mark.parametrize(("tamper", "rule"), [
    (None, None),
    (lambda p: p.withColumn("credits", F.when(F.col("position") == 0, F.col("credits") + 40).otherwise(F.col("credits"))), "semester cap"),
    (lambda p: p.withColumn("grade", F.when(F.col("course_id").isNotNull(), 1 + F.col("grade") % 4).otherwise(F.col("grade"))), "grade"),
    (lambda p: p.unionByName(p.where("position = 0").withColumn("position", F.lit(50))), "twice"),
    (lambda p: p.where("position is null or position < 1"), "left out"),
    (lambda p: p.withColumn("course_id", F.when(F.col("position") == 0, "P99").otherwise(F.col("course_id"))), "not offered"),
    (lambda p: p.withColumn("position", -F.col("position")), "prerequisite"),
])
def test_breaches_of_a_plan_are_found(spark, tamper, rule):
    students, listings = _one_track(spark)
    plan = L.plan_listed(students, listings)
    found = {r["rule"] for r in L.plan_breaches(tamper(plan) if tamper else plan, students, listings).collect()}
    assert rule in found if rule else not found
