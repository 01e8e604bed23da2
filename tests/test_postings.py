"""Posts of notices, identities and publication on small cases written by hand."""

from pyspark.sql import functions as F

from attestra.functions import scalars as S
from attestra.operators import extraction as E
from attestra.operators import history as H
from attestra.operators import postings as N
from attestra.streaming import jobs as J

HEAD = "Sl No Name of the Post Minimum\nEducational Qualification\nScale of Pay Total No. of vacant posts\n"


def one(spark, fn, text):
    return fn(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


def table(spark, text):
    r = one(spark, N.whitespace_tables, text)
    return r["status"], [(p["name"], p["total"]) for p in r["posts"] or []], r["error"]


def test_whitespace_tables(spark):
    rows = "1. Laboratory\nTechnician\nHSLC passed\n14,000 - 60,500\nGrade pay 8,700\n12 Nos\nas noted\n2 Staff Nurse B. Sc. Nursing\n22000-97000\n3 nos.\n"
    assert table(spark, HEAD + rows) == ("EXPLICIT", [("Laboratory Technician", 12), ("Staff Nurse", 3)], None)
    assert table(spark, rows) == ("LEGACY_UNSPLIT", [], None)
    assert table(spark, HEAD + "nothing") == ("AMBIGUOUS", [], None)
    assert table(spark, HEAD + rows.replace("2 Staff", "3 Staff"))[::2] == ("AMBIGUOUS", "SERIAL")
    assert table(spark, HEAD + rows.replace("22000-97000", "as per rules"))[::2] == ("AMBIGUOUS", "PAY")
    assert table(spark, HEAD + rows.replace("3 nos.", "three"))[::2] == ("AMBIGUOUS", "COUNT")
    assert table(spark, HEAD + rows.replace("12 Nos", "0 Nos"))[::2] == ("AMBIGUOUS", "TOTAL")
    assert table(spark, HEAD + rows + "3 Staff Nurse HSLC\n22000-97000\n1 no.")[::2] == ("AMBIGUOUS", "DUPLICATE")
    assert table(spark, HEAD + rows.replace("1. Lab", "I. Lab"))[0] == "EXPLICIT"  # a serial that was read as a letter


def positions(spark, text):
    r = one(spark, N.numbered_positions, text)
    return r["status"], [(p["name"], p["total"]) for p in r["posts"] or []]


def test_numbered_positions(spark):
    head = "Position\nEssential Qualification\n"
    rows = "1) Junior\nEngineer\n(4 Nos.)\nA degree.\n2. Driver\n1 post\n3 Reads like a row.\n(9 posts)\n4 Guard\nof the gate.\n5 posts\n"
    assert positions(spark, head + rows) == ("EXPLICIT", [("Junior Engineer", 4), ("Driver", 1)])
    assert positions(spark, head + rows + "7 driver\n(2 Nos)") == ("AMBIGUOUS", [])
    assert positions(spark, head + "1 Clerk\n\n(2 Nos)") == ("AMBIGUOUS", [])
    assert positions(spark, rows) == ("LEGACY_UNSPLIT", [])


def test_keys_and_names(spark):
    key = lambda t, o: spark.range(1).select(S.post_key(F.lit(t), F.lit(o))).first()[0]
    assert key("Junior  Clerk", "Office of A.") == "junior_clerk_office_of_a" and key("***", "") == "post" == key(None, None)
    long = key("Senior Officer " * 12, "Unit")
    assert long == key("SENIOR officer " * 12, "unit") and len(long) == 97 - (long[96] == "_") + 13 or long[-13] == "_"
    name = lambda t, o, p="": spark.range(1).select(S.canonical_post_name(F.lit(t), F.lit(o), F.lit(p))).first()[0]
    assert name("Junior Clerk", "Clerk") == "Junior Clerk – Clerk"
    assert name("Clerk - HEAD office ", "Head Office.") == "Clerk – Head Office"
    assert name("Clerk – Old unit", "New unit", "old unit") == "Clerk – New unit" and name(" .Clerk,", "") == "Clerk"


def test_critical_posts_by_policy(spark):
    path = lambda p, v: spark.range(1).select(S.is_critical(F.lit(p), v)).first()[0]
    assert path("posts.12.vacancies", 1) and not path("posts.clerk.vacancies", 1) and path("posts.clerk.vacancies", 2)
    assert path("posts.1.age.minimum", 1) and not path("posts.1.ages", 1) and path("posts.x.application.url", 2)


def test_a_document_keeps_its_parents_if_one_group_fails(spark):
    parents = spark.createDataFrame([(1, "Fitter", 3), (1, "Cook", 1), (2, "Fitter", 3), (2, "Cook", 2), (3, "Cook", 1), (3, "Cook", 1)], "doc_id long, name string, n long")
    children = spark.createDataFrame([(1, "Fitter", "UR", 2), (1, "Fitter", "SC", 1), (2, "Fitter", "UR", 3), (2, "Cook", "UR", 1), (3, "Cook", "UR", 1)], "doc_id long, parent string, name string, n long")
    rows = N.refined_parents(parents, children).orderBy("doc_id", "ordinal").collect()
    assert [(r["doc_id"], r["ordinal"], r["name"], r["n"]) for r in rows] == [
        (1, 1, "Cook", 1), (1, 2, "Fitter – SC", 1), (1, 3, "Fitter – UR", 2), (2, 1, "Cook", 2), (2, 2, "Fitter", 3), (3, 1, "Cook", 1), (3, 2, "Cook", 1)
    ]


def test_listing_names_need_a_margin(spark):
    rows = [(1, ["Staff Nurse", "Lab Technician"], ["staff nurse post", "technician"]), (2, ["Staff Nurse", "Staff Cook"], ["staff", "cook"]), (3, ["Nurse"], ["nurse"]), (4, ["a", "b"], ["a"])]
    out = {r["doc_id"]: (r["aligned"], r["names"]) for r in N.aligned_names(spark.createDataFrame(rows, "doc_id long, listing array<string>, parsed array<string>")).collect()}
    assert out == {1: (True, ["Staff Nurse", "Lab Technician"]), 2: (False, ["staff", "cook"]), 3: (False, ["nurse"]), 4: (False, ["a"])}


def test_owners_contain_organisation_and_base(spark):
    owners = spark.createDataFrame([(1, "Clerk, Office of the Director"), (2, "Office of the Directors clerk"), (3, None)], "owner_id long, phrase string")
    posts = spark.createDataFrame([(7, "office of the director", "Clerk"), (8, "Office", "driver")], "post_id long, organisation string, base string")
    assert [tuple(r) for r in N.owner_posts(owners, posts).collect()] == [(1, 7)]


def test_categories_with_wrapped_labels(spark):
    text = "UR (men\nand women) : 12 of\n 20\nOBC 5\nSCALE 9\nUR 7"
    out = N.category_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert {r["category"]: r["n"] for r in out.collect()} == {"UR": 7, "OBC": 9}


def test_notices_keep_the_last_of_each_url(spark):
    day = lambda d: f"2024-01-{d:02d}"
    rows = [("a", "u1", 1, "old", day(5)), ("a", "u1", 2, "new", day(4)), ("a", "u2", 3, "x", None), ("a", "u3", 4, "y", day(9)), ("a", "u4", 5, "early", day(1)), ("b", "u5", 6, "z", day(8))]
    df = spark.createDataFrame(rows, "source string, url string, position long, title string, day string").withColumn("day", F.col("day").cast("date"))
    out = N.listing_notices(df, F.lit(day(3)).cast("date"), 2).collect()
    assert {(r["url"], r["title"], r["exceeded"]) for r in out} == {("u3", "y", True), ("u1", "new", True), ("u5", "z", False)}


def test_jobs_by_post_or_by_master(spark):
    masters, posts = spark.createDataFrame([(1,), (2,)], "master_id long"), spark.createDataFrame([(10, 1), (11, 1), (30, 3)], "post_id long, master_id long")
    assert {tuple(r) for r in H.public_jobs(masters, posts).collect()} == {(10, 1, True), (11, 1, True), (2, 2, False)}


def test_breakdowns_go_as_deep_as_asked(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1, "c": {"d": [2]}}, "e": null, "f": "x"}'), (2, "not json"), (3, None)], "id long, json string")
    got = {(r["id"], r["path"], r["value"]) for r in E.breakdown_rows(df, "id", "json", 3).collect()}
    assert {g for g in got if g[1] != "e"} == {(1, "a.b", "1"), (1, "a.c.d", "[2]"), (1, "f", "x")}
    deep = spark.createDataFrame([(1, '{"a": {"b": {"c": {"d": {"e": {"f": 7}}}}}, "g": {}}')], "id long, json string")
    assert [tuple(r) for r in E.breakdown_rows(deep, "id", "json").collect()] == [(1, "a.b.c.d.e.f", "7")] and E.breakdown_rows(deep, "id", "json", 3).count() == 0


def test_a_replayed_batch_replaces_its_folder(spark, tmp_path):
    schema = "k int, v string"
    for n, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c"), (3, "d")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):
            J.append_each_batch(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lambda df: df, f"{tmp_path}/out", ["k"], f"{tmp_path}/state").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 2 + n
