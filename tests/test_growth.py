"""Work that grows with its input, not with the square of a part of it; times are far from both."""

import time

from pyspark.sql import functions as F

from attestra.functions.scalars import let
from attestra.operators import extraction as E
from attestra.operators import notices as N
from attestra.operators import post_details as D
from attestra.operators import postings as O
from attestra.operators import section_rules as R
from attestra.operators import verification as V


def seconds(make) -> tuple[list, float]:
    began = time.time()
    return [tuple(r) for r in make().collect()], time.time() - began


def test_windows_of_a_long_text_are_made_once(spark):
    """F1."""
    words = [f"w{i}" for i in range(30_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(reversed(words)))], "doc_id int, text string")
    facts = spark.createDataFrame([("late", " ".join(words[29_000:29_020])), ("short", " ".join(words[7:12]))], "fact_id string, value string")
    got, took = seconds(lambda: V.contained_facts(facts, docs))
    assert sorted(got) == [(1, "late"), (1, "short")] and took < 40


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def times_in_plan(spark, df, what: str) -> int:
    """How often an expression stands in a query: within a lambda each place is computed for itself."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        return df._jdf.queryExecution().analyzed().toString().count(what)
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


HEAD = "Name of the Posts\nMinimum Educational Qualification and\nScale of Pay with total no. of vacant posts"


def test_tables_without_bars_are_read_within_their_row(spark):
    """F2."""
    row = "{0}. Clerk {0} HSLC passed\n14,000 - 60,500\nGrade pay\n{1} Nos. in all"
    text = lambda n: "\n".join([HEAD, *(row.format(i + 1, 40 + i) for i in range(n))])
    docs = spark.createDataFrame([(1, text(3)), (2, HEAD), (3, "Qualification"), (3, None), (None, text(2).replace("60,500", "", 1)), (5, text(2).replace("Clerk 2", "Clerk 1"))], "doc_id int, text string")
    out = O.whitespace_tables(docs)
    got = sorted((r["doc_id"] or 0, r["status"], tuple(p["total"] for p in r["posts"] or []), r["error"] or "") for r in out.collect())
    assert got == [(0, "AMBIGUOUS", (), "PAY"), (1, "EXPLICIT", (40, 41, 42), ""), (2, "AMBIGUOUS", (), ""), (3, "LEGACY_UNSPLIT", (), ""), (3, "LEGACY_UNSPLIT", (), ""), (5, "AMBIGUOUS", (), "DUPLICATE")]
    assert "Exchange" not in plan_of(out) and "Exchange" not in plan_of(O.numbered_positions(docs))


def test_a_notice_of_many_posts_with_clauses_and_rosters(spark):
    """of 400 posts, each told in a clause and a roster."""
    n = 400
    table = "| Name of Post | Organisation | UR | Total Posts |\n" + "\n".join(f"| Clerk | Unit {i} | 5 | 5 |" for i in range(n))
    clauses = "\n".join(f"5.{i} For the post of Clerk in Unit {i}: The age\nof all must be 18-{20 + i % 9} as on\n01-01-2030." for i in range(n))
    rosters = "\n".join(f"Clerk in Unit {i} with Grade Pay of Rs. {i}/-\nUnreserved 5\nTotal 5" for i in range(n))
    docs = spark.createDataFrame([(1, f"{table}\n\n{clauses}\n6.1 Rosters\n{rosters}")], "doc_id int, text string")
    parsed = docs.select("doc_id", "text", let(N.source_lines("text"), N.vacancy_table)["posts"].alias("posts"))
    got, took = seconds(lambda: D.attached(D.claims(parsed)).groupBy("path", F.col("problem").isNull()).count())
    assert {(p, c) for p, fine, c in got if fine and p.startswith(("age", "pay"))} >= {("pay.grade_pay", n)} and took < 60
    assert times_in_plan(spark, N.pipe_tables(docs), "nameofthepost") == 1  # before: 7, so a header's meaning was found seven times
    told = D.claims(parsed)
    assert times_in_plan(spark, told, r"Grade\s+Pay") == 4 and times_in_plan(spark, told, "fire emergency") == 10  # before: 7, once for each roster and roster; and 18, for each clause and post


def test_rows_meet_posts_counted_by_key(spark):
    """30,000 rows and 30,000 posts of one key are 900 million pairs."""
    rows = spark.range(30_000).select(F.col("id").alias("row_id"), F.lit(1).alias("k")).unionByName(spark.createDataFrame([(-1, 2), (-2, 3), (-3, 2), (-3, 4), (-4, 3), (-4, 2), (-5, None)], "row_id long, k int"))
    posts = spark.range(30_000).select(F.col("id").alias("post_id"), F.lit(1).alias("k")).unionByName(spark.createDataFrame([(7, 2), (8, 4), (9, None)], "post_id long, k int"))
    got, took = seconds(lambda: E.unambiguous_matches(rows, posts, ["k"], "row_id").where("row_id < 1"))
    want = {(0, None, "AMBIGUOUS"), (-1, 7, "ATTACHED"), (-2, None, "UNMATCHED"), (-3, None, "AMBIGUOUS"), (-4, 7, "ATTACHED"), (-5, None, "UNMATCHED")}
    assert set(got) == want and len(got) == len(want)
    plan = E.unambiguous_matches(rows, posts, ["k"], "row_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") > plan.index("Aggregate") and plan.count("Aggregate") == 2


def test_posts_are_structured_within_the_notice_row(spark):
    """no join brings the strategies together, ids may repeat, and the first that finds something decides."""
    bars = "| Name of Post | Total Posts |\n| Clerk | 3 |"
    columns = HEAD + "\n1. Clerk HSLC passed\n14,000 - 60,500\n4 Nos."
    places = "Position\nEssential\nQualification\n1) Clerk\n(5 Nos.)"
    rows = [(1, "t", bars), (1, "t", columns), (2, "t", places), (3, "Advertisement for the post of Clerk", None), (None, "2 posts of Clerk in North", columns), (4, None, None), (5, "t", f"{bars}\n{columns}")]
    out = N.structure_posts(spark.createDataFrame(rows, "doc_id int, title string, text string"))
    got = sorted((r["doc_id"] or 0, r["strategy"], r["status"], *(p["total"] or 0 for p in r["posts"])) for r in out.collect())
    assert got == [(0, "NARRATIVE", "EXPLICIT", 2), (1, "COLUMNS", "EXPLICIT", 4), (1, "TABLE", "EXPLICIT", 3), (2, "POSITIONS", "EXPLICIT", 5), (3, "SINGLE", "EXPLICIT", 0), (4, "NONE", "LEGACY_UNSPLIT"), (5, "TABLE", "EXPLICIT", 3)]
    assert "Exchange" not in plan_of(out)


def test_sections_are_read_once(spark):
    """the notices stand in the plan once, and all that is said of a path is told from one pass."""
    text = "1. AGE LIMIT:\nMinimum age: 18 years\nMaximum: 30 years\n2.1 ALTER\n2.2 AGE RELAXATION:\nOBC/MOBC 3 years\nPwBD up to 10 years\n3.1 AGE\nMaximum: 31 years\nMinimum age: 18 years"
    docs = spark.createDataFrame([(1, text), (2, None), (2, text.replace("31", "30")), (None, "PAY SCALE: Rs. 10,000")], "doc_id int, text string")
    out = R.section_facts(R.headed_sections(docs), R.rule_table(spark, R.default_rules("Nord", "Nordic")))
    relaxed = '[{"category":"OBC / MOBC","relaxation":"3 years"},{"category":"PwBD","relaxation":"10 years"}]'
    got = {(r["doc_id"], r["path"]): r["value"] for r in out.collect()}
    assert got == {(1, "age.minimum"): "18", (1, "age.relaxations"): relaxed, (2, "age.minimum"): "18", (2, "age.maximum"): "30", (2, "age.relaxations"): relaxed, (None, "pay.scale"): "Rs. 10,000"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2 and "Union" not in plan_of(out)  # sections, and each one's value
