"""Cases in which a query once did less than its whole job."""

import datetime
import random

from attestra.operators import extraction as E
from attestra.operators import notices as N
from attestra.operators import postings as O
from attestra.operators import serving as P
from attestra.operators import verification as V
from attestra.plans import registry


def test_lines_and_tables_behind_long_text(spark):
    long = "\n".join(["Some words of the notice that go on for a while."] * 3000)
    table = "Name of post | Organisation | Total\nClerk | North | 3\nDriver | South | 2"
    docs = spark.createDataFrame([(1, f"{long}\n{table}\nLast heading\nThe last line of the document, which is no heading.", "t")], "doc_id long, text string, title string")
    lines = E.document_lines(docs)
    assert lines.count() == 3005 and lines.orderBy("line_no").tail(1)[0]["line"].startswith("The last line")
    assert E.document_lines(docs, most=120_000).count() < 3000
    assert N.pipe_tables(docs).first()["status"] == "EXPLICIT" and N.structure_posts(docs).first()["strategy"] == "TABLE"


def test_eligibility_by_all_criteria(spark):
    day = datetime.date(1990, 6, 1)
    profiles = spark.createDataFrame(
        [("fits", day, "GENERAL", ["B.A. (Honours)"], True, 24), ("lives elsewhere", day, "GENERAL", ["B.A. (Honours)"], False, 24), ("other degree", day, "GENERAL", ["M.A."], True, 24), ("too new", day, "GENERAL", ["B.A. (Honours)"], True, 23), ("says nothing", None, None, None, None, None), ("relaxed", datetime.date(1980, 6, 1), "OBC", ["B.A. (Honours)"], True, 24)],
        "profile_id string, born date, category string, qualifications array<string>, lives_there boolean, experience_months int",
    )
    rule = (datetime.date(2020, 5, 31), [("OBC", 9)], "b a honours", "STRING", "Permanent resident of Assam", None, 2, None)
    rules = spark.createDataFrame([(1, "18", "30", *rule), (2, "18", "30", *rule), (3, "18", "thirty", *rule), (4, *[None] * 3, [], *[None] * 6)], "job_id int, low string, high string, cutoff date, relaxations array<struct<category:string,years:int>>, qualification string, qualification_kind string, domicile string, months int, years int, experience string")
    got = {(r["profile_id"], r["first_job"]): (r["jobs"], r["age"], r["qualification"], r["domicile"], r["experience"], r["outcome"]) for r in P.evaluate_eligibility(profiles, rules, "Assam").collect()}
    assert len(got) == 18
    yes, no, ask, unknown = "ELIGIBLE", "NOT_ELIGIBLE", "REVIEW_REQUIRED", "UNKNOWN"
    assert got["fits", 1] == (2, yes, yes, yes, yes, yes) and got["fits", 3] == (1, ask, yes, yes, yes, ask) and got["fits", 4] == (1, *[unknown] * 5)
    assert got["lives elsewhere", 1] == (2, yes, yes, no, yes, no) and got["other degree", 1] == (2, yes, ask, yes, yes, ask)
    assert got["too new", 1] == (2, yes, yes, yes, no, no) and got["says nothing", 1] == (2, *[unknown] * 5) and got["relaxed", 1] == (2, yes, yes, yes, yes, yes)


def test_eligible_pairs_are_those_of_all_pairs(spark):
    """The range join against every pair, on bounds that cross, days at the edge, leap days, odd numbers and nulls."""
    rng = random.Random(5)
    days = [datetime.date(1988, 2, 29), datetime.date(1990, 12, 31), datetime.date(1991, 1, 1), datetime.date(1990, 1, 1)]
    pick = lambda *xs: rng.choice(xs)
    profiles = [(i, pick(*days, None), pick("GENERAL", "OBC", "SC", None), pick(["B.A."], ["b a", "M.A."], [], None, [None, "b.a"]), pick(True, True, False, None), pick(24, 36, 0, None)) for i in range(90)]
    rules = [(i, pick("18", "30", None, "2000000000", "x"), pick("28", "30", "33", None, "x"), pick(datetime.date(2020, 12, 31), datetime.date(2021, 1, 1), datetime.date(2021, 2, 28), None), pick([], [("OBC", 3)], [("OBC", 1), ("SC", 5)], None),
              pick("B.A.", "b-a", "M.A.", None), pick("STRING", "STRING", "JSON"), pick("Resident of Assam", "assam domicile", "local", None), pick(24, 36, None), pick(2, None), pick("some", None)) for i in range(240)]
    given = spark.createDataFrame(profiles, "profile_id int, born date, category string, qualifications array<string>, lives_there boolean, experience_months int")
    held = spark.createDataFrame(rules, "job_id int, low string, high string, cutoff date, relaxations array<struct<category:string,years:int>>, qualification string, qualification_kind string, domicile string, months int, years int, experience string")

    def age_says(p, r):
        low, high, cutoff = r[1], r[2], r[3]
        if (low is None and high is None) or p[1] is None:
            return "UNKNOWN"
        if cutoff is None or "x" in (low, high):
            return "REVIEW_REQUIRED"
        age = cutoff.year - p[1].year - ((cutoff.month, cutoff.day) < (p[1].month, p[1].day))
        if low is not None and age < int(low):
            return "NOT_ELIGIBLE"
        if high is None or age <= int(high):
            return "ELIGIBLE"
        if p[2] in (None, "GENERAL"):
            return "NOT_ELIGIBLE"
        years = dict(r[4] or []).get(p[2])
        return "REVIEW_REQUIRED" if years is None else "NOT_ELIGIBLE" if age > int(high) + years else "ELIGIBLE"

    rule_of = {}
    for r in rules:
        rule_of.setdefault(repr(r[1:]), r)
    every = P.evaluate_eligibility(given, held, "Assam").collect()
    assert {(r["profile_id"], r["first_job"]): r["age"] for r in every} == {(p[0], r[0]): age_says(p, r) for p in profiles for r in rule_of.values()}
    assert len(every) == 90 * len(rule_of)
    pairs = sorted(P.eligible_pairs(given, held, "Assam").collect())
    assert pairs == sorted(r for r in every if r["outcome"] == "ELIGIBLE") and len(pairs) > 20
    assert P.eligible_pairs(given.limit(0), held, "Assam").count() == P.evaluate_eligibility(given, held.limit(0), "Assam").count() == 0


def test_facts_contained_anywhere(spark):
    many = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"x {many} y"), (2, f"pre{many}post"), (None, f"  {many.upper()}\n"), (4, many[:-1]), (5, "a short ONE"), (5, "a shor"), (6, "")], "doc_id int, text string")
    facts = spark.createDataFrame([("many", many), ("three", "a  short one"), ("part", "short"), ("empty", " "), ("null", None)], "fact_id string, value string")
    assert {tuple(r) for r in V.contained_facts(facts, docs).collect()} == {(1, "many"), (2, "many"), (None, "many"), (5, "three"), (5, "part")}


def test_numbers_and_dates_of_evidence(spark):
    cases = [
        ("vacancies.total", "INTEGER", "5", "2 posts of A and 3 posts of B", "SUPPORTS"), ("vacancies.total", "INTEGER", "6", "2 posts of A and 3 posts of B", "CONTEXT_ONLY"), ("vacancies.total", "INTEGER", "6", "Total posts: 07", "CONTRADICTS"),
        ("age.minimum", "INTEGER", "18", "Not less than 18 years", "SUPPORTS"), ("age.maximum", "INTEGER", "18", "Not less than 18 years", "CONTEXT_ONLY"), ("application.end_date", "DATE", "2024-03-01", "Last date: 01/03/2024. End date 2024-03-09", "SUPPORTS"),
        ("application.end_date", "DATE", "2024-03-01", "Last date: 31/02/2024. End date 2024-03-09", "CONTRADICTS"), ("application.end_date", "DATE", "2024-03-01", "Last date 01/03/2024, last date 02/03/2024", "CONTEXT_ONLY"), ("x", "BOOLEAN", "true", "true", "CONTEXT_ONLY"), ("x", "STRING", "True  story", "a true story", "SUPPORTS"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "fact_id int, path string, value_type string, value string, excerpt string, want string")
    evidence = rows.selectExpr("fact_id", "fact_id AS evidence_id", "excerpt", "cast(null as string) AS context")
    got = {r["fact_id"]: r["assessment"] for r in V.interpret_evidence(rows.select("fact_id", "path", "value_type", "value"), evidence).collect()}
    assert [got[i] for i in range(len(cases))] == [c[-1] for c in cases]


def test_streamed_versions_lie_in_files(spark):
    df = registry.QUERIES["streamed_versions"](spark, "/root/testdata/sf0.001")
    assert df.inputFiles() and df.count() > 0 and not [t for t in spark.catalog.listTables() if t.name.startswith("versions_")]


def test_lifecycle_order_has_all_jobs(spark):
    sf_dir = "/root/testdata/sf0.001"
    page, everything = (registry.QUERIES[q](spark, sf_dir).collect() for q in ("lifecycle_page", "lifecycle_table"))
    assert len(everything) == spark.read.parquet(f"{sf_dir}/orders.parquet").count() > 200 and everything[:200] == page


def test_short_facts_and_long_names_meet_by_an_index(spark):
    docs = spark.createDataFrame([(1, "xfoo bary and more"), (2, "foo  BAR"), (3, "fo bar"), (4, "a"), (5, None)], "doc_id int, text string")
    facts = spark.createDataFrame([("two", "foo bar"), ("one", "oo"), ("letter", "A"), ("none", "zzz")], "fact_id string, value string")
    assert {tuple(r) for r in V.contained_facts(facts, docs).collect()} == {(1, "two"), (2, "two"), (1, "one"), (2, "one"), (1, "letter"), (2, "letter"), (3, "letter"), (4, "letter")}
    assert V.contained_facts(facts.where("1 = 0"), docs).count() == 0 == V.contained_facts(facts, docs.where("1 = 0")).count()
    long = "Office of the Joint Director of Public Works and Roads"
    owners = spark.createDataFrame([(1, f"Clerk at the {long}, North"), (2, "Office of the Joint Director"), (3, f"{long}s clerk"), (4, None)], "owner_id int, phrase string")
    posts = spark.createDataFrame([(7, long, "clerk"), (8, long, "driver"), (9, "", "clerk"), (10, "joint director", "office")], "post_id int, organisation string, base string")
    assert {tuple(r) for r in O.owner_posts(owners, posts).collect()} == {(1, 7), (1, 10), (2, 10), (3, 10)}


def test_counts_of_outcomes_by_age_against_all_pairs(spark):
    ages = [(k, a, c) for k, (a, c) in enumerate((a, c) for a in (None, 5, 17, 18, 20, 25, 26, 30, 31, 36, 90) for c in (None, "GENERAL", "OTHER"))]
    rules = [(lo, hi, r) for lo in (None, 18, 30) for hi in (None, 25, 30, 10) for r in (None, 0, 5)] * 2

    def outcome(age, category, lo, hi, r):
        if lo is None and hi is None or age is None:
            return "unknown"
        if lo is not None and age < lo:
            return "not_eligible"
        if hi is None or age <= hi:
            return "eligible"
        if category in (None, "GENERAL"):
            return "not_eligible"
        return "review_required" if r is None else "not_eligible" if age > hi + r else "eligible"

    names = ("eligible", "unknown", "review_required", "not_eligible")
    want = {(k, *(sum(outcome(a, c, *x) == n for x in rules) for n in names)) for k, a, c in ages}
    got = P.eligible_jobs(spark.createDataFrame(ages, "profile_id int, age int, category string"), spark.createDataFrame(rules, "low int, high int, relaxation int"))
    assert {(r["profile_id"], *(r[n] for n in names)) for r in got.collect()} == want
