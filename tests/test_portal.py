"""The review portal on small tables: families, states, search, pages beyond the last, orders with missing dates, and counts by source."""

import datetime

import pytest
from pyspark.sql import functions as F

from attestra.operators import portal as P

SCHEMA = """family string, authority string, candidate string, post_key string, status string, outcome string, path string, priority string, completeness string,
post_name string, organization string, authority_name string, title string, opening_date date, closing_date date, refreshed_at date, place int"""
DAY = datetime.date(2026, 1, 10)


def unit(family, candidate, post, *, status="RESOLVED", outcome=None, path=None, priority="HIGH", name="Clerk", start=None, end=None, fresh=None, place=1):
    return (family, "slb", candidate, post, status, outcome, path, priority, "COMPLETE", name, "Police", "Board_1 100%", None, start, end, fresh, place)


@pytest.fixture(scope="module")
def rows(spark):
    day = lambda n: DAY + datetime.timedelta(days=n)
    given = [
        unit("ACTIVE", "a", "p", status="QUEUED", start=day(-9), end=day(9), place=2),
        unit("ACTIVE", "a", "p", status="IN_REVIEW", place=3),
        unit("ACTIVE", "a", None, status="QUEUED"),  # a has posts, so that this isn't shown
        unit("PUBLISHED", "a", "p", path="AUTO_PUBLISHED", start=day(-9), end=day(9)),
        unit("RESOLVED", "a", "q", outcome="REJECTED", start=day(-90), end=day(-3)),
        unit("RESOLVED", "b", None, outcome="APPROVED_WITH_CORRECTIONS", fresh=day(-5), priority="NORMAL"),
        unit("RESOLVED", "c", None, outcome="APPROVED", fresh=day(-1), name="Driver"),
        unit("PUBLISHED", "c", None, path="HUMAN_PUBLISHED", start=day(4), end=day(2)),
        unit("ACTIVE", "d", None, status="IN_REVIEW", start=day(3), end=day(20), name="STRASSE"),
    ]
    return P.portal_rows(spark.createDataFrame(given, SCHEMA), ["place"], F.lit(DAY).cast("date")).cache()


def test_first_of_a_family_and_leaders_of_all(rows):
    got = {(r["family"], r["candidate"], r["post_key"]): (r["status"], r["leads"], r["lifecycle"]) for r in rows.collect()}
    assert len(got) == 7 and ("ACTIVE", "a", None) not in got
    assert got["ACTIVE", "a", "p"] == ("QUEUED", True, "OPEN") and got["PUBLISHED", "a", "p"] == ("RESOLVED", False, "OPEN")
    assert got["RESOLVED", "a", "q"][2] == "RECENTLY_CLOSED" and not got["RESOLVED", "c", None][1] and got["PUBLISHED", "c", None] == ("RESOLVED", True, "UNKNOWN")
    assert got["ACTIVE", "d", None][2] == "UPCOMING"


def test_counts(rows):
    assert P.portal_counts(rows).first().asDict() == {"total_jobs": 5, "review_required": 1, "in_review": 1, "approved": 2, "rejected": 1, "auto_published": 1, "human_published": 1}
    assert set(P.portal_counts(rows.limit(0)).first()) == {0}


def test_filters_and_search(rows):
    found = lambda **k: sorted((r["candidate"], r["post_key"] or "") for r in P.portal_filter(rows, **k).collect())
    assert found() == [("a", "p"), ("a", "q"), ("b", ""), ("c", ""), ("d", "")]
    assert found(selected="RESOLVED", text=" driver police ") == [("c", "")]  # across two columns, whatever the case
    assert found(text="100%") == found() and found(text="%") == found() and found(text="board?1") == [] and found(text="k p") == [("a", "p"), ("a", "q"), ("b", ""), ("c", "")]
    assert found(outcome="APPROVED") == [("b", "")] and found(outcome="REJECTED") == [("a", "q")] and found(selected="REJECTED", outcome="APPROVED") == []
    assert found(priority="NORMAL") == [("b", "")] and found(completeness="INCOMPLETE") == []


def test_pages_are_clamped_and_ordered(rows):
    page = lambda df, n: [(r["candidate"], r["post_key"], r["total"], r["pages"], r["page"]) for r in P.clamped_page(df, P.portal_order(), n, 2).collect()]
    every = P.portal_filter(rows)
    # open, then recently closed, then upcoming; unknown ones latest refreshed first, without a time last
    assert page(every, -3) == [("a", "p", 5, 3, 1), ("a", "q", 5, 3, 1)] and page(every, 2) == [("d", None, 5, 3, 2), ("b", None, 5, 3, 2)]
    assert page(every, 99) == page(every, 3) == [("c", None, 5, 3, 3)] and page(every.limit(0), 4) == []


def test_each_public_order(spark):
    d = lambda n: DAY + datetime.timedelta(days=n)
    jobs = spark.createDataFrame(
        [(1, "x", "b", d(5), 3, d(0), "OPEN", d(-1)), (2, "w", "B", None, None, d(2), "UNKNOWN", None), (3, "x", "a", d(1), 9, d(1), "OPEN", d(-2)), (4, "x", "c", d(-1), 9, d(1), "RECENTLY_CLOSED", d(-9))],
        "job_id int, candidate string, name string, end_date date, vacancies int, published_at date, lifecycle string, start_date date",
    )
    got = {}
    for r in P.sort_pages(jobs, 3).orderBy("mode", "place").collect():
        got.setdefault(r["mode"], []).append(r["job_id"])
    assert got == {
        "published_desc": [2, 3, 4], "published_asc": [1, 3, 4], "application_end_asc": [4, 3, 1], "application_end_desc": [1, 3, 4],
        "display_name_asc": [3, 2, 1], "vacancies_desc": [3, 4, 1], "lifecycle": [3, 1, 4],
    }


def test_reviews_by_source(spark):
    cases = spark.createDataFrame([(1, "QUEUED"), (1, "RESOLVED"), (2, "QUEUED"), (3, "QUEUED"), (9, "QUEUED")], "revision_id int, status string")
    revisions = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "revision_id int, candidate_id int")
    candidates = spark.createDataFrame([(10, 100), (11, 101)], "candidate_id int, authority_id int")
    authorities = spark.createDataFrame([(100, "a"), (101, "b"), (102, "c")], "authority_id int, code string")
    out = P.review_counts(cases, revisions, candidates, authorities, ["QUEUED", "RESOLVED"])
    assert sorted(map(tuple, out.collect())) == [("a", 2, 1), ("b", 1, 0), ("c", 0, 0)]
