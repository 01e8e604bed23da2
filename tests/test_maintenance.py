"""Successor revisions of edits and additions on a few subjects written by hand."""

import pytest

from attestra.operators import maintenance as M

ALLOWED = [("title", "STRING"), ("vacancies.total", "INTEGER"), ("application.url", "STRING"), ("name", "STRING")]


@pytest.fixture(scope="module")
def tables(spark):
    subjects = "good blank stale comment path type negative url twice same closed".split()
    current = [(s, f"r-{s}", 3, f"c-{s}", "PUBLISHED" if s == "closed" else "QUEUED") for s in subjects]
    facts = [(f"r-{s}", "title", "STRING", "Clerk") for s in subjects] + [(f"r-{s}", "vacancies.total", "STRING" if s == "type" else "INTEGER", "5") for s in subjects] + [("r-good", "posts.a.name", "STRING", "A")]
    links = [(f"r-{s}", p, f"e{k}") for s in subjects for p in ("title", "vacancies.total") for k in (1, 2)]
    edits = [
        ("good", "r-good", "title", " Cook ", "why"), ("good", "r-good", "vacancies.total", "05", "why"), ("good", "r-good", "posts.a.name", "B", "why"), ("good", "r-good", "application.url", "https://a.example/x", "why"),
        ("blank", "r-blank", "title", "  ", "why"), ("stale", "r-old", "title", "Cook", "why"), ("comment", "r-comment", "title", "Cook", " "), ("path", "r-path", "secret", "x", "why"), ("path", "r-path", "title", "Cook", "why"),
        ("type", "r-type", "vacancies.total", "6", "why"), ("negative", "r-negative", "vacancies.total", "-1", "why"), ("url", "r-url", "application.url", "ftp://x", "why"), ("twice", "r-twice", "title", "A", "why"), ("twice", "r-twice", "title", "B", "why"),
        ("same", "r-same", "title", "Clerk", "why"), ("nobody", "r-x", "title", "A", "why"), ("closed", "r-closed", "title", "Cook", "why"),
    ]
    make = spark.createDataFrame
    return (
        make(current, "subject string, revision_id string, revision_number int, case_id string, case_status string"), make(facts, "revision_id string, path string, kind string, value string"),
        make(links, "revision_id string, path string, evidence_id string"), make(edits, "subject string, expected_revision_id string, path string, value string, comment string"), make(ALLOWED, "path string, kind string"),
    )


def test_edits_make_one_successor_or_none(tables):
    made = M.successors(*tables)
    results = {r["subject"]: (r["result"], r["changed"]) for r in made["results"].collect()}
    assert results == {
        "good": ("REPUBLISHED", 3), "blank": ("NO_CHANGE", 0), "stale": ("STALE", 0), "comment": ("NO_COMMENT", 0), "path": ("UNSUPPORTED", 0), "type": ("WRONG_TYPE", 0), "negative": ("INVALID", 0),
        "url": ("INVALID", 0), "twice": ("PATH_TWICE", 0), "same": ("NO_CHANGE", 0), "nobody": ("UNKNOWN_SUBJECT", 0), "closed": ("REPUBLISHED", 1),
    }
    revision = {r["subject"]: r for r in made["revisions"].collect()}
    assert set(revision) == {"good", "closed"} and revision["good"]["revision_number"] == 4 and revision["good"]["follows"] == "r-good"
    mine = revision["good"]["revision_id"]
    facts = {r["path"]: (r["value"], r["change"]) for r in made["facts"].where(f"revision_id = '{mine}'").collect()}
    assert facts == {"title": ("Cook", "EDITED"), "vacancies.total": ("5", "KEPT"), "posts.a.name": ("B", "EDITED"), "application.url": ("https://a.example/x", "ADDED")}
    assert {(r["path"], r["evidence_id"]) for r in made["links"].where(f"revision_id = '{mine}'").collect()} == {("vacancies.total", "e1"), ("vacancies.total", "e2")}
    assert {r["path"] for r in made["items"].where(f"revision_id = '{mine}'").collect()} == {"title", "posts.a.name", "application.url"}
    assert {r["case_id"] for r in made["cancelled"].collect()} == {"c-good", "c-closed"}


def test_additions_take_missing_paths_of_active_cases(tables):
    made = M.successors(*tables, add_only=True)
    results = {r["subject"]: r["result"] for r in made["results"].collect()}
    assert results["good"] == "UNSUPPORTED" and results["closed"] == "NO_ACTIVE_CASE" and results["url"] == "INVALID" and results["comment"] == "UNSUPPORTED"
    current, facts, links, edits, allowed = tables
    one = edits.where("subject = 'good' and path = 'application.url'")
    made = M.successors(current, facts, links, one, allowed, add_only=True)
    assert [(r["result"], r["changed"]) for r in made["results"].collect()] == [("ENRICHED", 1)] and made["links"].count() == 4
    assert [tuple(r)[2:] for r in made["items"].collect()] == [("application.url", "MANUAL_ADDITION")] and made["cancelled"].first()["case_id"] == "c-good"


def test_a_batch_run_again_adds_nothing(tables):
    made = M.successors(*tables)
    first = M.applied({k: d.where("1 = 0") for k, d in made.items()}, made)
    assert first["facts"].count() == made["facts"].count() > 0
    again = M.applied(first, M.successors(*tables))
    assert all(d.count() == 0 for d in again.values())
