"""Snapshots and coverage of verifications and reviews: each violation by one damaged row."""

import pytest

from attestra.operators import integrity as I
from attestra.operators import monitoring as M

RUN = "run_id int, revision_id int, confidence_revision_id int, status string, hash_snapshot string, fields_total long"
FIELD = "revision_id int, field_id int, path string, type string, value string"
MADE = "run_id int, field_id int, status string, path string, type string, value string"


def verified(spark, *, run=(1, 7, 7, "COMPLETED", "h", 2), revision=(7, "h", "h"), made=None, scored=((1, 1), (1, 2))):
    fields = [(7, 1, "a", "STRING", None), (7, 2, "b", "INTEGER", "5")]
    made = [(1, 1, "FINALIZED", "a", "STRING", None), (1, 2, "FINALIZED", "b", "INTEGER", "5")] if made is None else made
    out = I.verification_violations(
        spark.createDataFrame([run], RUN), spark.createDataFrame([revision], "revision_id int, revision_hash string, expected_hash string"), spark.createDataFrame(fields, FIELD),
        spark.createDataFrame(made, MADE), spark.createDataFrame(list(scored), "run_id int, field_id int"),
    )
    return sorted(r["violation"] for r in out.collect())


GOOD = [(1, 1, "FINALIZED", "a", "STRING", None), (1, 2, "FINALIZED", "b", "INTEGER", "5")]


@pytest.mark.parametrize(
    "given, want",
    [
        ({}, []),
        ({"run": (1, 7, 7, "RUNNING", "h", 2)}, ["RUN_STATUS"]),
        ({"run": (1, 7, 8, "COMPLETED", "h", 2)}, ["REVISION_MISMATCH"]),
        ({"run": (1, 7, 7, "COMPLETED", None, 2)}, ["RUN_HASH"]),
        ({"run": (1, 7, 7, "COMPLETED", "h", 3)}, ["COVERAGE"]),
        ({"revision": (7, "h", "i")}, ["REVISION_HASH"]),
        ({"revision": (6, "h", "h")}, ["REVISION_MISSING"]),
        ({"made": GOOD[:1]}, ["COVERAGE"]),
        ({"made": []}, ["COVERAGE"]),
        ({"made": [*GOOD, GOOD[0]]}, ["COVERAGE"]),
        ({"made": [*GOOD, (1, 3, "FINALIZED", "c", "STRING", "x")]}, ["COVERAGE"]),
        ({"made": [GOOD[0], (1, 2, None, "b", "INTEGER", "5")]}, ["COVERAGE"]),
        ({"made": [GOOD[0], (1, 2, "FINALIZED", "b", "INTEGER", None)]}, ["SNAPSHOT"]),
        ({"made": [(1, 1, "FINALIZED", "a", "JSON", None), GOOD[1]]}, ["SNAPSHOT"]),
        ({"scored": [(1, 1)]}, ["COVERAGE"]),
    ],
)
def test_verifications(spark, given, want):
    assert verified(spark, **given) == want


CASE = "case_id int, confidence_id int, status string, outcome string, revision_id int, run_id int, policy string, priority string, score int, reasons array<string>"
ITEM = "case_id int, scope string, field_confidence_id int, field_id int, policy string, priority string, score int, reasons array<string>, path string, type string, value string, decision string, original_type string, original_value string"
OWN = ITEM.replace("case_id int, scope string, ", "").replace(", decision string, original_type string, original_value string", "")
PART = (1, "V2", "HIGH", 40, ["LOW"], "a", "STRING", None)
ITEM_1 = (1, "FIELD", 11, *PART, "APPROVE", "STRING", None)
WHOLE = (1, "REVISION", None, None, "V2", "HIGH", 40, ["LOW"], None, None, None, "APPROVE", None, None)


@pytest.mark.parametrize(
    "case, items, want",
    [
        ({}, [ITEM_1, WHOLE], []),
        ({"score": 41}, [ITEM_1, WHOLE], ["CASE_SNAPSHOT"]),
        ({"reasons": None}, [ITEM_1], ["CASE_SNAPSHOT"]),
        ({"confidence": 9}, [ITEM_1], ["CASE_SNAPSHOT"]),
        ({"outcome": "REJECTED"}, [ITEM_1], ["OUTCOME"]),
        ({"outcome": "REJECTED"}, [ITEM_1, (*ITEM_1[:11], "REJECT", "STRING", None), (*ITEM_1[:11], "CORRECT_AND_APPROVE", "STRING", None)], []),
        ({"outcome": "REJECTED"}, [(*ITEM_1[:11], "REQUEST_REVERIFICATION", "STRING", None), (*ITEM_1[:11], "REJECT", "STRING", None)], ["OUTCOME"]),
        ({}, [(*ITEM_1[:11], None, None, None), ITEM_1], ["UNDECIDED"]),
        ({"status": "QUEUED", "outcome": None}, [(*ITEM_1[:11], None, None, None)], []),
        ({}, [(*ITEM_1[:2], 12, *ITEM_1[3:])], ["ITEM_CONFIDENCE"]),
        ({}, [(*ITEM_1[:6], 39, *ITEM_1[7:])], ["ITEM_SNAPSHOT"]),
        ({}, [ITEM_1, (*WHOLE[:4], "V1", *WHOLE[5:])], ["ITEM_SNAPSHOT"]),
        ({}, [(*ITEM_1[:11], "APPROVE", "STRING", "x")], ["DECISION_SNAPSHOT"]),
        ({"status": "RESOLVED"}, [], []),
    ],
)
def test_reviews(spark, case, items, want):
    told = {"confidence": 5, "status": "RESOLVED", "outcome": "APPROVED", "score": 40, "reasons": ["LOW"]} | case
    cases = spark.createDataFrame([(1, told["confidence"], told["status"], told["outcome"], 7, 3, "V2", "HIGH", told["score"], told["reasons"])], CASE)
    confidences = spark.createDataFrame([(5, 7, 3, "V2", "HIGH", 40, ["LOW"])], CASE.replace("case_id int, ", "").replace("status string, outcome string, ", ""))
    out = I.review_violations(cases, confidences, spark.createDataFrame(items, ITEM), spark.createDataFrame([(11, *PART)], OWN))
    assert sorted(r["violation"] for r in out.collect()) == want


@pytest.mark.parametrize(
    "status, fields, posts, facts, want",
    [
        ("LEGACY_UNSPLIT", ["a"], [], [], []),
        ("EXPLICIT", [], [("p", 1), ("q", 2)], [("p", "total"), ("q", "total")], []),
        ("LEGACY_UNSPLIT", [], [], [], ["EMPTY"]),
        ("EXPLICIT", [], [], [], ["EMPTY", "NO_POSTS"]),
        ("EXPLICIT", ["a"], [], [], ["NO_POSTS"]),
        (None, ["a"], [("p", 1)], [], ["NOT_EXPLICIT"]),
        ("EXPLICIT", [], [("p", 1), ("p", 2)], [], ["POST_KEY"]),
        ("EXPLICIT", [], [("p", 1), ("q", 1)], [], ["ORDINAL"]),
        ("EXPLICIT", ["a", "a"], [("p", 1)], [], ["PATH"]),
        ("EXPLICIT", ["posts.p.total"], [("p", 1)], [("p", "total")], ["PATH"]),
        ("EXPLICIT", ["total"], [("p", 1)], [("p", "total"), ("p", "total")], ["PATH"]),
    ],
)
def test_revisions(spark, status, fields, posts, facts, want):
    out = I.revision_violations(
        spark.createDataFrame([(1, status)], "revision_id int, split_status string"), spark.createDataFrame([(1, p) for p in fields], "revision_id int, path string"),
        spark.createDataFrame([(1, *p) for p in posts], "revision_id int, post_key string, ordinal int"), spark.createDataFrame([(1, *p) for p in facts], "revision_id int, post_key string, path string"),
    )
    assert sorted(r["violation"] for r in out.collect()) == want


def test_batches(spark):
    checked = spark.createDataFrame([(1, 3, 1, 0, 2, True, False), (1, 4, 0, 1, 0, False, False), (1, 9, 9, 9, 9, True, True), (2, 1, 1, 1, 1, True, True)], "batch_id int, fields_confirmed int, fields_conflicted int, fields_insufficient int, fields_not_applicable int, review_required boolean, failed boolean")
    assert sorted(map(tuple, M.verification_summary(checked).collect())) == [(1, 2, 1, 7, 1, 1, 2, 1, 1), (2, 0, 1, 0, 0, 0, 0, 0, 0)]
    kinds = [("DIRECT", False, False, False), ("HUMAN_APPROVED", False, True, False), ("HUMAN_CORRECTED", False, True, True), ("DIRECT", True, False, False), ("REJECTED", False, True, False), ("REVIEW_PENDING", True, False, False)]
    told = M.publication_summary(spark.createDataFrame([(1, *k) for k in kinds], "batch_id int, kind string, failed boolean, master_exists boolean, revision_exists boolean")).first().asDict()
    want = {"selected": 6, "skipped": 2, "rejected": 1, "review_pending": 1, "direct_verified": 2, "human_approved": 1, "human_corrected": 1, "failed": 1, "master_unchanged": 1, "master_updated": 1, "master_created": 1}
    assert {k: told[k] for k in want} == want and told["review_missing"] == 0
