"""Sections of a notice by rules that are rows, and fields by a grammar."""

import json

import pytest
from pyspark.sql import functions as F

from attestra.operators import section_rules as R

NOTICE = """Page 1 of 2
5. ELIGIBILITY CRITERIA:
5.1 Applicant must be a Citizen of India and Permanent Resident of Nord.
5.2 The Applicant must be registered with a local Employment Exchange in Nord.
5.3 The Applicant must speak Nordic or any other State language fluently.
5.5.C Relaxations : Upper age limit for different categories are as under:
1 SC, ST (P) and ST (H) 5 years
2 OBC/MOBC 3 years
5.8 MEDICAL STANDARDS:
Applicants must be in good health, have normal eyesight,
Page 2 of 2
and be free from colour blindness.
6. HOW TO APPLY:
1. Register on the portal.
2. Upload the documents and
submit the application.
6.1 DOCUMENTS TO BE UPLOADED:
(i) Passport size photograph.
(ii) HSLC certificate and
valid driving licence.
7. PHASES OF RECRUITMENT TESTS
(i) Standard Test
(ii) Written Test
7.9 WRITTEN TEST:
The test will consist of 100 multiple choice type questions on an OMR answer sheet.
Total marks for the Written Test will be 50. Duration: 2 hours. There is no negative marking.
Nationality is no heading here.
8. Experience of no kind is asked in this sentence
NATIONALITY: Candidate must be an Indian citizen
"""


@pytest.fixture(scope="module")
def facts(spark):
    age = lambda low, high: f"AGE\nMinimum: {low} years\nMaximum: {high} years\n"
    rows = [("notice", NOTICE), ("twice", age(18, 25) + "GENERAL CONDITIONS\n" + age(20, 25)), ("same", age(18, 25) + age(18, 25)), ("none", "No heading.\n"), ("null", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    out = {}
    for r in R.section_facts(R.headed_sections(docs), R.rule_table(spark, R.default_rules("Nord", "Nordic"))).collect():
        out.setdefault(r["doc_id"], {})[r["path"]] = r["value"]
    return out


def test_claims_texts_lists_pairs_and_objects(facts):
    f = facts["notice"]
    assert f["domicile.requirement"] == "Applicant must be a Citizen of India and Permanent Resident of Nord"
    assert f["registration.employment_exchange"].endswith("in Nord") and f["language.requirement"].startswith("Applicant must speak Nordic")
    assert json.loads(f["age.relaxations"]) == [{"category": "SC / ST(P) / ST(H)", "relaxation": "5 years"}, {"category": "OBC / MOBC", "relaxation": "3 years"}]
    assert f["medical.criteria"] == "Applicants must be in good health, have normal eyesight, and be free from colour blindness."
    assert json.loads(f["application.steps"]) == ["Register on the portal", "Upload the documents and submit the application"]
    assert json.loads(f["application.documents_required"]) == ["Passport size photograph", "HSLC certificate and valid driving licence"]
    assert json.loads(f["selection.phases"]) == ["Standard Test", "Written Test"]
    assert json.loads(f["selection.exam_pattern"]) == [{"questions": 100, "marks": 50, "duration": "2 hours", "mode": "OMR answer sheet"}]
    assert "experience.requirement" not in f


def test_one_of_two_values_is_not_chosen(facts):
    # the claim of the eligibility section and the section of its own differ
    assert "nationality.requirement" not in facts["notice"]
    assert facts["twice"] == {"age.maximum": "25"} and facts["same"] == {"age.minimum": "18", "age.maximum": "25"}
    assert "none" not in facts and "null" not in facts


def test_a_new_rule_is_a_row(spark):
    docs = spark.createDataFrame([(1, "REMUNERATION\nRs 500 a day and a hat")], "doc_id long, text string")
    rules = R.rule_table(spark, [("pay", 0, R.MATCH, "pay.extra", None, r"and (a \w+)", "STRING"), ("age", 1, R.TEXT, "age.text", None, None, "STRING")])
    assert [(r["path"], r["value"], r["locator"]) for r in R.section_facts(R.headed_sections(docs), rules).collect()] == [("pay.extra", "a hat", "section=pay;occurrence=1")]


def test_fields_by_a_grammar_of_each_row(spark):
    rows = [(1, "No. 12 of 2030, no. 7", '{"number": "(?i)no\\\\. (\\\\d+)", "year": "20\\\\d\\\\d"}'), (2, "key=a; key=b", '{"k": "key=(?P<value>\\\\w)"}'), (3, None, "{}"), (4, "x", None), (5, "nothing", '{"k": "z"}')]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grammar string")
    out = sorted(tuple(r) for r in R.grammar_fields(docs, F.col("grammar")).collect())
    assert out == [(1, "number", "12", 4, 6), (1, "number", "7", 20, 21), (1, "year", "2030", 10, 14), (2, "k", "a", 4, 5), (2, "k", "b", 11, 12)]
