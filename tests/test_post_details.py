"""Detail tables, aligned columns, scoped clauses and rosters of notices written by hand."""

import pytest

from attestra.operators import notices as N
from attestra.operators import post_details as D

DRIVERS = """Page 1 of 4
BOARD
Advertisement for 127 posts of Driver Guard in City Guard and
4 posts of Driver Operator in Fire & Emergency Services in the Pay Scale of Rs. 14000 -70000/-.
3.1 There is no fee.
4. DETAILS OF VACANCIES:
Driver Guard in City Guard with Grade Pay of Rs. 5600/-
Category Number of Posts
Unreserved 65
OBC/MOBC 30
Tea Tribes & Adivasi
Communities 4
SC 9
ST (P) 13
ST (H) 6
Women 10
Ex-Servicemen 2
Total 127
Driver Operator in F & ES with Grade Pay of Rs. 5200/-
Category Number of Posts Total
Male Female
Unreserved 1 0 1
OBC/MOBC 2 0 2
SC 1 0 1
Total 4 0 4
5.5.A For the post of Driver Guard in City Guard : The age of the Applicant must be 18-25 as on
01-01-2030.
5.5.B For the post of Driver Operator in F & ES: The age of the Applicant must be 20-30 years as on
01 -01-2030.
5.5.C Relaxations : Upper age limit as under:
Page 2 of 4
5.6.B For the post of Driver Guard in City Guard, Applicant must possess valid driving license for LMV or MMV.
5.6.C For the post of Driver Operator in F & ES, Applicant must possess valid driving license for HMV.
Name of Post                  Essential Qualification                  Desirable Qualification                  Age
Driver Guard                  HSLC passed from recognised              Heavy vehicle driving                    18 to 25 years
                              Board or Council
Driver Operator               HSSLC passed                             Fire appliance driving                   20 to 30 years
                              from a Board

5.7 STANDARDS
"""
TABLE = "| Post | Organisation | Total |\n| --- | --- | --- |\n| Helper | North | 3 |\n| Helper | South | 2 |\n\n"
OWNED = TABLE + "| Name of Post | Organisation | Minimum Qualification | Maximum Age | Age Cutoff Date | Pay Scale |\n|-|-|-|-|-|-|\n| Helper | North | Class VIII | 40 years | 01/02/2030 | - |\n| helper | SOUTH | Class X | forty | 31/02/2030 | Rs 5 |\n"
UNOWNED = TABLE + "| Name of Post | Minimum Qualification |\n| --- | --- |\n| Helper | Class VIII |\n"
DAMAGED = TABLE + "| Post | Organisation | Domicile |\n| --- | --- | --- |\n| Helper | North |\n| Helper | South | here |\n"
TWICE = TABLE + "".join(f"| Post | Organisation | Grade Pay |\n| Helper | North | {pay} |\n\n" for pay in ("10", "20", "10"))
SHORT_ROSTER = DRIVERS.replace("SC 9\n", "SC 8\n").replace("must be 18-25 as", "must be of age as").replace("01 -01-2030", "31-02-2030")
GROUPED = (
    "20 posts of Guard in City Guard, 14 posts of Driver &\n4 posts of Driver Operator in Fire & Emergency Services.\n"
    "1.1 For the posts of Guard in City Guard and Driver in Fire & Emergency Services: The age must be 18 - 30 as on 1.2.2030\nfor all\n"
    "2. For the post of Driver in Fire & Emergency Services, Applicant must possess a driving licence of two years.\n2.1 End\n"
    "3.1 For the post of Cook in Mess: The age must be 18-20 as on 1.1.2030\n"
)
NOTICES = {"drivers": DRIVERS, "owned": OWNED, "unowned": UNOWNED, "damaged": DAMAGED, "twice": TWICE, "short": SHORT_ROSTER, "grouped": GROUPED, "none": "nothing", "null": None}


@pytest.fixture(scope="module")
def told(spark):
    docs = spark.createDataFrame([(name, text, "Notice") for name, text in NOTICES.items()], "doc_id string, text string, title string")
    notices = docs.join(N.structure_posts(docs).select("doc_id", "posts"), "doc_id")
    out = {name: ({}, []) for name in NOTICES}
    for r in sorted(D.attached(D.claims(notices)).collect(), key=lambda r: (r["source"], r["at"], r["row"], r["path"] or "")):
        if r["problem"] is None:
            out[r["doc_id"]][0].setdefault(r["ordinal"], {})[r["path"]] = r["value"]
        else:
            out[r["doc_id"]][1].append((r["locator"], r["path"], r["problem"]))
    return out


def test_rosters_clauses_and_columns_of_each_post(told):
    facts, problems = told["drivers"]
    assert problems == []
    want = {"vacancies.total": "127", "vacancies.ur": "65", "vacancies.tea_tribes_adivasi": "4", "vacancies.women": "10", "vacancies.ex_servicemen": "2", "pay.grade_pay": "Rs. 5600/-"}
    want |= {"age.minimum": "18", "age.maximum": "25", "age.reference_date": "2030-01-01", "qualification.essential": "HSLC passed from recognised Board or Council"}
    want |= {"qualification.desirable": "Heavy vehicle driving", "qualification.registration_or_licence": "valid driving license for LMV or MMV"}
    assert want.items() <= facts[1].items()
    second = {"vacancies.total": "4", "vacancies.obc_mobc": "2", "age.minimum": "20", "age.maximum": "30", "qualification.essential": "HSSLC passed from a Board", "qualification.registration_or_licence": "valid driving license for HMV"}
    assert second.items() <= facts[2].items() and "vacancies.women" not in facts[2] and set(facts) == {1, 2}


def test_detail_table_by_name_and_organisation(told):
    facts, problems = told["owned"]
    assert {"qualification.minimum": "Class VIII", "age.maximum": "40", "age.reference_date": "2030-02-01"}.items() <= facts[1].items() and "pay.scale" not in facts[1]
    assert {"qualification.minimum": "Class X", "pay.scale": "Rs 5"}.items() <= facts[2].items() and "age.maximum" not in facts[2]
    assert problems == [("table=post-details-6;row=2", "age.maximum", "not an exact integer"), ("table=post-details-6;row=2", "age.reference_date", "not an exact date")]


def test_a_row_without_one_owner_is_reported(told):
    facts, problems = told["unowned"]
    assert problems == [("table=post-details-6;row=1", None, "matches 2 posts")] and not any("qualification.minimum" in f for f in facts.values())
    facts, problems = told["damaged"]
    assert problems == [("table=post-details-6;row=1", None, "damaged columns")] and not any("domicile.requirement" in f for f in facts.values())


def test_the_first_value_stays_and_another_is_reported(told):
    facts, problems = told["twice"]
    assert facts[1]["pay.grade_pay"] == "10" and [p[1:] for p in problems] == [("pay.grade_pay", "conflicts with another value")]


def test_a_roster_that_does_not_fit_gives_nothing(told):
    facts, problems = told["short"]
    assert "vacancies.ur" not in facts[1] and "pay.grade_pay" not in facts[1] and facts[2]["vacancies.ur"] == "1"
    assert ("roster;occurrence=1", None, "doesn't sum to the post's total") in problems
    assert ("scope=age;occurrence=1", None, "owner or form is uncertain") in problems and ("scope=age;occurrence=2", None, "the date is invalid") in problems
    assert facts[1]["age.minimum"] == "18" and facts[2]["age.maximum"] == "30"  # from the columns


def test_owners_by_segment_of_organisation(told):
    facts, problems = told["grouped"]
    assert [facts[k].get("age.minimum") for k in (1, 2, 3)] == ["18", "18", None]
    assert [facts[k].get("qualification.registration_or_licence") for k in (1, 2, 3)] == [None, "a driving licence of two years", None]
    assert problems == [("scope=age;occurrence=3", None, "owner or form is uncertain")]


def test_no_posts_no_claims(told):
    assert told["none"] == told["null"] == ({}, [])
