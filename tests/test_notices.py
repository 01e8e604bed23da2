"""Posts of notices on small notices written by hand: every strategy, and what makes each ambiguous."""

import pytest

from attestra.operators import notices as N

HEAD = "| Name of Post | Organisation | UR | OBC/MOBC | SC | ST(P) | ST(H) | EWS | Total Posts |\n| --- | --- | --- | --- | --- | --- | --- | --- | --- |\n"
ROWS = "| Helper | City Guard | 80 | 50 | 15 | 20 | 6 | 10 | 181 |\n| Helper | Hill Battalions | 2 | 2 | 0 | 1 | 0 | 1 | 6 |\n| Helper | A & B Corps | 30 | 20 | 5 | 8 | 2 | 4 | 69 |\n"
DETAILS = "\n| Name of Post | Organisation | Minimum Qualification |\n| --- | --- | --- |\n| Helper | City Guard | Class VIII passed |\n| Helper | Hill Battalions | Class VIII passed |\n"
COLUMNS = "NOTICE\nPosts are open from 1/6/2030.\n\nSl.\nNo\nName of Posts\nMinimum educational qualification\nScale of Pay\nTotal No. of Vacant post\nReservation\n"
COLUMN_ROWS = "1 Ward Nurse\nB. Sc. Nursing of a known institution\nRs. 14,000-60,500\n+ GP 8,700\n484 nos UR-194\n2 Lamp Technician\nHSSLC with a course\nRs. 14,000-60,500\n+ GP 6,200\n125 nos UR-50\n\nTerms\n"
POSITIONS = "Interview\nSl. no.\nPosition  Essential Qualification, Experience  Pay\n1. Works\nManagement\nSpecialist\n(1 No.)\nA degree with experience.\nRs. 60,000-90,000 per month\n2. Assistant\nFinance\nSpecialist (AFS)\n(1 No)\nA degree.\n2. Assistant\nEngineer (AE)\n(1 No.)\nA degree.\n"


GRADE = "Advertisement for 181 posts of Grade V staff in City Guard,\n6 posts of Grade V staff in Hill Battalions and\n69 posts of Grade V staff under A & B Corps"
GRADES = [("Grade V Staff – City Guard", 181), ("Grade V Staff – Hill Battalions", 6), ("Grade V Staff – A & B Corps", 69)]
GROUPED = (
    "Advertisement for 127 posts of Driver Guard in City Guard,\n14 posts of Guard (Rider),\n20 posts of Guard (Messenger) &\n3 posts of Guard (Handymen) in Radio\n"
    "and 90 posts of Driver &\n4 posts of Driver Operator in Fire & Rescue\nand 7 posts of Driver Guard &\n106 posts of Driver in Forest Office.\n"
)
GROUPED_POSTS = [
    ("Driver Guard – City Guard", 127), ("Guard (Rider) – Radio", 14), ("Guard (Messenger) – Radio", 20), ("Guard (Handymen) – Radio", 3),
    ("Driver – Fire & Rescue", 90), ("Driver Operator – Fire & Rescue", 4), ("Driver Guard – Forest Office", 7), ("Driver – Forest Office", 106),
]
HELPERS = [("Helper – City Guard", 181), ("Helper – Hill Battalions", 6), ("Helper – A & B Corps", 69)]
NURSES = [("Ward Nurse", 484), ("Lamp Technician", 125)]

#: name: (text, title, strategy, status, posts, error)
CASES = {
    "table, six categories, a detail table behind a blank line": ("STATE BOARD\nNotice of 14/09/2030\n\n" + HEAD + ROWS + DETAILS, "", "TABLE", "EXPLICIT", HELPERS, None),
    "a cell is missing": (HEAD + "| Helper | City Guard | 80 | 50 | 15 | 20 | 6 | 181 |\n", "", "TABLE", "AMBIGUOUS", [], "row 1: 8 cells, expected 9"),
    "a sum is off": (HEAD + ROWS + "| Cook | Hill | 1 | 1 | 1 | 1 | 1 | 1 | 7 |\n", "", "TABLE", "AMBIGUOUS", [], "row 4: categories don't sum to the total"),
    "a key again": (HEAD + ROWS + "| HELPER | city guard | 1 | 0 | 0 | 0 | 0 | 0 | 1 |\n", "", "TABLE", "AMBIGUOUS", [], "row 4: key helper_city_guard again"),
    "no total": (HEAD + ROWS + "| Cook | Hill | 1 | 0 | 0 | 0 | 0 | 0 | one |\n", "", "TABLE", "AMBIGUOUS", [], "row 4: no post name or total"),
    "no rows": (HEAD + "\nnothing follows\n", "", "TABLE", "AMBIGUOUS", [], "no rows"),
    "two tables": (HEAD + ROWS + "\n" + HEAD + ROWS, "", "TABLE", "AMBIGUOUS", [], "TABLES"),
    "five numbers aren't summed": (HEAD + "| Cook | Hill | - | 1 | 1 | 1 | 1 | 1 | 9 |\n", "", "TABLE", "EXPLICIT", [("Cook – Hill", 9)], None),
    "one category isn't summed": ("Post | UR | Number of posts\nCook | 1 | 5\n", "", "TABLE", "EXPLICIT", [("Cook", 5)], None),
    "a line without bars ends a table": ("Post | Dept | Total\n\nas follows\nCook | Mess | 2\nnote\nDriver | Mess | 1\n", "", "TABLE", "EXPLICIT", [("Cook – Mess", 2)], None),
    "series in the text": (GRADE + ".\nOnline from 20/09/2030.", "", "NARRATIVE", "EXPLICIT", GRADES, None),
    "series in the title": ("Nothing of it here.", GRADE.replace("\n", " "), "NARRATIVE", "EXPLICIT", GRADES, None),
    "names that differ": ("10 posts of Post A in Unit A and 5 posts of Post B under Unit B", "", "NARRATIVE", "EXPLICIT", [("Post A – Unit A", 10), ("Post B – Unit B", 5)], None),
    "organisation stands last": (GROUPED, "", "NARRATIVE", "EXPLICIT", GROUPED_POSTS, None),
    "pay scale behind the organisation": ("4 posts of Driver in Fire Service in the Pay Scale of Rs 14000.", "", "NARRATIVE", "EXPLICIT", [("Driver – Fire Service", 4)], None),
    "table without bars": (COLUMNS + COLUMN_ROWS, "Notice of posts", "COLUMNS", "EXPLICIT", NURSES, None),
    "names of the listing": (COLUMNS + COLUMN_ROWS, "Advertisement-Ward Nurse(Day Care) & Lamp Technician", "COLUMNS", "EXPLICIT", [("Ward Nurse(Day Care)", 484), ("Lamp Technician", 125)], None),
    "damaged pay": (COLUMNS + COLUMN_ROWS.replace("14,000-60,500\n+ GP 6,200", "14,000-60,s00"), "", "COLUMNS", "AMBIGUOUS", [], "PAY"),
    "numbered positions": (POSITIONS, "Staff for A & B", "POSITIONS", "EXPLICIT", [("Works Management Specialist", 1), ("Assistant Finance Specialist (AFS)", 1), ("Assistant Engineer (AE)", 1)], None),
    "single post": ("Applications are invited.", "Advertisement for the post of Director, Institute, Town", "SINGLE", "EXPLICIT", [("Director, Institute, Town", None)], None),
    "single post of several": ("For the following technical posts as below.", "Advt. for the post of Staff", "SINGLE", "AMBIGUOUS", [], "the title's post is one of several"),
    "another title": ("Applications are invited.", "Recruitment to the post of Clerk", "NONE", "LEGACY_UNSPLIT", [], None),
    "nothing": ("See the annexure.", "Advertisement", "NONE", "LEGACY_UNSPLIT", [], None),
    "nulls": (None, None, "NONE", "LEGACY_UNSPLIT", [], None),
}
for told in (
    "10 posts of Guard (A). 5 posts of Guard (B) in Unit B", "10 posts of Guard (A), other work and 5 posts of Guard (B) in Unit B", "10 posts of Guard in Unit A 5 posts of Cook in Unit B",
    "10 posts of Guard in Unit A and 5 posts of Cook", "0 posts of Guard in Unit A and 5 posts of Cook in Unit B", "10 posts of Guard in Unit A and 5 posts of guard in unit a", "10 posts of Guard and Cook in Unit A",
):
    CASES[told] = (told, "", "NARRATIVE", "AMBIGUOUS", [], "the series can't be split" if "0 posts of Guard in" != told[:19] and "guard in unit" not in told else None)


@pytest.fixture(scope="module")
def parsed(spark):
    docs = spark.createDataFrame([(k, *case[:2]) for k, case in enumerate(CASES.values())], "doc_id long, text string, title string").repartition(2)
    return dict(zip(CASES, sorted(N.structure_posts(docs).collect(), key=lambda r: r["doc_id"])))


@pytest.mark.parametrize("name", CASES)
def test_notice(parsed, name):
    r, (_, _, strategy, status, posts, error) = parsed[name], CASES[name]
    assert (r["strategy"], r["status"], [(p["name"], p["total"]) for p in r["posts"]]) == (strategy, status, posts)
    assert (status == "AMBIGUOUS") == bool(r["errors"]) and (error is None or error in r["errors"])


def test_facts_and_keys(parsed):
    posts = parsed["table, six categories, a detail table behind a blank line"]["posts"]
    assert [p["post_key"] for p in posts] == ["helper_city_guard", "helper_hill_battalions", "helper_a_b_corps"]
    assert posts[0]["facts"] == {"name": "Helper", "organisation.name": "City Guard", "vacancies.ur": "80", "vacancies.obc_mobc": "50", "vacancies.sc": "15", "vacancies.st_p": "20", "vacancies.st_h": "6", "vacancies.ews": "10", "vacancies.total": "181"}
    assert len({p["post_key"] for p in parsed["organisation stands last"]["posts"]}) == 8
    assert "vacancies.total" not in parsed["single post"]["posts"][0]["facts"]
