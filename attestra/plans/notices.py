"""Queries over notices: orders are written out as notices of every form, their lines as the posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import notices as N
from attestra.operators import post_details as D
from attestra.operators import section_rules as S
from attestra.operators.postings import let

from . import bindings as B

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


def orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, status, priority, customer, r: an order and its lines in order (i: number, s: supplier, q: quantity)."""
    li, o = B.t(spark, sf_dir, "lineitem"), B.t(spark, sf_dir, "orders")
    r = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("i"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("int").alias("q"))))
    lines = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(r.alias("r"))
    of = o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).alias("priority"), F.col("o_custkey").alias("customer"))
    return lines.join(of, "doc_id").repartition(spark.sparkContext.defaultParallelism, "doc_id")  # notices take more time than room: AQE would leave them to one task


#: An order as in orders_with_lines: n lines, k suppliers, the sum of quantities, the suppliers in order.
ORDERS_SQL = """g AS (SELECT l_orderkey AS doc_id, o_orderstatus AS st, left(o_orderpriority, 1) AS p, o_custkey AS c, CAST(count(*) AS INTEGER) AS n, count(DISTINCT l_suppkey) AS k,
    CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS total, list(l_suppkey ORDER BY l_linenumber, l_suppkey, CAST(l_quantity AS INTEGER)) AS s,
    list(CAST(l_quantity AS INTEGER) ORDER BY l_linenumber, l_suppkey, CAST(l_quantity AS INTEGER)) AS q
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)"""

TABLE_HEAD = "Board\\n\\n| Name of Post | Organisation | UR | OBC/MOBC | SC | ST(P) | ST(H) | EWS | Total Posts |\\n| --- | --- | --- | --- | --- | --- | --- | --- | --- |\\n"
DETAIL_HEAD = "\\n\\n| Name of Post | Organisation | Minimum Qualification | Minimum Age | Pay Scale |\\n| --- | --- | --- | --- | --- |\\n"
COLUMN_HEAD = "Notice\\nSl. Name of the Posts\\nMinimum Educational Qualification and\\nScale of Pay with total no. of vacant posts\\n"
POSITION_HEAD = "Position\\nEssential\\nQualification\\n"


def _text(head: str, row: str, joiner: str = "\\n", tail: str = "") -> F.Column:
    """A heading and one row for each line x, whose place is k."""
    return F.expr(f"concat('{head}', array_join(transform(r, (x, k) -> {row}), '{joiner}'), '{tail}')")


def vacancy_rows(extra: str = "0") -> F.Column:
    """A table with a row for each line: the trade is the same, the unit is the supplier, and of the quantity a sixth is in each category but UR, which has the rest."""
    sixth = "cast(x.q div 6 as string)"
    return _text(TABLE_HEAD, f"concat('| Clerk | Unit ', x.s, ' | ', x.q - 5 * (x.q div 6), ' | ', concat_ws(' | ', array_repeat({sixth}, 5)), ' | ', x.q + {extra}, ' |')")


def written_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, text: an order as a notice whose form is its priority; pending orders' notices are damaged in a way of their own form."""
    docs, pending = orders_with_lines(spark, sf_dir), F.col("status") == "P"
    table = F.concat(F.when(pending, vacancy_rows("1")).otherwise(vacancy_rows()), _text(DETAIL_HEAD, "concat('| Clerk | Unit ', x.s, ' | HSLC | 18 years | Rs ', x.q, ' |')"))
    own = _text("Advertisement for ", "concat(x.q, ' posts of Clerk in Unit ', x.s)", " and\\n", ".\\nApply soon.")
    shared = _text("Advertisement for ", "concat(x.q, ' posts of Clerk ', k + 1)", ",\\n")
    series = F.when(F.col("status") == "F", own).when(pending, shared).otherwise(F.concat(shared, F.expr("concat(' in Unit ', element_at(r, -1).s, '.')")))
    pay = "if(status = 'P', 'as per rules', '14,000 - 60,500')"
    columns = _text(COLUMN_HEAD, f"concat(k + 1, if(k % 2 = 0, '. Clerk', ' Clerk'), if(x.s % 3 = 0, concat('\\nof unit ', x.s, '\\nHSLC passed'), concat(' of unit ', x.s, ' HSLC passed')), '\\n', {pay}, '\\nGrade pay\\n', x.q, ' Nos. in all')")
    positions = _text(POSITION_HEAD, "concat(k + 1, ') Clerk', if(k % 2 = 0, '\\nof unit ', ' of unit '), x.s, if(status = 'P', '\\nThree posts.', concat('\\n(', x.q, ' Nos.)')), '\\nAs the rules say.')")
    text = (
        F.when(F.col("priority") == "1", table).when(F.col("priority") == "2", series).when(F.col("priority") == "3", columns)
        .when(F.col("priority") == "4", positions).when(pending, "For the following posts of the board.").otherwise("Applications are invited.")
    )
    title = F.when(F.col("priority") == "5", F.concat(F.lit("Advertisement for the post of Clerk "), F.col("customer").cast("string"))).otherwise("Notice")
    return docs.select("doc_id", title.alias("title"), text.alias("text"))


@query("WITH " + ORDERS_SQL + """,
x AS (SELECT *, CASE p WHEN '1' THEN 'TABLE' WHEN '2' THEN 'NARRATIVE' WHEN '3' THEN 'COLUMNS' WHEN '4' THEN 'POSITIONS' ELSE 'SINGLE' END AS strategy,
  st <> 'P' AND (p = '5' OR (p = '2' AND st = 'O') OR k = n) AS fine FROM g)
SELECT doc_id, strategy, CASE WHEN fine THEN 'EXPLICIT' ELSE 'AMBIGUOUS' END AS status, CAST(CASE WHEN NOT fine THEN 0 WHEN p = '5' THEN 1 ELSE n END AS INTEGER) AS posts,
  CASE WHEN fine AND p <> '5' THEN total END AS total,
  CASE WHEN fine THEN CASE WHEN p = '1' OR (p = '2' AND st = 'F') THEN 'Clerk – Unit ' || s[1] WHEN p = '2' THEN 'Clerk 1 – Unit ' || s[-1] WHEN p = '5' THEN 'Clerk ' || c ELSE 'Clerk of unit ' || s[1] END END AS first_post FROM x""")
def structured_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-1 to EXT-6, AGG-15, WIN-7, WIN-11: posts of notices in all five forms, with posts repeated over units, a second table behind a blank line, shared organisations and damaged rows."""
    out = N.structure_posts(written_notices(spark, sf_dir))
    total = F.aggregate("posts", F.lit(0).cast("long"), lambda a, p: a + p["total"])
    return out.select("doc_id", "strategy", "status", F.size("posts").alias("posts"), F.when(F.size("posts") > 0, total).alias("total"), F.get("posts", F.lit(0))["name"].alias("first_post"))


def detailed_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, text: an order as a table of posts, followed by a detail table (fulfilled), aligned columns (open), or clauses and rosters (pending)."""
    docs = orders_with_lines(spark, sf_dir)
    pipes = _text(DETAIL_HEAD, "concat('| clerk | UNIT ', x.s, ' | HSLC | ', if(x.q > 25, 'young', '18 years'), ' | Rs ', x.q, ' |')")
    columns = _text("\\n\\nName of Post        Organisation        Minimum Qualification    Age\\n", "concat(rpad('Clerk', 20, ' '), rpad(concat('Unit ', x.s), 20, ' '), rpad('HSLC', 25, ' '), '18 to ', 18 + x.q, ' years\\n', repeat(' ', 40), 'passed')")
    clauses = _text("\\n\\nPage 2 of 3\\n", "concat('5.', k + 1, ' For the post of Clerk in Unit ', x.s, ': The age\\nof all must be 18-', 18 + x.q, ' as on\\n01-01-2030.')", tail="\\n6.1 Rosters\\n")
    sixth = "x.q div 6"
    roster = _text("", f"concat('Clerk in Unit ', x.s, ' with Grade Pay of Rs. ', x.q, '/-\\nUnreserved ', x.q - 5 * ({sixth}), '\\nOBC/MOBC ', {sixth}, '\\nSC ', {sixth}, '\\nST (P) ', {sixth}, '\\nST (H) ', {sixth}, '\\nEWS ', {sixth}, '\\nTotal ', x.q)")
    more = F.when(F.col("status") == "F", pipes).when(F.col("status") == "O", columns).otherwise(F.concat(clauses, roster))
    return docs.select("doc_id", F.lit("Notice").alias("title"), F.concat(vacancy_rows(), more).alias("text"))


@query("WITH " + ORDERS_SQL + """
SELECT doc_id, 9 * n + CASE st WHEN 'F' THEN 2 * n + len(list_filter(q, lambda x: x <= 25)) WHEN 'O' THEN 3 * n ELSE 4 * n END AS facts,
  CAST(CASE st WHEN 'F' THEN 18 * len(list_filter(q, lambda x: x <= 25)) ELSE 36 * n + total END AS BIGINT) AS ages,
  CASE WHEN st = 'F' THEN len(list_filter(q, lambda x: x > 25)) ELSE 0 END AS problems FROM g WHERE k = n""")
def post_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-9, EXT-10, WIN-7, WIN-12, JOIN-10, JOIN-11, AGG-16: facts of posts from detail tables, aligned columns, scoped clauses and rosters; an order of a repeated supplier has no posts."""
    parsed = detailed_notices(spark, sf_dir).select("doc_id", "text", let(N.source_lines("text"), N.vacancy_table)["posts"].alias("posts"))
    told = D.attached(D.claims(parsed))
    age = F.when(F.col("path").isin("age.minimum", "age.maximum") & F.col("problem").isNull(), F.col("value").cast("long"))
    return told.groupBy("doc_id").agg(F.count_if(F.col("problem").isNull()).alias("facts"), F.coalesce(F.sum(age), F.lit(0)).alias("ages"), F.count("problem").alias("problems"))


def sectioned_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: an order as a notice of headed sections; pending orders state another maximum age in a second section."""
    docs = orders_with_lines(spark, sf_dir)
    head = F.expr("concat('Page 1 of 2\\n1. ELIGIBILITY CRITERIA:\\n1.1 Applicant must be a Citizen of India and Permanent Resident of Nord.\\n2.1 AGE LIMIT:\\nMinimum age: 18 years\\nMaximum: ', 20 + size(r), ' years\\n')")
    second = F.when(F.col("status") == "P", "2.2 AGE\nMaximum: 99 years\n").otherwise("")
    relaxed = F.expr("concat('2.3 AGE RELAXATION:\\nOBC/MOBC ', size(r), ' years\\n')")
    listed = _text("3 DOCUMENTS REQUIRED\\n", "concat('(i) Bill of unit ', x.s, ' with\\nits copy.')")
    exam = F.expr("concat('\\n4.1 WRITTEN TEST: There will be ', aggregate(r, 0, (a, x) -> a + x.q), ' questions.\\nPage 2 of 2\\nTotal marks will be 50.\\nAge is no heading here.')")
    return docs.select("doc_id", F.concat(head, second, relaxed, listed, exam).alias("text"))


@query("WITH " + ORDERS_SQL + """
SELECT doc_id, 'nationality.requirement' AS path, 'Applicant must be a Citizen of India' AS value FROM g
UNION ALL SELECT doc_id, 'domicile.requirement', 'Applicant must be a Citizen of India and Permanent Resident of Nord' FROM g
UNION ALL SELECT doc_id, 'age.minimum', '18' FROM g UNION ALL SELECT doc_id, 'age.maximum', CAST(20 + n AS VARCHAR) FROM g WHERE st <> 'P'
UNION ALL SELECT doc_id, 'age.relaxations', '[{"category":"OBC / MOBC","relaxation":"' || n || ' years"}]' FROM g
UNION ALL SELECT doc_id, 'application.documents_required', '[' || array_to_string(list_transform(list_filter(s, lambda x, i: list_position(s, x) = i), lambda x: '"Bill of unit ' || x || ' with its copy"'), ',') || ']' FROM g
UNION ALL SELECT doc_id, 'selection.exam_pattern', '[{"questions":' || total || ',"marks":50}]' FROM g""")
def section_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT-8, WIN-6, SET-7, SRC-4, AGG-19: facts of headed sections by rules that are rows; of two maximum ages none is chosen."""
    rules = S.rule_table(spark, S.default_rules("Nord", "Nordic"))
    return S.section_facts(S.headed_sections(sectioned_notices(spark, sf_dir)), rules).select("doc_id", "path", "value")


@query("""WITH m AS (SELECT doc_id, 'mail' AS path, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]{2,}')) AS value FROM documents
UNION ALL SELECT doc_id, 'number', unnest(regexp_extract_all(text, '[0-9]{5,}')) FROM documents
UNION ALL SELECT doc_id, 'code', unnest(regexp_extract_all(text, '([A-Z]{4}[0-9A-Z]*)[ .,]', 1)) FROM documents WHERE lang = 'en')
SELECT doc_id, path, value, count(*) AS n FROM m GROUP BY ALL""")
def grammar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function of user grammars: two patterns for all documents, a third for those in English."""
    mail, number, code = '"mail": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]{2,}"', '"number": "[0-9]{5,}"', '"code": "([A-Z]{4}[0-9A-Z]*)[ .,]"'
    grammar = F.when(F.col("lang") == "en", f"{{{mail}, {number}, {code}}}").otherwise(f"{{{mail}, {number}}}")
    found = S.grammar_fields(B.t(spark, sf_dir, "documents"), grammar)
    return found.groupBy("doc_id", "path", "value").agg(F.count(F.lit(1)).alias("n"))
