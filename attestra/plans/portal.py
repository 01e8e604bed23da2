"""Queries of the review portal and of the public list's orders: orders are review units, customers their candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import portal as P
from attestra.operators.serving import with_status

from . import bindings as B

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


#: The same expressions in Spark and in SQL: an order as a unit of one of three families.
_UNIT = """CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'RESOLVED' ELSE 'PUBLISHED' END AS family, c_nationkey AS authority, c_custkey AS candidate,
  CASE WHEN c_custkey % 5 <> 0 AND o_orderkey % 4 <> 0 THEN o_orderkey % 3 END AS post_key,
  CASE WHEN o_orderstatus <> 'O' THEN 'RESOLVED' WHEN o_orderkey % 3 = 0 THEN 'QUEUED' ELSE 'IN_REVIEW' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'REJECTED' WHEN '2-HIGH' THEN 'APPROVED_WITH_CORRECTIONS' ELSE 'APPROVED' END END AS outcome,
  CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'AUTO_PUBLISHED' ELSE 'HUMAN_PUBLISHED' END END AS path,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'NORMAL' ELSE 'NONE' END AS priority,
  CASE WHEN o_totalprice > 100000 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS completeness,
  o_orderpriority AS post_name, c_mktsegment AS organization, c_name AS title,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS opening_date,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) END AS closing_date,
  CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderdate AS DATE) END AS refreshed_at, CAST(o_orderdate AS DATE) AS opened_at, o_orderkey AS unit_id"""


def _lifecycle_sql(start: str, end: str) -> str:
    day = f"DATE '{B.AS_OF}'"
    return f"CASE WHEN {start} > {end} THEN 'UNKNOWN' WHEN {start} > {day} THEN 'UPCOMING' WHEN {end} IS NULL THEN 'UNKNOWN' WHEN {end} >= {day} THEN 'OPEN' WHEN {day} - {end} <= 30 THEN 'RECENTLY_CLOSED' ELSE 'CLOSED' END"


_ROWS = f"""WITH u AS (SELECT {_UNIT}, n_name AS authority_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY family, authority, candidate, post_key ORDER BY opened_at, unit_id) = 1),
s AS (SELECT * FROM e WHERE post_key IS NOT NULL OR (authority, candidate) NOT IN (SELECT authority, candidate FROM u WHERE post_key IS NOT NULL)),
p AS (SELECT *, unit_id = first(unit_id) OVER (PARTITION BY authority, candidate, post_key ORDER BY family) AS leads, {_lifecycle_sql("opening_date", "closing_date")} AS lifecycle,
  concat_ws(':', authority, candidate, post_key) AS stable_id FROM s)
"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (B.t(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    units = spark.sql(f"SELECT {_UNIT}, n_name AS authority_name FROM {{joined}}", joined=joined)
    return P.portal_rows(units, ["opened_at", "unit_id"], F.lit(B.AS_OF).cast("date"))


@query(_ROWS + "SELECT family, stable_id, unit_id, status, leads, lifecycle FROM p")
def portal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-25, SET-1, SET-2, WIN-14."""
    return rows(spark, sf_dir).select("family", "stable_id", "unit_id", "status", "leads", "lifecycle")


@query(_ROWS + """SELECT count(*) FILTER (leads) AS total_jobs, count(*) FILTER (status = 'QUEUED') AS review_required, count(*) FILTER (status = 'IN_REVIEW') AS in_review, count(*) FILTER (outcome LIKE 'APPROVED%') AS approved,
  count(*) FILTER (outcome = 'REJECTED') AS rejected, count(*) FILTER (path = 'AUTO_PUBLISHED') AS auto_published, count(*) FILTER (path = 'HUMAN_PUBLISHED') AS human_published FROM p""")
def portal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-25, AGG-20."""
    return P.portal_counts(rows(spark, sf_dir))


_FOUND = " WHERE outcome LIKE 'APPROVED%' AND family = 'RESOLVED' AND completeness = 'COMPLETE' AND contains(lower(concat_ws(' ', post_name, organization, authority_name, title)), 'ding n') "


@query(_ROWS + f"SELECT lifecycle, count(*) AS n FROM p {_FOUND} GROUP BY 1")
def portal_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-25, AGG-21: a search that spans two columns, its lifecycles counted."""
    found = P.portal_filter(rows(spark, sf_dir), selected="RESOLVED", outcome="APPROVED", completeness="COMPLETE", text=" DING N")
    return found.groupBy("lifecycle").agg(F.count(F.lit(1)).alias("n"))


_ORDERED = """ORDER BY CASE lifecycle WHEN 'OPEN' THEN 1 WHEN 'RECENTLY_CLOSED' THEN 2 WHEN 'UPCOMING' THEN 3 WHEN 'CLOSED' THEN 4 ELSE 5 END,
  CASE lifecycle WHEN 'OPEN' THEN {end} - DATE '1970-01-01' WHEN 'UPCOMING' THEN {start} - DATE '1970-01-01' WHEN 'RECENTLY_CLOSED' THEN DATE '1970-01-01' - {end} WHEN 'CLOSED' THEN DATE '1970-01-01' - {end} END NULLS LAST,
  CASE WHEN lifecycle = 'UNKNOWN' THEN {refreshed} END DESC NULLS LAST, {id}"""
_PORTAL_ORDER = _ORDERED.format(start="opening_date", end="closing_date", refreshed="refreshed_at", id="stable_id")


@query(_ROWS + f""", f AS (SELECT *, row_number() OVER ({_PORTAL_ORDER}) AS k, count(*) OVER () AS total FROM p WHERE leads AND priority = 'HIGH')
SELECT stable_id, lifecycle, total, CAST(ceil(total / 20.0) AS BIGINT) AS pages, CAST(ceil(total / 20.0) AS BIGINT) AS page FROM f WHERE k > (CAST(ceil(total / 20.0) AS BIGINT) - 1) * 20""")
def portal_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-25, SORT-2, SORT-4: a page number beyond the last one gives the last one, where lifecycles are unknown."""
    found = P.portal_filter(rows(spark, sf_dir), priority="HIGH")
    return P.clamped_page(found, P.portal_order(), 1_000_000, 20).select("stable_id", "lifecycle", "total", "pages", "page")


_PUBLIC = f"""WITH {B.POSTINGS_SQL}, q AS (SELECT job_id, authority AS candidate, name, CASE WHEN job_id % 11 <> 0 THEN end_date END AS end_date, start_date, CASE WHEN job_id % 7 <> 0 THEN vacancies END AS vacancies, start_date + CAST(job_id % 90 AS INTEGER) AS published_at FROM postings),
j AS (SELECT *, {_lifecycle_sql("start_date", "end_date")} AS lifecycle FROM q), """
_MODES = {
    "published_desc": "ORDER BY published_at DESC, job_id", "published_asc": "ORDER BY published_at, job_id", "application_end_asc": "ORDER BY end_date NULLS LAST, job_id", "application_end_desc": "ORDER BY end_date DESC NULLS LAST, job_id",
    "display_name_asc": "ORDER BY lower(name), candidate, job_id", "vacancies_desc": "ORDER BY vacancies DESC NULLS LAST, job_id", "lifecycle": _ORDERED.format(start="start_date", end="end_date", refreshed="published_at", id="job_id"),
}


@query(_PUBLIC + "m AS (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, row_number() OVER ({order}) AS place, job_id FROM j" for m, order in _MODES.items()) + ") SELECT * FROM m WHERE place <= 50")
def sort_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SORT-3: the first page in each of the seven modes."""
    k = F.col("job_id")
    jobs = B.postings(spark, sf_dir).select(
        "job_id", F.col("authority").alias("candidate"), "name", F.when(k % 11 != 0, F.col("end_date")).alias("end_date"), "start_date", F.when(k % 7 != 0, F.col("vacancies")).alias("vacancies"),
        F.date_add("start_date", (k % 90).cast("int")).alias("published_at"),
    )
    return P.sort_pages(with_status(jobs, F.lit(B.AS_OF).cast("date")), 50)


@query("""WITH c AS (SELECT l_orderkey, CASE l_returnflag WHEN 'N' THEN 'QUEUED' WHEN 'A' THEN 'IN_REVIEW' ELSE 'RESOLVED' END AS status FROM lineitem)
SELECT n_name AS code, count(*) FILTER (status = 'QUEUED') AS queued, count(*) FILTER (status = 'IN_REVIEW') AS in_review, count(*) FILTER (status = 'RESOLVED') AS resolved
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN c ON l_orderkey = o_orderkey GROUP BY 1""")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23: lines are cases of orders, orders revisions of customers, nations the sources."""
    li, o, c, n = (B.t(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "nation"))
    status = F.when(F.col("l_returnflag") == "N", "QUEUED").when(F.col("l_returnflag") == "A", "IN_REVIEW").otherwise("RESOLVED")
    return P.review_counts(
        li.select(F.col("l_orderkey").alias("revision_id"), status.alias("status")), o.select(F.col("o_orderkey").alias("revision_id"), F.col("o_custkey").alias("candidate_id")),
        c.select(F.col("c_custkey").alias("candidate_id"), F.col("c_nationkey").alias("authority_id")), n.select(F.col("n_nationkey").alias("authority_id"), F.col("n_name").alias("code")), ["QUEUED", "IN_REVIEW", "RESOLVED"],
    )
