"""Queries over verification, history, serving and monitoring, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import scalars as S
from attestra.operators import history as H
from attestra.operators import monitoring as M
from attestra.operators import serving as P
from attestra.operators import verification as V

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


# Verification and confidence

COUNTS_SQL = "WITH " + B.FIELDS_SQL + """,
counted AS (SELECT field_id, count(*) AS evidence_count, """ + ", ".join(f"count(*) FILTER (source_class = '{c}' AND assessment = '{d}') AS {k}_{e}, count(DISTINCT endpoint_id) FILTER (source_class = '{c}' AND assessment = '{d}') AS {k}_{e}_endpoints" for k, c in V.CLASSES.items() for e, d in V.DIRECTIONS.items()) + """ FROM assessments GROUP BY field_id),
c AS (SELECT fields.*, coalesce(evidence_count, 0) AS evidence_count, """ + ", ".join(f"coalesce({k}_{e}{s}, 0) AS {k}_{e}{s}" for k in V.CLASSES for e in V.DIRECTIONS for s in ("", "_endpoints")) + """ FROM fields LEFT JOIN counted USING (field_id)),
r AS (SELECT *, CASE WHEN not_applicable THEN 'MANUALLY_MARKED_NOT_APPLICABLE' WHEN auth_conflict > 0 THEN 'AUTHORITATIVE_CONFLICT' WHEN auth_support > 0 THEN 'AUTHORITATIVE_SUPPORT'
  WHEN official_support + secondary_support > 0 AND official_conflict + secondary_conflict > 0 THEN 'SOURCE_CONFLICT' WHEN evidence_count = 0 THEN 'NO_EVIDENCE'
  WHEN secondary_support > 0 AND official_support = 0 AND official_conflict + secondary_conflict = 0 THEN 'ONLY_SECONDARY_EVIDENCE' ELSE 'INSUFFICIENT_SUPPORT' END AS reason FROM c),
v AS (SELECT *, CASE reason WHEN 'MANUALLY_MARKED_NOT_APPLICABLE' THEN 'NOT_APPLICABLE' WHEN 'AUTHORITATIVE_CONFLICT' THEN 'CONFLICT' WHEN 'SOURCE_CONFLICT' THEN 'CONFLICT' WHEN 'AUTHORITATIVE_SUPPORT' THEN 'CONFIRMED' ELSE 'INSUFFICIENT_EVIDENCE' END AS outcome FROM r),
s1 AS (SELECT *, CASE WHEN NOT not_applicable THEN CAST(least(CASE WHEN auth_conflict > 0 THEN 25 ELSE 100 END, greatest(0, least(100,
  CASE reason WHEN 'AUTHORITATIVE_SUPPORT' THEN 90 WHEN 'AUTHORITATIVE_CONFLICT' THEN 15 WHEN 'SOURCE_CONFLICT' THEN 35 WHEN 'NO_EVIDENCE' THEN 20 WHEN 'ONLY_SECONDARY_EVIDENCE' THEN 45 ELSE 40 END
  + least(greatest(auth_support_endpoints - 1, 0) * 3, 6) + least(official_support_endpoints * 2, 4) + least(secondary_support_endpoints, 2) + greatest(secondary_conflict_endpoints * -5, -10) + greatest(official_conflict_endpoints * -12, -24)))) AS INTEGER) END AS score FROM v),
s2 AS (SELECT *, CASE WHEN outcome <> 'NOT_APPLICABLE' THEN CAST(greatest(0, least(100, CASE outcome WHEN 'CONFIRMED' THEN 50 WHEN 'CONFLICT' THEN 20 ELSE 25 END
  + CASE WHEN auth_support > 0 THEN 30 ELSE 0 END + CASE WHEN official_support > 0 THEN 20 ELSE 0 END + CASE WHEN secondary_support > 0 THEN 8 ELSE 0 END
  + CASE WHEN method IS NULL THEN 0 WHEN method LIKE '%!_V1' ESCAPE '!' THEN 10 ELSE 5 END + CASE WHEN has_locator THEN 5 ELSE 0 END
  + greatest(0, least(auth_support_endpoints + official_support_endpoints + secondary_support_endpoints - 1, 5))
  - CASE WHEN auth_conflict > 0 THEN 45 ELSE 0 END - CASE WHEN official_conflict > 0 THEN 30 ELSE 0 END - CASE WHEN secondary_conflict > 0 THEN 10 ELSE 0 END - CASE WHEN ambiguous THEN 30 ELSE 0 END)) AS INTEGER) END AS score FROM v)
"""
_COUNT_COLUMNS = [f"{k}_{e}{s}" for k in V.CLASSES for e in V.DIRECTIONS for s in ("", "_endpoints")]


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.decide_outcome(V.count_evidence(B.fields(spark, sf_dir), B.assessments(spark, sf_dir)))


@query(COUNTS_SQL + f"SELECT field_id, evidence_count, {', '.join(_COUNT_COLUMNS)}, reason, outcome FROM v")
def field_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1, AGG-2, AGG-4, PIPE-4."""
    return verified(spark, sf_dir).select("field_id", "evidence_count", *_COUNT_COLUMNS, "reason", "outcome")


@query(COUNTS_SQL + "SELECT run_id, count(*) FILTER (outcome = 'CONFIRMED') AS confirmed, count(*) FILTER (outcome = 'CONFLICT') AS conflict, count(*) FILTER (outcome = 'INSUFFICIENT_EVIDENCE') AS insufficient_evidence, count(*) FILTER (outcome = 'NOT_APPLICABLE') AS not_applicable, count(*) AS fields_total FROM v GROUP BY run_id")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3."""
    return V.run_counters(verified(spark, sf_dir))


_PRIORITY_SQL = """CASE WHEN score IS NULL THEN 0 WHEN reason = 'AUTHORITATIVE_CONFLICT' AND critical THEN 3 WHEN reason = 'AUTHORITATIVE_CONFLICT' OR (critical AND (reason = 'SOURCE_CONFLICT' OR auth_support = 0 OR score < 50)) THEN 2
  WHEN reason <> 'AUTHORITATIVE_SUPPORT' OR (critical AND score < 90) OR (NOT critical AND score < 80) THEN 1 ELSE 0 END"""


@query(COUNTS_SQL + f"SELECT field_id, score, {_PRIORITY_SQL} AS priority_rank, CASE WHEN score IS NULL THEN 0 ELSE (reason <> 'AUTHORITATIVE_SUPPORT')::INT + (critical AND score < 90)::INT + (critical AND auth_support = 0)::INT + (NOT critical AND score < 80)::INT END AS n_reasons FROM s1")
def field_confidence_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-5, AGG-6, PIPE-6."""
    out = V.field_review_v1(V.field_score_v1(verified(spark, sf_dir)))
    return out.select("field_id", "score", "priority_rank", F.size("reasons").alias("n_reasons"))


@query(COUNTS_SQL + "SELECT field_id, score FROM s2")
def field_confidence_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7, PIPE-7."""
    return V.field_score_v2(verified(spark, sf_dir)).select("field_id", "score")


_REVISION_SQL = """SELECT run_id, CAST(sum(score * CASE WHEN critical THEN 2 ELSE 1 END) AS DECIMAL(18,0)) AS points, CAST(sum(CASE WHEN score IS NOT NULL THEN CASE WHEN critical THEN 2 ELSE 1 END END) AS DECIMAL(18,0)) AS weights,
  count(*) AS fields_total, count(outcome) AS finalised, count(*) FILTER (critical) AS critical_fields, count(*) FILTER (outcome <> 'CONFIRMED') AS unconfirmed_fields, max(ambiguous::INT) AS ambiguous{extra} FROM {of} GROUP BY run_id"""


@query(COUNTS_SQL + f", p AS (SELECT *, {_PRIORITY_SQL} AS priority_rank FROM s1), g AS ({_REVISION_SQL.format(of='p', extra=', max(priority_rank) AS priority_rank')}) SELECT run_id, CAST(floor((2 * points + weights) / (2 * weights)) AS INTEGER) AS score, 1.0 AS coverage, fields_total, critical_fields, unconfirmed_fields, priority_rank FROM g")
def revision_confidence_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-8, AGG-10, AGG-12, AGG-13."""
    out = V.revision_score(V.field_review_v1(V.field_score_v1(verified(spark, sf_dir))), policy=1)
    return out.select("run_id", "score", F.col("coverage").cast("double").alias("coverage"), "fields_total", "critical_fields", "unconfirmed_fields", "priority_rank")


@query(COUNTS_SQL + f", g AS ({_REVISION_SQL.format(of='s2', extra='')}) SELECT run_id, greatest(0, CAST(floor((2 * points + weights) / (2 * weights)) AS INTEGER) - 20 * ambiguous) AS score, fields_total, critical_fields FROM g WHERE weights IS NOT NULL UNION ALL SELECT run_id, CASE WHEN FALSE THEN 1 ELSE 0 END, fields_total, critical_fields FROM g WHERE weights IS NULL")
def revision_confidence_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9. A run without any score gets 0."""
    out = V.revision_score(V.field_score_v2(verified(spark, sf_dir)), policy=2)
    return out.select("run_id", F.coalesce("score", F.lit(0)).alias("score"), "fields_total", "critical_fields")


@query(COUNTS_SQL + f", g AS ({_REVISION_SQL.format(of='s1', extra='')}) SELECT run_id, CAST(floor((2 * points + weights) / (2 * weights)) AS INTEGER) AS score, fields_total, unconfirmed_fields FROM g ORDER BY score NULLS LAST, run_id LIMIT 100")
def lowest_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: outcome and confidence of every claim set, and the 100 least certain."""
    out = V.revision_score(V.field_score_v1(verified(spark, sf_dir)), policy=1)
    return out.orderBy(F.col("score").asc_nulls_last(), "run_id").limit(100).select("run_id", "score", "fields_total", "unconfirmed_fields")


@query(COUNTS_SQL + """, f AS (SELECT run_id, CASE WHEN reason = 'AUTHORITATIVE_CONFLICT' AND critical THEN 3 WHEN outcome = 'CONFLICT' OR (critical AND outcome = 'INSUFFICIENT_EVIDENCE') THEN 2 WHEN ambiguous THEN 1 ELSE 0 END AS rank,
  reason = 'AUTHORITATIVE_CONFLICT' AS a, reason = 'SOURCE_CONFLICT' AS b, critical AND outcome = 'INSUFFICIENT_EVIDENCE' AS c, ambiguous AS d FROM v),
g AS (SELECT run_id, max(rank) AS rank, bool_or(a) AS a, bool_or(b) AS b, bool_or(c) AS c, bool_or(d) AS d FROM f GROUP BY run_id)
SELECT run_id, concat_ws(',', CASE WHEN a THEN 'AUTHORITATIVE_CONFLICT' END, CASE WHEN b THEN 'SOURCE_CONFLICT' END, CASE WHEN c THEN 'INSUFFICIENT_CRITICAL_EVIDENCE,UNCLEAR_CRITICAL_MEANING' END, CASE WHEN d THEN 'AMBIGUOUS_POST_DETAILS' END, CASE WHEN run_id % 10 = 0 THEN 'PARTIAL_VERIFICATION' END) AS reasons,
  CASE greatest(rank, CASE WHEN run_id % 10 = 0 THEN 1 ELSE 0 END) WHEN 0 THEN 'NONE' WHEN 1 THEN 'NORMAL' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS priority, greatest(rank, CASE WHEN run_id % 10 = 0 THEN 1 ELSE 0 END) > 0 AS review_required FROM g""")
def review_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-8, AGG-11, AGG-12, FN-31."""
    partial = B.t(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("run_id"))
    return V.route_review(verified(spark, sf_dir), partial).withColumn("reasons", F.concat_ws(",", "reasons"))


@query("""SELECT o_orderkey AS revision_id, CAST(o_orderdate AS VARCHAR) AS created FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) OR (SELECT max(l_shipdate) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R') > (SELECT max(l_shipdate) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
ORDER BY o_orderdate, o_orderkey LIMIT 500""")
def verification_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-5, JOIN-14, SORT-5: orders without lines, or with a request after the last one."""
    o, li = B.t(spark, sf_dir, "orders"), B.t(spark, sf_dir, "lineitem")
    done = li.select(F.col("l_orderkey").alias("revision_id"), F.col("l_shipdate").alias("completed_at"))
    asked = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("revision_id"), F.col("l_shipdate").alias("requested_at"))
    out = V.select_for_verification(o.select(F.col("o_orderkey").alias("revision_id"), F.col("o_orderdate").alias("created_at")), done, asked, 500)
    return out.select("revision_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


# History


@query("WITH " + B.OBSERVATIONS_SQL + """ SELECT observation_id, endpoint_id, CASE WHEN row_number() OVER (PARTITION BY endpoint_id, url, content_hash ORDER BY observed_at, observation_id) > 1 THEN 'UNCHANGED'
  WHEN row_number() OVER (PARTITION BY endpoint_id, url ORDER BY observed_at, observation_id) > 1 THEN 'CHANGED' ELSE 'NEW' END AS label FROM observations""")
def observation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-5, PIPE-1."""
    return H.classify_observations(B.observations(spark, sf_dir)).select("observation_id", "endpoint_id", "label")


@query("WITH " + B.OBSERVATIONS_SQL + """, l AS (SELECT endpoint_id, row_number() OVER (PARTITION BY endpoint_id, url, content_hash ORDER BY observed_at, observation_id) AS c, row_number() OVER (PARTITION BY endpoint_id, url ORDER BY observed_at, observation_id) AS u FROM observations)
SELECT endpoint_id, count(*) FILTER (c = 1 AND u = 1) AS new, count(*) FILTER (c = 1 AND u > 1) AS changed, count(*) FILTER (c > 1) AS unchanged, count(*) AS total FROM l GROUP BY 1""")
def observation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14."""
    return H.observation_counters(H.classify_observations(B.observations(spark, sf_dir)), "endpoint_id")


@query("WITH " + B.OBSERVATIONS_SQL + " SELECT endpoint_id, url, content_hash, CAST(strftime(min(observed_at), '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS first_seen, CAST(strftime(max(observed_at), '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS last_seen, count(*) AS sightings FROM observations GROUP BY 1, 2, 3")
def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-1: versions with first and last sight."""
    out = H.document_versions(B.observations(spark, sf_dir))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})


@query("WITH " + B.VERSIONS_SQL + " SELECT subject, projection, seq_id, CAST(row_number() OVER (PARTITION BY subject ORDER BY seq_ts, seq_id) AS INTEGER) AS revision_number FROM (SELECT *, row_number() OVER (PARTITION BY subject, projection ORDER BY seq_ts, seq_id) AS n FROM versions) WHERE n = 1")
def numbered_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-2, WIN-4, SRC-6, FN-4."""
    return H.number_revisions(B.versions(spark, sf_dir)).select("subject", "projection", "seq_id", "revision_number")


_EVENTS_SQL = "WITH " + B.VERSIONS_SQL + """, w AS (SELECT *, lag(projection) OVER (PARTITION BY subject ORDER BY seq_ts, seq_id) AS before, row_number() OVER (PARTITION BY subject, projection ORDER BY seq_ts, seq_id) AS nth,
  lag(status) OVER (PARTITION BY subject ORDER BY seq_ts, seq_id) AS old_status, lag(priority) OVER (PARTITION BY subject ORDER BY seq_ts, seq_id) AS old_priority FROM versions),
e AS (SELECT *, CASE WHEN before IS NULL THEN 'CREATED' WHEN before = projection THEN 'UNCHANGED' WHEN nth > 1 THEN 'REPOINTED' ELSE 'UPDATED' END AS event FROM w) """


@query(_EVENTS_SQL + "SELECT subject, seq_id, event FROM e")
def publication_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-14, PIPE-16."""
    return H.publish_events(B.versions(spark, sf_dir)).select("subject", "seq_id", "event")


@query(_EVENTS_SQL + """, c AS (SELECT subject, seq_id, event, 'status' AS path, old_status AS old_value, status AS new_value FROM e UNION ALL SELECT subject, seq_id, event, 'priority', old_priority, priority FROM e)
SELECT subject, seq_id, path, old_value, new_value, CASE event WHEN 'CREATED' THEN 'ADDED' ELSE 'UPDATED' END AS change FROM c WHERE event IN ('CREATED', 'UPDATED') AND old_value IS DISTINCT FROM new_value""")
def master_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-7 over time, FLT-... change log; a version that points back leaves no rows."""
    return H.version_changes(B.versions(spark, sf_dir), ["status", "priority"]).select("subject", "seq_id", "path", "old_value", "new_value", "change")


@query("SELECT o_custkey AS subject, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority FROM orders GROUP BY 1")
def current_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-3, WIN-1: the current row of each subject."""
    return H.current(B.versions(spark, sf_dir)).select("subject", "status", "priority")


_DIFF = "(SELECT o_custkey AS subject, 'p' || o_orderkey % 5 AS path, max(o_orderstatus) AS v FROM orders WHERE {where} GROUP BY 1, 2)"


@query(f"SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.path, b.path) AS path, CASE WHEN a.v IS NULL THEN 'ADDED' WHEN b.v IS NULL THEN 'REMOVED' ELSE 'UPDATED' END AS change, a.v AS old_value, b.v AS new_value FROM {_DIFF.format(where='o_orderkey % 2 = 0')} a FULL JOIN {_DIFF.format(where='o_orderkey % 3 = 0')} b ON a.subject = b.subject AND a.path = b.path WHERE a.v IS DISTINCT FROM b.v")
def field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-7, SET-3: two fact sets, the facts of even orders and those of every third."""
    o = B.t(spark, sf_dir, "orders")
    path = F.concat(F.lit("p"), (F.col("o_orderkey") % 5).cast("string"))
    of = lambda where: o.where(where).groupBy(F.col("o_custkey").alias("subject"), path.alias("path")).agg(F.max("o_orderstatus").alias("value")).withColumn("type", F.lit("STRING"))
    return H.change_log(of("o_orderkey % 2 = 0"), of("o_orderkey % 3 = 0"))


@query("SELECT subject, path, max(v) AS value FROM (SELECT o_custkey AS subject, 'p' || o_orderkey % 9 AS path, o_orderstatus AS v FROM orders) GROUP BY 1, 2 HAVING count(DISTINCT v) = 1")
def conflict_free_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19."""
    facts = B.t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.concat(F.lit("p"), (F.col("o_orderkey") % 9).cast("string")).alias("path"), F.col("o_orderstatus").alias("value"))
    return H.conflict_free(facts, ["subject", "path"], "value")


@query("SELECT subject, path, type, value FROM (SELECT o_orderkey AS subject, 'status' AS path, 'STRING' AS type, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', 'STRING', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'customer', 'INTEGER', CAST(o_custkey AS VARCHAR) FROM orders)")
def long_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in long form (section 1 of the model)."""
    o = B.t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"))
    return H.facts_of(o, "o_orderkey", {"status": "STRING", "priority": "STRING", "customer": "INTEGER"})


@query("SELECT l_orderkey AS id, CASE WHEN NOT l_quantity > 5 THEN 'quantity' END AS rule FROM lineitem WHERE NOT l_quantity > 5 UNION ALL SELECT l_orderkey, 'discount' FROM lineitem WHERE NOT l_discount < 0.08")
def shape_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-18, PIPE-15."""
    return H.violations(B.t(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id"), {"quantity": "l_quantity > 5", "discount": "l_discount < 0.08"}, ["id"])


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17, keys that repeat."""
    return H.duplicates(B.t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT o_custkey AS k, sum(o_shippriority0) AS total, sum(n) AS parts, sum(n) = sum(o_shippriority0) AS reconciles FROM (SELECT o_custkey, o_orderkey % 4 + 1 AS o_shippriority0, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders) GROUP BY 1")
def reconciled_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15, AGG-16: stated counts of orders against their lines, by customer."""
    o, li = B.t(spark, sf_dir, "orders"), B.t(spark, sf_dir, "lineitem")
    n = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    parts = o.join(n, o["o_orderkey"] == n["l_orderkey"], "left").select(F.col("o_custkey").alias("k"), F.coalesce("n", F.lit(0)).alias("n"))
    totals = o.groupBy(F.col("o_custkey").alias("k")).agg(F.sum(F.col("o_orderkey") % 4 + 1).alias("total"))
    return H.reconciled(parts, totals, "k")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'MISSING_LEFT' ELSE 'MISSING_RIGHT' END AS violation FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def set_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-15, SRC-9."""
    return H.set_mismatches(B.t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), B.t(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("k")), ["k"])


# Serving

_JOBS = f"""WITH {B.POSTINGS_SQL}, j AS (SELECT *, CASE WHEN start_date > end_date THEN 'UNKNOWN' WHEN start_date > DATE '{B.AS_OF}' THEN 'UPCOMING' WHEN end_date IS NULL THEN 'UNKNOWN' WHEN end_date >= DATE '{B.AS_OF}' THEN 'OPEN' WHEN DATE '{B.AS_OF}' - end_date <= 30 THEN 'RECENTLY_CLOSED' ELSE 'CLOSED' END AS lifecycle FROM postings) """


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_status(B.postings(spark, sf_dir), F.lit(B.AS_OF).cast("date"))


@query(_JOBS + "SELECT job_id, lifecycle, CASE WHEN lifecycle IN ('CLOSED', 'RECENTLY_CLOSED') THEN 'CLOSED' ELSE lifecycle END AS status FROM j")
def job_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-23."""
    return jobs(spark, sf_dir).select("job_id", "lifecycle", "status")


@query(_JOBS + "SELECT lifecycle, count(*) AS n FROM j GROUP BY 1 UNION ALL SELECT 'ALL', count(*) FROM j")
def lifecycle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20, AGG-21."""
    return M.counts_with_all(jobs(spark, sf_dir), "lifecycle")


@query(_JOBS + f", h AS (SELECT * FROM j WHERE segment = 'BUILDING' AND vacancies >= 3 AND start_date >= DATE '1999-01-01' AND contains(lower(name), 'customer') AND (lifecycle NOT IN ('CLOSED', 'RECENTLY_CLOSED') OR end_date >= DATE '{B.AS_OF}' - INTERVAL 12 MONTH)) SELECT job_id, vacancies, (SELECT count(*) FROM h) AS total, CAST(ceil((SELECT count(*) FROM h) / 25.0) AS BIGINT) AS pages FROM h ORDER BY vacancies DESC NULLS LAST, job_id OFFSET 25 LIMIT 25")
def public_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-17, FLT-12, FLT-13, FLT-14, SORT-3, SORT-4."""
    found = jobs(spark, sf_dir).where(P.public_filters(segment="BUILDING", vacancies_from=3, start_from="1999-01-01", text="Customer")).where(P.in_history(F.lit(B.AS_OF).cast("date")))
    return P.page(found, P.SORTS["most_vacancies"]("job_id"), 2, 25).select("job_id", "vacancies", "total", "pages")


@query(_JOBS + """SELECT job_id, lifecycle FROM j ORDER BY CASE lifecycle WHEN 'OPEN' THEN 1 WHEN 'RECENTLY_CLOSED' THEN 2 WHEN 'UPCOMING' THEN 3 WHEN 'CLOSED' THEN 4 ELSE 5 END,
  CASE lifecycle WHEN 'OPEN' THEN end_date - DATE '1970-01-01' WHEN 'UPCOMING' THEN start_date - DATE '1970-01-01' WHEN 'RECENTLY_CLOSED' THEN DATE '1970-01-01' - end_date WHEN 'CLOSED' THEN DATE '1970-01-01' - end_date END NULLS LAST, job_id LIMIT 200""")
def lifecycle_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SORT-2: the first page; lifecycle_table has all jobs."""
    return jobs(spark, sf_dir).orderBy(*P.lifecycle_order("job_id")).limit(200).select("job_id", "lifecycle")


@query(_JOBS + """SELECT job_id, lifecycle FROM j ORDER BY CASE lifecycle WHEN 'OPEN' THEN 1 WHEN 'RECENTLY_CLOSED' THEN 2 WHEN 'UPCOMING' THEN 3 WHEN 'CLOSED' THEN 4 ELSE 5 END,
  CASE lifecycle WHEN 'OPEN' THEN end_date - DATE '1970-01-01' WHEN 'UPCOMING' THEN start_date - DATE '1970-01-01' WHEN 'RECENTLY_CLOSED' THEN DATE '1970-01-01' - end_date WHEN 'CLOSED' THEN DATE '1970-01-01' - end_date END NULLS LAST, job_id""")
def lifecycle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SORT-2: all jobs in lifecycle order."""
    return jobs(spark, sf_dir).orderBy(*P.lifecycle_order("job_id")).select("job_id", "lifecycle")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_orderkey, l_linenumber OFFSET 100 LIMIT 50")
def listed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5."""
    return P.list_rows(B.t(spark, sf_dir, "lineitem"), equal={"l_returnflag": "R", "l_linestatus": None}, order=[F.col("l_orderkey"), F.col("l_linenumber")], offset=100, limit=50).select("l_orderkey", "l_linenumber")


@query(_JOBS + "SELECT job_id, concat_ws(',', CASE WHEN coalesce(vacancies, 0) = 0 THEN 'vacancies' END, CASE WHEN end_date = start_date THEN 'end_date' END, CASE WHEN segment = 'MACHINERY' THEN 'qualification' END) AS missing, NOT (coalesce(vacancies, 0) = 0 OR end_date = start_date OR segment = 'MACHINERY') AS ready FROM j")
def job_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15, AGG-30, PIPE-20."""
    checks = {"vacancies": F.col("vacancies") > 0, "end_date": F.col("end_date") > F.col("start_date"), "qualification": F.col("segment") != "MACHINERY"}
    return P.readiness(jobs(spark, sf_dir), checks).select("job_id", F.concat_ws(",", "missing").alias("missing"), "ready")


@query("WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n, count(*) OVER (PARTITION BY l_suppkey) > 50 AS exceeded FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, exceeded FROM r WHERE n <= 50")
def capped_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SORT-8: the cap is the feature."""
    return P.capped_by(B.t(spark, sf_dir, "lineitem"), "l_suppkey", [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 50).select("l_suppkey", "l_orderkey", "l_linenumber", "exceeded")


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-2, WIN-14, WIN-15, SORT-6."""
    return P.first_by(B.t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


_RULE = "(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 20 + 18 END)"
_ELIGIBLE = f"""WITH prof AS (SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 11 <> 0 THEN 18 + c_custkey % 40 END AS age, CASE c_custkey % 3 WHEN 0 THEN 'GENERAL' WHEN 1 THEN 'RESERVED' END AS category FROM customer),
b AS (SELECT {_RULE} AS low, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 20 + 25 END AS high, CASE WHEN p_size % 2 = 0 THEN 5 END AS relaxation, count(*) AS jobs FROM part GROUP BY 1, 2, 3),
e AS (SELECT profile_id, jobs, CASE WHEN low IS NULL AND high IS NULL THEN 'UNKNOWN' WHEN age IS NULL THEN 'UNKNOWN' WHEN age < low THEN 'NOT_ELIGIBLE' WHEN high IS NULL OR age <= high THEN 'ELIGIBLE' WHEN category IS NULL OR category = 'GENERAL' THEN 'NOT_ELIGIBLE' WHEN relaxation IS NULL THEN 'REVIEW_REQUIRED' WHEN age > high + relaxation THEN 'NOT_ELIGIBLE' ELSE 'ELIGIBLE' END AS o FROM prof, b)
SELECT profile_id, CAST(coalesce(sum(jobs) FILTER (o = 'ELIGIBLE'), 0) AS BIGINT) AS eligible, CAST(coalesce(sum(jobs) FILTER (o = 'UNKNOWN'), 0) AS BIGINT) AS unknown, CAST(coalesce(sum(jobs) FILTER (o = 'REVIEW_REQUIRED'), 0) AS BIGINT) AS review_required, CAST(coalesce(sum(jobs) FILTER (o = 'NOT_ELIGIBLE'), 0) AS BIGINT) AS not_eligible FROM e GROUP BY 1"""


@query(_ELIGIBLE)
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-13, the age rule of PIPE-19; job_eligibility has all four rules."""
    c, p = B.t(spark, sf_dir, "customer"), B.t(spark, sf_dir, "part")
    k = F.col("c_custkey")
    profiles = c.select(k.alias("profile_id"), F.when(k % 11 != 0, 18 + k % 40).alias("age"), F.when(k % 3 == 0, "GENERAL").when(k % 3 == 1, "RESERVED").alias("category"))
    s = F.col("p_size")
    rules = p.select(F.when(s % 3 != 0, s % 20 + 18).alias("low"), F.when(s % 5 != 0, s % 20 + 25).alias("high"), F.when(s % 2 == 0, 5).alias("relaxation"))
    return P.eligible_jobs(profiles, rules)


_JOB_ELIGIBILITY = """WITH p AS (SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 11 <> 0 THEN DATE '1955-02-28' + CAST(c_custkey * 37 % 14000 AS INTEGER) END AS born, CASE c_custkey % 3 WHEN 0 THEN 'GENERAL' WHEN 1 THEN 'RESERVED' END AS category,
  CASE WHEN c_custkey % 5 <> 0 THEN [c_mktsegment, 'Degree'] END AS held, CASE WHEN c_nationkey < 20 THEN c_nationkey < 10 END AS lives, CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey % 90 AS INTEGER) END AS has FROM customer),
r AS (SELECT p_size AS s, min(p_partkey) AS first_job, count(*) AS jobs, CASE WHEN p_size % 3 <> 0 THEN p_size % 20 + 18 END AS low, p_size % 5 = 0 AS open_, CASE WHEN p_size % 10 <> 3 THEN p_size % 20 + 25 END AS high, CASE WHEN p_size % 7 <> 0 THEN DATE '1998-01-01' + CAST(p_size AS INTEGER) * 30 END AS cutoff,
  CASE p_size % 6 WHEN 1 THEN 'building' WHEN 2 THEN 'automobile' WHEN 3 THEN 'degree' WHEN 4 THEN 'doctor' END AS q, p_size % 13 = 0 AS json, p_size % 4 AS d, CASE WHEN p_size % 5 = 1 THEN p_size WHEN p_size % 5 = 2 THEN p_size % 6 * 12 END AS least, p_size % 5 = 3 AS told FROM part GROUP BY p_size),
a AS (SELECT *, date_diff('year', born, cutoff) - CASE WHEN (month(cutoff), day(cutoff)) < (month(born), day(born)) THEN 1 ELSE 0 END AS years FROM p, r),
o AS (SELECT profile_id, first_job, jobs, CASE WHEN (low IS NULL AND open_) OR born IS NULL THEN 'UNKNOWN' WHEN cutoff IS NULL OR (NOT open_ AND high IS NULL) THEN 'REVIEW_REQUIRED' WHEN years < low THEN 'NOT_ELIGIBLE' WHEN open_ OR years <= high THEN 'ELIGIBLE' WHEN category IS NULL OR category = 'GENERAL' THEN 'NOT_ELIGIBLE' WHEN s % 2 <> 0 THEN 'REVIEW_REQUIRED' WHEN years > high + 5 THEN 'NOT_ELIGIBLE' ELSE 'ELIGIBLE' END AS age,
  CASE WHEN q IS NULL OR held IS NULL THEN 'UNKNOWN' WHEN NOT json AND (q = lower(held[1]) OR q = 'degree') THEN 'ELIGIBLE' ELSE 'REVIEW_REQUIRED' END AS qualification,
  CASE WHEN d = 0 THEN 'UNKNOWN' WHEN d = 1 THEN 'REVIEW_REQUIRED' WHEN lives IS NULL THEN 'UNKNOWN' WHEN lives THEN 'ELIGIBLE' ELSE 'NOT_ELIGIBLE' END AS domicile,
  CASE WHEN told THEN 'REVIEW_REQUIRED' WHEN least IS NULL OR has IS NULL THEN 'UNKNOWN' WHEN has >= least THEN 'ELIGIBLE' ELSE 'NOT_ELIGIBLE' END AS experience FROM a)
SELECT *, CASE WHEN 'NOT_ELIGIBLE' IN (age, qualification, domicile, experience) THEN 'NOT_ELIGIBLE' WHEN 'REVIEW_REQUIRED' IN (age, qualification, domicile, experience) THEN 'REVIEW_REQUIRED' WHEN 'UNKNOWN' IN (age, qualification, domicile, experience) THEN 'UNKNOWN' ELSE 'ELIGIBLE' END AS outcome FROM o"""


def _profiles_and_rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as profiles, parts as jobs whose rules follow from their size."""
    c, p = B.t(spark, sf_dir, "customer"), B.t(spark, sf_dir, "part")
    k, n, s = F.col("c_custkey"), F.col("c_nationkey"), F.col("p_size")
    profiles = c.select(
        k.alias("profile_id"), F.when(k % 11 != 0, F.date_add(F.lit("1955-02-28").cast("date"), (k * 37 % 14000).cast("int"))).alias("born"), F.when(k % 3 == 0, "GENERAL").when(k % 3 == 1, "RESERVED").alias("category"),
        F.when(k % 5 != 0, F.array("c_mktsegment", F.lit("Degree"))).alias("qualifications"), F.when(n < 20, n < 10).alias("lives_there"), F.when(k % 6 != 0, (k % 90).cast("int")).alias("experience_months"),
    )
    none = F.expr("cast(array() as array<struct<category:string,years:int>>)")
    rules = p.select(
        F.col("p_partkey").alias("job_id"), F.when(s % 3 != 0, (s % 20 + 18).cast("string")).alias("low"), F.when(s % 5 != 0, F.when(s % 10 == 3, "about 30").otherwise((s % 20 + 25).cast("string"))).alias("high"),
        F.when(s % 7 != 0, F.date_add(F.lit("1998-01-01").cast("date"), (s * 30).cast("int"))).alias("cutoff"), F.when(s % 2 == 0, F.array(F.struct(F.lit("RESERVED").alias("category"), F.lit(5).alias("years")))).otherwise(none).alias("relaxations"),
        F.when(s % 6 == 1, "Building.").when(s % 6 == 2, " automobile").when(s % 6 == 3, "DEGREE").when(s % 6 == 4, "Doctor").alias("qualification"), F.when(s % 13 == 0, "JSON").otherwise("STRING").alias("qualification_kind"),
        F.when(s % 4 == 1, "Local candidates").when(s % 4 == 2, "Permanent resident of ASSAM").when(s % 4 == 3, "Assam domicile").alias("domicile"),
        F.when(s % 5 == 1, s).alias("months"), F.when(s % 5 == 2, s % 6).alias("years"), F.when(s % 5 == 3, "Some").alias("experience"),
    )
    return profiles, rules


@query(_JOB_ELIGIBILITY)
def job_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-19, JOIN-13, AGG-28."""
    return P.evaluate_eligibility(*_profiles_and_rules(spark, sf_dir), "Assam")


@query(f"SELECT * FROM ({_JOB_ELIGIBILITY}) WHERE outcome = 'ELIGIBLE'")
def eligible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-13, PIPE-19: where each profile is eligible, by a range join."""
    return P.eligible_pairs(*_profiles_and_rules(spark, sf_dir), "Assam")


@query("SELECT l_orderkey AS fact_id, n_name AS authority, CASE l_suppkey % 3 WHEN 0 THEN 'AUTHORITATIVE_OFFICIAL' WHEN 1 THEN 'OFFICIAL_SUPPORTING' ELSE 'SECONDARY_DISCOVERY_ONLY' END AS source_class, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3")
def field_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-1, JOIN-2, PIPE-18: fact, document, endpoint, authority."""
    li, o, s, n = (B.t(spark, sf_dir, x) for x in ("lineitem", "orders", "supplier", "nation"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"])
    return j.groupBy(F.col("l_orderkey").alias("fact_id"), F.col("n_name").alias("authority"), B.source_class("l_suppkey").alias("source_class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderkey % 2 = 0)")
def unsplit_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-4, JOIN-6."""
    return B.t(spark, sf_dir, "customer").join(B.t(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderkey % 2 = 0"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AND o_orderstatus <> 'P'")
def publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-13, JOIN-5, JOIN-6: supported, without contradiction, not pending."""
    o, li = B.t(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), B.t(spark, sf_dir, "lineitem")
    flags = li.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("s"), F.bool_or(F.col("l_returnflag") == "A").alias("c")).where("s and not c")
    return o.join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


# Monitoring

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_HEALTH_SQL = "WITH " + B.RUNS_SQL + """, s AS (SELECT source_id, count(*) AS runs, max(started_at) FILTER (status = 'RUNNING') AS r, max(started_at) FILTER (status = 'SUCCESS') AS ok, max(started_at) FILTER (status = 'FAILED') AS f,
  max(started_at) FILTER (status <> 'RUNNING') AS d, arg_max(status, (started_at, run_id)) FILTER (status <> 'RUNNING') AS ds FROM runs GROUP BY 1),
h AS (SELECT *, r IS NOT NULL AND (d IS NULL OR r > d) AS is_r, ok IS NULL OR ok < """ + _NOW + """ - INTERVAL 26 HOUR AS overdue FROM s)
SELECT source_id, runs, CASE WHEN is_r AND r < """ + _NOW + """ - INTERVAL 60 MINUTE THEN 'STALE' WHEN is_r THEN 'RUNNING' WHEN d IS NULL THEN 'NO_DATA' WHEN ds = 'FAILED' THEN 'FAILED' WHEN overdue THEN 'STALE' WHEN ds = 'PARTIAL' THEN 'DEGRADED' ELSE 'HEALTHY' END AS status,
  concat_ws(',', CASE WHEN is_r AND r < """ + _NOW + """ - INTERVAL 60 MINUTE THEN 'RUNNING_STALE' END, CASE WHEN f IS NOT NULL AND (ok IS NULL OR f > ok) THEN 'PIPELINE_FAILED' END, CASE WHEN NOT is_r AND overdue THEN 'SUCCESS_OVERDUE' END) AS alerts FROM h"""


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.source_health(B.runs(spark, sf_dir), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"))


@query(_HEALTH_SQL)
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MON-1, WIN-1."""
    return health(spark, sf_dir).withColumn("alerts", F.concat_ws(",", "alerts"))


@query("SELECT source_id, alert, channel, sha256(source_id || '|' || alert || '|' || channel) AS dedup_key FROM (SELECT source_id, unnest(string_split(alerts, ',')) AS alert FROM (" + _HEALTH_SQL + ") WHERE alerts <> ''), (VALUES ('log'), ('file')) c(channel)")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MON-2, FN-6."""
    return M.alert_rows(health(spark, sf_dir), ["log", "file"])


@query("WITH " + B.RUNS_SQL + """, w AS (SELECT *, row_number() OVER (PARTITION BY source_id, stage ORDER BY started_at DESC, run_id DESC) AS n FROM runs)
SELECT source_id, stage, count(*) AS samples, max(duration) FILTER (n = 1) AS latest, CAST(round_even(avg(CAST(duration AS DECIMAL(18,6))), 0) AS BIGINT) AS mean, min(duration) AS least, max(duration) AS most FROM w WHERE n <= 20 GROUP BY 1, 2""")
def stage_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22, WIN-3."""
    return M.stage_trends(B.runs(spark, sf_dir))


@query("WITH " + B.RUNS_SQL + " SELECT source_id, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'PARTIAL') AS partial, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'RUNNING') AS running, CAST(sum(CAST(duration AS DECIMAL(18,6))) AS DOUBLE) AS total_duration, arg_max(stage, (started_at, run_id)) FILTER (status = 'FAILED') AS last_failing_stage FROM runs GROUP BY 1")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MON-4, AGG-23, AGG-27."""
    return M.run_history(B.runs(spark, sf_dir))


@query("WITH a AS (SELECT user_id AS source_id, max(ts) AS last_attempt FROM events GROUP BY 1), s AS (SELECT DISTINCT user_id AS source_id, user_id % 4 AS g FROM events WHERE user_id % 9 <> 0) SELECT source_id, source_id % 5 AS priority, CAST(CASE WHEN source_id % 3 = 0 THEN 45 ELSE g * 30 + 30 END AS INTEGER) AS minutes, coalesce(last_attempt + to_minutes(CAST(CASE WHEN source_id % 3 = 0 THEN 45 ELSE g * 30 + 30 END AS INTEGER)) <= TIMESTAMP '2024-01-30 23:30:00', TRUE) AS is_due FROM s JOIN a USING (source_id)")
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MON-3, JOIN-9, FN-26, SORT-7."""
    e = B.t(spark, sf_dir, "events")
    u = F.col("user_id")
    sources = e.select(u.alias("source_id"), (u % 4).alias("group"), (u % 5).alias("priority"), F.when(u % 3 == 0, 45).alias("interval_minutes"), (u % 9 != 0).alias("enabled")).distinct()
    defaults = sources.select("group").distinct().withColumn("minutes", (F.col("group") * 30 + 30).cast("int"))
    last = e.groupBy(u.alias("source_id")).agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("last_attempt"))
    return M.due_sources(sources, defaults, last, F.expr("TIMESTAMP_NTZ '2024-01-30 23:30:00'")).select("source_id", "priority", "minutes", "is_due")


@query("SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS fresh_at FROM events WHERE event_type IN ('signup', 'purchase') AND user_id IN (SELECT c_custkey FROM customer)")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24."""
    runs = B.t(spark, sf_dir, "events").where("event_type in ('signup', 'purchase')").select(F.col("user_id").alias("source_id"), F.lit("SUCCESS").alias("status"), F.col("ts").alias("started_at"))
    return M.freshness(runs, B.t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"))).select(F.date_format("fresh_at", "yyyy-MM-dd HH:mm:ss").alias("fresh_at"))


# Scalars over tables


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^[A-Za-z]+://[^/?#]*@') THEN NULL ELSE lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) || CASE WHEN regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) LIKE '%:80' OR regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) LIKE '%:443' OR regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) NOT LIKE '%:%' THEN '' ELSE ':' || regexp_extract(url, '^[A-Za-z]+://[^/?#:]*:([0-9]+)', 1) END
  || CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) END AS url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) LIKE '%.org' AS allowed FROM pages""")
def normalized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-3, FLT-7."""
    return B.t(spark, sf_dir, "pages").select("page_id", S.normalize_url("url").alias("url"), S.host("url").endswith(".org").alias("allowed"))


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS header, trim(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_') AS post_key, 'N_ADVT_' || (1990 + c_nationkey) || '_' || upper(sha256(c_name)[1:12]) AS subject_key, sha256('=' || c_name || chr(31) || '=' || c_mktsegment) AS content_hash FROM customer")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-1, FN-8, FN-11, FN-13."""
    return B.t(spark, sf_dir, "customer").select("c_custkey", S.header_key("c_name").alias("header"), S.post_key("c_name", "c_mktsegment").alias("post_key"), S.subject_key(F.lit("N"), 1990 + F.col("c_nationkey"), "c_name").alias("subject_key"), S.canonical_hash(F.col("c_name"), F.col("c_mktsegment")).alias("content_hash"))


@query("SELECT o_orderkey, CAST(date_diff('year', DATE '1960-02-29', o_orderdate::DATE) - CASE WHEN (month(o_orderdate), day(o_orderdate)) < (2, 29) THEN 1 ELSE 0 END AS INTEGER) AS age, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_totalprice >= 200000 THEN substring(o_orderpriority, 1, 3) ELSE o_orderpriority END AS bounded FROM orders")
def date_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-19, FN-20, FN-24: a date written and read again; FLT-2."""
    o = B.t(spark, sf_dir, "orders")
    written = F.date_format("o_orderdate", "'on' dd/MM/yyyy 'at noon'")
    return o.select("o_orderkey", S.age_on(F.lit("1960-02-29").cast("date"), F.to_date("o_orderdate")).alias("age"), S.listing_date(written).alias("d"), F.when(F.col("o_totalprice") >= 200000, S.bounded("o_orderpriority", 3, "")).otherwise(F.col("o_orderpriority")).alias("bounded"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{\"k\":' || json_extract(props, '$.k') || '}' AS canon, TRUE AS is_valid FROM events")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1, FN-28, FN-29."""
    e = B.t(spark, sf_dir, "events")
    v = S.typed_value(F.lit("JSON"), "props")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"), v["value_canon"].alias("canon"), v["is_valid"].alias("is_valid"))


@query("SELECT e.doc_id, f.doc_id AS fact_id, CASE WHEN contains(trim(regexp_replace(lower(e.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(f.text[1:60]), '\\s+', ' ', 'g'))) THEN 'SUPPORTS' ELSE 'CONTEXT_ONLY' END AS assessment FROM documents e JOIN documents f ON f.doc_id = e.doc_id - e.doc_id % 3")
def evidence_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-5, the string rule of PIPE-3 between given pairs (passage_support and typed_evidence have the rest): the opening of every third document as a fact, that document and its two followers as evidence."""
    d = B.t(spark, sf_dir, "documents")
    evidence = d.select((F.col("doc_id") - F.col("doc_id") % 3).alias("fact_id"), F.col("doc_id").alias("evidence_id"), F.col("text").alias("excerpt"), F.lit(None).cast("string").alias("context"))
    facts = d.select(F.col("doc_id").alias("fact_id"), F.substring("text", 1, 60).alias("value"))
    return V.interpret_text(facts, evidence).select(F.col("evidence_id").alias("doc_id"), "fact_id", "assessment")


@query("WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents), b AS (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM benchmark) SELECT DISTINCT doc_id, item_id AS fact_id, 'SUPPORTS' AS assessment FROM d JOIN b ON contains(d.t, b.t) WHERE b.t <> ''")
def passage_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-3 for strings: whole benchmark passages as facts, all documents as evidence; a pair that isn't there is context."""
    facts = B.t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("fact_id"), F.col("text").alias("value"))
    return V.contained_facts(facts, B.t(spark, sf_dir, "documents")).withColumn("assessment", F.lit("SUPPORTS"))


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1)
SELECT o_orderkey AS fact_id, 'vacancies.total' AS path, CASE o_orderstatus WHEN 'F' THEN 'SUPPORTS' WHEN 'O' THEN CASE WHEN n > 1 THEN 'CONTEXT_ONLY' ELSE 'CONTRADICTS' END ELSE 'CONTEXT_ONLY' END AS assessment FROM orders JOIN l ON l_orderkey = o_orderkey
UNION ALL SELECT o_orderkey, 'application.end_date', CASE o_orderstatus WHEN 'F' THEN 'SUPPORTS' WHEN 'O' THEN 'CONTRADICTS' ELSE 'CONTEXT_ONLY' END FROM orders JOIN l ON l_orderkey = o_orderkey""")
def typed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-3 for numbers and dates, AGG-17: notices written out of orders and their lines; by status they agree, differ or are unlabelled."""
    li, o, status = B.t(spark, sf_dir, "lineitem"), B.t(spark, sf_dir, "orders"), F.col("o_orderstatus")
    sums = li.groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("long")).alias("q"), F.sum(F.col("l_quantity").cast("long")).alias("total"))
    j, day = o.join(sums, F.col("o_orderkey") == F.col("l_orderkey")), F.to_date("o_orderdate")
    posts = F.array_join(F.transform("q", lambda x: F.concat((x + (status == "O").cast("int")).cast("string"), F.lit(" posts of clerk"))), ", ")
    text = F.when(status == "F", F.concat(posts, F.lit(". Last date for fees and forms: "), F.date_format(day, "dd/MM/yyyy"), F.lit(". End date 01-01-1970."))).when(
        status == "O", F.concat(posts, F.lit(". Number of posts: 0"), (F.col("total") + 1).cast("string"), F.lit(". Closing date for online application is 1970-01-01; last date "), F.date_format(day, "yyyy-MM-dd")))
    rows = j.select(F.col("o_orderkey").alias("fact_id"), F.coalesce(text, F.lit("To be announced.")).alias("excerpt"), F.col("total").cast("string").alias("total"), day.cast("string").alias("day"))
    facts = lambda path, kind, v: V.interpret_evidence(rows.select("fact_id", F.lit(path).alias("path"), F.lit(kind).alias("value_type"), F.col(v).alias("value")), rows.select("fact_id", F.col("fact_id").alias("evidence_id"), "excerpt", F.lit(None).cast("string").alias("context")))
    return facts("vacancies.total", "INTEGER", "total").unionByName(facts("application.end_date", "DATE", "day")).select("fact_id", "path", "assessment")
