"""Queries of integrity before publication: orders are runs, revisions and cases, their lines fields and items, some of them damaged by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import integrity as I
from attestra.operators import monitoring as M

from . import bindings as B

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


#: The same expressions in Spark and in SQL.
_RUN = """o_orderkey AS run_id, o_orderkey AS revision_id, o_orderkey + CASE WHEN o_orderkey % 61 = 0 THEN 1 ELSE 0 END AS confidence_revision_id,
  CASE WHEN o_orderstatus = 'P' THEN 'RUNNING' ELSE 'COMPLETED' END AS status, CASE WHEN o_orderkey % 67 <> 0 THEN o_orderpriority END AS hash_snapshot"""
_REVISION = "o_orderkey AS revision_id, o_orderpriority AS revision_hash, CASE WHEN o_orderkey % 71 = 0 THEN 'x' ELSE o_orderpriority END AS expected_hash"
#: A line of an order's number; numbers repeat in the table.
_LINES = "SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber"
_MARK = "(l_orderkey * 7 + l_linenumber)"
_FIELD = "l_orderkey AS revision_id, l_linenumber AS field_id, l_linestatus AS path, l_returnflag AS type, CASE WHEN l_linenumber <> 3 THEN l_suppkey END AS value"
_MADE = f"""l_orderkey AS run_id, l_linenumber AS field_id, CASE WHEN {_MARK} % 103 = 0 THEN 'OPEN' ELSE 'FINALIZED' END AS status, l_linestatus AS path, l_returnflag AS type,
  CASE WHEN {_MARK} % 97 = 0 THEN -1 WHEN l_linenumber <> 3 THEN l_suppkey END AS value"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LINES.replace("FROM lineitem", "FROM {li}"), li=B.t(spark, sf_dir, "lineitem"))


@query(f"""WITH li AS ({_LINES}), f AS (SELECT {_FIELD} FROM li), lost AS (SELECT {_MADE} FROM li WHERE {_MARK} % 101 <> 0),
v AS (SELECT * FROM lost UNION ALL SELECT * FROM (SELECT {_MADE} FROM li WHERE {_MARK} % 107 = 0)),
n AS (SELECT revision_id, count(*) AS fields FROM f GROUP BY 1), r AS (SELECT {_RUN}, fields + CASE WHEN o_orderkey % 59 = 0 THEN 1 ELSE 0 END AS fields_total, fields FROM orders JOIN n ON revision_id = o_orderkey),
w AS (SELECT run_id, count(*) AS made, count(*) FILTER (status <> 'FINALIZED') AS open_, count(*) FILTER ((v.path, v.type) <> (f.path, f.type) OR v.value IS DISTINCT FROM f.value) AS changed, count(DISTINCT v.field_id) AS keys FROM v JOIN f ON v.run_id = f.revision_id AND v.field_id = f.field_id GROUP BY 1),
s AS (SELECT l_orderkey AS run_id, count(*) AS scored FROM li WHERE {_MARK} % 109 <> 0 GROUP BY 1), q AS (SELECT {_REVISION} FROM orders WHERE o_orderkey % 73 <> 0),
j AS (SELECT r.*, q.revision_id IS NULL AS missing, q.revision_hash, q.expected_hash, coalesce(made, 0) AS made, coalesce(open_, 0) AS open_, coalesce(changed, 0) AS changed, coalesce(keys, 0) AS keys, coalesce(scored, 0) AS scored FROM r LEFT JOIN q ON r.revision_id = q.revision_id LEFT JOIN w ON r.run_id = w.run_id LEFT JOIN s ON r.run_id = s.run_id)
SELECT run_id, 'REVISION_MISSING' AS violation FROM j WHERE missing UNION ALL SELECT run_id, 'REVISION_MISMATCH' FROM j WHERE confidence_revision_id <> revision_id UNION ALL SELECT run_id, 'RUN_STATUS' FROM j WHERE status <> 'COMPLETED'
UNION ALL SELECT run_id, 'REVISION_HASH' FROM j WHERE NOT missing AND revision_hash <> expected_hash UNION ALL SELECT run_id, 'RUN_HASH' FROM j WHERE NOT missing AND hash_snapshot IS DISTINCT FROM revision_hash
UNION ALL SELECT run_id, 'COVERAGE' FROM j WHERE fields_total <> fields OR made <> fields OR keys <> fields OR open_ > 0 OR scored <> fields UNION ALL SELECT run_id, 'SNAPSHOT' FROM j WHERE changed > 0""")
def verification_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-15, JOIN-15, FLT-18: verifications that were lost, repeated, left open or made of another value."""
    o, li = B.t(spark, sf_dir, "orders"), lines(spark, sf_dir)
    fields = spark.sql(f"SELECT {_FIELD} FROM {{li}}", li=li)
    lost = spark.sql(f"SELECT {_MADE} FROM {{li}} WHERE {_MARK} % 101 <> 0", li=li)
    again = spark.sql(f"SELECT {_MADE} FROM {{li}} WHERE {_MARK} % 107 = 0", li=li)
    counts = fields.groupBy("revision_id").agg(F.count(F.lit(1)).alias("fields"))
    runs = spark.sql(f"SELECT {_RUN} FROM {{o}}", o=o).join(counts, "revision_id").withColumn("fields_total", F.col("fields") + (F.col("run_id") % 59 == 0).cast("int")).drop("fields")
    revisions = spark.sql(f"SELECT {_REVISION} FROM {{o}} WHERE o_orderkey % 73 <> 0", o=o)
    scored = li.where(f"{_MARK} % 109 <> 0").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("field_id"))
    return I.verification_violations(runs, revisions, fields, lost.unionByName(again), scored)


_DECISION = "CASE l_linestatus WHEN 'O' THEN CASE l_linenumber % 7 WHEN 6 THEN 'CORRECT_AND_APPROVE' ELSE 'APPROVE' END ELSE CASE l_linenumber WHEN 5 THEN 'REJECT' WHEN 6 THEN 'REQUEST_REVERIFICATION' ELSE 'APPROVE' END END"
_CASE = """o_orderkey AS case_id, o_orderkey AS confidence_id, CASE WHEN o_orderstatus = 'O' THEN 'IN_REVIEW' ELSE 'RESOLVED' END AS status, CASE WHEN o_orderstatus <> 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'APPROVED' ELSE 'REJECTED' END END AS outcome,
  o_orderkey AS revision_id, o_orderkey AS run_id, 'V2' AS policy, CASE WHEN o_orderkey % 43 = 0 THEN 'x' ELSE o_orderpriority END AS priority, o_custkey AS score, o_orderpriority AS reasons"""
_CONFIDENCE = "o_orderkey AS confidence_id, o_orderkey AS revision_id, o_orderkey AS run_id, 'V2' AS policy, o_orderpriority AS priority, o_custkey AS score, o_orderpriority AS reasons"
_PART = "l_linenumber AS field_id, 'V2' AS policy, l_linestatus AS priority, l_quantity AS score, l_returnflag AS reasons, l_linestatus AS path, 'INTEGER' AS type"
_ITEM = f"""l_orderkey AS case_id, 'FIELD' AS scope, l_orderkey * 10 + l_linenumber AS field_confidence_id, {_PART}, CASE WHEN {_MARK} % 79 = 0 THEN -1 ELSE l_suppkey END AS value,
  CASE WHEN {_MARK} % 83 <> 0 THEN {_DECISION} END AS decision, 'INTEGER' AS original_type, CASE WHEN {_MARK} % 89 = 0 THEN NULL WHEN {_MARK} % 79 = 0 THEN -1 ELSE l_suppkey END AS original_value"""
_OWN = f"l_orderkey * 10 + l_linenumber AS field_confidence_id, {_PART}, l_suppkey AS value"
_WHOLE = "o_orderkey AS case_id, 'REVISION' AS scope, NULL AS field_confidence_id, NULL AS field_id, 'V2' AS policy, o_orderpriority AS priority, CASE WHEN o_orderkey % 47 = 0 THEN -1 ELSE o_custkey END AS score, NULL AS reasons, NULL AS path, NULL AS type, NULL AS value, 'APPROVE' AS decision, NULL AS original_type, NULL AS original_value"


@query(f"""WITH li AS ({_LINES}), c AS (SELECT {_CASE} FROM orders), i AS (SELECT {_ITEM} FROM li),
d AS (SELECT case_id, bool_or(decision = 'REQUEST_REVERIFICATION') AS again, bool_or(decision = 'REJECT') AS rejected, bool_or(decision = 'CORRECT_AND_APPROVE') AS corrected, bool_or(decision IS NULL) AS undecided FROM i GROUP BY 1),
e AS (SELECT c.*, coalesce(undecided, FALSE) AS undecided, CASE WHEN again THEN 'REVERIFICATION_REQUESTED' WHEN rejected THEN 'REJECTED' WHEN corrected THEN 'APPROVED_WITH_CORRECTIONS' ELSE 'APPROVED' END AS expected FROM c LEFT JOIN d ON c.case_id = d.case_id)
SELECT case_id, 'CASE_SNAPSHOT' AS violation FROM c JOIN orders ON o_orderkey = case_id WHERE priority <> o_orderpriority UNION ALL SELECT case_id, 'OUTCOME' FROM e WHERE status = 'RESOLVED' AND outcome <> expected UNION ALL SELECT case_id, 'UNDECIDED' FROM e WHERE status = 'RESOLVED' AND undecided
UNION ALL SELECT DISTINCT case_id, 'ITEM_CONFIDENCE' FROM i WHERE {_MARK.replace("l_orderkey", "case_id").replace("l_linenumber", "field_id")} % 113 = 0
UNION ALL SELECT DISTINCT case_id, 'ITEM_SNAPSHOT' FROM (SELECT case_id FROM i WHERE value = -1 AND {_MARK.replace("l_orderkey", "case_id").replace("l_linenumber", "field_id")} % 113 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 47 = 0 AND o_orderkey % 3 = 0)
UNION ALL SELECT DISTINCT case_id, 'DECISION_SNAPSHOT' FROM i WHERE decision IS NOT NULL AND original_value IS DISTINCT FROM value""")
def review_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIPE-15: cases and items that repeat another value than their confidence's, and outcomes that the decisions don't add up to."""
    o, li = B.t(spark, sf_dir, "orders"), lines(spark, sf_dir)
    items = spark.sql(f"SELECT {_ITEM} FROM {{li}} UNION ALL SELECT {_WHOLE} FROM {{o}} WHERE o_orderkey % 3 = 0", li=li, o=o)
    own = spark.sql(f"SELECT {_OWN} FROM {{li}} WHERE {_MARK} % 113 <> 0", li=li)
    return I.review_violations(spark.sql(f"SELECT {_CASE} FROM {{o}}", o=o), spark.sql(f"SELECT {_CONFIDENCE} FROM {{o}}", o=o), items, own)


_SPLIT = "o_orderkey AS revision_id, CASE o_orderstatus WHEN 'F' THEN 'EXPLICIT' WHEN 'O' THEN 'LEGACY_UNSPLIT' END AS split_status"
_POSTS = "SELECT l_orderkey AS revision_id, l_suppkey % 50 AS post_key, l_linenumber AS ordinal FROM lineitem WHERE l_returnflag = 'R'"
_FACTS = "SELECT l_orderkey AS revision_id, l_suppkey % 50 AS post_key, 'total' AS path FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 2"
_FIELDS = "SELECT l_orderkey AS revision_id, CASE WHEN l_linenumber = 4 THEN 'posts.' || CAST(l_suppkey % 50 AS VARCHAR(9)) || '.total' ELSE 'field' || CAST(l_suppkey AS VARCHAR(9)) END AS path FROM lineitem WHERE l_orderkey % 4 <> 0 AND l_returnflag <> 'A'"


@query(f"""WITH r AS (SELECT {_SPLIT} FROM orders), p AS ({_POSTS}), f AS ({_FIELDS}), a AS ({_FACTS}), paths AS (SELECT revision_id, path FROM f UNION ALL SELECT revision_id, 'posts.' || post_key || '.' || path FROM a)
SELECT revision_id, 'EMPTY' AS violation FROM r WHERE revision_id NOT IN (SELECT revision_id FROM p) AND revision_id NOT IN (SELECT revision_id FROM f)
UNION ALL SELECT revision_id, 'NO_POSTS' FROM r WHERE split_status = 'EXPLICIT' AND revision_id NOT IN (SELECT revision_id FROM p) UNION ALL SELECT revision_id, 'NOT_EXPLICIT' FROM r WHERE split_status IS DISTINCT FROM 'EXPLICIT' AND revision_id IN (SELECT revision_id FROM p)
UNION ALL SELECT DISTINCT revision_id, 'POST_KEY' FROM (SELECT revision_id FROM p GROUP BY revision_id, post_key HAVING count(*) > 1) UNION ALL SELECT DISTINCT revision_id, 'ORDINAL' FROM (SELECT revision_id FROM p GROUP BY revision_id, ordinal HAVING count(*) > 1)
UNION ALL SELECT DISTINCT revision_id, 'PATH' FROM (SELECT revision_id FROM paths GROUP BY revision_id, path HAVING count(*) > 1)""")
def revision_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17: orders are revisions; their returned lines posts, the others fields, some with a post's path."""
    o, li = B.t(spark, sf_dir, "orders"), B.t(spark, sf_dir, "lineitem")
    of = lambda sql: spark.sql(sql.replace("FROM lineitem", "FROM {li}"), li=li)
    return I.revision_violations(spark.sql(f"SELECT {_SPLIT} FROM {{o}}", o=o), of(_FIELDS), of(_POSTS), of(_FACTS))


_CHECKED = "l_suppkey AS batch_id, l_linenumber AS fields_confirmed, l_orderkey % 3 AS fields_conflicted, l_orderkey % 5 AS fields_insufficient, l_orderkey % 7 AS fields_not_applicable, l_returnflag = 'R' AS review_required, l_orderkey % 11 = 0 AS failed"


@query(f"""WITH r AS (SELECT {_CHECKED} FROM lineitem) SELECT batch_id, count(*) FILTER (NOT failed) AS completed, count(*) FILTER (failed) AS failed, """
       + ", ".join(f"CAST(coalesce(sum({c}) FILTER (NOT failed), 0) AS BIGINT) AS {c}" for c in ("fields_confirmed", "fields_conflicted", "fields_insufficient", "fields_not_applicable"))
       + ", count(*) FILTER (NOT failed AND review_required) AS review_cases_queued, count(*) FILTER (NOT failed AND NOT review_required) AS no_review_required FROM r GROUP BY 1")
def verification_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-27, verification."""
    return M.verification_summary(spark.sql(f"SELECT {_CHECKED} FROM {{li}}", li=B.t(spark, sf_dir, "lineitem")))


_KINDS = ("DIRECT", "HUMAN_APPROVED", "HUMAN_CORRECTED", "REVIEW_MISSING", "REVIEW_PENDING", "REVIEW_CANCELLED", "REJECTED", "REVERIFICATION_REQUESTED")
_TRIED = "o_custkey AS batch_id, CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END AS kind, o_orderpriority = '1-URGENT' AS failed, o_orderstatus <> 'O' AS master_exists, o_orderstatus = 'P' AS revision_exists"


@query(f"""WITH r AS (SELECT {_TRIED} FROM orders), l AS (SELECT *, kind IN ('DIRECT', 'HUMAN_APPROVED', 'HUMAN_CORRECTED') AS live FROM r) SELECT batch_id, count(*) AS selected, """
       + ", ".join(f"count(*) FILTER (kind = '{k}') AS {c}" for k, c in zip(_KINDS, ("direct_verified", "human_approved", "human_corrected", *[k.lower() for k in _KINDS[3:]])))
       + """, count(*) FILTER (NOT live) AS skipped, count(*) FILTER (live AND failed) AS failed, count(*) FILTER (live AND NOT failed AND revision_exists) AS master_unchanged,
count(*) FILTER (live AND NOT failed AND NOT revision_exists AND master_exists) AS master_updated, count(*) FILTER (live AND NOT failed AND NOT revision_exists AND NOT master_exists) AS master_created FROM l GROUP BY 1""")  # fmt: skip
def publication_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-27, publication."""
    return M.publication_summary(spark.sql(f"SELECT {_TRIED} FROM {{o}}", o=B.t(spark, sf_dir, "orders")))
