"""The driver tables as the model's tables: the same expressions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLASS_SQL = "CASE {k} % 3 WHEN 0 THEN 'AUTHORITATIVE_OFFICIAL' WHEN 1 THEN 'OFFICIAL_SUPPORTING' ELSE 'SECONDARY_DISCOVERY_ONLY' END"


def source_class(k: str):
    return F.expr(CLASS_SQL.format(k=k))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, field_id, critical, not_applicable, method, has_locator, ambiguous."""
    return t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("field_id"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("critical"), (F.col("o_orderkey") % 50 == 0).alias("not_applicable"),
        F.when(F.col("o_orderstatus") == "F", "NOTICE_V1").when(F.col("o_orderstatus") == "O", "OTHER").alias("method"), (F.col("o_orderkey") % 7 != 0).alias("has_locator"), (F.col("o_orderkey") % 40 == 1).alias("ambiguous"),
    )


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_id, endpoint_id, source_class, assessment."""
    direction = F.when(F.col("l_returnflag") == "R", "SUPPORTS").when(F.col("l_returnflag") == "A", "CONTRADICTS").otherwise("CONTEXT_ONLY")
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("field_id"), F.col("l_suppkey").alias("endpoint_id"), source_class("l_suppkey").alias("source_class"), direction.alias("assessment"))


FIELDS_SQL = """fields AS (
  SELECT o_custkey AS run_id, o_orderkey AS field_id, o_orderpriority IN ('1-URGENT', '2-HIGH') AS critical, o_orderkey % 50 = 0 AS not_applicable,
    CASE o_orderstatus WHEN 'F' THEN 'NOTICE_V1' WHEN 'O' THEN 'OTHER' END AS method, o_orderkey % 7 <> 0 AS has_locator, o_orderkey % 40 = 1 AS ambiguous FROM orders),
assessments AS (
  SELECT l_orderkey AS field_id, l_suppkey AS endpoint_id, """ + CLASS_SQL.format(k="l_suppkey") + """ AS source_class,
    CASE l_returnflag WHEN 'R' THEN 'SUPPORTS' WHEN 'A' THEN 'CONTRADICTS' ELSE 'CONTEXT_ONLY' END AS assessment FROM lineitem)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """endpoint_id, url, content_hash, observed_at, observation_id."""
    o, c = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").alias("endpoint_id"), F.col("o_custkey").alias("url"), F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256).alias("content_hash"), F.col("o_orderdate").alias("observed_at"), F.col("o_orderkey").alias("observation_id"))


OBSERVATIONS_SQL = "observations AS (SELECT c_nationkey AS endpoint_id, o_custkey AS url, sha256(o_orderstatus || o_orderpriority) AS content_hash, o_orderdate AS observed_at, o_orderkey AS observation_id FROM orders JOIN customer ON o_custkey = c_custkey)"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, seq_ts, seq_id, projection: what a subject was published as, over time."""
    return t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("seq_ts"), F.col("o_orderkey").alias("seq_id"), F.sha2(F.concat_ws("|", "o_orderstatus", "o_orderpriority"), 256).alias("projection"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


VERSIONS_SQL = "versions AS (SELECT o_custkey AS subject, o_orderdate AS seq_ts, o_orderkey AS seq_id, sha256(o_orderstatus || '|' || o_orderpriority) AS projection, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"

RUN_STATUS_SQL = "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PARTIAL' ELSE CASE WHEN event_type = 'click' AND ts > TIMESTAMP '2024-01-30 12:00:00' THEN 'RUNNING' ELSE 'SUCCESS' END END"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, source_id, status, started_at, stage, duration."""
    return t(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("source_id"), F.expr(RUN_STATUS_SQL).alias("status"), F.col("ts").cast("timestamp_ntz").alias("started_at"), (F.col("event_id") % 3).alias("stage"), F.col("value").alias("duration"))


RUNS_SQL = f"runs AS (SELECT event_id AS run_id, user_id AS source_id, {RUN_STATUS_SQL} AS status, ts AS started_at, event_id % 3 AS stage, value AS duration FROM events)"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, authority, segment, name, start_date, end_date, vacancies."""
    o, c = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer")
    lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("vacancies"))
    start = F.to_date("o_orderdate")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").select(F.col("o_orderkey").alias("job_id"), F.col("c_nationkey").alias("authority"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), start.alias("start_date"), F.date_add(start, (F.col("o_orderkey") % 60).cast("int")).alias("end_date"), "vacancies")


POSTINGS_SQL = "postings AS (SELECT o_orderkey AS job_id, c_nationkey AS authority, c_mktsegment AS segment, c_name AS name, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS end_date, n AS vacancies FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"
AS_OF = "2000-06-01"
