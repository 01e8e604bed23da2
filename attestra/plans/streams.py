"""Queries that read a table as a stream and run it to its end, each with its batch twin in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.streaming import jobs as J
from attestra.streaming import timers as T

from . import bindings as B

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return keep


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which the cluster shares; a temporary one only where that is unset."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='spark-')}/{name}_{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(B.t(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_stream(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.expr(B.RUN_STATUS_SQL).alias("status"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("source_id"))


@query("WITH " + B.OBSERVATIONS_SQL + """ SELECT observation_id, CASE WHEN row_number() OVER (PARTITION BY endpoint_id, url, content_hash ORDER BY observed_at, observation_id) > 1 THEN 'UNCHANGED'
  WHEN row_number() OVER (PARTITION BY endpoint_id, url ORDER BY observed_at, observation_id) > 1 THEN 'CHANGED' ELSE 'NEW' END AS label FROM observations""")
def labelled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1: orders arrive as observations of their customers. The state store is RocksDB while the stream runs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, J.ROCKSDB)
    try:
        o, c = read_stream(spark, sf_dir, "orders"), B.t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        seen = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_nationkey").alias("endpoint_id"), F.col("o_custkey").alias("url"), F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256).alias("content_hash"), F.col("o_orderdate").alias("observed_at"), F.col("o_orderkey").alias("observation_id")
        )
        return J.run_to_end(J.label_observations(seen), folder(spark, "labels"))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@query("WITH " + B.RUNS_SQL + " SELECT run_id FROM runs WHERE status = 'RUNNING' AND started_at + INTERVAL 120 MINUTE <= (SELECT max(started_at) FROM runs)")
def stale_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-2: runs without an end an hour after their start, as far as the watermark, an hour behind the last event, has passed."""
    return J.run_to_end(J.stale_runs(runs(spark, sf_dir)), folder(spark, "stale")).select("run_id")


@query("WITH " + B.RUNS_SQL + " SELECT DISTINCT source_id || '|PIPELINE_FAILED' AS dedup_key FROM runs WHERE status = 'FAILED'")
def alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-3: failures of a source alert once within the watermark."""
    failed = runs(spark, sf_dir).where("status = 'FAILED'").select(F.concat(F.col("source_id").cast("string"), F.lit("|PIPELINE_FAILED")).alias("dedup_key"), "at")
    return J.run_to_end(J.distinct_alerts(failed, within="400 days"), folder(spark, "alerts")).select("dedup_key")


@query("SELECT CAST(time_bucket(INTERVAL 60 SECOND, ts) AS VARCHAR) AS start, user_id, count(*) AS requests, count(*) > 2 AS limited FROM events WHERE time_bucket(INTERVAL 60 SECOND, ts) + INTERVAL 60 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE GROUP BY 1, 2")
def request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-4: windows that the watermark, five minutes behind the last event, has closed."""
    e = read_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = J.run_to_end(J.request_counts(e, limit=2, client="user_id"), folder(spark, "requests"))
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT o_custkey AS subject, o_orderstatus AS status FROM orders GROUP BY 1, 2")
def appended_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-5, SRC-6: each subject's states, added once, by micro-batch; the same stream run again adds nothing."""
    into = folder(spark, "appended")
    pick = lambda df: df.select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("status"))
    for state in ("first", "second"):
        J.append_each_batch(read_stream(spark, sf_dir, "orders"), pick, f"{into}/rows", ["subject", "status"], f"{into}/{state}").awaitTermination()
    return spark.read.parquet(f"{into}/rows").select("subject", "status")


def with_rocksdb(spark: SparkSession, run) -> DataFrame:
    """run() while the session's state store is RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, J.ROCKSDB)
    try:
        return run()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events),
w AS (SELECT user_id, min(ms) AS s FROM e GROUP BY 1 UNION ALL SELECT user_id, (SELECT min(ms) FROM e WHERE e.user_id = w.user_id AND ms >= w.s + 60000) FROM w WHERE s IS NOT NULL),
x AS (SELECT user_id, s, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS n FROM w WHERE s IS NOT NULL),
c AS (SELECT x.user_id, s, n, count(*) AS requests FROM x JOIN e ON e.user_id = x.user_id AND ms >= s AND ms < s + 60000 GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS client, s AS start_ms, requests, requests > 1 AS limited FROM c WHERE n IS NOT NULL OR s + 60000 <= (SELECT max(ms) FROM e) - 300000""")
def first_request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-4, exact: windows that start with a client's first request; the last one of a client is closed by its timer."""
    e = read_stream(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    run = lambda: J.run_to_end(T.request_windows(e, limit=1, client="user_id"), folder(spark, "windows"))
    return with_rocksdb(spark, run).select("client", F.unix_millis("start").alias("start_ms"), "requests", "limited")


@query("WITH " + B.RUNS_SQL + """, s AS (SELECT DISTINCT source_id, epoch_us(started_at) // 1000 AS ms FROM runs WHERE status = 'SUCCESS'),
g AS (SELECT source_id, ms, lead(ms) OVER (PARTITION BY source_id ORDER BY ms) AS next FROM s)
SELECT CAST(source_id AS VARCHAR) AS source, ms AS since_ms FROM g WHERE next > ms + 26 * 3600000 OR (next IS NULL AND ms + 26 * 3600000 <= (SELECT max(ms) FROM s) - 3600000)""")
def overdue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-2: successes after which a source has none for 26 hours, found by a timer where nothing follows."""
    successes = runs(spark, sf_dir).where("status = 'SUCCESS'")
    return with_rocksdb(spark, lambda: J.run_to_end(T.overdue_sources(successes), folder(spark, "overdue"))).select("source", F.unix_millis("since").alias("since_ms"))
